"""Cutting texts into segments.

The foldable segmentations are SQL aggregates over arrays of sentences or lines; the two
that look both ways over a document run on slices of Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.text import strip
from weftline.operators.documents import found_rows


def segments(text: Column, max_chars: int = 1000) -> Column:
    """Sentences (cut after ``. ``, line feeds as spaces) packed until a segment is longer than ``max_chars``; the last one is stripped.

    Done segments and the open one are one array, the open one last, so the fold appends only when a segment closes.
    """
    flat = F.replace(F.replace(text, F.lit("\n"), F.lit(" ")), F.lit(". "), F.lit(". \x00"))
    sentences = F.filter(F.split(flat, "\x00"), lambda s: strip(s) != "")
    state = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(acc: Column, s: Column) -> Column:
        grown = F.concat(acc["open"], strip(s), F.lit(" "))
        full = F.length(grown) > max_chars
        return F.struct(F.when(full, F.array_append(acc["done"], grown)).otherwise(acc["done"]).alias("done"), F.when(full, "").otherwise(grown).alias("open"))

    def finish(acc: Column) -> Column:
        return F.when(strip(acc["open"]) != "", F.array_append(acc["done"], strip(acc["open"]))).otherwise(acc["done"])

    return F.aggregate(sentences, state, step, finish)


def ends(chunks: Column, begin: int | None = None, end: int | None = None) -> Column:
    """The first ``begin`` and the last ``end`` chunks; all of them where the two would overlap."""
    n = F.size(chunks)
    head = F.slice(chunks, 1, begin) if begin else None
    tail = F.slice(chunks, F.greatest(F.lit(1), n - end + 1), end) if end else None
    if begin and end:
        return F.when(n <= begin + end, chunks).otherwise(F.concat(head, tail))
    return head if begin else tail if end else chunks


def segment_rows(df: DataFrame, field: str, max_chars: int = 1000, name: str = "paragraphs", index: str = "index", max_chunks: int = 1000, remove: bool = False) -> DataFrame:
    """One row per segment with its 0-based index, at most ``max_chunks`` of each text."""
    out = df.select("*", F.posexplode(F.slice(segments(F.col(field), max_chars), 1, max_chunks)).alias(index, name))
    return out.drop(field) if remove else out


def lines(text: Column, max_chars: int = 1000) -> Column:
    """Non-empty lines, each cut to ``max_chars``."""
    return F.transform(F.filter(F.split(text, "\n"), lambda x: x != ""), lambda x: F.left(x, F.lit(max_chars)))


def located_lines(df: DataFrame, key: Sequence[str], field: str, max_chars: int = 1000) -> DataFrame:
    """Lines with their character ranges and their section: the last heading line that starts before the line's middle, else ``other``.

    Offsets are running sums and the section an as-of lookup, both windows within a document.
    """
    w = Window.partitionBy(*key).orderBy("pos")
    raw = df.select(*key, F.posexplode(F.split(F.col(field), "\n")).alias("pos", "raw"))
    at = raw.withColumn("start", F.coalesce(F.sum(F.length("raw") + 1).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    cut = at.where("raw <> ''").withColumn("text", F.left("raw", F.lit(max_chars))).withColumn("stop", F.col("start") + F.length("text"))
    heading = F.when(F.col("text").startswith("#"), F.col("text"))
    # a heading's own middle lies after its start unless it is empty, so it is its own section
    return cut.withColumn("section", F.coalesce(F.last(heading, ignorenulls=True).over(w), F.lit("other"))).drop("raw")


def packed(text: Column, max_chars: int = 10_000) -> Column:
    """Cut after ``.\\n``, glue parts that go on in lower case, pack up to ``max_chars``, merge a last one of at most 30 %."""
    parts = F.split(F.regexp_replace(text, r" +\n", "\n"), r"\.\n")
    n = F.size(parts)
    dotted = F.transform(parts, lambda p, i: F.when(i < n - 1, F.concat(p, F.lit("."))).otherwise(p))
    empty = F.array().cast("array<string>")
    last = lambda acc: F.element_at(acc, -1)
    put = lambda acc, s: F.array_append(F.slice(acc, 1, F.size(acc) - 1), F.concat(last(acc), F.lit("\n"), s))

    def glue(acc: Column, p: Column) -> Column:
        t = strip(p)
        return F.when(F.size(acc) == 0, F.array(p)).when(t.rlike(r"(?U)^\p{Lower}"), put(acc, t)).otherwise(F.array_append(acc, t))

    def pack(acc: Column, p: Column) -> Column:
        return F.when(F.size(acc) == 0, F.array(p)).when(F.length(last(acc)) + F.length(p) > max_chars, F.array_append(acc, p)).otherwise(put(acc, p))

    def tail(acc: Column) -> Column:
        before = F.element_at(acc, -2)
        joined = F.array_append(F.slice(acc, 1, F.size(acc) - 2), F.concat(before, F.lit("\n"), last(acc)))
        return F.when(F.size(acc) < 2, acc).when(F.length(last(acc)) * 10 <= F.length(before) * 3, joined).otherwise(acc)

    return F.aggregate(F.aggregate(dotted, empty, glue), empty, pack, tail)


ABBREVIATIONS = ("Mr", "St", "Mrs", "Ms", "Dr", "Prof", "Capt", "Cpt", "Lt", "Mt", "Inc", "Ltd", "Jr", "Sr", "Co", "Ph", "Ph.D")
SENTENCE_END = re.compile(r"([.?!]+[\"”]?)\s+")


def sentences(text: str) -> list[str]:
    """Sentences end at ``. ? !`` before white space, but not after an abbreviation or a single letter."""
    text, out, start = text.replace("\n", " "), [], 0
    for m in SENTENCE_END.finditer(text):
        word = text[start : m.start()].rsplit(" ", 1)[-1]
        if m[1] == "." and (word in ABBREVIATIONS or (len(word) == 1 and word.isalpha())):
            continue
        out.append(text[start : m.end()].strip())
        start = m.end()
    rest = text[start:].strip()
    return [*out, rest] if rest else out


def uniform(text: str, n: int) -> list[str]:
    """Pieces of about ``n`` characters: cut before headings, then, where too long, at blank lines, lines, sentences and characters;
    packed forward within a section and then backward over the text."""

    def finer(pieces: list[str], cut) -> list[str]:
        return [y for x in pieces for y in ([x] if len(x) <= n else cut(x))]

    def pack(pieces: list[str]) -> list[list[str]]:
        out: list[list[str]] = [[]]
        for p in pieces:
            if sum(map(len, out[-1])) >= n:
                out.append([])
            out[-1].append(p)
        return out

    done = []
    for section in re.split(r"(?=\n#{1,4} )", text):
        pieces = [section]
        for cut in (lambda x: re.split(r"(?=\n\n)", x), lambda x: re.split(r"(?=\n)", x), sentences, lambda x: [x[k : k + n] for k in range(0, len(x), n)]):
            pieces = finer(pieces, cut)
        done += [" ".join(p).replace("  ", " ") for p in pack(pieces)]
    return [" ".join(p[::-1]).replace("  ", " ").replace("\n ", "\n") for p in pack(done[::-1])[::-1]]


def uniform_rows(df: DataFrame, key: str, field: str, n: int) -> DataFrame:
    """``key, text, chunk_id``: uniform segments, numbered from 1."""
    return found_rows(df, key, field, lambda t: [(x, i) for i, x in enumerate(uniform(t, n), 1)], "text string, chunk_id long")


LEVELS = ("# ", "## ", "### ", "#### ")


def headed(text: str, max_chars: int) -> list[dict[str, str]]:
    """Sections with their headings; figures and tables are no headings; long ones cut at blank lines, a tail of at most 40 % merged."""
    trail, out = dict.fromkeys(LEVELS, ""), []
    out.append({**trail, "content": ""})
    for line in text.split("\n"):
        level = next((k for k in LEVELS if line.startswith(k)), None)
        if level is None or "Figure" in line or "Table" in line:
            out[-1]["content"] += "\n" + line
            continue
        fresh = trail[level] != "" or level != LEVELS[-1]
        for k in LEVELS[LEVELS.index(level) + 1 :]:
            trail[k] = ""
        trail[level] = line
        if fresh:
            out.append({**trail, "content": ""})
        else:
            out[-1]["content"] += "\n"
    done = []
    for s in out:
        pieces = s["content"].split("\n\n")
        if len(s["content"]) <= max_chars or len(pieces) < 2:
            done.append(s)
            continue
        packs = [pieces[0]]
        for p in pieces[1:]:
            if len(packs[-1]) > max_chars:
                packs.append(p)
            else:
                packs[-1] += "\n\n" + p
        if len(packs) > 1 and len(packs[-1]) <= 0.4 * len(packs[-2]):
            packs[-2:] = [packs[-2] + "\n\n" + packs[-1]]
        done += [{**s, "content": p} for p in packs]
    return done


def headed_rows(df: DataFrame, key: str, field: str, max_chars: int = 750) -> DataFrame:
    """``key, h1 .. h4, content, local_index``: sections under their headings."""
    schema = "h1 string, h2 string, h3 string, h4 string, content string, local_index long"
    return found_rows(df, key, field, lambda t: [(*s.values(), i) for i, s in enumerate(headed(t, max_chars))], schema)


PAGE_MARK = re.compile(r"^(?://\s*Page \d+|<!--\s*PAGE.*-->)\s*$", re.IGNORECASE)


def without_layout(text: str) -> tuple[str, list[tuple[str, str]]]:
    """The text without page marks, table ranges and images, and the images with their captions."""
    kept, images, in_table = [], [], False
    blocks = [p for p in text.split("\n") if p.strip() and not PAGE_MARK.match(p)]
    i = 0
    while i < len(blocks):
        p = blocks[i]
        if p.startswith("<!--TABLE"):
            in_table = True
        elif p.startswith("<!--END"):
            in_table = False
        elif not in_table and p.startswith("![Image"):
            after = blocks[i + 1] if i + 1 < len(blocks) else ""
            caption = after if re.search(r"fig(?:ure)?", after[:10], re.IGNORECASE) else ""
            images.append((p, caption))
            i += bool(caption)
        elif not in_table:
            kept.append(p)
        i += 1
    return "\n".join(kept), images


def outline_rows(text: str) -> list[dict[str, object]]:
    """Rows of a ``## / ### / Abstract: / Details:`` outline, numbered."""
    out, section, number, sub = [], "", 0, 0
    for line in text.split("\n"):
        if line.startswith("### "):
            sub += 1
            out.append({"section": section, "section_index": number, "title": line[4:].strip(), "index": sub, "abstract": "", "details": []})
        elif line.startswith("## "):
            section, number, sub = line[3:].strip(), number + 1, 0
        elif out and line.startswith("Abstract:"):
            out[-1]["abstract"] = line[9:].strip()
        elif out and line.strip().startswith("- "):
            out[-1]["details"].append(line.strip()[2:])
    return out
