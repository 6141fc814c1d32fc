"""HTML and outline documents: images, titles, dates, heading trees, placeholders, plans."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from weftline.functions.text import simplify

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


def remove_images(c: Column) -> Column:
    return F.regexp_replace(c, r"(?i)<img[^>]*/?>", "")


def title(c: Column) -> Column:
    return F.regexp_extract(c, r"(?is)<title[^>]*>(.*?)</title>", 1)


def links(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r'(?i)<a\s[^>]*href="([^"]*)"'), F.lit(1)))


def links_with(c: Column, part: str) -> Column:
    return F.filter(links(c), lambda u: F.contains(F.lower(u), F.lit(part)))


def plain_text(c: Column) -> Column:
    """Text outside scripts, styles, comments and tags, white space runs as one space."""
    bare = F.regexp_replace(c, r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?s)<[^>]*>", " "), r"(?U)\s+", " "))


def main_text(c: Column, least: int = 100) -> Column:
    """The article's or main element's text if it is longer than ``least`` characters, else the body's."""
    part = F.regexp_extract(c, r"(?is)<(article|main)\b[^>]*>(.*?)</\1>", 2)
    body = F.regexp_extract(c, r"(?is)<body[^>]*>(.*)</body>", 1)
    found = plain_text(part)
    return F.when(F.length(found) > least, found).otherwise(plain_text(F.when(body != "", body).otherwise(c)))


#: Meta names and attributes that carry a page's date, in order of trust.
DATE_META = ("article:published_time", "datePublished", "date", "pubdate", "publish-date", "og:updated_time")


def page_date(c: Column) -> Column:
    """The first readable date of the listed meta elements, then of ``time`` elements, as ``yyyy-MM-dd``."""
    tries = [F.regexp_extract(c, rf'(?i)<meta\s[^>]*(?:name|property|itemprop)="{re.escape(m)}"[^>]*content="(\d{{4}}-\d{{2}}-\d{{2}})', 1) for m in DATE_META]
    tries.append(F.regexp_extract(c, r'(?i)<time\s[^>]*datetime="(\d{4}-\d{2}-\d{2})', 1))
    return F.coalesce(*(F.when(t != "", t) for t in tries))


class Node:
    __slots__ = ("attrs", "children", "tag", "up")

    def __init__(self, tag: str, attrs: Sequence[tuple[str, str | None]] = (), up: Node | None = None) -> None:
        self.tag, self.attrs, self.up, self.children = tag, list(attrs), up, []

    def text(self) -> str:
        return "".join(c if isinstance(c, str) else c.text() for c in self.children)

    def html(self) -> str:
        inner = "".join(c if isinstance(c, str) else c.html() for c in self.children)
        if not self.tag:
            return inner
        attrs = "".join(f" {k}" if v is None else f' {k}="{v}"' for k, v in self.attrs)
        return f"<{self.tag}{attrs}>" if self.tag in VOID else f"<{self.tag}{attrs}>{inner}</{self.tag}>"

    def walk(self) -> Iterator[Node]:
        for c in self.children:
            if isinstance(c, Node):
                yield c
                yield from c.walk()


class TreeBuilder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=False)
        self.root = self.at = Node("")

    def handle_starttag(self, tag: str, attrs: list) -> None:
        n = Node(tag, attrs, self.at)
        self.at.children.append(n)
        if tag not in VOID:
            self.at = n

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.at.children.append(Node(tag, attrs, self.at))

    def handle_endtag(self, tag: str) -> None:
        n = self.at
        while n.tag and n.tag != tag:
            n = n.up
        if n.tag:
            self.at = n.up

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)

    def handle_entityref(self, name: str) -> None:
        self.at.children.append(f"&{name};")

    def handle_charref(self, name: str) -> None:
        self.at.children.append(f"&#{name};")


def parse(text: str) -> Node:
    b = TreeBuilder()
    b.feed(text)
    b.close()
    return b.root


HELD = ("p", "img", "table", "ul", "ol")


def contract(text: str) -> tuple[str, dict[str, str]]:
    """Outermost paragraphs, images, tables and lists as numbered placeholders with a preview; and what they stand for."""
    root, kept = parse(text), {}

    def visit(n: Node) -> None:
        for i, c in enumerate(n.children):
            if isinstance(c, str):
                continue
            if c.tag in HELD:
                key = f"ph-{len(kept) + 1}"
                kept[key] = c.html()
                hold = Node("div", [("id", key), ("data-kind", c.tag)], n)
                hold.children.append(re.sub(r"\s+", " ", c.text()).strip()[:100])
                n.children[i] = hold
            else:
                visit(c)

    visit(root)
    return root.html(), kept


def expand(text: str, kept: dict[str, str]) -> str:
    """The inverse of ``contract``; unknown placeholders stay."""
    root = parse(text)

    def visit(n: Node) -> None:
        for i, c in enumerate(n.children):
            if isinstance(c, Node):
                key = dict(c.attrs).get("id")
                if key in kept:
                    n.children[i] = kept[key]
                else:
                    visit(c)

    visit(root)
    return root.html()


def heading_rows(text: str) -> list[tuple[int, int | None, int, str, str]]:
    """``node, parent, level, title, text`` of a page's heading tree; a heading's parent is the last one of a higher level."""
    out: list[list] = [[0, None, 0, "", ""]]
    trail = [0]
    for n in parse(text).walk():
        if re.fullmatch(r"h[1-6]", n.tag):
            level = int(n.tag[1])
            while out[trail[-1]][2] >= level:
                trail.pop()
            out.append([len(out), trail[-1], level, n.text().strip(), ""])
            trail.append(len(out) - 1)
        elif n.tag in HELD and (n.up is None or n.up.tag not in HELD):
            out[-1][4] += n.text().strip() + "\n"
    return [tuple(r) for r in out]


def merge_small(rows: Sequence[tuple], least: int) -> list[tuple[int, int | None, int, str, str]]:
    """Sections whose subtree has fewer than ``least`` characters become one, headings as lines."""
    kids: dict[int | None, list] = {}
    for r in rows:
        kids.setdefault(r[1], []).append(r)

    def size(r: tuple) -> int:
        return len(r[4]) + sum(size(k) for k in kids.get(r[0], ()))

    def flat(r: tuple) -> str:
        return r[4] + "".join(f"{'#' * k[2]} {k[3]}\n{flat(k)}" for k in kids.get(r[0], ()))

    def walk(r: tuple) -> Iterator[tuple]:
        if size(r) < least:
            yield (*r[:4], flat(r))
        else:
            yield r
            for k in kids.get(r[0], ()):
                yield from walk(k)

    return [x for r in kids.get(None, ()) for x in walk(r)]


#: Rows read at once, and characters of found texts handed on at once (more only for a single input).
READ, HAND_ON = 64, 1 << 20


def found_rows(df: DataFrame, key: str, field: str, f: Callable[[str], Iterable[tuple]], schema: str | T.StructType) -> DataFrame:
    """``key`` and the rows that ``f`` finds in each text, null texts skipped. A worker holds some rows of input and output, however large Spark's batches are; a text that
    repeats within such a slice is looked at once."""
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    schema = T.StructType([df.schema[key], *schema.fields])
    kinds = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, size = [], 0
            for lo in range(0, b.num_rows, READ):
                part, known = b.slice(lo, READ), {}
                for k, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    if t is None:
                        continue
                    if t not in known:
                        known[t] = list(f(t))
                    for r in known[t]:
                        rows.append((k, *r))
                        size += sum(len(x) if isinstance(x, str) else 8 for x in r)
                        if size > HAND_ON:
                            yield handed(rows)
                            rows, size = [], 0
            if rows:
                yield handed(rows)

    def handed(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, type=t.type) for c, t in zip(columns, kinds, strict=True)], schema=kinds)

    return df.select(key, field).mapInArrow(run, schema)


def parsed_rows(df: DataFrame, key: str, field: str, f, schema: str) -> DataFrame:
    """Rows that a text function finds in each document; ``schema`` is without the key."""
    return found_rows(df, key, field, f, schema)


def article_cells(text: str) -> list[tuple[str, str, list[str]]]:
    """``title, text, images`` of the cells of class ``article``."""
    out = []
    for n in parse(text).walk():
        if n.tag == "td" and "article" in (dict(n.attrs).get("class") or "").split():
            inner = list(n.walk())
            head = next((a.text().strip() for a in inner if a.tag == "a" and a.text().strip()), "")
            out.append((head, re.sub(r"\s+", " ", n.text()).strip(), [dict(i.attrs).get("src") or "" for i in inner if i.tag == "img"]))
    return out


def plan_leaves(nodes: DataFrame, node: str, parent: str) -> DataFrame:
    """Nodes of an adjacency table without children."""
    return nodes.join(nodes.select(F.col(parent).alias("__p")).distinct(), nodes[node] == F.col("__p"), "left_anti")


def first_references(knowledge: DataFrame, document: str, reference: str, order: str) -> DataFrame:
    """The first reference of each document."""
    return knowledge.groupBy(document).agg(F.min_by(reference, order).alias(reference))


def apply_contents(nodes: DataFrame, contents: DataFrame, node: str, text: str, depth: str, hashes: bool = False) -> DataFrame:
    """Nodes' texts replaced by those given; ``hashes`` puts a heading mark of the node's depth before it."""
    out = nodes.drop(text).join(contents.select(node, text), node, "left")
    if hashes:
        out = out.withColumn(text, F.when(F.col(text).isNotNull(), F.concat(F.repeat(F.lit("#"), F.col(depth).cast("int")), F.lit(" "), F.col(text))))
    return out


def without_title(text: Column, heading: Column) -> Column:
    """Without the first line if it is the title."""
    first = F.substring_index(text, "\n", 1)
    return F.when(simplify(first) == simplify(heading), F.substring(text, F.length(first) + 2, F.length(text))).otherwise(text)


def preview(rows: DataFrame, key: str, depth: str, heading: str, path: str, focus: Column | None = None) -> DataFrame:
    """An indented outline per document; a focused node is marked."""
    mark = F.when(focus, F.lit(" <--")).otherwise("") if focus is not None else F.lit("")
    line = F.concat(F.repeat(F.lit("  "), F.col(depth).cast("int")), F.lit("- "), F.col(heading), mark)
    rows = rows.withColumn("__l", line)
    return rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(path, "__l"))), lambda x: x["__l"]), "\n").alias("preview"))


def pages_of(chunks: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """Running page of each chunk: the last page mark at or before it."""
    seen = F.regexp_extract_all(F.col(text), F.lit(r"// Page (\d+)"), F.lit(1))
    w = Window.partitionBy(key).orderBy(order)
    return chunks.withColumn("page", F.coalesce(F.last(F.when(F.size(seen) > 0, F.element_at(seen, -1)), ignorenulls=True).over(w).cast("int"), F.lit(0)))


#: Titles of bibliography sections.
BIBLIOGRAPHY = (
    "bibliography", "references", "works cited", "cited works", "sources", "citations", "literature cited", "further reading", "additional reading", "resources",
    "références", "bibliographie", "ouvrages cités", "sources citées", "littérature citée", "lectures complémentaires",
)


def bare_title(text: str) -> str:
    """Only the letters a to z of the lower-cased title, so accents and spaces don't count on either side."""
    return re.sub(r"[^a-z]", "", text.lower())


def remove_bibliography(text: str) -> str:
    """Without the bibliography section, if exactly one heading names one, and without bracketed citations."""
    titles = {bare_title(x) for x in BIBLIOGRAPHY}
    marks = list(re.finditer(r"^(#{1,4})[^\S\n]*(.*)$", text, re.MULTILINE))
    ends = [*(m.start() for m in marks[1:]), len(text)]
    named = [i for i, m in enumerate(marks) if bare_title(m[2]) in titles]
    if len(named) == 1:
        i = named[0]
        text = text[: marks[i].start()] + text[ends[i] :]
    return re.sub(r"\[\s*\d+(?:\s*,\s*\d+)*\s*\]", "", text)


def renumber_citations(text: str) -> str:
    """Citations numbered in order of first use, the bibliography in that order, unused entries in a section of their own."""
    head, mark, tail = text.partition("## Bibliography")
    if not mark:
        return text
    entries = {int(m[1]): m[2].strip() for m in re.finditer(r"^\[(\d+)\]\s*(.*)$", tail, re.MULTILINE)}
    order = list(dict.fromkeys(int(n) for n in re.findall(r"\[(\d+)\]", head) if int(n) in entries))
    new = {n: i for i, n in enumerate(order, 1)}
    body = re.sub(r"\[(\d+)\]", lambda m: f"[{new[int(m[1])]}]" if int(m[1]) in new else m[0], head)
    out = body + mark + "\n\n" + "\n".join(f"[{new[n]}] {entries[n]}" for n in order) + "\n"
    unused = [e for n, e in sorted(entries.items()) if n not in new]
    return out + ("\n## Unused Sources\n\n" + "\n".join(f"- {e}" for e in unused) + "\n" if unused else "")
