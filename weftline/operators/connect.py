"""Search, downloads, uploads and checked replies around injected providers.

A searcher is a callable on query texts that returns for each a JSON list of ``{url, title, date, text}``; a getter
returns bytes for each address. Nothing here reaches the network by itself.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.operators.documents import parse
from weftline.operators.providers import Provider, ProviderError, complete, with_retries

HIT = "array<struct<url:string,title:string,date:string,text:string>>"
BytesGetter = Callable[[list[str]], list[bytes | None]]


def search(queries: DataFrame, key: str, query: str, searcher: Provider, retries: int = 10) -> DataFrame:
    """``key, rank, url, title, date, text``: the hits of each query in the searcher's order."""
    kinds = T.StructType([queries.schema[key], T.StructField("__hits", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({key: b[key], "__hits": with_retries(searcher, list(b[query]), retries)})

    found = queries.select(key, query).mapInPandas(run, kinds)
    return found.select(key, F.posexplode(F.from_json("__hits", HIT)).alias("rank", "hit")).select(key, "rank", "hit.*")


def recent(hits: DataFrame, today: Column, days: int = 30) -> DataFrame:
    """Hits of the last ``days`` days; a hit without a readable date stays out."""
    return hits.where(F.datediff(today, F.try_to_timestamp(F.left("date", F.lit(10)), F.lit("yyyy-MM-dd"))).between(0, days))


def titled(hits: DataFrame, terms: str) -> DataFrame:
    """Hits whose title has all of the comma-listed terms, in any case."""
    for x in (x.strip().lower() for x in terms.split(",")):
        if x:
            hits = hits.where(F.contains(F.lower("title"), F.lit(x)))
    return hits


def decoded_address(c: Column) -> Column:
    """The address inside a wrapped news link: the first ``http`` run of the base64 text after ``/articles/``, the link itself if there is none."""
    code = F.regexp_extract(c, r"/articles/([A-Za-z0-9_-]+)", 1)
    fill = F.rpad(F.translate(code, "-_", "+/"), (F.ceil(F.length(code) / 4) * 4).cast("int"), "=")
    inner = F.regexp_extract(F.decode(F.try_to_binary(fill, F.lit("base64")), "ISO-8859-1"), r"(https?://[\x21-\x7e]+)", 1)
    return F.when(F.coalesce(inner, F.lit("")) != "", inner).otherwise(c)


def download(df: DataFrame, url: str, get: BytesGetter, name: str = "content", magic: bytes = b"%PDF") -> DataFrame:
    """Rows whose address yields bytes that start with ``magic``, with those bytes."""
    kinds = T.StructType([*(f for f in df.schema.fields if f.name != name), T.StructField(name, T.BinaryType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(**{name: with_retries(get, list(b[url]))})[kinds.names]

    return df.mapInPandas(run, kinds).where(F.col(name).isNotNull() & (F.substring(F.col(name), 1, len(magic)) == F.lit(magic)))


def file_text(files: DataFrame, content: str, reader: Callable[[bytes], list[str]], name: str = "text", broken: str = "Corrupted Or Locked PDF", joiner: str = "\n", pages: bool = False) -> DataFrame:
    """The text of binary files by a page reader; ``pages`` puts a ``// Page n`` line before each page. A file the reader refuses reads ``broken``."""
    kinds = T.StructType([*(f for f in files.schema.fields if f.name != name), T.StructField(name, T.StringType())])

    def one(body: bytes) -> str:
        try:
            got = reader(body)
        except Exception:  # noqa: BLE001 - any reader's error means a broken file
            return broken
        return joiner.join(f"// Page {i}\n{p}" if pages else p for i, p in enumerate(got, 1))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(**{name: [one(bytes(x)) for x in b[content]]})[kinds.names]

    return files.mapInPandas(run, kinds)


def wrapped(df: DataFrame, content: str, name: str = "PDF") -> DataFrame:
    """A binary column as the one field of a record."""
    return df.select(F.struct(F.col(content).alias(name)).alias("record"))


def unwrapped(df: DataFrame, record: str, name: str = "PDF") -> DataFrame:
    return df.select(F.col(f"{record}.{name}").alias("content"))


DATA_IMAGE = re.compile(r"data:image/([a-z.+-]+);base64,(.*)", re.DOTALL)


def upload_images(text: str, put: Callable[[str, bytes], str | None], folder: str = "/Uploads/") -> str:
    """Embedded images handed to ``put(path, bytes)`` and replaced by the address it returns; images it refuses are removed."""
    root, n = parse(text), 0

    def visit(node) -> None:
        nonlocal n
        kept = []
        for c in node.children:
            if not isinstance(c, str):
                found = DATA_IMAGE.match(dict(c.attrs).get("src") or "") if c.tag == "img" else None
                if found:
                    n += 1
                    try:
                        address = put(f"{folder}image-{n}.{found[1]}", base64.b64decode(found[2], validate=True))
                    except (ValueError, ProviderError):
                        address = None
                    if address is None:
                        continue
                    c.attrs = [(k, address if k == "src" else v) for k, v in c.attrs]
                visit(c)
            kept.append(c)
        node.children = kept

    visit(root)
    return root.html()


def checked(df: DataFrame, prompt: str, provider: Provider, required: Sequence[str] = (), retries: int = 3, name: str = "record") -> DataFrame:
    """The provider's JSON object with all required keys, asked for up to ``retries`` - 1 times; ``{}`` after that."""
    kinds = T.StructType([*(f for f in df.schema.fields if f.name != name), T.StructField(name, T.StringType())])

    def good(reply: str) -> str | None:
        try:
            got = json.loads(reply[reply.index("{") : reply.rindex("}") + 1])
        except ValueError:
            return None
        return json.dumps(got, ensure_ascii=False, sort_keys=True) if all(k in got for k in required) else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            asked, said = list(b["__asked"]), ["{}"] * len(b)
            left = list(range(len(b)))
            for _ in range(retries - 1):
                if not left:
                    break
                answers = [good(a) for a in provider([asked[i] for i in left])]
                for i, a in zip(left, answers, strict=True):
                    said[i] = a or "{}"
                left = [i for i, a in zip(left, answers, strict=True) if a is None]
            yield b.assign(**{name: said})[kinds.names]

    return df.withColumn("__asked", F.to_json(prompt)).mapInPandas(run, kinds)


def headings_fault(text: str) -> str:
    """What is wrong with the headings of a page: nothing (empty), no heading, a first one that isn't ``h1``, or a skipped level."""
    levels = [int(m) for m in re.findall(r"(?i)<h([1-6])\b", text)]
    if not levels:
        return "no heading"
    if levels[0] != 1:
        return "the first heading is not h1"
    return next((f"h{b} follows h{a}" for a, b in zip(levels, levels[1:]) if b > a + 1), "")


def cleaned_headings(df: DataFrame, prompt: str, provider: Provider, name: str = "html", tries: int = 3) -> DataFrame:
    """A page with mended headings from the provider: the only fenced html block, asked for again while its headings have a fault; null at last."""

    def ask(texts: list[str]) -> list[str]:
        out: list[str] = []
        for t in texts:
            page = ""
            for _ in range(tries):
                blocks = re.findall(r"(?s)```html\s*\n(.*?)```", provider([t])[0])
                if len(blocks) == 1 and not headings_fault(blocks[0]):
                    page = blocks[0]
                    break
            out.append(page)
        return out

    return complete(df, prompt, ask, name).withColumn(name, F.when(F.col(name) != "", F.col(name)))


PAGE = r"__PAGE_(\d+)__"


def paged_chunks(chunks: DataFrame, document: str, order: str, text: str) -> DataFrame:
    """Chunks without their page marks, with ``page_start, page_end`` and ``local_index``, their place among those that begin on the same page."""
    marks = F.transform(F.regexp_extract_all(F.col(text), F.lit(PAGE), F.lit(1)), lambda x: x.cast("int"))
    upto = Window.partitionBy(document).orderBy(order)
    rows = chunks.withColumn("page_end", F.greatest(F.lit(0), F.coalesce(F.max(F.array_max(marks)).over(upto), F.lit(0))))
    rows = rows.withColumn("page_start", F.coalesce(F.lag("page_end").over(upto), F.lit(0)))
    rows = rows.withColumn("local_index", (F.row_number().over(Window.partitionBy(document, "page_start").orderBy(order)) - 1).cast("int"))
    return rows.withColumn(text, F.regexp_replace(F.col(text), PAGE, ""))


def comparison_prompts(old: DataFrame, new: DataFrame, nearest: DataFrame, key: str, text: str) -> DataFrame:
    """``key, prompt``: each new chunk with its nearest old ones, best first. ``nearest`` has ``query`` (new), ``key`` (old), ``rank``."""
    pairs = nearest.join(old.select(key, F.col(text).alias("__old")), key)
    said = pairs.groupBy("query").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "__old"))), lambda x: x["__old"]), "\n---\n").alias("__olds"))
    rows = new.join(said, new[key] == said["query"], "left")
    body = F.concat(F.lit("New passage:\n"), F.col(text), F.lit("\n\nOld passages:\n"), F.coalesce("__olds", F.lit("")))
    return rows.select(new[key], F.array(F.struct(F.lit("user").alias("role"), body.alias("content"))).alias("prompt"))


def comparison_summary(found: DataFrame, page: str, kind: str) -> DataFrame:
    """``page, kind, n, first_index``: how many changes of a kind there are on each page."""
    return found.groupBy(page, kind).agg(F.count("*").alias("n"), F.min("local_index").alias("first_index"))
