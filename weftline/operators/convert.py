"""Conversions between records, tables, lists and texts, and typed schemas."""

from __future__ import annotations

import html
import json
import re
import unicodedata
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.text import between, longest_bracket, split_literal

BIB = "struct<title:string,abstract:string,doi:string,date:string,journal:string,full_entry_type:string,authors:array<string>,type:array<string>,keywords:array<string>,affiliations:array<string>>"
URL = "struct<url:string,title:string,text:string,clean_text:string,date:string,images:array<string>,success:boolean>"


def as_schema(df: DataFrame, kind: str, strict: bool = False) -> DataFrame:
    """Columns of a record type: missing texts become empty, missing lists empty; ``strict`` refuses unknown fields."""
    want = T._parse_datatype_string(kind)
    if strict and (extra := set(df.columns) - set(want.names)):
        raise TypeError(f"unexpected fields: {sorted(extra)}")

    def column(f: T.StructField) -> Column:
        empty = F.array().cast(f.dataType) if isinstance(f.dataType, T.ArrayType) else F.lit(False) if isinstance(f.dataType, T.BooleanType) else F.lit("")
        return (F.coalesce(F.col(f.name).cast(f.dataType), empty) if f.name in df.columns else empty).alias(f.name)

    return df.select(*(column(f) for f in want.fields))


def to_json_text(df: DataFrame, name: str = "json", pretty: bool = False) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns), {"pretty": str(pretty).lower()}).alias(name))


def explode_list(df: DataFrame, field: str, wrap: str | None = None) -> DataFrame:
    """Rows of a list field: its structs' fields, or its scalars under the name ``wrap``."""
    if wrap:
        return df.select(F.explode(field).alias(wrap))
    return df.select(F.inline(field))


def list_of_texts(c: Column) -> Column:
    return F.transform(c, lambda x: x.cast("string"))


def texts_to_rows(df: DataFrame, field: str, key: str) -> DataFrame:
    return df.select(F.explode(field).alias(key))


def parse_list(c: Column, schema: str) -> Column:
    """The JSON list between the first ``[`` and the last ``]``."""
    return F.from_json(between(c, "[", "]"), schema)


def parse_record(c: Column, schema: str) -> Column:
    """The JSON object or list of a text, whichever is longer, read as a record."""
    return F.from_json(longest_bracket(c), schema)


def parse_record_text(c: Column) -> Column:
    return longest_bracket(c)


def urls_from(text: Column, separator: str = "\n") -> Column:
    return split_literal(text, separator)


TAG = "___ASCII___"


def encode_bytes(c: Column) -> Column:
    """Bytes as tagged base64 text, as JSON can hold them."""
    return F.concat(F.lit(TAG), F.base64(c))


def decode_bytes(c: Column) -> Column:
    """The bytes of tagged text, null for other texts."""
    return F.when(c.startswith(TAG), F.unbase64(F.substring(c, len(TAG) + 1, 1 << 30)))


NULL_CELLS = ("", "null", "not found", "none", "absent")


def pipe_table(df: DataFrame, key: str, field: str) -> DataFrame:
    """``key, column_name, row_name, value`` of a pipe table; null-like cells are skipped. Not a table: no rows."""
    cells = lambda line: F.transform(F.split(F.regexp_replace(F.trim(line), r"^\||\|$", ""), r"\|"), lambda x: F.trim(x))
    lines = F.filter(F.split(F.col(field), "\n"), lambda x: F.contains(x, F.lit("|")))
    t = df.select(key, lines.alias("ls")).where(F.size("ls") > 2)
    t = t.select(key, cells(F.element_at("ls", 1)).alias("head"), F.posexplode(F.slice("ls", 3, F.size("ls"))).alias("line_no", "line")).withColumn("cells", cells(F.col("line")))
    t = t.select(key, "head", "line_no", F.element_at("cells", 1).alias("row_name"), F.posexplode("cells").alias("i", "value")).where("i > 0 AND i < size(head)")
    return t.where(~F.lower("value").isin(*NULL_CELLS)).select(key, F.get("head", F.col("i")).alias("column_name"), "row_name", "value", "line_no")


def html_of(value: object) -> str:
    """JSON as nested lists of HTML."""
    if isinstance(value, dict):
        return "<ul>" + "".join(f"<li><strong>{html.escape(str(k))}:</strong> {html_of(v)}</li>" for k, v in value.items()) + "</ul>"
    if isinstance(value, list):
        return "<ol>" + "".join(f"<li>{html_of(v)}</li>" for v in value) + "</ol>"
    return "<em>null</em>" if value is None else html.escape(str(value))


def markdown_to_html(text: str, css: str = "") -> str:
    """Headings, lists, emphasis, links, code and paragraphs."""
    inline = [(r"`([^`]+)`", r"<code>\1</code>"), (r"\*\*([^*]+)\*\*", r"<strong>\1</strong>"), (r"\*([^*]+)\*", r"<em>\1</em>"), (r"\[([^\]]+)\]\(([^)\s]+)\)", r'<a href="\2">\1</a>')]

    def dress(s: str) -> str:
        s = html.escape(s, quote=False)
        for a, b in inline:
            s = re.sub(a, b, s)
        return s

    out, paragraph, items = [], [], []

    def close() -> None:
        if paragraph:
            out.append(f"<p>{dress(' '.join(paragraph))}</p>")
            paragraph.clear()
        if items:
            out.append("<ul>" + "".join(f"<li>{dress(i)}</li>" for i in items) + "</ul>")
            items.clear()

    for line in text.split("\n"):
        if m := re.match(r"(#{1,6})\s+(.*)", line):
            close()
            out.append(f"<h{len(m[1])}>{dress(m[2].strip())}</h{len(m[1])}>")
        elif m := re.match(r"\s*[-*+]\s+(.*)", line):
            if paragraph:
                close()
            items.append(m[1])
        elif line.strip():
            if items:
                close()
            paragraph.append(line.strip())
        else:
            close()
    close()
    return f"<html><head><style>{css}</style></head><body>{''.join(out)}</body></html>"


def map_text(df: DataFrame, field: str, name: str, f: Callable[[str], str]) -> DataFrame:
    """A text function over Arrow batches; null stays null."""
    schema = T.StructType([*(x for x in df.schema.fields if x.name != name), T.StructField(name, T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(**{name: [None if x is None else f(x) for x in b[field]]})[schema.names]

    return df.mapInPandas(run, schema)


def field_name(text: str) -> str:
    """ASCII letters, digits and underscores in lower case."""
    flat = unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode().lower().replace(" ", "_")
    return re.sub(r"[^a-z0-9_]", "", flat)


def upper_name(text: str) -> str:
    """Upper snake case without accents and leading digits."""
    flat = "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn")
    return re.sub(r"\W+", "_", re.sub(r"^\d+", "", flat)).strip("_").upper()


#: The scalar types of field lists.
SCALARS = {"str": "string", "string": "string", "int": "bigint", "integer": "bigint", "float": "double", "number": "double", "bool": "boolean", "boolean": "boolean", "date": "string", "duration": "string", "list[str]": "array<string>", "list[int]": "array<bigint>", "list[float]": "array<double>", "list[bool]": "array<boolean>"}


def compile_fields(fields: Sequence[dict]) -> T.StructType:
    """A field list (``name, type, fields, multiple``) as a Spark schema; nested fields are lists of structs."""
    out = []
    for f in fields:
        if f.get("fields"):
            kind: T.DataType = T.ArrayType(compile_fields(f["fields"]))
        else:
            kind = T._parse_datatype_string(SCALARS[str(f["type"]).lower().replace(" ", "")])
            kind = T.ArrayType(kind) if f.get("multiple") else kind
        out.append(T.StructField(field_name(f["name"]), kind, not f.get("required", False)))
    return T.StructType(out)


def compile_grid(sections: Sequence[dict]) -> T.StructType:
    """Sections of criteria: each has a value and an analysis."""
    criterion = T.StructType([T.StructField("value", T.LongType()), T.StructField("analysis", T.StringType())])
    return T.StructType([T.StructField(field_name(s["name"]), T.StructType([T.StructField(field_name(c["name"]), criterion) for c in s["rows"]])) for s in sections])


def verify(c: Column, schema: T.StructType, required: Sequence[str]) -> Column:
    """Whether a JSON text reads as the schema and has the required fields."""
    read = F.from_json(c, schema, {"mode": "PERMISSIVE"})
    ok = read.isNotNull()
    for r in required:
        ok = ok & read[r].isNotNull()
    return F.coalesce(ok, F.lit(False))


def normalise(df: DataFrame, name: str = "document_level") -> dict[str, DataFrame]:
    """Nested records as linked tables: each list of structs becomes a child table that carries its parents' scalar fields and ids."""
    out: dict[str, DataFrame] = {}

    def walk(rows: DataFrame, at: str, level: int) -> None:
        nested = [f.name for f in rows.schema.fields if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType)]
        flat = [c for c in rows.columns if c not in nested]
        out[f"{level}_{at}"] = rows.select(*flat)
        for n in nested:
            inner = rows.schema[n].dataType.elementType.names
            child = rows.select(*flat, F.posexplode_outer(n).alias(f"{n}_id", "__x"))
            taken = set(child.columns)
            walk(child.select(*flat, f"{n}_id", *(F.col("__x")[i].alias(f"{i}_{n}" if i in taken else i) for i in inner)), n, level + 1)

    walk(df, name, 1)
    return dict(sorted(out.items()))


def json_list(text: str) -> list:
    """A Python value of a JSON list in a text; raises if there is none."""
    got = json.loads(text[text.index("[") : text.rindex("]") + 1].replace("\n", " ").replace("\t", " "))
    if not isinstance(got, list):
        raise TypeError("not a list")
    return got


def without_justifications(df: DataFrame, mark: str = "_JUSTIFICATION") -> DataFrame:
    """Extracted rows without the columns that only justify others."""
    return df.drop(*(c for c in df.columns if c.upper().endswith(mark)))


def entry_rows(df: DataFrame, key: str, field: str, schema: str, one: bool = False) -> DataFrame:
    """``key`` and the fields of the entries in a JSON text: a list, or with ``one`` a single record per document."""
    got = F.from_json(field, f"struct<{schema}>" if one else f"array<struct<{schema}>>")
    return without_justifications(df.select(key, got.alias("__e")).select(key, "__e.*") if one else df.select(key, F.inline(got)))


REF_MARK = r"<ref (\d+)(?: *: *(\d+))? */?>"


def numbered_references(c: Column) -> Column:
    """``<ref a/>`` and ``<ref a : b/>`` tags as ``[n]``, numbered by the order in which their sources first appear."""
    ids = F.array_distinct(F.regexp_extract_all(c, F.lit(REF_MARK), F.lit(1)))
    parts = F.split(F.regexp_replace(c, REF_MARK, "\x01$1\x02"), "[\x01\x02]")
    return F.array_join(F.transform(parts, lambda p, i: F.when(i % 2 == 1, F.concat(F.lit("["), F.array_position(ids, p).cast("string"), F.lit("]"))).otherwise(p)), "")
