"""Conversations as arrays of ``struct<role, content>``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.template import render

LIMIT = 300_000


def message(role: str | Column, content: Column) -> Column:
    return F.struct((F.lit(role) if isinstance(role, str) else role).alias("role"), content.alias("content"))


def start(role: str, content: Column, limit: int = 0) -> Column:
    """A conversation of one message, cut to ``limit`` characters if that isn't 0."""
    return F.array(message(role, F.left(content, F.lit(limit)) if limit else content))


def start_template(df: DataFrame, role: str, template: str) -> Column:
    return F.array(message(role, render(df, template)))


def start_dated(df: DataFrame, role: str, template: str, now: Column | None = None) -> Column:
    """A ``{{expr}}`` template that may use ``__date__``."""
    dated = df.withColumn("__date__", (F.current_timestamp() if now is None else now).cast("string"))
    return F.array(message(role, F.replace(render(dated, template.replace("{{", "{").replace("}}", "}").replace("{__date__}", "__date__")), F.lit("__date__"), (F.current_timestamp() if now is None else now).cast("string"))))


def add(prompt: Column, role: str, content: Column) -> Column:
    return F.array_append(prompt, message(role, content))


def last(prompt: Column) -> Column:
    return F.element_at(prompt, -1)["content"]


def instructions(fields: Sequence[tuple[str, str, str]], before: str = "", after: str = "", justify: bool = False) -> str:
    """The expected JSON structure of a field list (name, type, description) as text."""
    lines = [f'"{n}" : {k} or null ({d})' + (f',\n"{n}_justification" : str' if justify else "") for n, k, d in fields]
    return before + "{\n" + ",\n".join(lines) + "\n}" + after


def add_instructions(prompt: Column, role: str, fields: Sequence[tuple[str, str, str]], before: str = "", after: str = "", justify: bool = False) -> Column:
    return add(prompt, role, F.lit(instructions(fields, before, after, justify)))


def from_turns(turns: DataFrame, key: str, order: str, role: str, content: str, name: str = "prompt") -> DataFrame:
    """One conversation per key, its turns in order."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(role).alias("role"), F.col(content).alias("content"))))
    return turns.groupBy(key).agg(F.transform(rows, lambda r: F.struct(r["role"].alias("role"), r["content"].alias("content"))).alias(name))


def truncate(prompt: Column, limit: int = LIMIT) -> Column:
    """Cut the longest message first (the earlier of equals), then the next, until the total is within the limit.

    Closed form: in order of length, message i keeps min(length, max(0, length - (total - limit - cut so far))).
    """
    total = F.aggregate(prompt, F.lit(0), lambda s, m: s + F.length(m["content"]))
    sized = F.transform(prompt, lambda m, i: F.struct((-F.length(m["content"])).alias("n"), i.alias("i")))
    ranked = F.array_sort(sized)
    state = F.struct((total - limit).alias("over"), F.map_from_arrays(F.array().cast("array<int>"), F.array().cast("array<int>")).alias("cut"))

    def step(acc: Column, r: Column) -> Column:
        cut = F.greatest(F.lit(0), F.least(-r["n"], acc["over"]))
        return F.struct((acc["over"] - cut).alias("over"), F.map_concat(acc["cut"], F.create_map(r["i"], cut)).alias("cut"))

    cuts = F.aggregate(ranked, state, step, lambda acc: acc["cut"])
    return F.transform(prompt, lambda m, i: F.struct(m["role"].alias("role"), F.left(m["content"], F.length(m["content"]) - F.element_at(cuts, i)).alias("content")))
