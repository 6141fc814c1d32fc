"""Operators with an outside effect, around an injected provider.

A provider is a picklable callable on texts. The offline ones here are deterministic, so
the dataflow can be run and tested without a network. Calls are made per Arrow batch on the
executors, repeated on failure, and return one text per row.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
from collections.abc import Callable, Iterator, Sequence
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

Provider = Callable[[list[str]], list[str]]
Embedder = Callable[[list[str]], np.ndarray]
EMBED_BATCH, RETRIES, PAUSE = 1024, 3, 10.0


class ProviderError(RuntimeError):
    """A call that may succeed if repeated."""


def with_retries(call: Callable, texts: list[str], retries: int = RETRIES, pause: float = 0.0) -> list:
    for attempt in range(retries):
        try:
            return call(texts)
        except ProviderError:
            if attempt == retries - 1:
                raise
            time.sleep(pause)
    return []


def echo(texts: list[str]) -> list[str]:
    """Offline: the last message's content."""
    out = []
    for t in texts:
        try:
            got = json.loads(t)
            out.append(got[-1]["content"] if isinstance(got, list) and got else t)
        except ValueError:
            out.append(t)
    return out


def hashed_embedder(dim: int = 64) -> Embedder:
    """Offline: signed word hashing, unit length."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        for i, t in enumerate(texts):
            for w in re.findall(r"\w+", t.lower()):
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                out[i, h % dim] += 1 if h >> 63 else -1
            out[i] /= np.linalg.norm(out[i]) or 1
        return out

    return embed


def complete(df: DataFrame, prompt: str, provider: Provider = echo, name: str = "reply", retries: int = RETRIES) -> DataFrame:
    """Add the provider's text for each conversation."""
    kinds = T.StructType([*(f for f in df.schema.fields if f.name != name), T.StructField(name, T.StringType())])
    asked = df.withColumn("__asked", F.to_json(prompt))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(**{name: with_retries(provider, list(b["__asked"]), retries)})[kinds.names]

    return asked.mapInPandas(run, kinds)


def reply(df: DataFrame, prompt: str, provider: Provider = echo, role: str = "user") -> DataFrame:
    """Append the provider's text to each conversation."""
    done = complete(df, prompt, provider, "__reply")
    return done.withColumn(prompt, F.array_append(prompt, F.struct(F.lit(role).alias("role"), F.col("__reply").alias("content")))).drop("__reply")


def structured(df: DataFrame, prompt: str, schema: str | T.StructType, provider: Provider = echo, name: str = "record", required: Sequence[str] = ()) -> DataFrame:
    """The provider's text read as a record; null where it doesn't read or lacks a required field."""
    kind = schema if isinstance(schema, str) else schema.simpleString()
    done = complete(df, prompt, provider, "__reply").withColumn(name, F.from_json(F.regexp_extract("__reply", r"(?s)\{.*\}", 0), kind))
    ok = F.lit(True)
    for r in required:
        ok = ok & F.col(f"{name}.{r}").isNotNull()
    return done.withColumn(name, F.when(ok, F.col(name))).drop("__reply")


def rows_of(df: DataFrame, prompt: str, schema: str, provider: Provider = echo) -> DataFrame:
    """Extraction: the list of records in the provider's text as rows."""
    done = complete(df, prompt, provider, "__reply").withColumn("__rows", F.from_json(F.regexp_extract("__reply", r"(?s)\[.*\]", 0), f"array<struct<{schema}>>"))
    return done.select(*(c for c in df.columns if c != prompt), F.inline("__rows"))


def code_block(c: Column, label: str) -> Column:
    """The only fenced block with the label; null if there is none or several."""
    found = F.regexp_extract_all(c, F.lit(f"(?s)```{label}\\s*\\n(.*?)```"), F.lit(1))
    return F.when(F.size(found) == 1, F.get(found, F.lit(0)))


def embed(df: DataFrame, text: str, embedder: Embedder | None = None, name: str = "embedding", batch: int = EMBED_BATCH) -> DataFrame:
    """Add vectors; line feeds become spaces; empty texts are embedded as ``no data``."""
    embedder = embedder or hashed_embedder()
    kinds = T.StructType([*(f for f in df.schema.fields if f.name != name), T.StructField(name, T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [(t or "").replace("\n", " ").strip() or "no data" for t in b[text]]
            vectors = [v for k in range(0, len(texts), batch) for v in with_retries(embedder, texts[k : k + batch])]
            yield b.assign(**{name: [list(map(float, v)) for v in vectors]})[kinds.names]

    return df.mapInPandas(run, kinds)


def fetch(df: DataFrame, url: str, get: Provider, name: str = "html", skip: Column | None = None) -> DataFrame:
    """Fetch pages; rows where ``skip`` holds keep what they have."""
    asked = df.withColumn("__skip", F.coalesce(skip, F.lit(False)) if skip is not None else F.lit(False))
    if name not in df.columns:
        asked = asked.withColumn(name, F.lit(None).cast("string"))
    kinds = T.StructType([f for f in asked.schema.fields if f.name != "__skip"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            want = list(b.index[~b["__skip"]])
            got = with_retries(get, list(b.loc[want, url])) if want else []
            values = dict(zip(want, got, strict=True))
            yield b.assign(**{name: [values.get(i, old) for i, old in zip(b.index, b[name], strict=True)]})[kinds.names]

    return asked.mapInPandas(run, kinds)


def deliver(df: DataFrame, text: str, put: Callable[[list[str]], None], batch: int = 500) -> None:
    """Send rows to an outside sink, at most ``batch`` at a time. Sinks must accept a row twice: tasks may be repeated."""

    def run(rows: Iterator) -> None:
        texts = (r[text] for r in rows)
        while part := list(islice(texts, batch)):
            with_retries(put, part)

    df.foreachPartition(run)


def reduce_fields(fields: DataFrame, score: str, order: str, keep: int = 50) -> DataFrame:
    """The best-scored fields, at most ``keep``, ties in order."""
    return fields.orderBy(F.desc(score), order).limit(keep)


def grade(answers: Column) -> Column:
    """Sum of a map of grades."""
    return F.aggregate(F.map_values(answers), F.lit(0).cast("long"), lambda s, x: s + F.coalesce(x, F.lit(0)))


def budget(text: Column, tokens: Column, most: int) -> Column:
    """Cut a text to the share of its tokens that fits."""
    return F.when(tokens > most, F.left(text, F.floor(F.length(text) * most / tokens).cast("int"))).otherwise(text)


def scored_fields(fields: DataFrame, group: str, order: str, text: str, provider: Provider, batch: int = 20) -> DataFrame:
    """``group, order, score``: the provider's grade of each field, asked for ``batch`` fields of a group at a time; it replies with a JSON list of numbers, and a
    field without one scores 0."""
    no = F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1
    rows = fields.select(group, order, text, no.alias("__n")).withColumn("__b", F.floor(F.col("__n") / batch).cast("int")).withColumn("__n", F.col("__n") % batch)
    asked = rows.groupBy(group, "__b").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__n", F.col(text).alias("t")))), lambda x: x["t"]), "\n").alias("__q"))
    said = complete(asked.withColumn("__p", F.array(F.struct(F.lit("user").alias("role"), F.col("__q").alias("content")))), "__p", provider, "__r")
    scores = said.select(group, "__b", F.from_json(F.regexp_extract("__r", r"(?s)\[.*\]", 0), "array<double>").alias("__s"))
    return rows.join(scores, [group, "__b"]).select(group, order, F.coalesce(F.get("__s", F.col("__n")), F.lit(0.0)).alias("score"))
