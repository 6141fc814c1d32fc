"""Smaller operators: reference tags, schema texts, YAML ballots, report trees, feeds, versioned documents."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from datetime import datetime, timedelta, timezone
from email.utils import parsedate_to_datetime
from xml.etree import ElementTree

import pandas as pd
import yaml
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.documents import parsed_rows

REF = r"<ref\s+([^/>]+?)\s*/>"


def ref_tags(c: Column) -> Column:
    """Distinct ids of ``<ref a/>`` and ``<ref a : b/>`` tags, sorted."""
    found = F.regexp_extract_all(c, F.lit(REF), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: F.regexp_replace(x, r"\s*:\s*", ":"))))


def missing_tags(given: Column, used: Column) -> tuple[Column, Column]:
    """Tags given but not used, and tags used but not given, comma-joined."""
    a, b = ref_tags(given), ref_tags(used)
    return F.array_join(F.array_except(a, b), ", "), F.array_join(F.array_except(b, a), ", ")


def schema_text(fields: Column) -> Column:
    """``{"name" : Type or null (Description)}`` of a list of ``struct<name, type, description>``."""
    line = lambda f: F.concat(F.lit('"'), f["name"], F.lit('" : '), f["type"], F.lit(" or null ("), f["description"], F.lit(")"))
    return F.concat(F.lit("{"), F.array_join(F.transform(fields, line), ", "), F.lit("}"))


def outline_text(sections: Column) -> Column:
    """Markdown of a list of ``struct<index, title, details array<struct<index, text>>>`` in the order of the indices."""

    def one(s: Column) -> Column:
        details = F.transform(F.array_sort(s["details"]), lambda d: F.concat(F.lit("- "), d["text"]))
        return F.concat(F.lit("## "), s["title"], F.lit("\n"), F.array_join(details, "\n"))

    return F.array_join(F.transform(F.array_sort(sections), one), "\n\n")


def load_yaml(text: str) -> object:
    """YAML of a fenced or bare text; on an error, values with colons are quoted and read again. Null if it still fails."""
    m = re.search(r"```(?:ya?ml)?\s*\n(.*?)```", text, re.DOTALL)
    body = (m[1] if m else text).replace("\u00a0", " ").replace("\t", "  ")
    try:
        return yaml.safe_load(body)
    except yaml.YAMLError:
        quoted = re.sub(r"^([ \t]*(?:- )?[^:\n]+:[ \t]+)([^\"'\s|>\[{][^\n]*:[^\n]*)$", lambda x: x[1] + json.dumps(x[2], ensure_ascii=False), body, flags=re.MULTILINE)
        try:
            return yaml.safe_load(quoted)
        except yaml.YAMLError:
            return None


def yaml_json(df: DataFrame, key: str, field: str) -> DataFrame:
    """``key, json``: YAML texts as JSON."""
    return parsed_rows(df, key, field, lambda t: [(json.dumps(load_yaml(t), default=str, ensure_ascii=False),)], "json string")


def ballot_rows(text: str) -> list[tuple[str, str, float, str]]:
    """``group, criterion, value, analysis`` of a ballot ``{group: {criterion: {value, analysis}}}``."""
    got = load_yaml(text)
    out = []
    for g, criteria in got.items() if isinstance(got, dict) else ():
        for c, v in criteria.items() if isinstance(criteria, dict) else ():
            if isinstance(v, dict):
                value = next((x for k, x in v.items() if str(k).endswith("value")), None)
                analysis = next((x for k, x in v.items() if str(k).endswith("analysis")), "")
                if isinstance(value, (int, float)):
                    out.append((str(g), str(c), float(value), str(analysis)))
    return out


def ballots(df: DataFrame, key: str, field: str) -> DataFrame:
    return parsed_rows(df, key, field, ballot_rows, "group string, criterion string, value double, analysis string")


def align_criteria(rows: DataFrame, key: str) -> DataFrame:
    """Criterion names of all ballots replaced by the nearest of the first ballot's in the group (least edit distance, then name)."""
    names = rows.groupBy().agg(F.min(key).alias("k0"))
    canon = rows.join(F.broadcast(names), F.col(key) == F.col("k0")).select(F.col("group").alias("g"), F.col("criterion").alias("canon")).distinct()
    seen = rows.select("group", "criterion").distinct()
    near = seen.join(canon, F.col("group") == F.col("g")).groupBy("group", "criterion").agg(F.min(F.struct(F.levenshtein("criterion", "canon").alias("d"), "canon")).alias("m"))
    return rows.join(near.select("group", "criterion", "m.canon"), ["group", "criterion"]).drop("criterion").withColumnRenamed("canon", "criterion")


def grid_skeleton(sections: list[dict]) -> str:
    """The YAML answer form of a grid."""
    out = []
    for s in sections:
        out.append(f"{s['name']}:")
        for c in s["rows"]:
            values = ", ".join(str(v["value"]) for v in c.get("possible_values", []))
            out += [f"  {c['name']}:", f"    {c['name']}_analysis: text", f"    {c['name']}_value: one of {values}"]
    return "\n".join(out)


def tree_markdown(node: dict, depth: int = 1) -> str:
    """A report tree of sections, texts, metrics, bullet points and images as Markdown."""
    out = [f"{'#' * min(depth, 6)} {node.get('title', '')}"]
    for c in node.get("contents", []):
        kind = c.get("info_type")
        if kind == "sections" or "contents" in c:
            out += [tree_markdown(x, depth + 1) for x in c.get("sections", [c])]
        elif kind == "metric":
            out.append(f"**{c.get('title', '')}**: {c.get('value', '')} {c.get('unit', '')}".rstrip())
        elif kind == "bullet_points":
            out.append("\n".join(f"- {x}" for x in c.get("items", [])))
        elif kind == "image":
            out.append(f"![{c.get('title', '')}]({c.get('url', '')})")
        else:
            out.append(str(c.get("text", "")))
    return "\n\n".join(out)


def leaf_paths(nodes: list[dict], trail: tuple[int, ...] = ()) -> list[tuple[int, ...]]:
    """Index paths of the leaves of a tree of ``children``."""
    out: list[tuple[int, ...]] = []
    for i, n in enumerate(nodes):
        at = (*trail, i)
        out += leaf_paths(n["children"], at) if n.get("children") else [at]
    return out


def feed_rows(text: str, now: datetime, hours: int = 48) -> list[tuple[str, str, str, str, str]]:
    """``title, url, published, source, full`` of the items of an RSS feed that are newer than ``hours``; ``full`` has 200 words at most."""
    try:
        root = ElementTree.fromstring(text)
    except ElementTree.ParseError:
        return []
    out = []
    for item in root.iter("item"):
        get = lambda k: (item.findtext(k) or "").strip()  # noqa: B023, E731
        try:
            when = parsedate_to_datetime(get("pubDate"))
        except ValueError:
            continue
        when = when if when.tzinfo else when.replace(tzinfo=timezone.utc)
        if now - when < timedelta(hours=hours):
            host = re.sub(r"^(?:www|m)\.", "", re.sub(r"^\w+://([^/?#]*).*$", r"\1", get("link")))
            words = re.sub(r"<[^>]*>", " ", get("description")).split()[:200]
            out.append((get("title"), get("link"), when.astimezone(timezone.utc).isoformat(), host.split(".")[0].capitalize(), " ".join(words)))
    return out


def feeds(df: DataFrame, key: str, field: str, now: datetime, hours: int = 48) -> DataFrame:
    return parsed_rows(df, key, field, lambda t: feed_rows(t, now, hours), "title string, url string, published string, source string, full string")


def next_tasks(entities: DataFrame, key: str, queue: str) -> DataFrame:
    """The first queued task of each entity that has one."""
    return entities.where(F.size(queue) > 0).select(key, F.get(queue, F.lit(0)).alias("task"))


def apply_changes(values: DataFrame, changes: DataFrame, order: str) -> DataFrame:
    """Changes ``entity, field, version_id, value`` folded into the values in order: the last one for a key wins."""
    keys = ["entity", "field", "version_id"]
    last = changes.groupBy(*keys).agg(F.max_by("value", order).alias("value"))
    return values.join(last.select(*keys), keys, "left_anti").unionByName(last)


def clean_pages(text: str) -> dict[str, str]:
    """``page: text`` of a text with ``// Page n`` marks."""
    parts = re.split(r"// Page (\d+)\s*", text)
    return {parts[i]: parts[i + 1].strip() for i in range(1, len(parts) - 1, 2)}


def per_document(df: DataFrame, key: str, f: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A function of all rows of a document, for folds that SQL can't express."""
    return df.groupBy(key).applyInPandas(f, schema)
