"""Row filters. All are Column predicates, so they reach the scan where a source can use them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.text import matches_at_start, simplify, simplify_text, truthy


def filter_value(df: DataFrame, field: str, value: str, equals: bool = True, remove_nans: bool = False, compat: str = "intent") -> DataFrame:
    """Normalised (in)equality of a field with a text; ``remove_nans`` also drops missing values.

    ``compat="strict"`` reproduces the original's slip: texts normalise to nothing, so ``equals`` keeps every non-empty text and null,
    and ``remove_nans`` replaces the comparison.
    """
    c = F.col(field)
    if compat == "strict":
        if remove_nans:
            return df.where(c.isNotNull())
        kept = c.isNull() | ((c != "") if isinstance(df.schema[field].dataType, T.StringType) else F.lit(False))
        return df.where(kept if equals else ~kept)
    same = F.coalesce(simplify(c.cast("string")) == simplify_text(value), F.lit(False))
    df = df.where(same if equals else ~same)
    return df.where(c.isNotNull()) if remove_nans else df


def filter_truthy(df: DataFrame, field: str, keep_false: bool = False) -> DataFrame:
    yes = truthy(F.col(field), df.schema[field].dataType)
    return df.where(~yes if keep_false else yes)


def filter_contains(df: DataFrame, field: str, value: Column | str) -> DataFrame:
    """Rows whose list field holds the value, or whose text field has it as a part."""
    v = F.lit(value) if isinstance(value, str) else value
    c = F.col(field)
    held = F.array_contains(c, v) if isinstance(df.schema[field].dataType, T.ArrayType) else F.contains(c, v)
    return df.where(F.coalesce(held, F.lit(False)))


def filter_listed(df: DataFrame, field: str, values: str) -> DataFrame:
    """Normalised membership in a comma list; a missing value counts as the text None."""
    listed = [simplify_text(v) for v in values.split(",")]
    return df.where(simplify(F.coalesce(F.col(field).cast("string"), F.lit("None"))).isin(*listed))


def filter_regex(df: DataFrame, field: str, pattern: str, flags: str = "") -> DataFrame:
    """Match from the start of the field; a leading ``!`` negates, and then missing values pass."""
    c = F.col(field).cast("string")
    if pattern.startswith("!"):
        return df.where(c.isNull() | ~matches_at_start(c, pattern[1:], flags))
    return df.where(c.isNotNull() & matches_at_start(c, pattern, flags))


def any_keyword(c: Column, keywords: str) -> Column:
    out = F.lit(False)
    for k in keywords.split(","):
        out = out | F.contains(c, F.lit(k.strip()))
    return out


def filter_keywords(df: DataFrame, field: str, keywords: str, without: bool = False) -> DataFrame:
    """Texts with any of the keywords (case counts), or those with none."""
    found = any_keyword(F.col(field), keywords)
    return df.where(~found if without else found)


def filter_exact(df: DataFrame, field: str, value: object) -> DataFrame:
    return df.where(F.col(field) == F.lit(value))


def good_text(c: Column, min_lines: int = 30, min_chars: int = 5000) -> Column:
    """More characters than ``min_chars`` without spaces, and more lines than ``min_lines``."""
    ends = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85\u2028\u2029]"
    lines = F.when(c == "", 0).otherwise(F.size(F.split(F.regexp_replace(c, f"(?:{ends})\\z", ""), ends)))
    return F.coalesce((F.length(F.replace(c, F.lit(" "), F.lit(""))) > min_chars) & (lines > min_lines), F.lit(False))


def quality_gate(df: DataFrame, field: str, min_lines: int = 30, min_chars: int = 5000, bad: bool = False) -> DataFrame:
    ok = good_text(F.col(field), min_lines, min_chars)
    return df.where(~ok if bad else ok)


def inject_faults(df: DataFrame, probability: float, seed: int = 0) -> DataFrame:
    """Fails a row with the given probability; for tests of recovery."""
    return df.where(F.when(F.rand(seed) < probability, F.raise_error(F.lit("injected"))).isNull())
