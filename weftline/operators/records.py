"""Projections and record merges: one row in, one row out.

Row order is explicit: operators that need it take ``order``, the columns that define it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.template import expression, fill_slots, render
from weftline.functions.text import simplify


MAX_LIST = 100_000


def names(text: str, stripped: bool = True) -> list[str]:
    return [x.strip() if stripped else x for x in text.split(",")]


def set_field(df: DataFrame, name: str, value: object) -> DataFrame:
    """Set a field to a constant (text, number, truth value) or Column, overwriting."""
    return df.withColumn(name, value if isinstance(value, Column) else F.lit(value))


def set_record(df: DataFrame, name: str, record: DataFrame) -> DataFrame:
    """Set a field to the single row of ``record`` as a struct."""
    return df.crossJoin(F.broadcast(record.limit(1).select(F.struct(*record.columns).alias(name))))


def set_table(df: DataFrame, name: str, table: DataFrame, order: Sequence[str]) -> DataFrame:
    """Set a field to all rows of ``table`` as an ordered list. The table is a parameter of at most ``MAX_LIST`` rows: it must fit in a row."""
    if table.limit(MAX_LIST + 1).count() > MAX_LIST:
        raise ValueError(f"more than {MAX_LIST} rows")
    rows = F.transform(F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("o"), F.struct(*table.columns).alias("r")))), lambda x: x["r"])
    return df.crossJoin(F.broadcast(table.agg(rows.alias(name))))


def set_expression(df: DataFrame, name: str, text: str) -> DataFrame:
    return df.withColumn(name, expression(df, text))


def set_template(df: DataFrame, name: str, template: str) -> DataFrame:
    return df.withColumn(name, render(df, template))


def set_slots(df: DataFrame, name: str, template: str) -> DataFrame:
    return df.withColumn(name, fill_slots(df, template))


def extract(df: DataFrame, name: str) -> DataFrame:
    """One field as text; an unknown field is an error."""
    if name not in df.columns:
        raise KeyError(name)
    return df.select(F.col(name).cast("string").alias(name))


def select_fields(df: DataFrame, fields: str, remove: bool = False) -> DataFrame:
    """Keep the listed fields that exist, or drop them."""
    listed = set(names(fields))
    return df.select(*(c for c in df.columns if (c in listed) != remove))


def drop_fields(df: DataFrame, fields: str) -> DataFrame:
    """Drop a comma list of fields taken as written, without stripping."""
    return df.drop(*names(fields, stripped=False))


def filter_fields_by(values: Column, analysis: Column, allowed: str) -> Column:
    """Entries of a map whose field has an allowed verdict in a second map; unknown verdicts count as ``???``."""
    ok = [v.strip().lower() for v in allowed.split(",")]
    return F.map_filter(values, lambda k, _: F.lower(F.trim(F.coalesce(F.try_element_at(analysis, k), F.lit("???")))).isin(*ok))


def all_true(df: DataFrame, name: str, fields: Sequence[str] | None = None) -> DataFrame:
    """Whether all fields are true; a field that isn't boolean makes it false, no field makes it true."""
    out = F.lit(True)
    for f in df.columns if fields is None else fields:
        out = out & (F.coalesce(F.col(f), F.lit(False)) if isinstance(df.schema[f].dataType, T.BooleanType) else F.lit(False))
    return df.withColumn(name, out)


def add_constants(df: DataFrame, constants: DataFrame, row_wins: bool = True) -> DataFrame:
    """Add the single row of ``constants`` to all rows; ``row_wins`` says who keeps a field both have."""
    both = set(df.columns) & set(constants.columns)
    if row_wins:
        constants = constants.drop(*both)
    else:
        df = df.drop(*both)
    return df.crossJoin(F.broadcast(constants.limit(1)))


def add_index(df: DataFrame, name: str, order: Sequence[str | Column], group: Sequence[str] = ()) -> DataFrame:
    """1-based position. Without a group it is counted in two levels, so no task gets all rows."""
    if group:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()).withColumn("__id", F.monotonically_increasing_id())
    sizes = parts.groupBy("__part").agg(F.count("*").alias("n")).withColumn("__off", F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    local = F.col("__id") - F.col("__part").cast("long") * F.lit(1 << 33)
    return parts.join(F.broadcast(sizes.drop("n")), "__part").withColumn(name, (F.col("__off") + local + 1).cast("long")).drop("__part", "__id", "__off")


def final_score(df: DataFrame, fit: str = "fit_score", other: str = "fit_other_score", coverage: str = "coverage_score") -> DataFrame:
    """total_score = fit - other (100 where missing) + coverage."""
    number = lambda c, d: F.coalesce(F.col(c).cast("long"), F.lit(d)) if c in df.columns else F.lit(d).cast("long")
    return df.withColumn("total_score", number(fit, 0) - number(other, 100) + number(coverage, 0))


def comparison_view(df: DataFrame, columns: dict[str, str], page: str, index: str) -> DataFrame:
    """Sort by page and index, keep the columns in order with pages from 1 as text, rename for display."""
    out = df.orderBy(F.col(page).cast("int"), index)
    shown = [(F.col(c).cast("int") + 1).cast("string") if c.startswith("page") else F.col(c) for c in columns]
    return out.select(*(c.alias(n) for c, n in zip(shown, columns.values(), strict=True)))


def merge_records(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Shallow merge of aligned records, the right side's fields win."""
    shared = [c for c in left.columns if c in right.columns and c not in on]
    return left.drop(*shared).join(right, list(on), "inner")


def merge_deep(rows: DataFrame, key: str, fields: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Records of one key merged in order: the last value given for each field wins; ``__NAME__`` is the key."""
    at = F.struct(*order)
    return rows.groupBy(F.col(key).alias("__NAME__")).agg(*(F.max_by(F.col(f), F.when(F.col(f).isNotNull(), at)).alias(f) for f in fields))


def merge_entropic(rows: DataFrame, group: Sequence[str], fields: Sequence[str], order: str) -> DataFrame:
    """For each field the value that is longest as UTF-8 text; the first of equals, null counts as 0."""
    size = lambda f: F.coalesce(F.octet_length(F.col(f).cast("string")), F.lit(0))
    return rows.groupBy(*group).agg(*(F.max_by(F.col(f), F.struct(size(f), -F.col(order))).alias(f) for f in fields))


def lookup(df: DataFrame, field: str, table: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """Lookup join: set ``name`` where the field is found, leave it as it is (or null) else."""
    side = table.select(F.col(key).alias("__key"), F.col(value).alias("__value"))
    had = F.col(name) if name in df.columns else F.lit(None)
    return df.join(side, df[field] == F.col("__key"), "left").withColumn(name, F.coalesce("__value", had)).drop("__key", "__value")


def normalised_equals(c: Column, other: Column) -> Column:
    return simplify(c) == simplify(other)


def duplicates(spark, n: int) -> DataFrame:
    """n empty texts."""
    return spark.range(n).select(F.lit("").alias("value"))
