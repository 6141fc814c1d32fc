"""Sort, limit, top-k, keep-first, split and set operations."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sort_stable(df: DataFrame, field: str, order: Sequence[str], default: object = None) -> DataFrame:
    """Ascending, ties in row order; missing values count as ``default`` if one is given."""
    key = F.col(field) if default is None else F.coalesce(F.col(field), F.lit(default))
    return df.orderBy(key.asc(), *order)


def keep_top(df: DataFrame, field: str, order: Sequence[str], keep: int = 10, reverse: bool = False) -> DataFrame:
    """The last ``keep`` rows of the stable sort: the largest, ascending; with ``reverse`` the smallest, descending. Missing counts as 0."""
    key = F.coalesce(F.col(field), F.lit(0))
    back = [F.col(o).desc() for o in order]
    last = df.orderBy(key.asc() if reverse else key.desc(), *back).limit(keep)
    return last.orderBy(key.desc() if reverse else key.asc(), *order)


def keep_first(df: DataFrame, fields: Sequence[str], order: Sequence[str], strict: bool = False) -> DataFrame:
    """The first row of each value; null is a value. One aggregate, so a hot value is combined before the shuffle."""
    if strict:
        df = df.withColumn("__ok", F.when(reduce(lambda a, b: a | b, (F.col(f).isNull() for f in fields)), F.raise_error(F.lit("missing key"))))
        df = df.where(F.col("__ok").isNull()).drop("__ok")
    first = df.groupBy(*(F.col(f).alias(f"__k{i}") for i, f in enumerate(fields))).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("r"))
    return first.select("r.*")


def split_groups(df: DataFrame, field: str, name: str = "group_no") -> DataFrame:
    """Number the groups of a field from 0 in the order of their values; the values join back as a small table."""
    numbered = df.select(field).distinct().withColumn(name, (F.dense_rank().over(Window.orderBy(F.col(field).asc_nulls_last())) - 1).cast("int"))
    return df.join(numbered.withColumnRenamed(field, "__v"), df[field].eqNullSafe(F.col("__v"))).drop("__v")


def split_write(df: DataFrame, field: str, path: str) -> None:
    """One folder per value."""
    df.write.partitionBy(field).parquet(path)


def union_all(tables: Sequence[DataFrame], id_column: str | None = None) -> DataFrame:
    """UNION ALL by name; ``id_column`` gets the number of the input, from 1."""
    if id_column:
        tables = [t.withColumn(id_column, F.lit(i)) for i, t in enumerate(tables, 1)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def union_first(tables: Sequence[DataFrame], field: str, order: Sequence[str]) -> DataFrame:
    """Union of all, the first row of each value of the field stays."""
    return keep_first(union_all(tables, "__input"), [field], ["__input", *order]).drop("__input")


def union_capped(left: DataFrame, right: DataFrame, percent: int, order: Sequence[str], dedup: str | None = None) -> DataFrame:
    """Left and the first rows of right, as many as ``percent`` of left's at most."""
    n = left.count() * percent // 100
    out = union_all([left, right.orderBy(*order).limit(int(n))], "__input")
    return (keep_first(out, [dedup], ["__input", *order]) if dedup else out).drop("__input")


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.exceptAll(right)


def common(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.intersect(right)


def concat_lists(a: Column, b: Column) -> Column:
    return F.concat(a, b)


def merge_workbooks(books: Sequence[dict[str, DataFrame]]) -> dict[str, DataFrame]:
    """Sheets of all workbooks; a later one replaces a sheet of the same name."""
    return reduce(lambda a, b: {**a, **b}, books, {})
