"""Relational operators that the DataFrame API has no single call for."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# Predicates
def xor(a: Column, b: Column) -> Column:
    """Three-valued exclusive or."""
    return a.cast("boolean") != b.cast("boolean")


def is_true(c: Column) -> Column:
    return F.coalesce(c.cast("boolean"), F.lit(False))


def is_false(c: Column) -> Column:
    """Not true: holds for null as well."""
    return ~is_true(c)


def row_in(left: list[Column], rows: list[tuple]) -> Column:
    """Membership of a tuple in literal tuples."""
    return F.struct(*left).isin([F.struct(*[F.lit(v) for v in r]) for r in rows])


def exact_like(c: Column, pattern: str) -> Column:
    head, tail = ("%" if pattern.startswith("%") else ""), ("%" if pattern.endswith("%") else "")
    return reduce(lambda a, b: a | b, [c.ilike(head + p + tail) for p in pattern.strip("%").split("|")])


# Set operations
def union(*parts: DataFrame, distinct: bool = False) -> DataFrame:
    """Union by position; one DISTINCT makes the whole chain distinct."""
    width = {len(p.columns) for p in parts}
    if len(width) != 1:
        raise ValueError("the parts of a union must have the same number of columns")
    out = reduce(DataFrame.union, parts)
    return out.distinct() if distinct else out


# Joins and subqueries
def not_in(left: DataFrame, right: DataFrame, left_col: str, right_col: str) -> DataFrame:
    """NOT IN with nulls: nothing passes if the right side holds a null; a null passes only an empty right side.

    An anti join on equality, with the two special cases as scalars, shuffles
    both sides by key where a null-aware join would broadcast the right one.
    """
    keys = right.select(F.col(right_col).alias("_key"))
    facts = keys.agg(F.count("*").alias("_all"), F.count("_key").alias("_some"))
    kept = left.join(keys.where("_key IS NOT NULL"), F.col(left_col) == F.col("_key"), "left_anti")
    checked = kept.crossJoin(F.broadcast(facts))  # one row
    return checked.where((F.col("_all") == 0) | ((F.col("_all") == F.col("_some")) & F.col(left_col).isNotNull())).drop("_all", "_some")


def compare_all(left: DataFrame, right: DataFrame, left_col: str, op: str, right_col: str) -> DataFrame:
    """Rows whose value stands in ``op`` (<, <=, >, >=) to all values of ``right``; all rows if there is none."""
    bound = (F.min if op[0] == "<" else F.max)(right_col)
    facts = right.agg(F.count("*").alias("_all"), F.count(right_col).alias("_some"), bound.alias("_bound"))
    test = F.expr(f"`{left_col}` {op} _bound")
    return left.crossJoin(F.broadcast(facts)).where((F.col("_all") == 0) | ((F.col("_all") == F.col("_some")) & test)).drop("_all", "_some", "_bound")


# Aggregates
def group_concat(value: Column, separator: str = ",", distinct: bool = False, order: list[Column] | None = None) -> Column:
    """Join a group's values; nulls are skipped, a group of nulls gives null."""
    text = value.cast("string")
    if order is None:
        return (F.listagg_distinct if distinct else F.listagg)(text, F.lit(separator))
    pair = F.when(text.isNotNull(), F.struct(*[o.alias(f"k{i}") for i, o in enumerate(order)], text.alias("v")))
    items = F.transform(F.array_sort((F.collect_set if distinct else F.collect_list)(pair)), lambda p: p["v"])
    items = F.array_distinct(items) if distinct else items  # each value at its first place
    return F.when(F.size(items) > 0, F.array_join(items, separator))


def count_rows(*columns: Column) -> Column:
    """COUNT(a, b, ...): rows in which no argument is null."""
    return F.count(F.when(reduce(lambda a, b: a & b, [c.isNotNull() for c in columns]), 1))


def bitmap(value: Column) -> Column:
    """A group's values as a bitmap (sorted array)."""
    return F.array_sort(F.collect_set(value.cast("bigint")))


def bitmap_or(df: DataFrame, keys: list[str], column: str, out: str = "bitmap") -> DataFrame:
    """The union of a group's bitmaps, by members, so that no group is held whole before it is reduced."""
    return df.select(*keys, F.explode(column).alias("_m")).groupBy(*keys).agg(bitmap(F.col("_m")).alias(out))


def _members(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    return df.select(*keys, F.explode(column).alias("_m")).groupBy(*keys, "_m").agg(F.count("*").alias("_n"))


def bitmap_xor(df: DataFrame, keys: list[str], column: str, out: str = "bitmap") -> DataFrame:
    """Members of an odd number of a group's bitmaps."""
    return _members(df, keys, column).groupBy(*keys).agg(F.array_sort(F.collect_list(F.when(F.col("_n") % 2 == 1, F.col("_m")))).alias(out))


def bitmap_and(df: DataFrame, keys: list[str], column: str, out: str = "bitmap") -> DataFrame:
    """Members of all of a group's bitmaps."""
    sizes = df.groupBy(*keys).agg(F.count(column).alias("_groups"))
    members = _members(df, keys, column).join(sizes, keys, "right")
    return members.groupBy(*keys).agg(F.array_sort(F.collect_list(F.when(F.col("_n") == F.col("_groups"), F.col("_m")))).alias(out))


# Windows
def constant_order(*partition: str):
    """A window whose ranking functions give 1, as without ORDER BY."""
    return Window.partitionBy(*partition).orderBy(F.lit(0))


def shifted(value: Column, offset: int, default: Column, window, lead: bool = True) -> Column:
    """LEAD or LAG whose default is computed on the current row."""
    move = F.lead if lead else F.lag
    return F.when(move(F.lit(1), offset).over(window).isNull(), default).otherwise(move(value, offset).over(window))


def newest(df: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Merge on read: the row with the highest version of each key."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(version).desc()))
    return df.withColumn("_place", place).where("_place = 1").drop("_place")
