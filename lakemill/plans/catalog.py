"""All registered queries of the engine and their DuckDB forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakemill.plans import queries_dialect, queries_operators

Query = Callable[[SparkSession, str], DataFrame]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue by market segment."""
    t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    joined = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy("c_mktsegment").agg(F.count("*").alias("n_lines"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


QUERIES: dict[str, Query] = {"flagship_revenue": flagship} | queries_dialect.QUERIES | queries_operators.QUERIES
ORACLE: dict[str, str] = {"flagship_revenue": "SELECT c_mktsegment, count(*) AS n_lines, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment"} | queries_dialect.ORACLE | queries_operators.ORACLE

#: What the benchmark runs.
HEADLINE = ["flagship_revenue", "agg_pricing", "join_five", "agg_multi_distinct", "window_frames", "sub_exists", "fulltext_search", "vector_l2", "rollup_sum", "fn_datetime"]
