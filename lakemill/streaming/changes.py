"""Change streams: a log of row changes and its readers.

A change is (commit_ts, seq, event_type, key, before, after), with the images as
JSON text; ``seq`` orders changes of one commit time.  The log is Parquet in folders by commit second, written by the statement
that makes the change; a reader is a file stream with the commit time as offset.
Delivery is at least once and :func:`apply` is idempotent, so a table that
follows a log ends in the same state however often a batch is repeated.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "commit_ts long, seq long, event_type string, key string, before string, after string"


def _image(columns: list[str], side: str) -> Column:
    return F.to_json(F.struct(*[F.col(f"{side}.`{c}`").alias(c) for c in columns]), {"ignoreNullFields": "false"})


def changes(before: DataFrame, after: DataFrame, key: list[str], commit_ts: int, seq: int = 0) -> DataFrame:
    """The changes between two states of a table."""
    columns = before.columns
    b, a = before.withColumn("_b", F.lit(True)).alias("b"), after.withColumn("_a", F.lit(True)).alias("a")
    both = b.join(a, [F.col(f"b.`{k}`").eqNullSafe(F.col(f"a.`{k}`")) for k in key], "full")
    kind = F.when(F.col("_b").isNull(), "INSERT").when(F.col("_a").isNull(), "DELETE").otherwise("UPDATE")
    rows = both.select(F.lit(commit_ts).cast("long").alias("commit_ts"), F.lit(seq).cast("long").alias("seq"), kind.alias("event_type"), F.to_json(F.struct(*[F.coalesce(F.col(f"a.`{k}`"), F.col(f"b.`{k}`")).alias(k) for k in key])).alias("key"), F.when(F.col("_b").isNotNull(), _image(columns, "b")).alias("before"), F.when(F.col("_a").isNotNull(), _image(columns, "a")).alias("after"))
    return rows.where("NOT (before <=> after)")


def append(log: str, rows: DataFrame) -> None:
    rows.write.mode("append").parquet(log)


def read(spark: SparkSession, log: str, since: int = 0) -> DataFrame:
    """The changes from ``since`` on, in commit order."""
    return spark.read.schema(SCHEMA).parquet(log).where(F.col("commit_ts") >= since).orderBy("commit_ts", "seq", "key")


def subscribe(spark: SparkSession, log: str, since: int = 0, files_per_batch: int = 1000) -> DataFrame:
    """The log as a stream."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(log).where(F.col("commit_ts") >= since)


def follow(stream: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None], once: bool = True) -> StreamingQuery:
    """Give each batch of changes to ``handle``, sorted by commit."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: handle(df.orderBy("commit_ts", "seq", "key"), n))
    return (writer.trigger(availableNow=True) if once else writer).start()


def apply(base: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """The state after ``rows``: the last image of each changed key, and all other rows as they were."""
    last = F.row_number().over(Window.partitionBy("key").orderBy(F.col("commit_ts").desc(), F.col("seq").desc()))
    newest = rows.withColumn("_place", last).where("_place = 1")
    keys = newest.select(F.from_json("key", base.select(*key).schema).alias("k")).select("k.*")
    images = newest.where("event_type <> 'DELETE'").select(F.from_json("after", base.schema).alias("r")).select("r.*")
    same = [base[k].eqNullSafe(keys[k]) for k in key]
    return base.join(keys, same, "left_anti").unionByName(images)


def subscribe_with_snapshot(snapshot: DataFrame, stream: DataFrame, key: list[str], checkpoint: str, handle: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """A base subscription: the snapshot's rows as inserts at time 0, then the stream."""
    first = changes(snapshot.limit(0), snapshot, key, 0)
    handle(first, -1)
    return follow(stream, checkpoint, handle)


def alive(df: DataFrame, column: str, ttl_seconds: int) -> DataFrame:
    """Rows whose time to live is not over."""
    return df.where(F.col(column).cast("timestamp") + F.expr(f"INTERVAL {int(ttl_seconds)} SECOND") > F.current_timestamp())
