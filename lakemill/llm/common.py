"""Helpers that the training-data operators share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters; everything else belongs to a word.
ASCII_SPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
#: Order value of a null id: after every real one.
LAST_ID = 2**63 - 1


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it.

    On a cluster the package is installed on every node (or shipped with
    ``--py-files``); the entry below is then a harmless addition to the path.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    have = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in have.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (have, root) if x)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it.

    Only where ``spark.checkpoint.dir`` is unset in a local session, as in a test,
    a temporary folder takes its place; a cluster must name one.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
        return named.rstrip("/")
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="lakemill-"))
    return sc.getCheckpointDir().rstrip("/")


def fresh_folder(spark: SparkSession, kind: str) -> str:
    """A name for a new folder below the shared one."""
    return f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and cut its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def text_of(column: str = "text") -> Column:
    """The text, with null as the empty string."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def n_words(column: Column) -> Column:
    """The number of words; 0 for null."""
    return F.coalesce(F.regexp_count(column, F.lit(WORD)), F.lit(0)).cast("long")


def batches_of_rows(batches: Iterator, limit: int = 16 << 20) -> Iterator:
    """Cut Arrow batches to about ``limit`` bytes, one row at least, so that long texts can't pile up in a worker."""
    for batch in batches:
        if not batch.num_rows:
            continue
        step = max(1, int(batch.num_rows * limit / max(batch.nbytes, 1)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def whole_blocks(batches: Iterator) -> Iterator[pa.Table]:
    """Sorted batches as tables that hold whole blocks (runs of equal first values)."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        block = batch.column(0).to_numpy()
        last = int(np.searchsorted(block, block[-1]))  # blocks before the last one are complete
        if last or (held and held[-1].column(0)[-1].as_py() != block[0]):
            held.append(batch.slice(0, last))
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _stars(batches: Iterator) -> Iterator:
    """The links of a task contracted, some at a time: each node's link goes to the least node that it is connected to."""
    for batch in _joined_batches(batches, 1 << 19):
        names, at = np.unique(np.r_[batch.column(0).to_numpy(), batch.column(1).to_numpy()], return_inverse=True)
        x, y = at[: batch.num_rows], at[batch.num_rows :]
        up = np.arange(len(names))
        while True:
            low = np.minimum(up[x], up[y])
            if (up[x] == low).all() and (up[y] == low).all():
                break
            for k in (x, y):
                np.minimum.at(up, up[k], low)
                np.minimum.at(up, k, low)
            up = up[up]
        up = up[up]
        some = np.flatnonzero(up != np.arange(len(names)))
        yield pa.RecordBatch.from_arrays([pa.array(names[up[some]], pa.int64()), pa.array(names[some], pa.int64())], names=["a", "b"])


def _joined_batches(batches: Iterator, rows: int) -> Iterator:
    """Batches of about so many rows."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every linked node, root being the least node of its component.

    Tasks contract what links they have.  Then large-star and small-star steps
    follow in turn; each writes its links to the shared folder, and they end when
    the links are stars.  All steps aggregate before they shuffle, and join.
    """
    links = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b")
    links = checkpointed(links.mapInArrow(_stars, "a long, b long"))
    while True:
        # A node that hangs below two others, or below one and above another, is in no star yet.
        ends = links.select(F.col("b").alias("node"), F.col("a").alias("least"), F.col("a").alias("most")).union(links.select("a", F.lit(None).cast("long"), F.lit(None).cast("long")))
        seen = ends.groupBy("node").agg(F.min("least").alias("least"), F.max("most").alias("most"), F.count("*").alias("n"), F.count("least").alias("below"))
        if not seen.where("least < most OR (below > 0 AND n > below)").limit(1).count():
            return links.select(F.col("b").alias("node"), F.col("a").alias("root")).union(links.select("a", "a")).distinct()
        both = links.union(links.select("b", "a")).toDF("u", "v")
        # Large star: neighbours above u go to the least of u and its neighbours.
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        low = low.select("u", F.least("u", "m").alias("m"))
        star = both.where("v > u").join(low, "u").select("m", "v").where("m < v").toDF("a", "b")
        # Small star: u and its neighbours below it go to the least of them.
        down = star.groupBy("b").agg(F.min("a").alias("m"))
        star = star.join(down, "b").select("m", F.when(F.col("a") == F.col("m"), F.col("b")).otherwise(F.col("a")).alias("x")).where("m < x").distinct().toDF("a", "b")
        links = checkpointed(star)
