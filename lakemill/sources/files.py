"""File sources and sinks."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType, sep: str = ",", defaults: dict[str, str] | None = None, header: bool = False, quote: str = '"', escape: str = "\\", null: str = "\\N") -> DataFrame:
    """Delimited text with a declared schema.

    Missing trailing fields take their default (an SQL expression), extra ones
    are dropped, fields that do not fit their type are null, and columns of
    ``name=value`` folders in the path are read as partitions.
    """
    declared = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in declared])
    reader = spark.read.schema(text).option("sep", sep).option("quote", quote).option("escape", escape).option("header", header).option("mode", "PERMISSIVE").option("nullValue", null).option("enforceSchema", True)
    df = reader.csv(path)
    return _typed(df, declared, defaults or {})


def _typed(df: DataFrame, declared: T.StructType, defaults: dict[str, str]) -> DataFrame:
    kept = [c for c in df.columns if c not in declared.names]
    cells = [F.coalesce(F.col(f"`{f.name}`").try_cast(f.dataType), F.expr(defaults[f.name]).cast(f.dataType)) if f.name in defaults else F.col(f"`{f.name}`").try_cast(f.dataType) for f in declared]
    return df.select(*[c.alias(f.name) for c, f in zip(cells, declared, strict=True)], *kept)


def load_data(spark: SparkSession, path: str, schema: str, fields: str = "\t", enclosed: str = '"', escaped: str = "\\", lines: str = "\n", ignore: int = 0, assignments: dict[str, str] | None = None) -> DataFrame:
    """LOAD DATA INFILE: the rows to insert.

    ``ignore`` skips first lines of every file, counted by their place in it;
    ``assignments`` are SET expressions over the fields.
    """
    declared = T.StructType.fromDDL(schema)
    raw = spark.read.option("lineSep", lines).text(path)
    if ignore:
        # A row limit on the window runs in each task first, so that only first lines are shuffled; they go by an anti join.
        raw = raw.select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_n"))
        place = F.row_number().over(Window.partitionBy("_file").orderBy("_at", "_n"))
        first = raw.select("_file", "_at", "_n").withColumn("_line", place).where(F.col("_line") <= ignore)
        raw = raw.join(first.select("_n"), "_n", "left_anti").select("value")
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in declared])
    cells = F.from_csv("value", text.simpleString()[7:-1].replace(":", " ").replace(",", ", "), {"sep": fields, "quote": enclosed, "escape": escaped, "nullValue": "\\N", "mode": "PERMISSIVE"})
    df = _typed(raw.select(cells.alias("c")).select("c.*"), declared, {})
    for name, e in (assignments or {}).items():
        df = df.withColumn(name, F.expr(e))
    return df


def read_parquet(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Parquet with filter and column pushdown; the schema is that of the files or a declared one, never merged."""
    reader = spark.read.option("mergeSchema", False)
    return (reader.schema(schema) if schema else reader).parquet(path)


def write_parquet(df: DataFrame, path: str, partitions: list[str] | None = None, mode: str = "errorifexists") -> None:
    """One file for each task and partition value; no shuffle, so a large partition is written by many tasks."""
    writer = df.write.mode(mode)
    (writer.partitionBy(*partitions) if partitions else writer).parquet(path)


def export(df: DataFrame) -> Iterator[Row]:
    """All rows in bounded memory: one partition after another on the driver."""
    yield from df.toLocalIterator(prefetchPartitions=True)


def export_text(df: DataFrame, path: str, sep: str = "\t", null: str = "\\N") -> None:
    """SELECT ... INTO OUTFILE, as a folder of files."""
    df.write.option("sep", sep).option("nullValue", null).option("header", False).csv(path)
