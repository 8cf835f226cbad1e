"""Other systems: databases over JDBC, key-value stores, catalogs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def jdbc(spark: SparkSession, url: str, table: str, columns: list[str] | None = None, where: str | None = None, partition_column: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 1, **properties: str) -> DataFrame:
    """A table of another database, read in ranges of ``partition_column``.

    Column choice and filters are pushed down by Spark; ``where`` goes into the
    remote statement as written.
    """
    source = f"(SELECT * FROM {table} WHERE {where}) t" if where else table
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", source).option("pushDownPredicate", True).option("pushDownAggregate", True).option("pushDownLimit", True).options(**properties)
    if partition_column and bounds:
        reader = reader.option("partitionColumn", partition_column).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", partitions)
    df = reader.load()
    return df.select(*columns) if columns else df


def key_value(keys: DataFrame, connect, key_col: str = "key") -> DataFrame:
    """Values by key from a store: ``connect()`` runs once a task and returns a function from a list of keys to their values."""

    def fetch(batches):
        get = connect()
        for pdf in batches:
            yield pdf.assign(value=get(pdf["key"].tolist()))

    return keys.select(F.col(key_col).cast("string").alias("key")).mapInPandas(fetch, "key string, value string")


def information_schema(spark: SparkSession, what: str, database: str | None = None) -> DataFrame:
    """``schemata``, ``tables`` or ``columns`` of the session's catalog; its names only, so the driver can list them."""
    catalog = spark.catalog
    if what == "schemata":
        return spark.createDataFrame([(d.catalog, d.name) for d in catalog.listDatabases()], "catalog_name string, schema_name string")
    databases = [database] if database else [d.name for d in catalog.listDatabases()]
    tables = [(d, t) for d in databases for t in catalog.listTables(d)]
    if what == "tables":
        return spark.createDataFrame([(d, t.name, t.tableType) for d, t in tables], "table_schema string, table_name string, table_type string")
    if what == "columns":
        rows = []
        for d, t in tables:
            name = t.name if t.isTemporary else f"{d}.{t.name}"
            rows += [(d, t.name, c.name, i, c.dataType, c.nullable) for i, c in enumerate(catalog.listColumns(name), 1)]
        return spark.createDataFrame(rows, "table_schema string, table_name string, column_name string, ordinal_position int, data_type string, is_nullable boolean")
    raise ValueError(f"no information_schema.{what}")


def explain(df: DataFrame, mode: str = "formatted") -> str:
    """The plan as text."""
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))


def statistics(spark: SparkSession, table: str, columns: list[str] | None = None) -> None:
    """ANALYZE: row counts, distinct counts and histograms for the optimizer."""
    what = f"FOR COLUMNS {', '.join(columns)}" if columns else "FOR ALL COLUMNS"
    spark.sql(f"ANALYZE TABLE {table} COMPUTE STATISTICS {what}")
