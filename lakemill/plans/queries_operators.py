"""Queries through the DataFrame operators, each with a DuckDB form."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakemill.operators import relational as rel
from lakemill.operators import search
from lakemill.plans.statements import Engine
from lakemill.plans.tables import DuplicateKey, Tables
from lakemill.sources import external, files
from lakemill.streaming import changes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return register


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share: below the checkpoint folder, or the warehouse where none is named."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/lakemill-{uuid.uuid4().hex}"


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 150000)")
def rel_not_in(spark, sf_dir):
    return rel.not_in(_t(spark, sf_dir, "customer"), _t(spark, sf_dir, "orders").where("o_totalprice > 150000"), "c_custkey", "o_custkey").select("c_custkey")


@query("SELECT p_partkey FROM part WHERE p_size > ALL (SELECT p_size FROM part WHERE p_size < 20)")
def rel_compare_all(spark, sf_dir):
    part = _t(spark, sf_dir, "part")
    return rel.compare_all(part, part.where("p_size < 20").select(F.col("p_size").alias("q")), "p_size", ">", "q").select("p_partkey")


@query("SELECT n_regionkey, string_agg(n_name, ';' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
def rel_group_concat(spark, sf_dir):
    return _t(spark, sf_dir, "nation").groupBy("n_regionkey").agg(rel.group_concat(F.col("n_name"), ";", order=[F.col("n_name")]).alias("names"))


@query("SELECT l_linestatus, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY l_linestatus")
def rel_bitmap_or(spark, sf_dir):
    maps = _t(spark, sf_dir, "lineitem").groupBy("l_linestatus", "l_returnflag").agg(rel.bitmap(F.col("l_suppkey")).alias("b"))
    return rel.bitmap_or(maps, ["l_linestatus"], "b").select("l_linestatus", F.size("bitmap").cast("long").alias("n"))


_GROUPED = "SELECT l_linestatus, l_suppkey, count(DISTINCT l_returnflag) AS k FROM lineitem GROUP BY ALL"


@query(f"SELECT l_linestatus, count(*) FILTER (k % 2 = 1) AS n FROM ({_GROUPED}) GROUP BY l_linestatus")
def rel_bitmap_xor(spark, sf_dir):
    maps = _t(spark, sf_dir, "lineitem").groupBy("l_linestatus", "l_returnflag").agg(rel.bitmap(F.col("l_suppkey")).alias("b"))
    return rel.bitmap_xor(maps, ["l_linestatus"], "b").select("l_linestatus", F.size("bitmap").cast("long").alias("n"))


@query(f"SELECT g.l_linestatus, count(*) FILTER (k = m) AS n FROM ({_GROUPED}) g JOIN (SELECT l_linestatus, count(DISTINCT l_returnflag) AS m FROM lineitem GROUP BY 1) h USING (l_linestatus) GROUP BY g.l_linestatus")
def rel_bitmap_and(spark, sf_dir):
    maps = _t(spark, sf_dir, "lineitem").groupBy("l_linestatus", "l_returnflag").agg(rel.bitmap(F.col("l_suppkey")).alias("b"))
    return rel.bitmap_and(maps, ["l_linestatus"], "b").select("l_linestatus", F.size("bitmap").cast("long").alias("n"))


@query("SELECT event_id, coalesce(lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id), -event_id) AS nxt FROM events")
def window_default(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return _t(spark, sf_dir, "events").select("event_id", rel.shifted(F.col("event_id"), 1, -F.col("event_id"), w).alias("nxt"))


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def merge_on_read(spark, sf_dir):
    return rel.newest(_t(spark, sf_dir, "events"), ["user_id"], "event_id").select("user_id", "event_id")


@query("SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey FROM region")
def rel_union(spark, sf_dir):
    n = _t(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("k"))
    return rel.union(n, _t(spark, sf_dir, "region").select("r_regionkey"), distinct=True)


_TERMS = "SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[A-Za-z0-9_À-ɏ]+')) AS term FROM documents"


@query(f"SELECT id, count(*) AS weight FROM ({_TERMS}) WHERE term IN ('thing', 'zu', 'que') GROUP BY id")
def fulltext_search(spark, sf_dir):
    index = search.postings(_t(spark, sf_dir, "documents"), "doc_id", "text")
    return search.search(index, "thing zu que")


@query(f"SELECT id, count(*) FILTER (term IN ('the', 'and')) AS weight FROM ({_TERMS}) GROUP BY id HAVING count(*) FILTER (term = 'the') > 0 AND count(*) FILTER (term = 'and') > 0 AND count(*) FILTER (term = 'with') = 0")
def fulltext_boolean(spark, sf_dir):
    index = search.postings(_t(spark, sf_dir, "documents"), "doc_id", "text")
    return search.search(index, "+the +and -with", "boolean")


@query("SELECT item_id, length(regexp_replace(text, '\\s', '', 'g')) - 1 AS n FROM benchmark")
def fulltext_bigrams(spark, sf_dir):
    return _t(spark, sf_dir, "benchmark").select("item_id", F.size(search.segments(F.col("text"), "bigram")).cast("long").alias("n"))


def _first_vector(spark, sf_dir) -> list[float]:
    return _t(spark, sf_dir, "embeddings").where("vec_id = 0").first()["embedding"]


_L2 = "list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE)))"
_IP = "list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda x: x[1]::DOUBLE * x[2]::DOUBLE))"


@query(f"SELECT e.vec_id, round({_L2}, 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY {_L2}, e.vec_id LIMIT 10")
def vector_l2(spark, sf_dir):
    return search.nearest(_t(spark, sf_dir, "embeddings"), _first_vector(spark, sf_dir), 10).select("vec_id", F.round("score", 6).alias("score"))


@query(f"SELECT e.vec_id, round({_IP}, 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE e.label < 3 ORDER BY {_IP} DESC, e.vec_id LIMIT 10")
def vector_inner_product(spark, sf_dir):
    return search.nearest(_t(spark, sf_dir, "embeddings"), _first_vector(spark, sf_dir), 10, metric="ip", where=F.col("label") < 3).select("vec_id", F.round("score", 6).alias("score"))


@query()
def vector_approx(spark, sf_dir):
    return search.nearest_approx(_t(spark, sf_dir, "embeddings"), _first_vector(spark, sf_dir), 10)


@query("SELECT n_nationkey, n_name, coalesce(n_regionkey, 0) AS n_regionkey, 'none' AS extra FROM nation")
def csv_defaults(spark, sf_dir):
    path = _scratch(spark)
    files.export_text(_t(spark, sf_dir, "nation"), path, ",")
    return files.read_csv(spark, path, "n_nationkey int, n_name string, n_regionkey int, extra string", defaults={"extra": "'none'"})


@query("SELECT r_regionkey + 1 AS k, upper(r_name) AS name FROM region")
def load_data(spark, sf_dir):
    path = _scratch(spark)
    files.export_text(_t(spark, sf_dir, "region"), path)
    return files.load_data(spark, path, "k int, name string", assignments={"k": "k + 1", "name": "upper(name)"})


@query("SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1")
def partition_scan(spark, sf_dir):
    path = _scratch(spark)
    files.write_parquet(_t(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag"), path, ["l_returnflag"])
    return files.read_parquet(spark, path).where("l_returnflag = 'R'").groupBy("l_returnflag").agg(F.count("*").alias("n"))


def _customers(spark, sf_dir, partitions=None) -> Tables:
    tables = Tables(spark, _scratch(spark))
    tables.create("c", "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double", ["c_custkey"], partitions=partitions)
    tables.insert("c", _t(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal"))
    return tables


_C = "SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer"


@query(f"SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_nationkey = 3 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM ({_C}) WHERE NOT (c_acctbal < 0)")
def dml_update_delete(spark, sf_dir):
    tables = _customers(spark, sf_dir)
    tables.update("c", {"c_acctbal": "c_acctbal + 1"}, "c_nationkey = 3 AND c_acctbal >= 0")
    tables.delete("c", "c_acctbal < 0")
    return tables.read("c")


_NEW = "SELECT c_custkey + 1000 AS c_custkey, 'new' AS c_name, 1 AS c_nationkey, 5.0::DOUBLE AS c_acctbal FROM customer"


@query(f"SELECT * FROM ({_C}) UNION ALL SELECT * FROM ({_NEW}) WHERE c_custkey NOT IN (SELECT c_custkey FROM customer)")
def dml_insert_ignore(spark, sf_dir):
    tables = _customers(spark, sf_dir)
    tables.insert_ignore("c", _t(spark, sf_dir, "customer").selectExpr("c_custkey + 1000 AS c_custkey", "'new' AS c_name", "1 AS c_nationkey", "5D AS c_acctbal"))
    return tables.read("c")


@query(f"SELECT * FROM ({_NEW}) UNION ALL SELECT * FROM ({_C}) WHERE c_custkey NOT IN (SELECT c_custkey + 1000 FROM customer)")
def dml_replace(spark, sf_dir):
    tables = _customers(spark, sf_dir)
    tables.replace("c", _t(spark, sf_dir, "customer").selectExpr("c_custkey + 1000 AS c_custkey", "'new' AS c_name", "1 AS c_nationkey", "5D AS c_acctbal"))
    return tables.read("c")


@query(f"SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey, coalesce(o.c_name, n.c_name) AS c_name, coalesce(o.c_nationkey, n.c_nationkey) AS c_nationkey, CASE WHEN o.c_custkey IS NULL THEN n.c_acctbal WHEN n.c_custkey IS NULL THEN o.c_acctbal ELSE o.c_acctbal + n.c_acctbal END AS c_acctbal FROM ({_C}) o FULL JOIN ({_NEW}) n ON o.c_custkey = n.c_custkey")
def dml_upsert(spark, sf_dir):
    tables = _customers(spark, sf_dir)
    tables.upsert("c", _t(spark, sf_dir, "customer").selectExpr("c_custkey + 1000 AS c_custkey", "'new' AS c_name", "1 AS c_nationkey", "5D AS c_acctbal"), {"c_acctbal": "target.c_acctbal + source.c_acctbal"})
    return tables.read("c")


@query(f"SELECT * FROM ({_C}) WHERE c_nationkey = 7")
def table_partition(spark, sf_dir):
    return _customers(spark, sf_dir, ["c_nationkey"]).partition("c", c_nationkey=7)


@query("SELECT l_returnflag, sum(l_quantity) AS l_quantity FROM lineitem WHERE l_linestatus = 'O' GROUP BY l_returnflag")
def rollup_sum(spark, sf_dir):
    tables = Tables(spark, _scratch(spark))
    tables.create("l", "l_returnflag string, l_linestatus string, l_quantity double", [])
    tables.insert("l", _t(spark, sf_dir, "lineitem"))
    tables.add_rollup("l", "r", ["l_returnflag", "l_linestatus"], ["l_quantity"])
    return tables.aggregate("l", ["l_returnflag"], ["l_quantity"], "l_linestatus = 'O'", ["l_linestatus"])


@query("SELECT l_returnflag, sum(l_quantity) * 2 AS l_quantity FROM lineitem GROUP BY l_returnflag")
def rollup_kept(spark, sf_dir):
    """A rollup takes part in inserts and still answers."""
    tables = Tables(spark, _scratch(spark))
    tables.create("l", "l_returnflag string, l_linestatus string, l_quantity double", [])
    tables.insert("l", _t(spark, sf_dir, "lineitem"))
    tables.add_rollup("l", "r", ["l_returnflag", "l_linestatus"], ["l_quantity"])
    tables.insert("l", _t(spark, sf_dir, "lineitem"))
    if not tables.rollup_for("l", ["l_returnflag"], ["l_quantity"], []):
        raise AssertionError("the rollup is out of use")
    return tables.aggregate("l", ["l_returnflag"], ["l_quantity"])


@query("SELECT 'INSERT' AS event_type, count(*) AS n FROM customer UNION ALL SELECT 'UPDATE', count(*) FROM customer WHERE c_nationkey = 3 UNION ALL SELECT 'DELETE', count(*) FROM customer WHERE c_acctbal < 0")
def change_statements(spark, sf_dir):
    """Statements write the change log themselves."""
    _t(spark, sf_dir, "customer").createOrReplaceTempView("customer")
    log = _scratch(spark)
    engine = Engine(spark, _scratch(spark), log)
    engine.execute("CREATE TABLE c (k BIGINT PRIMARY KEY, nation INT, bal DOUBLE)")
    engine.execute("INSERT INTO c SELECT c_custkey, c_nationkey, c_acctbal FROM customer")
    engine.execute("UPDATE c SET nation = 100 WHERE nation = 3")
    engine.execute("DELETE FROM c WHERE bal < 0")
    return changes.read(spark, f"{log}/c").groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT event_type, count(*) AS n FROM (SELECT CASE WHEN c_acctbal < 0 THEN 'DELETE' ELSE 'UPDATE' END AS event_type FROM customer WHERE c_acctbal < 0 OR c_nationkey = 3) GROUP BY 1")
def change_log(spark, sf_dir):
    before = _t(spark, sf_dir, "customer")
    after = before.where("NOT c_acctbal < 0").withColumn("c_acctbal", F.when(F.col("c_nationkey") == 3, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")))
    log = _scratch(spark)
    changes.append(log, changes.changes(before, after, ["c_custkey"], 100))
    return changes.read(spark, log).groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer WHERE NOT c_acctbal < 0")
def change_apply(spark, sf_dir):
    before = _t(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    after = before.where("NOT c_acctbal < 0").withColumn("c_acctbal", F.when(F.col("c_nationkey") == 3, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")))
    return changes.apply(before, changes.changes(before, after, ["c_custkey"], 100), ["c_custkey"]).select("c_custkey", "c_acctbal")


@query("SELECT table_name, column_name, ordinal_position FROM information_schema.columns WHERE table_name IN ('region', 'nation', 'customer')")
def information_schema(spark, sf_dir):
    for name in ("region", "nation", "customer"):
        _t(spark, sf_dir, name).createOrReplaceTempView(name)
    found = external.information_schema(spark, "columns")
    return found.where("table_name IN ('region', 'nation', 'customer')").select("table_name", "column_name", "ordinal_position")


def _engine(spark, sf_dir) -> Engine:
    """An engine with the customers as a table whose names are unique."""
    _t(spark, sf_dir, "customer").createOrReplaceTempView("customer")
    engine = Engine(spark, _scratch(spark))
    engine.execute("CREATE TABLE c (k BIGINT, name VARCHAR(64), nation INT DEFAULT 7, bal DOUBLE, PRIMARY KEY (k), UNIQUE KEY u (name))")
    engine.execute("INSERT INTO c SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer")
    return engine


_K = "SELECT c_custkey AS k, c_name AS name, c_nationkey AS nation, c_acctbal AS bal FROM customer"


@query(f"SELECT k, name, CASE WHEN k % 3 = 0 THEN nation + 100 ELSE nation END AS nation, bal FROM ({_K}) UNION ALL SELECT k + 1000000, name || 'x', nation, bal FROM ({_K}) WHERE k % 3 = 1")
def dml_upsert_unique(spark, sf_dir):
    """New keys whose unique names are there already update those rows; others are inserted."""
    engine = _engine(spark, sf_dir)
    engine.execute("INSERT INTO c SELECT c_custkey + 1000000, IF(c_custkey % 3 = 0, c_name, concat(c_name, 'x')), c_nationkey, c_acctbal FROM customer WHERE c_custkey % 3 < 2 ON DUPLICATE KEY UPDATE nation = nation + 100")
    return engine.execute("SELECT k, name, nation, bal FROM c")


@query(f"SELECT k, name, nation, bal, 2 AS refused FROM ({_K})")
def dml_update_conflict(spark, sf_dir):
    """An UPDATE that would give two rows one key is refused and changes nothing."""
    engine, refused = _engine(spark, sf_dir), 0
    for statement in ("UPDATE c SET name = 'a'", "UPDATE c SET k = 1 WHERE nation < 3"):
        try:
            engine.execute(statement)
        except DuplicateKey:
            refused += 1
    return engine.execute("SELECT k, name, nation, bal FROM c").withColumn("refused", F.lit(refused))


@query(f"SELECT k, name, CASE WHEN k <= 10 THEN 7 ELSE nation END AS nation, bal FROM ({_K}) WHERE NOT (bal < 0) AND k NOT IN (SELECT k FROM ({_K}) WHERE NOT (bal < 0) ORDER BY bal DESC, k LIMIT 5)")
def dml_statements(spark, sf_dir):
    """DEFAULT, DELETE by order and limit, and data changes in the words of DDL."""
    engine = _engine(spark, sf_dir)
    engine.execute("UPDATE c SET nation = DEFAULT(nation) WHERE k <= 10")
    engine.execute("ALTER TABLE c MODIFY COLUMN DELETE WHERE bal < 0")
    engine.execute("DELETE FROM c ORDER BY bal DESC, k LIMIT 5")
    return engine.execute("SELECT k, name, nation, bal FROM c")


@query("SELECT o_orderkey AS k, o_totalprice AS price FROM orders WHERE o_orderkey % 100 >= 10 AND o_totalprice >= 100000")
def table_range_partitions(spark, sf_dir):
    """RANGE partitions: one is truncated, two are read."""
    _t(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    engine = Engine(spark, _scratch(spark))
    engine.execute("CREATE TABLE o (k BIGINT, price DOUBLE, PRIMARY KEY (k)) PARTITION BY RANGE (price) (PARTITION low VALUES LESS THAN (100000), PARTITION mid VALUES LESS THAN (200000), PARTITION high VALUES LESS THAN MAXVALUE)")
    engine.execute("INSERT INTO o SELECT o_orderkey, o_totalprice FROM orders")
    engine.execute("DELETE FROM o WHERE k % 100 < 10")
    engine.execute("TRUNCATE TABLE o PARTITION (low)")
    return engine.execute("SELECT k, price FROM o PARTITION (mid, high)")


@query("SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 4 = 3")
def table_hash_partitions(spark, sf_dir):
    _t(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    engine = Engine(spark, _scratch(spark))
    engine.execute("CREATE TABLE o (k BIGINT, price DOUBLE, PRIMARY KEY (k)) PARTITION BY HASH (k) PARTITIONS 4")
    engine.execute("INSERT INTO o SELECT o_orderkey, o_totalprice FROM orders")
    return engine.execute("SELECT o.k FROM o PARTITION (p3)")


@query("SELECT c_nationkey AS nation, sum(c_acctbal)::DECIMAL(18, 2)::DOUBLE AS bal, count(*) AS n FROM customer GROUP BY c_nationkey")
def statements_views(spark, sf_dir):
    """CREATE VIEW, ALTER VIEW, PREPARE and EXECUTE."""
    engine = _engine(spark, sf_dir)
    engine.execute("CREATE VIEW v AS SELECT k FROM c")
    engine.execute("ALTER VIEW v AS SELECT nation, bal FROM c")
    engine.execute("PREPARE s FROM 'SELECT nation, round(sum(bal), 2) bal, count(*) n FROM v GROUP BY nation'")
    return engine.execute("EXECUTE s")


@query("SELECT 'k' AS column_name, count(*) AS n_rows, 0 AS n_nulls FROM customer UNION ALL SELECT 'nation', count(*), count(*) FILTER (c_nationkey = 3) FROM customer")
def statements_analyze(spark, sf_dir):
    engine = _engine(spark, sf_dir)
    engine.execute("UPDATE c SET nation = NULL WHERE nation = 3")
    return engine.execute("ANALYZE TABLE c").where("column_name IN ('k', 'nation')").select("column_name", "n_rows", "n_nulls")


@query("SELECT n_nationkey AS k, n_name AS name FROM nation")
def export_and_load(spark, sf_dir):
    """Full export as text, and LOAD DATA of it."""
    path, engine = _scratch(spark), Engine(spark, _scratch(spark))
    files.export_text(_t(spark, sf_dir, "nation").select("n_nationkey", "n_name"), path)
    engine.execute("CREATE TABLE n (k BIGINT PRIMARY KEY, name VARCHAR(64))")
    engine.execute(f"LOAD DATA INFILE '{path}' INTO TABLE n")
    return engine.execute("SELECT k, name FROM n")


@query("SELECT n_regionkey, string_agg(n, ';' ORDER BY n DESC) AS names FROM (SELECT DISTINCT n_regionkey, left(n_name, 1) AS n FROM nation) GROUP BY n_regionkey")
def rel_group_concat_distinct(spark, sf_dir):
    first = F.left(F.col("n_name"), F.lit(1))
    return _t(spark, sf_dir, "nation").groupBy("n_regionkey").agg(rel.group_concat(first, ";", distinct=True, order=[-F.ascii(first)]).alias("names"))
