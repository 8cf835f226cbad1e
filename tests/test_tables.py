"""Tables, sources and change streams by the state they leave."""

import pytest
from pyspark.sql import functions as F

from lakemill.operators import relational as rel
from lakemill.operators import search
from lakemill.plans.tables import DuplicateKey, Tables
from lakemill.sources import external, files
from lakemill.streaming import changes


@pytest.fixture
def tables(spark, tmp_path):
    t = Tables(spark, str(tmp_path / "db"))
    t.create("t", "id int, name string, n bigint", ["id"], unique=[["name"]], defaults={"n": "7"})
    t.insert("t", spark.sql("SELECT * FROM VALUES (1, 'a', 10L), (2, 'b', 20L), (3, 'c', 30L) AS v(id, name, n)"))
    return t


def state(t, name="t"):
    return sorted(tuple(r) for r in t.read(name).collect())


def rows(spark, values, names="id, name, n"):
    return spark.sql(f"SELECT * FROM VALUES {values} AS v({names})")


def test_insert_refuses_duplicates_and_leaves_no_trace(spark, tables):
    before = state(tables)
    for bad in ("(1, 'z', 1L)", "(9, 'a', 1L)", "(8, 'x', 1L), (8, 'y', 1L)"):
        with pytest.raises(DuplicateKey):
            tables.insert("t", rows(spark, bad))
    assert state(tables) == before


def test_insert_kinds(spark, tables):
    tables.insert("t", rows(spark, "(4, 'd')", "id, name"))
    assert (4, "d", 7) in state(tables)
    tables.insert_ignore("t", rows(spark, "(1, 'z', 1L), (5, 'e', 5L)"))
    assert len(state(tables)) == 5
    tables.replace("t", rows(spark, "(1, 'b', 99L)"))  # drives out 1 by its id and 2 by its name
    assert state(tables) == [(1, "b", 99), (3, "c", 30), (4, "d", 7), (5, "e", 5)]
    tables.upsert("t", rows(spark, "(3, 'c', 1L), (6, 'f', 6L)"), {"n": "target.n + source.n"})
    assert (3, "c", 31) in state(tables) and (6, "f", 6) in state(tables)
    tables.insert_merge("t", rows(spark, "(3, 'c', 9L)"), ["n"])
    assert (3, "c", 40) in state(tables)


def test_update_delete_truncate(spark, tables):
    tables.update("t", {"n": "n + 1"}, "n >= 10", [F.col("n").desc()], 1)
    assert state(tables) == [(1, "a", 10), (2, "b", 20), (3, "c", 31)]
    tables.delete("t", "n > 0", [F.col("n")], 2)
    assert state(tables) == [(3, "c", 31)]
    tables.truncate("t")
    assert state(tables) == []


def test_ddl(spark, tables):
    tables.add_column("t", "m", "int")
    tables.add_column("t", "k", "int", "5")
    assert state(tables)[0] == (1, "a", 10, None, 5)
    tables.modify_column("t", "k", "string", "kk")
    tables.drop_column("t", "m")
    assert state(tables)[0] == (1, "a", 10, "5")
    tables.drop("t")
    assert tables.names() == []
    tables.restore("t")
    tables.rename("t", "u")
    assert tables.names() == ["u"] and len(state(tables, "u")) == 3


def test_partitions_and_rollup(spark, tmp_path):
    t = Tables(spark, str(tmp_path))
    t.create("p", "a int, b int, v bigint", [], partitions=["a"])
    t.insert("p", rows(spark, "(1, 1, 5L), (1, 2, 6L), (2, 1, 7L)", "a, b, v"))
    assert t.partition("p", a=1).count() == 2
    t.add_rollup("p", "r", ["a", "b"], ["v"])
    assert t.rollup_for("p", ["a"], ["v"], ["b"]) and not t.rollup_for("p", ["v"], ["v"], [])
    assert sorted(map(tuple, t.aggregate("p", ["a"], ["v"]).collect())) == [(1, 11), (2, 7)]
    t.truncate("p", a=1)
    assert t.rollup_for("p", ["a"], ["v"], []) is None  # the table has changed since
    assert sorted(map(tuple, t.aggregate("p", ["a"], ["v"]).collect())) == [(2, 7)]


def test_ttl(spark, tmp_path):
    t = Tables(spark, str(tmp_path))
    t.create("e", "id int, at timestamp", ["id"], ttl=("at", 3600))
    t.insert("e", spark.sql("SELECT 1 AS id, current_timestamp() AS at UNION ALL SELECT 2, current_timestamp() - INTERVAL 2 HOUR"))
    assert [r[0] for r in t.read("e").collect()] == [1]


def test_csv_and_load(spark, tmp_path):
    (tmp_path / "day=1").mkdir()
    (tmp_path / "day=1" / "x.csv").write_text("1,a\n2,b,9,extra\nx,c,3\n")
    got = files.read_csv(spark, str(tmp_path), "id int, name string, n int", defaults={"n": "7"})
    assert sorted(map(tuple, got.collect()), key=str) == [(1, "a", 7, 1), (2, "b", 9, 1), (None, "c", 3, 1)]
    (tmp_path / "l.txt").write_text("head\nhead\n1\tq\n2\tr\n")
    got = files.load_data(spark, str(tmp_path / "l.txt"), "id int, name string", ignore=2, assignments={"id": "id * 10"})
    assert sorted(map(tuple, got.collect())) == [(10, "q"), (20, "r")]
    assert len(list(files.export(got))) == 2


def test_change_stream_is_idempotent(spark, tmp_path):
    a = rows(spark, "(1, 'a', 1L), (2, 'b', 2L)")
    b = rows(spark, "(2, 'b', 5L), (3, 'c', 3L)")
    log = str(tmp_path / "log")
    changes.append(log, changes.changes(a, b, ["id"], 10))
    seen = []

    def handle(df, n):
        seen.append(sorted(r[0] for r in changes.apply(changes.apply(a, df, ["id"]), df, ["id"]).collect()))

    changes.follow(changes.subscribe(spark, log), str(tmp_path / "ck"), handle).awaitTermination()
    assert seen == [[2, 3]]
    assert [r["event_type"] for r in changes.read(spark, log, 10).orderBy("key").collect()] == ["DELETE", "UPDATE", "INSERT"]
    assert changes.read(spark, log, 11).count() == 0


def test_predicates_and_sets(spark):
    df = spark.sql("SELECT * FROM VALUES (true), (false), (CAST(NULL AS BOOLEAN)) AS t(x)")
    assert df.select(rel.is_false(F.col("x"))).collect() == [(False,), (True,), (True,)]
    assert df.select(rel.xor(F.col("x"), F.lit(True))).collect() == [(False,), (True,), (None,)]
    with pytest.raises(ValueError):
        rel.union(df, df.withColumn("y", F.lit(1)))
    left = spark.sql("SELECT * FROM VALUES (1), (CAST(NULL AS INT)) AS t(a)")
    right = spark.sql("SELECT * FROM VALUES (2) AS t(b)")
    assert rel.not_in(left, right, "a", "b").collect() == [(1,)]
    assert rel.not_in(left, right.where("b > 5"), "a", "b").count() == 2
    assert rel.not_in(left, right.union(spark.sql("SELECT CAST(NULL AS INT)")), "a", "b").count() == 0


def test_search(spark, tmp_path):
    docs = spark.sql("SELECT * FROM VALUES (1, 'Red fox ＦＯＸ'), (2, 'blue fox'), (3, NULL), (4, '中文 text') AS t(id, text)")
    index = search.postings(docs, "id", "text")
    assert sorted(map(tuple, search.search(index, "fox red").collect())) == [(1, 3), (2, 1)]
    assert [r[0] for r in search.search(index, "+fox -red", "boolean").collect()] == [2]
    assert [r[0] for r in search.search(index, "文", "all").collect()] == [4]
    assert search.search(index, "").count() == 0
    search.write_index(docs, str(tmp_path / "i"), "id", "text")
    assert search.search(search.read_index(spark, str(tmp_path / "i")), "blue").count() == 1


def test_vector_recall(spark, data):
    df = spark.read.parquet(f"{data}/embeddings.parquet")
    found = 0
    for r in df.limit(5).collect():
        exact = {x[0] for x in search.nearest(df, r["embedding"], 10).collect()}
        found += len(exact & {x[0] for x in search.nearest_approx(df, r["embedding"], 10, width=4.0, tables=10).collect()})
    assert found >= 25


def test_vector_recall_registered(spark, data):
    """At the parameters of vector_approx, recall at 10 over all ids divisible by 100."""
    df = spark.read.parquet(f"{data}/embeddings.parquet")
    queries = df.where("vec_id % 100 = 0").collect()
    found = 0
    for r in queries:
        exact = {x[0] for x in search.nearest(df, r["embedding"], 10).collect()}
        found += len(exact & {x[0] for x in search.nearest_approx(df, r["embedding"], 10).collect()})
    assert queries and found >= 0.9 * 10 * len(queries)


def test_information_schema(spark):
    spark.range(1).createOrReplaceTempView("info_v")
    assert external.information_schema(spark, "schemata").count() >= 1
    assert external.information_schema(spark, "tables").where("table_name = 'info_v'").count() == 1
    assert "Physical Plan" in external.explain(spark.range(1))
