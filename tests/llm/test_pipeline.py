"""The pipeline, stage by stage, against brute force over its own input."""

from collections import defaultdict

from lakemill.llm import bpe, rules, simhash


def test_stages(spark, data, documents, tmp_path):
    import corpus_pipeline

    docs, seen = documents, {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, data).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        seen[name] = (before, docs)
        if i + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == documents.columns
    before, after = seen["quality_rules"]
    assert {r["doc_id"] for r in after.collect()} == {r["doc_id"] for r in rules.score(before).where("kept").collect()}
    before, after = seen["exact_dedup"]
    groups = defaultdict(list)
    for r in before.collect():
        groups["".join(x for x in r["text"] if x not in " \t\n\x0b\x0c\r")].append((-len(r["text"]), r["doc_id"]))
    assert {r["doc_id"] for r in after.collect()} == {min(g)[1] for g in groups.values()}
    before, after = seen["simhash_near_dedup"]
    sets = {r["doc_id"]: set(simhash.shingle_hashes(r["text"], 5).tolist()) for r in before.collect()}
    alike = lambda a, b: len(sets[a] & sets[b]) / max(1, len(sets[a] | sets[b]))
    kept = {r["doc_id"] for r in after.collect()}
    assert kept <= set(sets)
    for i in set(sets) - kept:  # what went is like something that stays or went for it
        assert max(alike(i, j) for j in sets if j != i) > 0.5
    left = [(a, b) for a in kept for b in kept if a < b and alike(a, b) >= 0.85]
    assert not left
    before, after = seen["bpe_tokens"]
    texts = sorted((r["doc_id"], r["text"]) for r in before.collect())
    decoded = bpe.decode(after)
    assert sorted((r["doc_id"], r["decoded"]) for r in decoded.collect()) == texts


def test_awkward_and_empty(spark, data, awkward, empty):
    import corpus_pipeline

    for df in (awkward, empty):
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            df = stage(spark, df, data)
            if i + 1 < len(corpus_pipeline.STAGES):
                assert set(df.columns) >= {"doc_id", "text", "lang", "source", "n_chars"}
        assert df.count() >= 0


def test_registered(spark):
    import __spark_entry__

    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def test_near_dedup_exact(spark, data, documents):
    """The survivors are the least ids of the components of all pairs of similarity 0.8 or more, no others."""
    import corpus_pipeline

    rows = documents.collect()
    sets = {r["doc_id"]: set(simhash.shingle_hashes(r["text"] or "", 5).tolist()) for r in rows}
    root = {i: i for i in sets}
    for i in sorted(sets):
        for j in sets:
            both = len(sets[i] & sets[j])
            if j < i and root[i] != root[j] and (5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both)):
                low, high = sorted((root[i], root[j]))
                root = {x: low if r == high else r for x, r in root.items()}
    kept = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, documents, data).collect()}
    assert kept == {i for i, r in root.items() if i == r}


def test_near_dedup_by_simhash(spark, data, monkeypatch):
    """All links of the stage come through the tries of SimHashes: without an error budget none is left."""
    import corpus_pipeline

    words = [[f"w{k}x{i}" for i in range(60)] for k in range(8)]
    rows = [(2 * k + j, " ".join(w[: 60 - 3 * j])) for k, w in enumerate(words) for j in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = lambda: {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, data).collect()}
    assert kept() == set(range(0, 16, 2))
    monkeypatch.setattr(simhash, "WIDE_BUDGET", -1)
    assert kept() == set(range(16))
