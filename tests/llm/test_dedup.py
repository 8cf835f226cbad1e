"""Exact, near and substring deduplication against brute force."""

import hashlib
import random
from collections import defaultdict
from fractions import Fraction
from math import comb

import numpy as np
import pyarrow as pa
import pytest

from lakemill.llm import alike, exact, simhash, substrings
from lakemill.llm.common import components

SPACE = dict.fromkeys(map(ord, " \t\n\x0b\x0c\r"))
LAST = 2**63 - 1


def order(i):
    return LAST if i is None else i


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(SPACE)].append((-len(t or ""), order(i), i))
    out = []
    for norm, members in groups.items():
        members.sort(key=lambda m: m[:2])
        for k, m in enumerate(members):
            out.append((m[2], members[0][2], len(members), k == 0, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("bits", [256, 4])
def test_exact(awkward, documents, bits):
    """With four bits nearly all digests collide, and the texts themselves must tell."""
    for df in (awkward, documents.select("doc_id", "text")):
        rows = [(r["doc_id"], r["text"]) for r in df.collect()]
        assert sorted(map(tuple, exact.report(df, digest_bits=bits).collect()), key=repr) == sorted(((*x[:4], x[4][: bits // 4]) for x in brute_exact(rows)), key=repr)


def test_exact_survivors(awkward, documents, empty):
    for df in (awkward, documents):
        want = sorted((repr(x[0]) for x in brute_exact([(r["doc_id"], r["text"]) for r in df.collect()]) if x[3]))
        got = exact.survivors(df)
        assert got.columns == df.columns
        assert sorted(repr(r["doc_id"]) for r in got.collect()) == want
    assert exact.report(empty).count() == 0 and exact.survivors(empty).count() == 0


def test_exact_hot_group(spark):
    df = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'same text' ELSE concat('t', id) END AS text")
    rows = exact.report(df).where("group_size > 1").collect()
    assert {r["group_size"] for r in rows} == {1000} and {r["keep_id"] for r in rows} == {0} and sum(r["kept"] for r in rows) == 1


def brute_components(values, budget):
    values = sorted(set(values))
    root = {v: v for v in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if (a ^ b).bit_count() <= budget and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {v: find(v) for v in values}


def test_fingerprint_definition():
    import xxhash

    text = "The quick brown FOX jumps the quick brown fox Äpfel"
    words = text.encode().lower().split()
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(len(words) - 2)]
    want = sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))
    assert simhash.fingerprint(text) == want
    assert simhash.fingerprint("") == simhash.fingerprint(" \n") == 0
    assert simhash.fingerprint("Two words") == xxhash.xxh64_intdigest(b"two words", 42)


def test_trie_join(monkeypatch):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(30)]
    values = {b ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 3))) for b in base for _ in range(20)} | set(range(200))
    prints = np.array(sorted(values), np.uint64)
    want = len(prints) - len(set(brute_components(map(int, prints), 2).values()))
    for frontier in (1 << 17, 3):
        monkeypatch.setattr(simhash, "FRONTIER", frontier)
        a, b = simhash.trie_links(prints)
        assert all((int(prints[x]) ^ int(prints[y])).bit_count() <= 2 for x, y in zip(a, b, strict=True))
        assert len(a) == want


def test_trie_visits(spark):
    """On real fingerprints the join goes down the tries and gives most node pairs up; the links are those of brute force."""
    texts = [r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    prints = np.unique(np.array([simhash.fingerprint(t) for t in texts], np.uint64))
    visits = simhash.Visits()
    a, b = simhash.trie_links(prints, visits=visits)
    n = len(prints)
    apart = np.bitwise_count(prints[:, None] ^ prints[None])
    x, y = np.nonzero(np.triu(apart <= 2, 1))
    assert len(a) == len(simhash.forest(n, x, y)) and (apart[a, b] <= 2).all()
    assert visits.pruned > visits.single > 0 and n < visits.visited and visits.single < n * (n - 1) // 20


@pytest.mark.parametrize("part_rows", [20_000, 2])
def test_near_links(spark, part_rows):
    """Small parts are dealt out again and again, and no link is lost."""
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(25)]
    values = sorted({b ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 3))) for b in base for _ in range(15)})
    df = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    roots = {r["node"] % 2**64: r["root"] % 2**64 for r in components(simhash.near_links(df, part_rows=part_rows)).collect()}
    want = brute_components(values, 2)
    groups = lambda f: {frozenset(v for v in values if f(v) == k) for k in map(f, values)}
    assert groups(lambda v: roots.get(v, v)) == groups(want.get)


def test_near_duplicates(awkward, documents, empty):
    for df in (awkward, documents):
        rows = simhash.near_duplicates(df).collect()
        prints = [simhash.fingerprint(r["text"] or "") for r in df.collect()]
        root = brute_components(prints, 2)
        least = {}
        for r, p in zip(df.collect(), prints, strict=True):
            least[root[p]] = min(least.get(root[p], LAST), order(r["doc_id"]))
        want = [(r["doc_id"], f"{p:016x}", None if least[root[p]] == LAST else least[root[p]]) for r, p in zip(df.collect(), prints, strict=True)]
        assert sorted(map(tuple, rows), key=repr) == sorted(want, key=repr)
        kept = simhash.survivors(df)
        assert kept.columns == df.columns and kept.count() == len(set(root.values()))
    assert simhash.near_duplicates(empty).count() == 0 and simhash.survivors(empty).count() == 0


def brute_repeats(rows):
    coded = sorted(((order(i), (t or "").encode()) for i, t in rows), key=lambda r: r[0])
    first = {}
    for i, b in coded:
        for k in range(len(b) - 49):
            first.setdefault(b[k : k + 50], i)
    out = []
    for i, b in coded:
        gone, spans = bytearray(len(b)), 0
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        spans = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        out.append((None if i == LAST else i, len(b), sum(gone), spans, bytes(c for c, g in zip(b, gone, strict=True) if not g)))
    return sorted(out, key=repr)


def test_wide_survivors(spark, awkward, empty):
    """Near copies of similarity 0.8 or more go, other texts stay."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    rows, near = [], 0
    for k in range(120):
        words = [word() for _ in range(rng.randint(80, 400))]
        rows.append((k * 2, " ".join(words)))
        if k % 2:
            rows.append((k * 2 + 1, " ".join(words[: len(words) * 19 // 20])))
            near += 1
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for part_rows in (20_000, 3):
        left = {r["doc_id"] for r in simhash.survivors(df, size=5, wide=True, part_rows=part_rows).collect()}
        assert all(k * 2 in left for k in range(120))
        assert sum(i % 2 for i in left) <= 0.05 * near
    assert simhash.survivors(awkward, size=5, wide=True).columns == awkward.columns
    assert simhash.survivors(empty, size=5, wide=True).count() == 0


def brute_alike(rows, size=5):
    """Root of each text: components of all pairs of shingle sets of Jaccard similarity 0.8 or more."""
    sets = {i: set(alike.shingle_hashes(t, size).tolist()) for i, t in rows}
    root = dict.fromkeys(sets)
    order = sorted(sets)
    for i in order:
        root[i] = i
    for k, i in enumerate(order):
        for j in order[:k]:
            both = len(sets[i] & sets[j])
            if root[i] != root[j] and 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                low, high = sorted((root[i], root[j]))
                root = {x: low if r == high else r for x, r in root.items()}
    return root


def planted(rng, low, high, families, n=120):
    """Pairs (2k, 2k + 1) of texts whose five-word shingle similarity is from low to high."""
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows = []
    for k in range(families):
        want, base = rng.uniform(low, high), [word() for _ in range(n + rng.randint(0, 2 * n))]
        sets = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        alike = lambda w: len(sets(w) & sets(base)) / len(sets(w) | sets(base))  # noqa: E731, B023
        other = list(base)
        while alike(other) > want:
            before, other = other, list(other)
            other[rng.randrange(len(other))] = word()
        if alike(other) < low:  # one word too many
            other = before
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(other))]
    return rows


def survived(spark, rows, **how):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    return {r["doc_id"] for r in simhash.survivors(df, size=5, wide=True, **how).collect()}


def test_wide_finds_all(spark):
    """Each near copy of similarity 0.80 to 0.85 goes."""
    rows = planted(random.Random(11), 0.80, 0.85, 300)
    assert {i for i, r in brute_alike(rows).items() if i == r} == set(range(0, 600, 2))
    assert survived(spark, rows) == set(range(0, 600, 2))


def test_wide_leaves_others(spark):
    """Texts of similarity 0.60 to 0.79 stay, also as members of a large family around one template."""
    rng = random.Random(12)
    rows = planted(rng, 0.60, 0.79, 150)
    template = [f"t{k}" for k in range(100)]
    rows += [(1000 + k, " ".join([*template, *(f"u{k}x{j}" for j in range(20))])) for k in range(60)]
    assert all(i == r for i, r in brute_alike(rows).items())
    assert survived(spark, rows) == {i for i, _ in rows}


@pytest.mark.parametrize("part_rows", [20_000, 3])
def test_wide_crowded(spark, part_rows):
    """Families of more copies than a block may have are joined whole: the survivors are those of brute force."""
    rng = random.Random(13)
    rows = []
    for family in range(4):
        base = [f"w{family}x{rng.randrange(10**6)}" for _ in range(100)]
        for _ in range(60):
            words = list(base)
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = f"n{rng.randrange(30)}"
            rows.append((len(rows), " ".join(words[: rng.randint(85, 100)])))
    rng.shuffle(rows)
    assert survived(spark, rows, part_rows=part_rows) == {i for i, r in brute_alike(rows).items() if i == r}


def test_wide_rounds(spark, monkeypatch):
    """Families around the threshold, of which a set names one partner a round: the rest is settled by whole sets."""
    rng = random.Random(14)
    rows = []
    for family in range(3):
        base = [f"w{family}x{k}" for k in range(150)]
        for _ in range(40):
            words = list(base)
            for _ in range(rng.randint(1, 4)):
                words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(words)))
    want = {i for i, r in brute_alike(rows).items() if i == r}
    asked = []
    settled = alike._settled
    monkeypatch.setattr(alike, "_settled", lambda size: asked.append(size) or settled(size))
    assert 3 < len(want) < 100 and survived(spark, rows) == want
    monkeypatch.setattr(alike, "PARTNERS", (1, 1))
    assert survived(spark, rows) == want and asked


def test_parity_bound():
    """Parity fingerprints never differ in more bits than the sets in members, also when one is folded."""
    rng = np.random.Generator(np.random.PCG64(15))
    for n in (3, 300, 600, 3000, 9000):
        x = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        y = np.unique(np.r_[x[rng.random(len(x)) < 0.9], rng.integers(0, 2**63, n // 10 + 1, dtype=np.uint64)])
        table = pa.table({"block": [1, 1], "fp": [1, 2], "sizes": [len(x) << 32 | len(x), len(y) << 32 | len(y)], "root": [1, 2], "parity": [alike.parity(x), alike.parity(y)]})
        rows = alike._Rows(table)
        width = int(rows.width.min())
        assert np.bitwise_count(rows.words[width][0] ^ rows.words[width][1]).sum() <= len(np.setxor1d(x, y))
        if alike._alike(x, y):
            assert rows.near(np.array([0]), np.array([1]))[0]


def test_wide_pairs(monkeypatch):
    """Tries of fingerprints of many words bring each pair within the budget together once, in each part alone."""
    rng = np.random.Generator(np.random.PCG64(16))
    words = simhash.WIDE_BITS // 64
    bits = np.repeat(rng.integers(0, 2, (12, simhash.WIDE_BITS), dtype=np.uint8), 15, axis=0)
    for row, n in zip(bits, rng.integers(0, 130, len(bits)) * (rng.random(len(bits)) < 0.8), strict=True):  # a fifth are copies
        row[rng.choice(simhash.WIDE_BITS, n, replace=False)] ^= 1
    prints, part = np.packbits(bits, axis=1).view("<u8"), np.sort(rng.integers(0, 4, len(bits)))
    assert prints.shape == (180, words)
    order = np.lexsort((*prints.T[::-1], part))
    prints, starts = prints[order], np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    apart = np.bitwise_count(prints[:, None] ^ prints[None]).sum(axis=2)
    for budget in (0, 60, simhash.WIDE_BUDGET, 400):
        want = sorted(zip(*(x.tolist() for x in np.nonzero(np.triu((apart <= budget) & (part[:, None] == part[None]), 1))), strict=True))
        for frontier in (1 << 17, 700):
            monkeypatch.setattr(simhash, "FRONTIER", frontier)
            assert sorted((int(i), int(j)) for x, y in simhash.near_pairs(prints, budget, starts) for i, j in zip(x, y, strict=True)) == want


def test_wide_budget():
    """A bit of two alike sets differs with probability 3/16 at most, and more bits than the budget below 2 ** -64."""
    coins = lambda n: np.array([comb(n, k) / 2**n for k in range(n + 1)])

    def differs(n, m, both):
        heads = np.arange(both + 1)
        x, y = (np.array([coins(k - both)[2 * (h + np.arange(k - both + 1)) > k].sum() for h in heads]) for k in (n, m))
        return float((coins(both) * (x * (1 - y) + y * (1 - x))).sum())

    worst = {(n, m): differs(n, m, -(-4 * (n + m) // 9)) for n in range(1, 61) for m in range(n, 5 * n // 4 + 1)}
    assert worst[4, 5] == 3 / 16 and max(v for k, v in worst.items() if k != (4, 5)) < 0.162
    tail = sum(Fraction(comb(simhash.WIDE_BITS, k) * 3**k * 13 ** (simhash.WIDE_BITS - k), 16**simhash.WIDE_BITS) for k in range(simhash.WIDE_BUDGET + 1, simhash.WIDE_BITS + 1))
    assert tail < Fraction(1, 2**64)
    rng = np.random.Generator(np.random.PCG64(17))
    for n in (5, 300, 1000):
        x = rng.integers(0, 2**63, n, dtype=np.uint64)
        a, b = (np.frombuffer(simhash.wide_fingerprint(s), np.uint8) for s in (x, x[: 4 * n // 5]))
        strange = np.frombuffer(simhash.wide_fingerprint(rng.integers(0, 2**63, n, dtype=np.uint64)), np.uint8)
        assert len(a) * 8 == simhash.WIDE_BITS and np.bitwise_count(a ^ b).sum() <= simhash.WIDE_BUDGET < np.bitwise_count(a ^ strange).sum()
    assert not any(simhash.wide_fingerprint(np.zeros(0, "<u8")))


def test_wide_nodes(spark, monkeypatch):
    """Texts that share 64 bits of SimHash are not joined for that; each has its own links."""
    words = [f"w{k}" for k in range(200)]
    rows = [(0, " ".join(words)), (1, " ".join(f"v{k}" for k in range(200))), (2, " ".join([*words[:190], *(f"z{k}" for k in range(10))]))]
    monkeypatch.setattr(simhash, "_majority", lambda hashes: 7)
    assert survived(spark, rows) == {0, 1}
    assert len({alike.node_of(alike.set_of(t, 5)) for _, t in rows}) == 3


def test_substrings(awkward, documents, empty):
    low = awkward.sparkSession.createDataFrame([(12, "x" * 30_000 + "y" * 60), (13, "ab" * 20_000), (14, "ba" * 9_000 + "x" * 70)], "doc_id long, text string")
    for df in (awkward.select("doc_id", "text").union(low), awkward, documents):
        got = [(r["doc_id"], r["n_bytes"], sum(s["stop"] - s["start"] for s in r["spans"]), len(r["spans"]), bytes(r["kept"])) for r in substrings.remove_repeats(df).collect()]
        assert sorted(got, key=repr) == brute_repeats([(r["doc_id"], r["text"]) for r in df.collect()])
    assert substrings.remove_repeats(empty).count() == 0


def test_substring_edges(spark):
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    shared = [word(n) for n in (49, 50, 51, 75, 120, 900)]
    rows = [(i, word(rng.randint(0, 60)) + rng.choice(shared) + word(rng.randint(0, 60)) + rng.choice(shared)) for i in range(80)]
    rows += [(100, "z" * 60), (101, "z" * 49), (102, "z" * 500), (103, "é" * 30), (104, "xé" + "é" * 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r["doc_id"], r["n_bytes"], sum(s["stop"] - s["start"] for s in r["spans"]), len(r["spans"]), bytes(r["kept"])) for r in substrings.remove_repeats(df).collect()]
    assert sorted(got, key=repr) == brute_repeats(rows)


def test_settled_runs():
    """A run is settled only if all of its strings are, not just the first and the last."""
    a, z = np.array([10, 30, 50]), np.array([20, 40, 60])
    settled = lambda first, last: all(any(x <= k < y for x, y in zip(a, z, strict=True)) for k in range(first, last + 1))
    runs = np.array([(i, j) for i in range(65) for j in range(i, min(i + 31, 65))])
    assert substrings._all_inside(runs[:, 0], runs[:, 1], a, z).tolist() == [settled(i, j) for i, j in runs.tolist()]
    assert not substrings._all_inside(np.array([15]), np.array([35]), a, z)[0]
    assert substrings._all_inside(np.array([15]), np.array([35]), np.array([10, 20]), np.array([20, 40]))[0]
    assert not substrings._all_inside(np.array([3]), np.array([3]), a[:0], z[:0])[0]


def test_low_entropy_runs():
    """A stretch of one letter, or of a short period, is a few runs, not one for each letter."""
    for text in (b"z" * 200_000, b"abc" * 70_000):
        b = np.frombuffer(text, np.uint8)
        h, first, last, cuts = substrings.runs(b, np.array([0, len(b)]))
        assert len(h) < 60 and len(cuts) < 5
        assert first[0] == 0 and last[-1] == len(b) - 50 and (first[1:] == last[:-1] + 1).all() and (last - first).max() < 1 << 15


def test_refinement():
    data = np.frombuffer(("ab" * 40 + "c" * 10 + "ab" * 40).encode(), np.uint8)
    live, bucket = substrings.refine(data, np.arange(len(data) - 49))
    groups = defaultdict(set)
    for k in range(len(data) - 49):
        groups[data[k : k + 50].tobytes()].add(k)
    want = {frozenset(g) for g in groups.values() if len(g) > 1}
    assert {frozenset(live[bucket == b].tolist()) for b in set(bucket.tolist())} == want
