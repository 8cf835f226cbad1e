"""SimHash near-duplicates by a self-join of binary tries.

A fingerprint is a path of 64 bits in a binary trie.  The join walks pairs of
nodes together: two nodes at one depth stand for two sets of fingerprints, and
the bits in which their paths differ are added up on the way.  A pair is given
up as soon as its sum exceeds the budget; a pair whose remaining depth fits
into what is left of the budget links as a whole.

For many machines the trie is first cut into parts that can be joined alone.
Fingerprints with at most ``budget`` differing bits agree in one of
``budget + 1`` bands of the bits, so each band deals the fingerprints out by its
value, and a part's trie is made of the other bits.  A part with more than
``part_rows`` fingerprints is dealt out again by bands of those other bits, and
so on: the argument holds for them as well, so nothing is lost or capped.  Parts
report only the links of a spanning forest, at most one a row, and connected
components follow by label exchange between tables.

Near copies of a given shingle similarity differ in too many bits for bands.  Their
sets have fingerprints of WIDE_BITS bits, joined by the same tries under a larger
budget, in parts that shingles deal out (see :mod:`lakemill.llm.alike`).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakemill.llm import alike
from lakemill.llm.alike import shingle_hashes
from lakemill.llm.common import checkpointed, components, ready, text_of, whole_blocks

BITS, BUDGET, SHINGLE, PART_ROWS = 64, 2, 3, 20_000
SEED = 42
#: So many node pairs go down the tries together.
FRONTIER = 1 << 17
#: Bits of the fingerprint of a set of shingles, and how many may differ in sets of Jaccard similarity 4/5 or more.  A bit
#: differs with probability 3/16 at most (sets of 4 and 5 shingles; 0.162 for any others), so that more than 183 do with less
#: than 2 ** -64: a pair is lost no likelier than two shingles have one hash.
WIDE_BITS, WIDE_BUDGET = 512, 183
_DRAWN = np.arange(1, WIDE_BITS // BITS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def _majority(hashes: np.ndarray) -> int:
    """A bit is set if it is set in over half of the hashes."""
    total = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 8192):
        total += np.unpackbits(hashes[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str, size: int = SHINGLE) -> int:
    """SimHash of the text's word shingles, repeats included; 0 without words."""
    return _majority(shingle_hashes(text, size))


def wide_fingerprint(shingles: np.ndarray) -> bytes:
    """SimHash of a set of shingle hashes in WIDE_BITS bits, all 0 for an empty set."""
    total = np.zeros(WIDE_BITS, np.int64)
    for at in range(0, len(shingles), 255):  # so many add up in a byte
        x = shingles[at : at + 255, None] + _DRAWN  # each hash is drawn out to WIDE_BITS by SplitMix64
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        total += np.unpackbits(x.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * total > len(shingles), bitorder="little").tobytes()


def fingerprints(spark: SparkSession, size: int = SHINGLE):
    """A column function from text to its fingerprint, as a signed long with the same bits."""
    ready(spark)

    @F.arrow_udf("long")
    def prints(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(x.as_py() or "", size) for x in texts], dtype=np.uint64).view(np.int64), pa.int64())

    return prints


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def band_masks(level: int, n: int) -> list[int]:
    """Deal the bits out to ``n`` bands by the ``level``-th digit of their place, written to base ``n``."""
    return [sum(1 << i for i in range(BITS) if i // n**level % n == k) for k in range(n)]


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places of edges (a, b) between ``n`` nodes that make a spanning forest: each component takes its first edge, again and again."""
    label, left, chosen = np.arange(n), np.arange(len(a)), []
    while True:
        left = left[label[a[left]] != label[b[left]]]
        if not len(left):
            return np.sort(np.concatenate(chosen)) if chosen else left
        first = np.full(n, len(a))
        np.minimum.at(first, label[a[left]], left)
        np.minimum.at(first, label[b[left]], left)
        pick = np.unique(first[first < len(a)])
        chosen.append(pick)
        x, y, up = label[a[pick]], label[b[pick]], np.arange(n)
        while True:
            low = np.minimum(up[x], up[y])
            if (up[x] == low).all() and (up[y] == low).all():
                break
            for k in (x, y):
                np.minimum.at(up, up[k], low)
                np.minimum.at(up, k, low)
            up = up[up]
        label = up[label]


class Visits:
    """What a self-join did: node pairs that it visited, gave up for their differing bits, compared as single paths and linked as wholes."""

    def __init__(self) -> None:
        self.visited = self.pruned = self.single = self.whole = 0


def near_nodes(prints: np.ndarray, budget: int, starts: np.ndarray | None = None, visits: Visits | None = None) -> Iterator[np.ndarray]:
    """Pairs of nodes (a0, a1, b0, b1) all of whose paths are within ``budget`` bits, over sorted fingerprints of one or more words each.

    ``starts`` are the first rows of tries that are joined each with itself (one
    by default).  A node is a run of the sorted rows with one prefix.  All node
    pairs of one depth go down together: each gives the pairs of its halves, and a
    pair whose differing bits exceed the budget is given up.  Two nodes of one
    row each are paths without branches, whose other bits are added up at once.
    """
    visits = visits or Visits()
    words = prints.reshape(len(prints), -1) if len(prints) else prints.reshape(0, 1)
    bits = BITS * words.shape[1]
    starts = np.zeros(1, np.int64) if starts is None else starts

    @lru_cache(BITS)
    def ones(depth: int) -> np.ndarray:
        return np.r_[0, np.cumsum((words[:, depth // BITS] >> np.uint64(BITS - 1 - depth % BITS)) & np.uint64(1), dtype=np.int64)]

    ends = np.r_[starts[1:], len(words)]
    stack = [(0, np.stack([starts, ends, starts, ends, np.zeros(len(starts), np.int64)]))] if len(words) else []
    while stack:
        depth, pairs = stack.pop()
        same = pairs[0] == pairs[2]
        pairs = pairs[:, (pairs[1] > pairs[0]) & (pairs[3] > pairs[2]) & ~(same & (pairs[1] - pairs[0] < 2))]
        visits.visited += pairs.shape[1]
        over = pairs[4] > budget
        visits.pruned += int(over.sum())
        pairs = pairs[:, ~over]
        single = (pairs[1] - pairs[0] == 1) & (pairs[3] - pairs[2] == 1)
        visits.single += int(single.sum())
        paths = pairs[:4, single]
        apart = np.zeros(paths.shape[1], np.int64)
        for word in words.T:
            apart += np.bitwise_count(word[paths[0]] ^ word[paths[2]])
        yield paths[:, apart <= budget]
        pairs = pairs[:, ~single]
        whole = bits - depth <= budget - pairs[4]  # whatever the other bits are, all of these link
        visits.whole += int(whole.sum())
        yield pairs[:4, whole]
        pairs = pairs[:, ~whole]
        if not pairs.shape[1]:
            continue
        if pairs.shape[1] > FRONTIER:  # go down with a part first, so that what is held stays small
            stack += [(depth, x) for x in np.array_split(pairs, -(-pairs.shape[1] // FRONTIER), axis=1)]
            continue
        a0, a1, b0, b1, spent = pairs
        same, one = a0 == b0, ones(depth)
        am, bm = a1 - (one[a1] - one[a0]), b1 - (one[b1] - one[b0])
        apart = ~same
        below = [(a0, am, b0, bm, spent), (am, a1, bm, b1, spent), (a0, am, bm, b1, spent + 1), tuple(x[apart] for x in (am, a1, b0, bm, spent + 1))]
        stack.append((depth + 1, np.concatenate([np.stack(x) for x in below], axis=1)))


def _rows_of(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The rows of runs that begin at ``first`` and have ``n`` each."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - first, n)


def trie_links(prints: np.ndarray, budget: int = BUDGET, starts: np.ndarray | None = None, visits: Visits | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) of a spanning forest over distinct sorted fingerprints within ``budget`` bits, by tries as in :func:`near_nodes`."""
    a, b = [], []
    for a0, a1, b0, b1 in near_nodes(prints, budget, starts, visits):
        a += [_rows_of(a0, a1 - a0), np.repeat(a0, b1 - b0 - 1)]
        b += [np.repeat(b0, a1 - a0), _rows_of(b0 + 1, b1 - b0 - 1)]
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
    some = a != b
    a, b = a[some], b[some]
    tree = forest(len(prints), a, b)
    return a[tree], b[tree]


def near_pairs(prints: np.ndarray, budget: int, starts: np.ndarray | None = None, visits: Visits | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs (a, b) of rows within ``budget`` bits, each once and some at a time, by tries as in :func:`near_nodes`."""
    for a0, a1, b0, b1 in near_nodes(prints, budget, starts, visits):
        a, b, n = _rows_of(a0, a1 - a0), np.repeat(b0, a1 - a0), np.repeat(b1 - b0, a1 - a0)
        piece = (np.cumsum(n) - n) // FRONTIER
        for some in np.split(np.arange(len(a)), np.flatnonzero(np.diff(piece)) + 1) if len(a) else []:
            x, y = np.repeat(a[some], n[some]), _rows_of(b[some], n[some])
            yield x[x < y], y[x < y]  # a node with itself has each pair twice; of two nodes the first comes before


def _joined(budget: int):
    """Links from rows (part, fp) sorted by part, by one trie for each part."""

    def links(batches):
        for table in whole_blocks(batches):
            part, prints = table[0].to_numpy(), table[1].to_numpy().view(np.uint64)
            order = np.lexsort((prints, part))
            part, prints = part[order], prints[order]
            a, b = trie_links(prints, budget, np.flatnonzero(np.r_[True, part[1:] != part[:-1]]))
            yield pa.RecordBatch.from_arrays([pa.array(prints[x].view(np.int64), pa.int64()) for x in (a, b)], names=["a", "b"])

    return links


def near_links(prints: DataFrame, budget: int = BUDGET, part_rows: int = PART_ROWS) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of distinct ``fp`` within ``budget`` bits.

    After all levels a part's fingerprints differ in a few bits only (13 at a
    budget of 2), so that no part can be large then.
    """
    n_bands = budget + 1
    if n_bands == 1:
        return prints.limit(0).select(F.col("fp").alias("a"), F.col("fp").alias("b"))
    levels = next(k for k in range(1, BITS + 1) if n_bands**k >= BITS)
    rows = prints.select("fp", F.lit(0).cast("long").alias("part"), F.lit(-1).cast("long").alias("left"))
    found: DataFrame | None = None
    for level in range(levels):
        dealt = F.array(*[F.lit(_signed(m)).cast("long") for m in band_masks(level, n_bands)])
        rows = rows.withColumn("mask", F.explode(dealt)).withColumn("mask", F.col("left").bitwiseAND(F.col("mask")))
        # A collision of this hash only brings strangers together; links are checked on all bits.
        rows = rows.select("fp", F.xxhash64("part", "mask", F.col("fp").bitwiseAND(F.col("mask"))).alias("part"), F.col("left").bitwiseAND(F.bitwise_not("mask")).alias("left"))
        # Counts combine before they are shuffled; the join that brings them back can be split where a part is large.
        counts = checkpointed(rows.groupBy("part").agg(F.count("*").alias("n")).where("n > 1"))
        sized = rows.join(counts, "part")
        last = level + 1 == levels
        small = sized if last else sized.where(F.col("n") <= part_rows)
        # Dealt out anew, as a split join does not keep a part together.
        links = small.select("part", "fp").repartition("part").sortWithinPartitions("part").mapInArrow(_joined(budget), "a long, b long")
        found = links if found is None else found.unionByName(links)
        if last or not counts.where(F.col("n") > part_rows).limit(1).count():
            break
        rows = checkpointed(sized.where(F.col("n") > part_rows).select("fp", "part", "left"))
    return found


def _groups(marked: DataFrame, id_name: str, join) -> DataFrame:
    """(fp, component_id, keeper): for each fingerprint its component's least id and the fingerprint that has it."""
    more = [c for c in marked.columns if c not in ("fp", id_name)]
    first = [F.min(F.struct(*more)).alias("more")] if more else []
    prints = checkpointed(marked.groupBy("fp").agg(F.min(id_name).alias("least"), *first))
    roots = components(join(prints.select("fp", "more.*") if more else prints))
    labelled = prints.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    best = labelled.groupBy("root").agg(F.min(F.struct(F.col("least").isNull(), "least", "fp")).alias("best"))
    return labelled.join(best, "root").select("fp", F.col("best.least").alias("component_id"), F.col("best.fp").alias("keeper"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = BUDGET, size: int = SHINGLE, part_rows: int = PART_ROWS) -> DataFrame:
    """One row per input row: id, ``fingerprint`` (16 hex digits), ``component_id``.

    A null text is an empty one; texts without words have fingerprint zero, which
    links like any other.  Null ids come last, so a component of null ids has a
    null id.  Repeated rows stay repeated; other columns are not read; an empty
    table gives an empty result.
    """
    prints = fingerprints(docs.sparkSession, size)
    marked = checkpointed(docs.select(F.col(id_col).alias("id"), prints(text_of(text_col)).alias("fp")))
    groups = _groups(marked, "id", lambda prints: near_links(prints, budget, part_rows))
    out: Column = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return marked.join(groups, "fp").select(F.col("id").alias(id_col), out.alias("fingerprint"), "component_id")


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, budget: int = BUDGET, wide: bool = False, part_rows: int = PART_ROWS) -> DataFrame:
    """One document of each component, that with the smallest id, with all its columns.

    ``wide`` joins texts whose sets of shingles have Jaccard similarity 0.8 or
    more, all of them and no others: tries of their wide fingerprints find the pairs, whole
    sets are checked (:func:`lakemill.llm.alike.alike_links`).  Otherwise ``budget``
    bits of 64 may differ.  Texts without words are equal.  If rows share that id
    and its fingerprint (its set), the first by text stays.
    """
    spark, text = ready(docs.sparkSession), text_of(text_col)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("id"), text.alias("text"))
    first = F.row_number().over(Window.partitionBy("fp", "id").orderBy(F.col(f"row.`{text_col}`").asc_nulls_last()))
    if wide:
        texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("digest"), text.alias("text"))
        common = alike.commonness(texts.select("text"), size)
        # Marked as nondeterministic only so that the optimizer does not compute it once more for a filter.
        slim = checkpointed(texts.select("id", "digest", alike.profiles(common, size).asNondeterministic()(F.col("text")).alias("p")).select("id", "digest", "p.*"))
        groups = _groups(slim.drop("digest"), "id", lambda p: alike.alike_links(p, texts, slim.select("id", "digest", "fp"), common, size, part_rows))
        keep = groups.where(F.col("keeper") == F.col("fp")).select("fp", F.col("component_id").alias("kid"))
        mine = slim.select("id", "digest", "fp").join(keep.withColumnRenamed("fp", "kfp"), (F.col("fp") == F.col("kfp")) & F.col("id").eqNullSafe(F.col("kid")))
        # Digests tell apart rows of one id; where such rows share a set, texts decide between them.
        mine = mine.groupBy("fp", "kid").agg(F.count("*").alias("n"), F.collect_set("digest").alias("digests"))
        mine = checkpointed(mine.select("fp", "kid", "n", F.explode("digests").alias("kdigest")))
        rows = rows.select("row", "id", F.xxhash64("text").alias("digest"))
        same = (F.col("digest") == F.col("kdigest")) & F.col("id").eqNullSafe(F.col("kid"))
        out = rows.join(mine.where("n = 1"), same, "left_semi").select("row.*")
        if mine.where("n > 1").limit(1).count():
            out = out.union(rows.join(mine.where("n > 1"), same).withColumn("place", first).where("place = 1").select("row.*"))
        return out
    prints = fingerprints(spark, size).asNondeterministic()
    marked = rows.select("row", "id", prints("text").alias("fp"))
    groups = _groups(checkpointed(marked.select("id", "fp")), "id", lambda p: near_links(p, budget, part_rows))
    keep = checkpointed(groups.where(F.col("keeper") == F.col("fp")).select(F.col("fp").alias("kfp"), F.col("component_id").alias("kid")))
    same = (F.col("fp") == F.col("kfp")) & F.col("id").eqNullSafe(F.col("kid"))
    return marked.join(keep, same, "left_semi").withColumn("place", first).where("place = 1").select("row.*")
