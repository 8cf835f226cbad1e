"""Near copies by shingle similarity: SimHash tries in exact parts, and a check of the shingle sets.

The pairs come from the self-join of binary tries of :mod:`lakemill.llm.simhash`, over
fingerprints of WIDE_BITS bits.  Sets of Jaccard similarity 4/5 or more differ in
more than WIDE_BUDGET of them with probability below 2 ** -64.  SimHash alone can't tell
0.8 from less, so what the tries bring is checked on the whole sets.

* Parts.  Each set's rarest shingles (a fifth and one) deal it out to blocks; any
  two alike sets meet in one, where their places in the order of rarity must also
  leave enough to share.  A crowded block is cut into chunks and each two meet.
* Tries.  Each block's fingerprints make a trie that is joined with itself; a node
  pair is given up when its differing bits exceed the budget.
* Check.  A parity fingerprint has a bit for each class of shingles, set if an odd
  number of them is in the set, so two sets differ in at least as many shingles as
  their parity fingerprints in bits; alike sets differ in at most a ninth of their
  sizes' sum.  Pairs of the tries beyond that need no texts; a set names a few partners
  of the others, which are checked on the whole sets, and components follow.  A block
  that has more pairs, of sets not connected by then, is asked again; what is left
  after that goes to the block as whole sets.  So what is sent stays in proportion to
  the rows of blocks, and no pair of the tries is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakemill.llm.common import batches_of_rows, checkpointed, components, whole_blocks

#: Sets are alike from this Jaccard similarity on.
ALIKE = (4, 5)
PART_ROWS = 20_000
#: Partners that a row names in the first and in the second round, and bytes of fingerprints or sets held at once.
PARTNERS, COMPARED = (2, 16), 32 << 20
#: Bits of the parity fingerprints of small and of large sets.
LEAST_BITS, MOST_BITS = 512, 4096
#: Shingles are counted by buckets, which are added up in so many blocks.
BUCKET_BITS, BUCKET_BLOCKS = 19, 64
#: Bits of the filter of wanted ids; it is never larger, only less selective.
FILTER_BITS = 1 << 26
SEED, _U = 42, np.uint64


def shingle_hashes(text: str, size: int) -> np.ndarray:
    """XXH64 of the text's word shingles, repeats included; none without words."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()  # bytes: A-Z only, ASCII white space only
    if not words:
        return np.zeros(0, "<u8")
    joined, n = b" ".join(words), max(1, len(words) - size + 1)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1)
    starts, stops = (ends - lengths - 1)[:n], ends[min(size, len(words)) - 1 :] - 1
    return np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts.tolist(), stops.tolist(), strict=True)), "<u8", n)


def set_of(text: str, size: int) -> np.ndarray:
    """The text's shingles as a sorted set of hashes."""
    return np.unique(shingle_hashes(text, size))


def node_of(shingles: np.ndarray) -> int:
    """A hash of all of a set, so that only equal sets are one node."""
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(shingles.tobytes(), SEED)


def parity(shingles: np.ndarray) -> bytes:
    """The parity fingerprint of a set; larger sets have more bits."""
    bits = LEAST_BITS
    while bits < min(len(shingles), MOST_BITS):
        bits *= 2
    return np.packbits(np.bincount((shingles & _U(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little").tobytes()


def _bucket(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> _U(64 - BUCKET_BITS)).astype(np.int64)


def _bucket_counts(size: int):
    """Rows (block, counts): how many texts have shingles of each bucket, by blocks of buckets."""

    def count(batches):
        total = np.zeros(1 << BUCKET_BITS, "<u4")
        for batch in batches:
            for part in batches_of_rows([batch], 4 << 20):
                at, n = np.unique(np.concatenate([_bucket(set_of(x.as_py(), size)) for x in part.column(0)]), return_counts=True)
                total[at] += n.astype("<u4")
        rows = [(k, x.tobytes()) for k, x in enumerate(total.reshape(BUCKET_BLOCKS, -1)) if x.any()]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], names=["block", "counts"])

    return count


def _summed(batches):
    """Rows (block, counts) added up, for rows that a task has."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            total[block] = total.get(block, 0) + np.frombuffer(counts.as_buffer(), "<u4").astype("<u8")
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["block", "counts"])


def commonness(texts: DataFrame, size: int) -> np.ndarray:
    """For each bucket of shingles a class, four to the doubling of its count above the mean.

    Classes only order shingles and deal out blocks, so texts of strangers that
    share a bucket cost time but change no result.  The counts have a fixed size.
    """
    counts = texts.mapInArrow(_bucket_counts(size), "block int, counts binary")
    rows = counts.repartition(BUCKET_BLOCKS, "block").mapInArrow(_summed, "block int, counts binary").collect()
    total = np.zeros((BUCKET_BLOCKS, (1 << BUCKET_BITS) // BUCKET_BLOCKS))
    for r in rows:
        total[r["block"]] = np.frombuffer(r["counts"], "<u8")
    return (4 * np.log2(np.maximum(total - np.floor(total.mean()), 0) + 1)).astype(np.uint8).ravel()


def profiles(common: np.ndarray, size: int):
    """A column function from text to (fp, n, prefix, parity, simhash): its node, the size of its set, its rarest shingles in order, its fingerprints.

    Two sets of Jaccard similarity ALIKE or more have one of these shingles in
    common: their first common one is so far ahead in both that enough can follow.
    """

    @F.arrow_udf("fp long, n int, prefix binary, parity binary, simhash binary")
    def cut(texts: pa.Array) -> pa.Array:
        from lakemill.llm.simhash import wide_fingerprint

        fps, ns, prefixes, parities, prints = [], [], [], [], []
        for x in texts:
            shingles = set_of(x.as_py() or "", size)
            n = len(shingles)
            fps.append(node_of(shingles))
            ns.append(n)
            prefixes.append(shingles[np.lexsort((shingles, common[_bucket(shingles)]))[: n - -(-ALIKE[0] * n // ALIKE[1]) + 1]].tobytes() if n else b"")
            parities.append(parity(shingles))
            prints.append(wide_fingerprint(shingles))
        columns = [pa.array(np.array(fps, np.uint64).view(np.int64), pa.int64()), pa.array(ns, pa.int32()), *(pa.array(x, pa.binary()) for x in (prefixes, parities, prints))]
        return pa.StructArray.from_arrays(columns, names=["fp", "n", "prefix", "parity", "simhash"])

    return cut


def _filter(ids: DataFrame):
    """A column function that is true for ids of a table and few others, from a bitmap of at most FILTER_BITS."""
    n = min(FILTER_BITS, 1 << max(15, ids.count().bit_length() + 4))
    place = F.pmod(F.xxhash64("id"), F.lit(n)) + 1
    rows = ids.groupBy(F.bitmap_bucket_number(place).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()
    bits = np.zeros((n >> 15, 1 << 12), np.uint8)
    for r in rows:
        bits[r["k"] - 1] = np.frombuffer(r["bits"], np.uint8)
    bits = bits.ravel()

    @F.arrow_udf("boolean")
    def has(places: pa.Array) -> pa.Array:
        at = places.to_numpy()
        return pa.array(bits[at >> 3] >> (at & 7).astype(np.uint8) & 1 > 0)

    return has(place - 1)


def _blocks(common: np.ndarray, part_rows: int):
    """Rows (block, fp, sizes), one for each shingle of a prefix; sizes packs the set's and what is left of it from this shingle on.

    A common shingle's nodes are dealt out to k chunks and each two chunks make a
    block, so that all pairs still meet.
    """
    chunks = 1 + (np.exp2(common / 4) // part_rows).astype(np.int64)

    def spread(batches):
        for batch in batches:
            for part in batches_of_rows([batch], 1 << 20):
                prefixes = [np.frombuffer(x or b"", "<u8") for x in part.column(2).to_pylist()]
                lengths = np.fromiter(map(len, prefixes), np.int64, len(prefixes))
                shingle = np.concatenate(prefixes)
                fp, n = (np.repeat(part.column(k).to_numpy(), lengths).astype(np.int64) for k in (0, 1))
                rest = n - (np.arange(len(shingle)) - np.repeat(np.cumsum(lengths) - lengths, lengths))
                times = chunks[_bucket(shingle)]
                row = np.repeat(np.arange(len(shingle)), times)
                other = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
                shingle, fp, n, rest, times = (x[row] for x in (shingle, fp, n, rest, times))
                mine = (fp.view(np.uint64) % times.astype(np.uint64)).astype(np.int64)
                pair = (np.minimum(mine, other) * times + np.maximum(mine, other)).astype(np.uint64)
                with np.errstate(over="ignore"):
                    block = (shingle ^ pair * _U(0x9E3779B97F4A7C15)) * _U(0xD6E8FEB86659FD93)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (block.view(np.int64), fp, n << 32 | rest)], names=["block", "fp", "sizes"])

    return spread


class _Rows:
    """The rows of some whole blocks; methods speak of them by their places."""

    def __init__(self, table: pa.Table) -> None:
        number = lambda c: table[c].to_numpy()
        self.block, self.fp, self.sizes = number("block"), number("fp"), number("sizes")
        self.n, self.rest = self.sizes >> 32, self.sizes & 0xFFFFFFFF
        self.root = number("root") if "root" in table.column_names else self.fp
        self.start = np.flatnonzero(np.r_[True, self.block[1:] != self.block[:-1]])
        self.end = np.r_[self.start[1:], len(self.block)]
        if "simhash" in table.column_names:
            self.simhash = np.frombuffer(b"".join(table["simhash"].to_pylist()), "<u8").reshape(len(self.block), -1)
        if "parity" in table.column_names:
            prints = table["parity"].to_pylist()
            self.width = np.fromiter(map(len, prints), np.int64, len(prints)) // 8
            self.words = {}
            for width in np.unique(self.width).tolist():
                out = self.words[width] = np.zeros((len(prints), width), "<u8")
                for wide in np.unique(self.width[self.width >= width]).tolist():
                    some = np.flatnonzero(self.width == wide)
                    x = np.frombuffer(b"".join([prints[k] for k in some.tolist()]), "<u8").reshape(-1, wide)
                    while x.shape[1] > width:  # fold: classes are numbers modulo the width
                        x = x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2 :]
                    out[some] = x

    def twos(self) -> np.ndarray:
        """First rows of the blocks of two, by far the commonest, that can be alike."""
        two = self.start[self.end - self.start == 2]
        return two[self._fits(two, two + 1) & (self.fp[two] != self.fp[two + 1]) & (self.root[two] != self.root[two + 1])]

    def larger(self) -> Iterator[np.ndarray]:
        """The rows of each block of more, by node."""
        for a, z in zip(*(x[self.end - self.start > 2].tolist() for x in (self.start, self.end)), strict=True):
            if (self.root[a:z] != self.root[a]).any():
                yield a + np.argsort(self.fp[a:z], kind="stable")

    def _fits(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether rows x can be alike to rows y, if the block's shingle is their first common one."""
        p, q = ALIKE
        return (p + q) * np.minimum(self.rest[x], self.rest[y]) >= p * (self.n[x] + self.n[y])

    def admitted(self, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (x, y) of a block's rows that can be alike and are not connected, y's node being less, by x."""
        step = max(1, (COMPARED >> 6) // len(rows))
        for lo in range(0, len(rows), step):
            some = rows[lo : lo + step, None]
            x, y = np.nonzero(self._fits(some, rows[None]) & (self.fp[some] > self.fp[rows]) & (self.root[some] != self.root[rows]))
            yield rows[lo + x], rows[y]

    def near(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Which pairs of rows differ in no more bits than alike sets can."""
        good, both = np.zeros(len(x), bool), np.minimum(self.width[x], self.width[y])
        for width, words in self.words.items():
            of = np.flatnonzero(both == width)
            step = max(1, COMPARED // (8 * width))
            for at in range(0, len(of), step):
                some = of[at : at + step]
                apart = np.bitwise_count(words[x[some]] ^ words[y[some]]).sum(axis=1, dtype=np.int64)
                good[some] = sum(ALIKE) * apart <= (ALIKE[1] - ALIKE[0]) * (self.n[x[some]] + self.n[y[some]])
        return good

    def pairs(self, budget: int, visits=None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (x, y) of the blocks' rows that tries of their SimHashes bring together, y's node being less, without those that can't be alike or are connected."""
        from lakemill.llm.simhash import near_pairs

        order = np.lexsort((*self.simhash.T[::-1], self.block))
        for a, b in near_pairs(self.simhash[order], budget, self.start, visits):
            x, y = order[a], order[b]
            x, y = np.where(self.fp[x] > self.fp[y], x, y), np.where(self.fp[x] > self.fp[y], y, x)
            some = self._fits(x, y) & (self.fp[x] != self.fp[y]) & (self.root[x] != self.root[y])
            x, y = x[some], y[some]
            near = self.near(x, y)
            if near.any():
                yield x[near], y[near]


def _meeting(batches):
    """The rows (block, fp, sizes) that can be alike to another row of their block."""
    for table in whole_blocks(batches):
        rows, keep = _Rows(table), np.zeros(table.num_rows, bool)
        two = rows.twos()
        keep[two] = keep[two + 1] = True
        for own in rows.larger():
            for x, y in rows.admitted(own):
                keep[x] = keep[y] = True
        yield pa.RecordBatch.from_arrays([pa.array(x[keep], pa.int64()) for x in (rows.block, rows.fp, rows.sizes)], names=["block", "fp", "sizes"])


def _named(most: int):
    """Pairs (kind 0: a, b): a node of a block with its first near partners, ``most`` at most; and (kind 1: block, fp, sizes) the rows of blocks that have more pairs.

    Reads rows (block, fp, sizes, root, parity, simhash); nodes of one root are connected already.
    """
    from lakemill.llm import simhash

    budget = simhash.WIDE_BUDGET

    def named(batches):
        for table in whole_blocks(batches):
            rows, left, right = _Rows(table), [], []
            block = np.repeat(np.arange(len(rows.start)), rows.end - rows.start)
            partners, paired, more = np.zeros(len(block), np.int64), np.zeros(len(block), bool), np.zeros(len(rows.start), bool)
            for x, y in rows.pairs(budget):
                order = np.argsort(x, kind="stable")
                x, y = x[order], y[order]
                nth = partners[x] + np.arange(len(x)) - np.searchsorted(x, x)
                partners += np.bincount(x, minlength=len(block))
                paired[x] = paired[y] = True
                more[block[x[nth >= most]]] = True
                left.append(rows.fp[y[nth < most]])
                right.append(rows.fp[x[nth < most]])
            open_rows = paired & more[block]
            a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
            pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1) if len(a) else np.zeros((2, 0), np.int64)
            zero, one = np.zeros(pair.shape[1], np.int64), np.ones(int(open_rows.sum()), np.int64)
            columns = [(zero, one), (pair[0], rows.block[open_rows]), (pair[1], rows.fp[open_rows]), (zero, rows.sizes[open_rows])]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in columns], names=["kind", "a", "b", "sizes"])

    return named


def _alike(x: np.ndarray, y: np.ndarray) -> bool:
    p, q = ALIKE
    return (p + q) * len(np.intersect1d(x, y, assume_unique=True)) >= p * (len(x) + len(y))


def _verified(size: int):
    """The pairs (a, b) whose texts' sets are alike, from rows (a, b, text, text)."""

    def verified(batches):
        for batch in batches_of_rows(batches):
            good, seen, x = [], None, None
            for node, left, right in zip(*(batch.column(c) for c in (0, 2, 3)), strict=True):
                if node != seen:
                    seen, x = node, set_of(left.as_py(), size)
                good.append(_alike(x, set_of(right.as_py(), size)))
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(good, pa.bool_())) for k in (0, 1)], names=["a", "b"])

    return verified


def _settled(size: int):
    """Links (a, b) that connect all alike sets of a block, from rows (block, fp, sizes, root, parity, simhash, text)."""
    from lakemill.llm import simhash

    budget = simhash.WIDE_BUDGET

    def settled(batches):
        for table in whole_blocks(batches):
            rows, found, held = _Rows(table), [], 0
            sets: dict[int, np.ndarray] = {}
            up: dict[int, int] = {}

            def find(r, up=up):
                while r in up:
                    r = up[r]
                return r

            for x, y in rows.pairs(budget):
                for i, j in zip(x.tolist(), y.tolist(), strict=True):
                    p, q = find(int(rows.root[i])), find(int(rows.root[j]))
                    if p == q:
                        continue
                    if held > COMPARED:
                        sets, held = {}, 0
                    for k in (i, j):
                        if rows.fp[k] not in sets:
                            sets[rows.fp[k]] = set_of(table["text"][k].as_py(), size)
                            held += sets[rows.fp[k]].nbytes
                    if _alike(sets[rows.fp[i]], sets[rows.fp[j]]):
                        up[max(p, q)] = min(p, q)
                        found.append((int(rows.fp[j]), int(rows.fp[i])))
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return settled


def alike_links(prints: DataFrame, texts: DataFrame, ids: DataFrame, common: np.ndarray, size: int, part_rows: int = PART_ROWS) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of sets with Jaccard similarity ALIKE or more.

    ``prints`` has (fp, n, prefix, parity, simhash) of each distinct set, ``texts`` (id,
    digest, text) and ``ids`` (id, digest, fp) of each row.  Each link is checked
    on the whole sets.
    """
    kinds = "kind long, a long, b long, sizes long"

    def by_block(rows: DataFrame) -> DataFrame:
        return rows.repartition("block").sortWithinPartitions("block")

    def rows_of(found: DataFrame) -> DataFrame:
        return found.where("kind = 1").select(F.col("a").alias("block"), F.col("b").alias("fp"), "sizes")

    def pairs_of(found: DataFrame) -> DataFrame:
        return found.where("kind = 0").select("a", "b").distinct()

    blocks = prints.select("fp", "n", "prefix").mapInArrow(_blocks(common, part_rows), "block long, fp long, sizes long")
    met = by_block(blocks).mapInArrow(_meeting, "block long, fp long, sizes long").join(prints.select("fp", "parity", "simhash"), "fp")
    found = checkpointed(by_block(met.select("block", "fp", "sizes", F.col("fp").alias("root"), "parity", "simhash")).mapInArrow(_named(PARTNERS[0]), kinds))
    pairs, more = checkpointed(pairs_of(found)), rows_of(found)
    needed = pairs.select(F.col("a").alias("fp")).union(pairs.select("b")).union(more.select("fp")).distinct()
    # One row of each node.
    wanted = ids.join(needed, "fp", "left_semi").groupBy("fp").agg(F.min(F.struct("id", "digest")).alias("row"))
    wanted = checkpointed(wanted.select("fp", F.col("row.id").alias("want"), F.col("row.digest").alias("digest")))
    rows = texts.where(_filter(wanted.select(F.col("want").alias("id")))).join(wanted, (texts["digest"] == wanted["digest"]) & F.col("id").eqNullSafe(F.col("want")))
    chosen = checkpointed(rows.select("fp", "text").dropDuplicates(["fp"]))

    def checked(pairs: DataFrame) -> DataFrame:
        both = pairs.join(chosen.toDF("a", "x"), "a").join(chosen.toDF("b", "y"), "b").select("a", "b", "x", "y")
        return checkpointed(both.mapInArrow(_verified(size), "a long, b long"))

    def still_apart(more: DataFrame, links: DataFrame) -> DataFrame:
        """Rows of blocks whose sets are not all connected, with their roots and fingerprints."""
        rooted = more.join(components(links), F.col("fp") == F.col("node"), "left").select("block", "fp", "sizes", F.coalesce("root", "fp").alias("root"))
        apart = rooted.groupBy("block").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least < most").select("block")
        return rooted.join(apart, "block", "left_semi").join(prints.select("fp", "parity", "simhash"), "fp").select("block", "fp", "sizes", "root", "parity", "simhash")

    links = checked(pairs)
    if not more.limit(1).count():
        return links
    found = checkpointed(by_block(still_apart(more, links)).mapInArrow(_named(PARTNERS[1]), kinds))
    links, more = links.union(checked(pairs_of(found).join(pairs, ["a", "b"], "left_anti"))), rows_of(found)
    if not more.limit(1).count():
        return links
    whole = still_apart(more, links).join(chosen, "fp").select("block", "fp", "sizes", "root", "parity", "simhash", "text")
    return links.union(checkpointed(by_block(whole).mapInArrow(_settled(size), "a long, b long")))
