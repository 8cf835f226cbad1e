"""Suffix-array deduplication of long repeats, with bucket-pointer refinement.

A byte goes if it lies in a string of 50 bytes that also starts in a document
with a smaller id.  Sorting every suffix of a corpus by its first 50 bytes would
answer that, but a row for each byte is far beyond any budget.  Three steps
bring the suffixes to be sorted down to those that can matter, and lose none:

* Chunks.  Content cuts each text into chunks.  A chunk, with the 49 bytes
  after it, that also stands in an earlier document settles all its strings at
  once; only the first document's copy goes on.  Chunks are equal if their XXH3
  digests of 128 bits are.  Tasks combine their own equal chunks first.
* Anchors.  Each string of 50 bytes holds 31 strings of 20 bytes; the one with
  the least hash is its anchor.  Equal strings have equal anchors, and one
  anchor serves some 16 neighbouring strings, or all of a stretch that repeats
  one anchor.  Only anchors that stand in two documents go on.  Tasks first
  settle what repeats among their own documents.
* Refinement.  Around the anchors that are left, suffixes are put into buckets
  by their first 8 bytes, and each suffix points to the end of its bucket.  A
  bucket is refined by sorting its suffixes by the pointers of those 8 bytes
  further on; the new pointers, now of 16 bytes, are written back at once and
  refine by 16, and those of 32 by 18.  Suffixes alone in a bucket are finished
  and drop out.  What shares a bucket of 50 bytes is equal, byte by byte.

The texts themselves are shuffled once, by document; all steps join with that
one exchange.  Between steps go packed arrays, dealt out by the anchor's hash
to parts of a bounded number of bytes on average.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakemill.llm.common import LAST_ID, batches_of_rows, checkpointed, ready, text_of

LENGTH, ANCHOR, CHUNK_MASK, SALTS = 50, 20, 31, 64
WINDOW = LENGTH - ANCHOR + 1
#: Bytes of text that a task looks at together, bytes of text for each part, and about the most strings of a run.
BLOCK, PART_BYTES, MOST_STRINGS = 1 << 20, 16 << 20, 4096
#: Bytes of the buckets that refinement begins with.
GRAM = 8
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_U = np.uint64
#: What stands before the bytes of a run of strings that share an anchor; runs of other shares of a part can't match.
RUN = np.dtype([("ord", "<i8"), ("tag", "<i8"), ("at", "<u4"), ("size", "<u2"), ("share", "<u2")])
SHARES = 16
#: A chunk that stands in a document: it settles the strings that start from ``start`` to before ``stop``.
CHUNK = np.dtype([("ord", "<i8"), ("tag", "<i8"), ("start", "<u4"), ("stop", "<u4")])


def gram_hashes(b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each string of ANCHOR bytes, from sums over 1, 2, 4, 8 and 16 bytes."""
    with np.errstate(over="ignore"):
        h, width, powers = (b.astype(_U) + _U(1)) * _M1, 1, {}
        step = _M2
        while width <= ANCHOR:
            powers[width] = (h, step)
            if len(h) <= width:
                break
            h = h[:-width] * step + h[width:]
            step, width = step * step, width * 2
        total, done = None, 0
        for w in sorted(powers, reverse=True):
            if ANCHOR & w:
                part, mult = powers[w]
                if total is None:
                    total, done = part, w
                else:
                    n = len(b) - done - w + 1
                    total, done = total[:n] * mult + part[done : done + n], done + w
        total ^= total >> _U(29)
        total *= _M2
        return total ^ (total >> _U(32))


def runs(b: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first, last, cuts) of texts that stand one after another: the anchors' hashes, the strings that each serves, and where chunks begin.

    ``offsets`` are the texts' bounds; places count from the start of ``b``.
    Neighbouring strings with equal anchors make one run wherever those stand, so
    that a stretch of one letter is a run and not one for each of its letters.
    """
    none = np.zeros(0, np.int64)
    if len(b) < LENGTH:
        return none.astype(_U), none, none, none
    h = gram_hashes(b)
    key = (h & _U(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=_U)
    least, width = key, 1
    while 2 * width <= WINDOW:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = WINDOW - width
    least = np.minimum(least[: len(least) - rest], least[rest:]) if rest else least
    # A string that would cross into the next text is none.
    valid = np.ones(len(least) + LENGTH, bool)
    for k in range(1, LENGTH):
        valid[np.maximum(offsets[1:] - k, 0)] = False
    valid = valid[: len(least)]
    change = np.r_[True, least[1:] != least[:-1]]
    first = np.flatnonzero(valid & (change | ~np.r_[False, valid[:-1]]))
    last = np.flatnonzero(valid & (np.r_[change[1:], True] | ~np.r_[valid[1:], False]))
    if not len(first):
        return none.astype(_U), none, none, none
    anchor = (least[first] & _U(0xFFFFFFFF)).astype(np.int64)
    h = h[anchor]
    same = np.r_[False, h[1:] == h[:-1]]
    cuts = anchor[((h & _U(CHUNK_MASK)) == 0) & ~(same & (np.diff(anchor, prepend=-LENGTH) <= WINDOW))]
    head = ~(same & (first == np.r_[-1, last[:-1] + 1]))
    piece = (first - first[head][np.cumsum(head) - 1]) // MOST_STRINGS
    head = np.flatnonzero(head | np.r_[True, piece[1:] != piece[:-1]])
    return h[head], first[head], last[np.r_[head[1:] - 1, len(last) - 1]], cuts


def chunks(cuts: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, stop) of the runs of strings' starts that chunks settle; they cover every string of every text."""
    long = np.flatnonzero(np.diff(offsets) >= LENGTH)
    starts = np.unique(np.r_[offsets[long], cuts])
    text = np.searchsorted(offsets, starts, "right") - 1
    end = offsets[text + 1] - LENGTH + 1
    keep = starts < end
    starts, text, end = starts[keep], text[keep], end[keep]
    return text, starts, np.minimum(np.r_[starts[1:], end[-1:]], end)


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column, one text after another, and their bounds; nothing is copied."""
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4).astype(np.int64)
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def _long(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def _chunk_rows(batches: Iterator) -> Iterator:
    """Rows (h1, h2, least, most, covered, own): each chunk of some texts once, with all its places in them."""
    from xxhash import xxh3_128_digest

    for batch in batches_of_rows(batches, 8 * BLOCK):
        marks, metas = [], []
        for part in batches_of_rows([batch], BLOCK):
            b, offsets = _texts(part.column(3))
            text, starts, stops = chunks(runs(b, offsets)[3], offsets)
            raw = memoryview(b)
            marks += [xxh3_128_digest(raw[x:y]) for x, y in zip(starts.tolist(), (stops + LENGTH - 1).tolist(), strict=True)]
            meta = np.zeros(len(text), CHUNK)
            meta["ord"], meta["tag"] = _long(part.column(0))[text], _long(part.column(1))[text]
            meta["start"], meta["stop"] = starts - offsets[text], stops - offsets[text]
            metas.append(meta)
        if not marks:
            continue
        mark, meta = np.frombuffer(b"".join(marks), "<i8").reshape(-1, 2), np.concatenate(metas)
        order = np.lexsort((meta["ord"], mark[:, 1], mark[:, 0]))
        mark, meta = mark[order], meta[order]
        a = np.flatnonzero(np.r_[True, (mark[1:] != mark[:-1]).any(axis=1)])
        z = np.r_[a[1:], len(mark)]
        covered = np.add.reduceat(meta["stop"].astype(np.int64) - meta["start"], a)
        own = [meta[x:y].tobytes() for x, y in zip(a.tolist(), z.tolist(), strict=True)]
        columns = (mark[a, 0], mark[a, 1], meta["ord"][a], meta["ord"][z - 1], covered)
        yield pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(x), pa.int64()) for x in columns), pa.array(own, pa.binary())], names=["h1", "h2", "least", "most", "covered", "own"])


def _later_chunks(parts: int):
    """Rows (part, data) of the places of chunks (from, own) in documents after the one ``from``, by their documents' part."""

    def emit(batches: Iterator) -> Iterator:
        for batch in batches_of_rows(batches, 8 * BLOCK):
            own = batch.column(1).to_pylist()
            meta = np.frombuffer(b"".join(own), CHUNK)
            least = np.repeat(_long(batch.column(0)), [len(x) // CHUNK.itemsize for x in own])
            meta = meta[meta["ord"] > least]
            part = _tag_part(meta["tag"].copy(), parts)
            order = np.argsort(part, kind="stable")
            meta, part = meta[order], part[order]
            cuts = list(zip(*_cuts(part), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array([int(part[x]) for x, _ in cuts], pa.int32()), pa.array([meta[x:y].tobytes() for x, y in cuts], pa.binary())], names=["part", "data"])

    return emit


def _by_document(table: pa.Table) -> pa.Table:
    """The places of a part by document: rows (tag, spans), each packing (ord, start, stop)."""
    meta = np.concatenate([np.frombuffer(x.as_buffer(), CHUNK) for x in table["data"]])
    meta = meta[np.lexsort((meta["start"], meta["ord"], meta["tag"]))]
    a, z = _cuts(meta["tag"])
    return pa.table({"tag": pa.array(meta["tag"][a], pa.int64()), "chunks": pa.array([meta[x:y].tobytes() for x, y in zip(a, z, strict=True)], pa.binary())})


def _spans(column: pa.Array, ords: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted starts and stops of the settled spans of all texts, counted from the start of the block."""
    a, z = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k in np.flatnonzero(np.asarray(column.is_valid())).tolist():
        own = np.frombuffer(column[k].as_buffer(), CHUNK)
        own = own[own["ord"] == ords[k]]
        a.append(own["start"].astype(np.int64) + offsets[k])
        z.append(own["stop"].astype(np.int64) + offsets[k])
    a, z = np.concatenate(a), np.concatenate(z)
    order = np.argsort(a, kind="stable")
    return a[order], z[order]


def _all_inside(first: np.ndarray, last: np.ndarray, a: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Whether all places from first to last lie in the sorted spans."""
    if not len(a):
        return np.zeros(len(first), bool)
    z = np.minimum(z, np.r_[a[1:], z[-1:]])
    total = np.r_[0, np.cumsum(z - a)]

    def below(places: np.ndarray) -> np.ndarray:
        k = np.searchsorted(a, places, "left")
        return total[k] - np.where(k > 0, np.maximum(z[np.maximum(k, 1) - 1] - places, 0), 0)

    return below(last + 1) - below(first) == last + 1 - first


def _cuts(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal values."""
    if not len(key):
        none = np.zeros(0, np.int64)
        return none, none
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return start, np.r_[start[1:], len(key)]


def _packed_asks(kind: int, part: np.ndarray, tags: np.ndarray, rest: np.ndarray) -> pa.RecordBatch:
    """A row (kind, part, data) for each part; data: documents, their tags and numbers of hashes, then all hashes."""
    order = np.lexsort((rest, tags, part))
    part, tags, rest = part[order], tags[order], rest[order]
    parts, rows = [], []
    for x, y in zip(*_cuts(part), strict=True):
        a, z = _cuts(tags[x:y])
        parts.append(int(part[x]))
        rows.append(np.int64(len(a)).tobytes() + tags[x:y][a].astype("<i8").tobytes() + (z - a).astype("<u4").tobytes() + rest[x:y].astype("<u4").tobytes())
    return pa.RecordBatch.from_arrays([pa.array([kind] * len(rows), pa.int32()), pa.array(parts, pa.int32()), pa.array(rows, pa.binary())], names=["kind", "part", "data"])


def _unpacked_asks(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int(np.frombuffer(data, "<i8", 1)[0])
    tags, counts = np.frombuffer(data, "<i8", n, 8), np.frombuffer(data, "<u4", n, 8 + 8 * n)
    return np.repeat(tags, counts), np.frombuffer(data, "<u4", -1, 8 + 12 * n)


def _tag_part(tags: np.ndarray, parts: int) -> np.ndarray:
    return (tags.view(_U) >> _U(20)).astype(np.int64) % parts


def _repeated(key: np.ndarray, tags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows sorted by key and then document: whether a key has several documents, and whether a row is its first."""
    a, z = _cuts(key)
    first = np.zeros(len(key), bool)
    first[a] = True
    return np.repeat(tags[a] != tags[z - 1], z - a), first


def _anchor_rows(parts: int):
    """Kind 0: hashes of anchors to be compared with those of other tasks; kind 1: some that are known to stand in two documents."""

    def emit(batches: Iterator) -> Iterator:
        for batch in batches_of_rows(batches, 8 * BLOCK):
            hs, tags = [], []
            for part in batches_of_rows([batch], BLOCK):
                b, offsets = _texts(part.column(3))
                h, first, last, _ = runs(b, offsets)
                spans = _spans(part.column(4), _long(part.column(0)), offsets)
                # A run goes on if any of its strings is not settled.
                keep = ~_all_inside(first, last, *spans)
                hs.append(h[keep])
                tags.append(_long(part.column(1))[np.searchsorted(offsets, first[keep], "right") - 1])
            h, tag = np.concatenate(hs), np.concatenate(tags)
            if not len(h):
                continue
            order = np.lexsort((tag, h))
            h, tag = h[order], tag[order]
            again = np.r_[False, (h[1:] == h[:-1]) & (tag[1:] == tag[:-1])]
            h, tag = h[~again], tag[~again]
            shared, first = _repeated(h, tag)
            rest = (h & _U(0xFFFFFFFF)).astype("<u4")
            if shared.any():
                yield _packed_asks(1, _tag_part(tag[shared], parts), tag[shared], rest[shared])
            lead = first | ~shared  # a shared hash is known already; its first document speaks for it
            yield _packed_asks(0, (h[lead] >> _U(32)).astype(np.int64) % parts, tag[lead], rest[lead])

    return emit


def _shared_anchors(table: pa.Table) -> pa.Table:
    """The anchors' hashes of a part that stand in two documents or more, by document."""
    kept_tags, kept = [], []
    for wanted in (1, 0):
        found = [_unpacked_asks(d) for k, d in zip(table["kind"].to_pylist(), table["data"].to_pylist(), strict=True) if k == wanted]
        if found:
            tags, rest = (np.concatenate(x) for x in zip(*found, strict=True))
            if not wanted:
                order = np.lexsort((tags, rest))
                tags, rest = tags[order], rest[order]
                some, _ = _repeated(rest, tags)
                tags, rest = tags[some], rest[some]
            kept_tags.append(tags)
            kept.append(rest)
    tags, rest = (np.concatenate(kept_tags), np.concatenate(kept)) if kept else (np.zeros(0, "<i8"), np.zeros(0, "<u4"))
    order = np.argsort(tags, kind="stable")
    tags, rest = tags[order], rest[order]
    a, z = _cuts(tags)
    return pa.table({"tag": pa.array(tags[a], pa.int64()), "hashes": pa.array([rest[x:y].tobytes() for x, y in zip(a, z, strict=True)], pa.binary())})


def _run_rows(parts: int):
    """Kind 0: the runs of strings around shared anchors, for their part; kind 1: strings that a task has settled itself."""

    def emit(batches: Iterator) -> Iterator:
        for batch in batches_of_rows(batches, 8 * BLOCK):
            hs, metas, texts = [], [], []
            for part in batches_of_rows([batch], BLOCK):
                found = part.column(4)
                some = np.flatnonzero(np.asarray(found.is_valid()))
                if not len(some):
                    continue
                part = part.take(pa.array(some))
                b, offsets = _texts(part.column(3))
                h, first, last, _ = runs(b, offsets)
                text = np.searchsorted(offsets, first, "right") - 1
                wanted = [(k, np.frombuffer(b"".join(x), "<u4")) for k, x in enumerate(part.column(4).to_pylist())]
                wanted = np.concatenate([(_U(k) << _U(32)) | w.astype(_U) for k, w in wanted])
                keep = np.isin((text.astype(_U) << _U(32)) | (h & _U(0xFFFFFFFF)), wanted)
                first, last, text = first[keep], last[keep], text[keep]
                meta = np.zeros(len(text), RUN)
                meta["ord"], meta["tag"] = _long(part.column(0))[text], _long(part.column(1))[text]
                meta["at"], meta["size"] = first - offsets[text], last - first + LENGTH
                meta["share"] = (h[keep] >> _U(16)) % _U(SHARES)
                raw = b.tobytes()
                texts += [raw[x:y] for x, y in zip(first.tolist(), (last + LENGTH).tolist(), strict=True)]
                hs.append(h[keep])
                metas.append(meta)
            if not texts:
                continue
            h, meta = np.concatenate(hs), np.concatenate(metas)
            # Of equal runs only that of the first document has to meet the other tasks' runs.
            least: dict[bytes, int] = {}
            ords = meta["ord"].tolist()
            for x, o in zip(texts, ords, strict=True):
                if o < least.get(x, o + 1):
                    least[x] = o
            later = np.fromiter((least[x] < o for x, o in zip(texts, ords, strict=True)), bool, len(texts))
            part = (h >> _U(32)).astype(np.int64) % parts
            kinds, numbers, rows = [], [], []
            part_of_later = _tag_part(meta["tag"][later].copy(), parts)
            order = np.argsort(part_of_later, kind="stable")
            done = meta[later][order]
            for x, y in zip(*_cuts(part_of_later[order]), strict=True):
                kinds.append(1)
                numbers.append(int(part_of_later[order[x]]))
                rows.append(done[x:y].tobytes())
            order = np.flatnonzero(~later)
            order = order[np.lexsort((meta["share"][order], part[order]))]
            for x, y in zip(*_cuts(part[order]), strict=True):
                own = order[x:y]
                kinds.append(0)
                numbers.append(int(part[own[0]]))
                rows.append(len(own).to_bytes(4, "little") + meta[own].tobytes() + b"".join([texts[k] for k in own.tolist()]))
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(numbers, pa.int32()), pa.array(rows, pa.binary())], names=["kind", "part", "data"])

    return emit


def refine(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket-pointer refinement: of ``starts``, those whose 50 bytes in ``data`` occur at another start, and their buckets."""
    if not len(starts):
        return starts, starts
    padded = np.r_[data, np.zeros(LENGTH + 2 * GRAM, np.uint8)]
    grams = np.zeros(len(data) + LENGTH, _U)
    for k in range(GRAM):  # every eighth string of 8 bytes is a number of the same view
        own = grams[k::GRAM]
        own[:] = padded[k : k + GRAM * len(own)].view(">u8")
    steps = [GRAM]
    while sum(steps) < LENGTH:
        steps.append(min(sum(steps), LENGTH - sum(steps)))
    # Which suffixes are needed at each depth: those that the deeper ones look at, and they themselves.
    needed = [np.sort(starts)]
    for step in reversed(steps[1:]):
        mark = np.zeros(len(grams), bool)
        mark[needed[-1]] = mark[needed[-1] + step] = True
        needed.append(np.flatnonzero(mark))
    pointer = np.zeros(len(grams), np.uint32)
    suffixes = needed.pop()
    key = grams[suffixes]
    order = np.argsort(key)
    suffixes, key = suffixes[order], key[order]
    first, end = _cuts(key)
    pointer[suffixes] = np.repeat((end - 1).astype(np.uint32), end - first)
    for step in steps[1:]:
        live = needed.pop()
        live = live[_crowded(pointer[live])]
        if not len(live):
            return live, live
        key = pointer[live].astype(_U) << _U(32) | pointer[live + step]
        order = np.argsort(key)
        live, key = live[order], key[order]
        bucket = key >> _U(32)
        first, end = _cuts(bucket)
        after = np.repeat(end, end - first)  # where the suffix's old bucket ends among the live ones
        first, end = _cuts(key)
        pointer[live] = bucket.astype(np.int64) - (after - np.repeat(end, end - first))
    keep = live[_crowded(pointer[live])]
    return keep, pointer[keep].astype(np.int64)


def _crowded(bucket: np.ndarray) -> np.ndarray:
    """Which rows share their bucket."""
    return np.bincount(bucket)[bucket] > 1 if len(bucket) else np.zeros(0, bool)


def _matched(meta: np.ndarray, text: np.ndarray) -> np.ndarray:
    """The strings of these runs that also start in an earlier document, as spans of bytes."""
    begin = np.cumsum(meta["size"].astype(np.int64)) - meta["size"]
    count = meta["size"].astype(np.int64) - LENGTH + 1
    run = np.repeat(np.arange(len(meta)), count)
    starts = begin[run] + np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)
    live, bucket = refine(text, starts)
    if not len(live):
        return np.zeros(0, RUN)
    who = np.searchsorted(begin, live, "right") - 1
    ords = meta["ord"][who]
    order = np.lexsort((ords, bucket))
    first, _ = _cuts(bucket[order])
    least = np.zeros(int(bucket.max()) + 1, np.int64)
    least[bucket[order][first]] = ords[order][first]
    gone = np.sort(live[ords > least[bucket]])
    if not len(gone):
        return np.zeros(0, RUN)
    who = np.searchsorted(begin, gone, "right") - 1
    cut = np.flatnonzero(np.r_[True, (gone[1:] != gone[:-1] + 1) | (who[1:] != who[:-1])])
    found = np.zeros(len(cut), RUN)
    found["ord"], found["tag"] = meta["ord"][who[cut]], meta["tag"][who[cut]]
    found["at"], found["size"] = meta["at"][who[cut]] + (gone[cut] - begin[who[cut]]), np.diff(np.r_[cut, len(gone)]) + LENGTH - 1
    return found


def _resolved(table: pa.Table) -> pa.Table:
    """The strings of a part that also start in an earlier document, as spans of bytes by document; one share after another."""
    shares: list[list] = [[] for _ in range(SHARES)]
    spans = []
    for chunk in zip(table["kind"], table["data"], strict=True):
        kind, data = chunk[0].as_py(), chunk[1].as_buffer()
        if kind == 1:
            spans.append(np.frombuffer(data, RUN))
            continue
        n = int(np.frombuffer(data, "<u4", 1)[0])
        meta, text = np.frombuffer(data, RUN, n, 4), np.frombuffer(data, np.uint8, offset=4 + n * RUN.itemsize)
        end = np.cumsum(meta["size"].astype(np.int64))
        for a, z in zip(*_cuts(meta["share"]), strict=True):
            shares[meta["share"][a]].append((meta[a:z], text[end[a] - int(meta["size"][a]) : end[z - 1]]))
    for share in shares:
        if share:
            spans.append(_matched(*(np.concatenate(x) for x in zip(*share, strict=True))))
    rows = np.concatenate(spans) if spans else np.zeros(0, RUN)
    rows = rows[np.lexsort((rows["at"], rows["tag"], rows["ord"]))]
    cut = np.flatnonzero(np.r_[True, (rows["ord"][1:] != rows["ord"][:-1]) | (rows["tag"][1:] != rows["tag"][:-1])]) if len(rows) else np.zeros(0, np.int64)
    pair = np.stack([rows["at"], rows["at"] + rows["size"]], axis=1).astype("<u4")
    blobs = [pair[a:z].tobytes() for a, z in zip(cut, np.r_[cut[1:], len(rows)], strict=True)]
    return pa.table({"ord": pa.array(rows["ord"][cut], pa.int64()), "tag": pa.array(rows["tag"][cut], pa.int64()), "spans": pa.array(blobs, pa.binary())})


def _cut(batches: Iterator) -> Iterator:
    """Merge a document's spans and cut them out."""
    for batch in batches_of_rows(batches):
        sizes, spans, kept = [], [], []
        for own, text, chunk, fine in zip(*(batch.column(k) for k in (0, 3, 4, 5)), strict=True):
            raw, own = text.as_py(), own.as_py()
            sizes.append(len(raw))
            pairs = [(a, z + LENGTH - 1) for o, _, a, z in (np.frombuffer(chunk.as_buffer(), CHUNK).tolist() if chunk.is_valid else []) if o == own]
            pairs += [tuple(p) for x in fine.as_py() or [] if x["ord"] == own for p in np.frombuffer(x["spans"], "<u4").reshape(-1, 2).tolist()]
            merged: list[list[int]] = []
            for a, z in sorted(pairs):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], z)
                else:
                    merged.append([a, z])
            spans.append([{"start": a, "stop": z} for a, z in merged])
            at, parts = 0, []
            for a, z in merged:
                parts.append(raw[at:a])
                at = z
            kept.append(b"".join([*parts, raw[at:]]))
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], names=["id", "n_bytes", "spans", "kept"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``n_bytes``, ``spans`` (removed runs: start, stop), ``kept`` (the other bytes).

    Null texts are empty; texts under 50 bytes stay whole.  A null id counts
    after every other.  Rows with one id never remove each other's bytes, and
    repeated rows stay repeated.  Strings are judged on the input.  Other columns
    are not read; an empty table gives an empty result.
    """
    spark = ready(docs.sparkSession)
    raw = text_of(text_col).cast("binary")
    ident = F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID))
    # A row is known by the hash of its id and text; what comes back to it also names its id.
    rows = docs.select(ident.alias("ord"), F.xxhash64(ident, raw).alias("tag"), F.col(id_col).alias("id"), raw.alias("text"))

    cut = checkpointed(rows.mapInArrow(_chunk_rows, "h1 long, h2 long, least long, most long, covered long, own binary"))
    covered = cut.agg(F.sum("covered")).first()[0] or 0
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), covered // PART_BYTES)
    cut = cut.withColumn("salt", F.pmod(F.xxhash64("least", "most"), F.lit(SALTS)).cast("int"))
    salted = cut.groupBy("h1", "h2", "salt").agg(F.min("least").alias("from"), F.max("most").alias("to"))
    firsts = salted.groupBy("h1", "h2").agg(F.min("from").alias("from"), F.max("to").alias("to"), F.collect_set("salt").alias("salts")).where("from < to")
    firsts = firsts.select("h1", "h2", "from", F.explode("salts").alias("salt"))
    again = cut.join(firsts, ["h1", "h2", "salt"]).where("most > from").select("from", "own").mapInArrow(_later_chunks(parts), "part int, data binary")
    settled = again.groupBy("part").applyInArrow(_by_document, "tag long, chunks binary")

    asked = rows.join(settled, "tag", "left").select("ord", "tag", "id", "text", "chunks").mapInArrow(_anchor_rows(parts), "kind int, part int, data binary")
    shared = asked.groupBy("part").applyInArrow(_shared_anchors, "tag long, hashes binary")
    hashes = shared.groupBy("tag").agg(F.collect_list("hashes").alias("hashes"))

    sent = rows.join(hashes, "tag", "left").select("ord", "tag", "id", "text", "hashes").mapInArrow(_run_rows(parts), "kind int, part int, data binary")
    fine = sent.groupBy("part").applyInArrow(_resolved, "ord long, tag long, spans binary")
    spans = fine.groupBy("tag").agg(F.collect_list(F.struct("ord", "spans")).alias("fine"))

    kind = docs.schema[id_col].dataType.simpleString()
    whole = rows.join(settled, "tag", "left").join(spans, "tag", "left").select("ord", "tag", "id", "text", "chunks", "fine")
    out = whole.mapInArrow(_cut, f"id {kind}, n_bytes long, spans array<struct<start:long,stop:long>>, kept binary")
    return out.withColumnRenamed("id", id_col)
