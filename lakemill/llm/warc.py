"""WARC archives: a deterministic sharded writer and a reader.

Pages are dealt into shards by ranges of their id and their payload's digest, and
each shard is sorted and written by one task as a run of ``.warc.gz`` files; a
new file begins when the compressed size of the last one reaches a limit.  The
ranges come from a sample of bounded size that a hash of the pages' keys takes,
so that the same pages give the same files, however the input is partitioned.
Headers and digests are made anew from the
pages, and every record is a gzip member of its own.

A file is written under a temporary name, which holds the task attempt, and
renamed when it is complete; a task that runs again writes the same bytes.  The
manifest, a Parquet table beside the files, is committed last and names the files
that count.
"""

from __future__ import annotations

import hashlib
import posixpath
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakemill.llm.common import ready

#: Payload bytes of a shard, compressed bytes of a file, smallest payload that is deduplicated, and about how many pages are sampled for the shards' ranges.
SHARD_BYTES, FILE_BYTES, MIN_DEDUP, SAMPLE = 16 << 20, 16 << 20, 1000, 65_536
#: Sampled pages that a shard should have, so that its size comes out near the others', that it must have, and that are sampled at least.
PER_SHARD, LEAST_PER_SHARD, LEAST_SAMPLE = 64, 4, 1024
SALTS, LEVEL = 64, 6
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
MANIFEST = "_manifest"
RECORD_SCHEMA = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary, file string"


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def _member(head: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [f"{k}: {v}" for k, v in [*head, ("Content-Length", str(len(block)))]]
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)  # 31: gzip, without a time stamp
    return z.compress("\r\n".join(["WARC/1.1", *lines, "", ""]).encode() + block + b"\r\n\r\n") + z.flush()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One page as a compressed record: a response, or a revisit of the page ``refers_to``."""
    digest = hashlib.sha1(payload).hexdigest()
    uri = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    block = HTTP % len(payload) + (payload if refers_to is None else b"")
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", _record_id(page_id, digest)), ("WARC-Date", DATE)]
    head += [("WARC-Target-URI", uri)] if url is not None else []
    head += [("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{hashlib.sha1(block).hexdigest()}"), ("X-Payload-Length", str(len(payload)))]
    head += [("X-Page-ID", str(page_id))] if page_id is not None else []
    if refers_to is not None:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _record_id(refers_to, digest)), ("X-Refers-To-Page", str(refers_to))]
    return _member(head, block)


class _Roll:
    """The files of one shard."""

    def __init__(self, folder: str, limit: int, attempt: str) -> None:
        (self.fs, self.folder), self.limit, self.attempt = _filesystem(folder), limit, attempt
        self.out, self.done = None, []

    def open(self, shard: int, seq: int) -> None:
        self.shard, self.seq, self.records, self.size, self.sum = shard, seq, 0, 0, hashlib.sha256()
        self.name = f"part-{shard:06d}-{seq:05d}.warc.gz"
        self.part = posixpath.join(self.folder, f"_temporary-{self.attempt}-{self.name}")
        self.out = self.fs.open_output_stream(self.part, compression=None)
        head = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", _record_id(None, self.name)), ("WARC-Date", DATE), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")]
        self.write(_member(head, b"software: lakemill\r\nformat: WARC file version 1.1\r\n"))
        self.records = 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.sum.update(data)
        self.records, self.size = self.records + 1, self.size + len(data)

    def add(self, shard: int, data: bytes) -> None:
        if self.out and (self.shard != shard or self.size >= self.limit):
            self.close()
        if not self.out:
            self.open(shard, 0 if not self.done or self.done[-1][1] != shard else self.done[-1][2] + 1)
        self.write(data)

    def close(self) -> None:
        if self.out:
            self.out.close()
            self.fs.move(self.part, posixpath.join(self.folder, self.name))
            self.done.append((self.name, self.shard, self.seq, self.records, self.size, self.sum.hexdigest()))
            self.out = None


def _revisits(rows: DataFrame, min_dedup: int) -> DataFrame:
    """(id, digest, head) of pages that revisit another one; digests meet by salts first, so that a common payload is spread."""
    big = rows.where(F.octet_length("payload") >= min_dedup).select("id", F.sha2("payload", 256).alias("sha"), F.sha1("payload").alias("digest"))
    big = big.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    salted = big.groupBy("sha", "salt").agg(F.max("id").alias("head"), F.count("*").alias("n"))
    heads = salted.groupBy("sha").agg(F.max("head").alias("head"), F.sum("n").alias("n"), F.collect_set("salt").alias("salts")).where("n > 1")
    heads = heads.select("sha", "head", F.explode("salts").alias("salt"))
    return big.join(heads, ["sha", "salt"]).where(F.col("head").isNotNull() & ~F.col("id").eqNullSafe(F.col("head"))).select("id", "digest", "head").distinct()


def _key(digest: Column) -> Column:
    """The first 60 bits of a hex digest, in the digests' order."""
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def _shards(rows: DataFrame, shard_bytes: int, sample: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys (id, key of the digest) at which new shards begin; a null id is the least.

    ``rows`` has id, digest and size.  Pages with one key go into one shard.
    """
    found = rows.agg(F.count("*").alias("n"), F.sum("size").alias("size")).first()
    shards = (found["size"] or 0) // shard_bytes + 1
    every = max(1, -(-found["n"] // min(sample, max(LEAST_SAMPLE, PER_SHARD * shards))))
    taken = rows.select(F.coalesce("id", F.lit(-(2**63))).alias("id"), _key(F.col("digest")).alias("key"), "size").where(F.pmod(F.xxhash64("id", "key"), F.lit(every)) == 0)
    taken = sorted(map(tuple, taken.groupBy("id", "key").agg(F.sum("size").alias("size")).collect()))
    total = sum(size for *_, size in taken)
    shards = max(1, min(shards, len(taken) // LEAST_PER_SHARD))
    cuts, filled = [], 0
    for ident, key, size in taken:
        if filled >= total / shards * (len(cuts) + 1):
            cuts.append((ident, key))
        filled += size
    return np.array([c[0] for c in cuts], np.int64), np.array([c[1] for c in cuts], np.int64)


def _shard_of(ids: np.ndarray, keys: np.ndarray, cuts: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The number of cuts at or before each (id, key)."""
    low, high = np.searchsorted(cuts[0], ids, "left"), np.searchsorted(cuts[0], ids, "right")
    for k in np.unique(low[low < high]).tolist():  # ids at which shards begin
        some = np.flatnonzero((low == k) & (high > k))
        low[some] += np.searchsorted(cuts[1][k : high[some[0]]], keys[some], "right")
    return low


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", shard_bytes: int = SHARD_BYTES, file_bytes: int = FILE_BYTES, min_dedup: int = MIN_DEDUP, sample: int = SAMPLE) -> DataFrame:
    """Write every page to ``folder`` and return the committed manifest.

    Null html is an empty payload.  Of equal payloads of at least ``min_dedup``
    bytes the page with the largest id is a response and the others revisit it;
    repeated rows of that page are all responses.  A null id counts below every
    other; pages whose equals all have null ids are responses.  A null url gives
    a record without a target.  Other columns are not read.  An empty table gives
    an empty manifest.  Shards grow beyond ``shard_bytes`` where ``sample`` pages
    can't tell so many apart.
    """
    spark = ready(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary").alias("payload"))
    cuts = _shards(rows.select("id", F.sha1("payload").alias("digest"), (F.octet_length("payload").cast("long") + 500).alias("size")), shard_bytes, sample)
    n_shards, shipped = len(cuts[0]) + 1, spark.sparkContext.broadcast(cuts)  # 16 bytes a cut, of which there are fewer than sampled pages

    @F.arrow_udf("int")
    def shard(ids: pa.Array, keys: pa.Array) -> pa.Array:
        return pa.array(_shard_of(ids.to_numpy(), keys.to_numpy(), shipped.value), pa.int32())

    def sharded(df: DataFrame) -> DataFrame:
        return df.withColumn("shard", shard(F.coalesce("id", F.lit(-(2**63))), _key(F.col("digest"))))

    # A page's mark comes before the page itself; so one pass over a sorted shard joins them.
    marks = sharded(_revisits(rows, min_dedup)).select("shard", "id", "digest", F.lit(0).alias("kind"), "head", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"))
    whole = sharded(rows.withColumn("digest", F.sha1("payload"))).select("shard", "id", "digest", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("head"), "url", "payload")
    placed = marks.unionByName(whole).repartitionById(n_shards, F.col("shard")).sortWithinPartitions("shard", "id", "digest", "kind", "url")

    def archive(batches: Iterator) -> Iterator:
        files, mark = _Roll(folder, file_bytes, uuid.uuid4().hex), None
        for batch in batches:
            for shard, ident, digest, kind, head, url, payload in zip(*(c for c in batch.columns), strict=True):
                ident, digest = ident.as_py(), digest.as_py()
                if kind.as_py() == 0:
                    mark = (ident, digest, head.as_py())
                else:
                    files.add(shard.as_py(), record(ident, url.as_py(), payload.as_py(), mark[2] if mark and mark[:2] == (ident, digest) else None))
        files.close()
        names = ["file", "shard", "seq", "records", "bytes", "sha256"]
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
        columns = list(zip(*files.done, strict=True)) or [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    fs, path = _filesystem(folder)
    fs.create_dir(path, recursive=True)
    placed.mapInArrow(archive, "file string, shard int, seq int, records long, bytes long, sha256 string").write.parquet(posixpath.join(folder, MANIFEST))
    return pages.sparkSession.read.parquet(posixpath.join(folder, MANIFEST))


def _members(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The decompressed gzip members of a stream, one at a time."""
    z, parts, data = zlib.decompressobj(31), [], stream.read(chunk)
    while data:
        parts.append(z.decompress(data))
        if z.eof:
            yield b"".join(parts)
            data, z, parts = z.unused_data, zlib.decompressobj(31), []
            data = data or stream.read(chunk)
        else:
            data = stream.read(chunk)
    if any(parts):
        raise ValueError("the last record is cut off")


def parse(member: bytes) -> dict | None:
    """A record's fields as in RECORD_SCHEMA (without the file), None for a file header; broken digests raise."""
    raw, _, rest = member.partition(b"\r\n\r\n")
    lines = raw.decode().split("\r\n")
    head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    if head["WARC-Type"] not in ("response", "revisit"):
        return None
    block = rest[: int(head["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    digest, kind = head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"]
    if len(block) < int(head["Content-Length"]) or hashlib.sha1(block).hexdigest() != head["WARC-Block-Digest"].removeprefix("sha1:"):
        raise ValueError(f"block digest of {head['WARC-Record-ID']}")
    if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"payload digest of {head['WARC-Record-ID']}")
    number = lambda k: int(head[k]) if k in head else None
    return {"page_id": number("X-Page-ID"), "url": head.get("WARC-Target-URI"), "record_type": kind, "payload_bytes": number("X-Payload-Length"), "payload_digest": digest, "refers_to": number("X-Refers-To-Page"), "payload": payload if kind == "response" else None}


def read(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """The records of the files that the manifest names, with digests checked; ``payload`` is null for revisits, or for all."""
    ready(spark)
    manifest = spark.read.parquet(posixpath.join(folder, MANIFEST)).select("file")
    schema = RECORD_SCHEMA if payloads else RECORD_SCHEMA.replace("payload binary, ", "")
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    target = pa.schema([(n, kinds[x.split()[1]]) for n, x in zip(names, schema.split(", "), strict=True)])

    def records(batches: Iterator) -> Iterator:
        fs, path = _filesystem(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with fs.open_input_stream(posixpath.join(path, name), compression=None) as stream:
                    held, size = [], 0
                    for member in _members(stream):
                        found = parse(member)
                        if found is not None:
                            held.append({k: v for k, v in (found | {"file": name}).items() if k in names})
                            size += len(member)
                        if size > 8 << 20:
                            yield pa.RecordBatch.from_pylist(held, target)
                            held, size = [], 0
                    yield pa.RecordBatch.from_pylist(held, target)

    n = max(1, manifest.count())
    tasks = min(n, max(1, spark.sparkContext.defaultParallelism * 8))
    return manifest.repartition(tasks).mapInArrow(records, schema)
