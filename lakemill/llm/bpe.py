"""Byte-level BPE: encoding by tree concatenation, and decoding.

Texts up to ``leaf_chars`` are encoded where they are.  A longer text is cut
into leaves, which are encoded in parallel by different tasks and then joined
pairwise, level by level, like a tree.  At each join only a window of tokens
around the seam is encoded again.  It grows until the new tokens agree with
those of the left side where the window begins and with those of the right side
before it ends (or until it covers a side whole).  Two facts make that exact:
the splitting pattern looks ahead by a bounded number of characters and never
back, so that scans which share one boundary stay together; and within one
unsplit run, tokens form the BPE encoding if and only if each adjacent pair
does, so that a shared token is enough to splice two valid sequences.

The vocabulary is a parameter, read on the driver and broadcast (1.5 MB).
"""

from __future__ import annotations

import hashlib
import json
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakemill.llm.common import batches_of_rows, ready, text_of

#: The splitting pattern of byte-level BPE vocabularies of this family (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LEAF_CHARS = 32_768
#: Bytes of text that a task holds at once.
BATCH_BYTES = 4 << 20
#: Tokens that both encodings must share for a splice, and bytes kept away from a cut.
AGREE, MARGIN = 4, 32


def default_tokenizer() -> str:
    """Path of the 50k byte-level vocabulary of the installed tokenizer package."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: visible Latin-1 stays, the rest counts up from U+0100."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(seen)]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """One vocabulary, ready to encode and decode."""

    def __init__(self, spec: bytes) -> None:
        import tiktoken

        model = json.loads(spec)
        letters = _byte_alphabet()
        special = {t["content"]: t["id"] for t in model.get("added_tokens", [])}
        vocab = {bytes(letters[c] for c in k): v for k, v in model["model"]["vocab"].items() if k not in special}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"]]
        order = [model["model"]["vocab"]["".join(m)] for m in merges]
        if order != sorted(order):
            raise ValueError("the ids of this vocabulary do not follow the order of its merges")
        self._bpe = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=vocab, special_tokens=special)
        top = max([*vocab.values(), *special.values()]) + 1
        self.parts = [b""] * top
        for piece, i in [*vocab.items(), *((k.encode(), v) for k, v in special.items())]:
            self.parts[i] = piece
        self.sizes = np.array([len(x) for x in self.parts], dtype=np.int64)

    def encode(self, text: str) -> list[int]:
        return self._bpe.encode(text, allowed_special="all")

    def decode(self, ids) -> str:
        return b"".join(map(self.parts.__getitem__, ids)).decode("utf-8", "replace")

    def join(self, left: bytes, a: np.ndarray, right: bytes, b: np.ndarray, window: int = 32) -> np.ndarray:
        """The tokens of ``left + right`` from the tokens ``a`` and ``b`` of its parts."""
        if not len(a) or not len(b):
            return a if len(a) else b
        starts, ends = np.cumsum(self.sizes[a]) - self.sizes[a], np.cumsum(self.sizes[b])
        while True:
            i, j = max(0, len(a) - window), min(len(b), window) - 1
            while i and (left[starts[i]] & 0xC0) == 0x80:
                i -= 1
            while j + 1 < len(b) and (right[ends[j]] & 0xC0) == 0x80:
                j += 1
            seam, cut = len(left) - starts[i], int(ends[j])
            new = np.array(self.encode((left[starts[i] :] + right[:cut]).decode("utf-8", "replace")), dtype=np.uint32)
            enough = i == 0 or (seam > 2 * MARGIN and np.array_equal(new[:AGREE], a[i : i + AGREE]))
            if enough and j + 1 == len(b):
                return np.concatenate([a[:i], new])
            if enough:
                edges = np.cumsum(self.sizes[new]) - seam
                for y in range(j + 1):
                    if ends[y + AGREE if y + AGREE <= j else j] > cut - MARGIN or y + AGREE > j:
                        break
                    x = int(np.searchsorted(edges, ends[y]))
                    if x < len(edges) and edges[x] == ends[y] and np.array_equal(new[x + 1 : x + 1 + AGREE], b[y + 1 : y + 1 + AGREE]) and x + 1 + AGREE <= len(new):
                        return np.concatenate([a[:i], new[: x + 1], b[y + 1 :]])
            window *= 2

    def tree(self, leaves: list[tuple[bytes, np.ndarray]]) -> np.ndarray:
        """Join neighbours until one sequence is left."""
        while len(leaves) > 1:
            pairs = [leaves[k : k + 2] for k in range(0, len(leaves), 2)]
            leaves = [p[0] if len(p) == 1 else (p[0][0] + p[1][0], self.join(*p[0], *p[1])) for p in pairs]
        return leaves[0][1] if leaves else np.zeros(0, np.uint32)


@lru_cache(maxsize=4)
def codec(spec: bytes) -> Codec:
    return Codec(spec)


def pack(ids) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return np.asarray(ids, dtype="<u4").tobytes() if isinstance(ids, np.ndarray) else array("I", ids).tobytes()


def unpack(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, dtype="<u4")


def _shipped(spark: SparkSession, path: str | None):
    with open(path or default_tokenizer(), "rb") as f:
        return ready(spark).sparkContext.broadcast(f.read())


def _split(docs: DataFrame, id_col: str, text_col: str, spec, leaf_chars: int) -> tuple[DataFrame, DataFrame]:
    """Rows (key, text) of the texts that fit into a leaf, and (key, ids) of the others, encoded by tree concatenation."""

    @F.arrow_udf("binary")
    def tokens(texts: pa.Array) -> pa.Array:
        bpe = codec(spec.value)
        return pa.array([pack(bpe.encode(x.as_py())) for x in texts], pa.binary())

    def leaves(batches):
        for batch in batches_of_rows(batches):
            for key, rid, text in zip(*(batch.column(k) for k in range(3)), strict=True):
                t, key, rid = text.as_py(), key.as_py(), rid.as_py()
                cuts = range(0, len(t), leaf_chars)
                yield pa.RecordBatch.from_pydict({"key": pa.array([key] * len(cuts), batch.column(0).type), "rid": pa.array([rid] * len(cuts), pa.int64()), "seq": pa.array(range(len(cuts)), pa.int32()), "piece": pa.array([t[c : c + leaf_chars] for c in cuts], pa.string())})

    def joined(table: pa.Table) -> pa.Table:
        bpe = codec(spec.value)
        rows = sorted(zip(table["seq"].to_pylist(), table["piece"].to_pylist(), table["ids"].to_pylist(), strict=True))
        ids = bpe.tree([(piece.encode(), unpack(x).astype(np.uint32)) for _, piece, x in rows])
        return pa.table({"key": table["key"].slice(0, 1), "ids": pa.array([pack(ids)], pa.binary())})

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("key"), text_of(text_col).alias("text"))
    long = F.char_length("text") > leaf_chars
    cut = rows.where(long).select("key", F.monotonically_increasing_id().alias("rid"), "text").mapInArrow(leaves, f"key {kind}, rid long, seq int, piece string")
    encoded = cut.repartition("rid", "seq").withColumn("ids", tokens("piece"))
    return rows.where(~long), encoded.groupBy("rid").applyInArrow(joined, f"key {kind}, ids binary")


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """Encode whole texts.

    Returns ``id_col``, ``ids`` (binary, little-endian unsigned 32-bit) and
    ``n_tokens``, one row per input row.  Null and empty texts have no tokens; a
    null id stays null; repeated rows stay repeated; other columns of the input
    are not read.  Special-token strings in a text become their ids.
    """
    spec = _shipped(docs.sparkSession, path)
    short, whole = _split(docs, id_col, text_col, spec, leaf_chars)

    def tokens(batches):
        bpe = codec(spec.value)
        for batch in batches_of_rows(batches, BATCH_BYTES):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([pack(bpe.encode(x.as_py())) for x in batch.column(1)], pa.binary())], names=["key", "ids"])

    rows = short.mapInArrow(tokens, f"key {docs.schema[id_col].dataType.simpleString()}, ids binary").unionByName(whole)
    return rows.select(F.col("key").alias(id_col), "ids", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"))


def decoder(spark: SparkSession, path: str | None = None):
    """A column function from packed ids to text; bytes that are not UTF-8 become U+FFFD, null stays null."""
    spec = _shipped(spark, path)

    @F.arrow_udf("string")
    def texts(packed: pa.Array) -> pa.Array:
        bpe = codec(spec.value)
        return pa.array([None if x.as_py() is None else bpe.decode(unpack(x.as_py()).tolist()) for x in packed], pa.string())

    return texts


def decode(tokens: DataFrame, ids_col: str = "ids", path: str | None = None, out_col: str = "decoded") -> DataFrame:
    """Add the decoded text, special tokens included."""
    return tokens.withColumn(out_col, decoder(tokens.sparkSession, path)(F.col(ids_col)))


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """Encode, decode and digest every text: id, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``.

    The same as :func:`decode` of :func:`encode`, and with the same rows; texts
    that fit into a leaf go to Python once, and only their digests come back.
    """
    spec = _shipped(docs.sparkSession, path)
    short, whole = _split(docs, id_col, text_col, spec, leaf_chars)

    def digests(batches):
        bpe = codec(spec.value)
        for batch in batches_of_rows(batches, BATCH_BYTES):
            counts, ids, decoded = [], [], []
            for x in batch.column(1):
                tokens = bpe.encode(x.as_py())
                counts.append(len(tokens))
                ids.append(hashlib.sha256(pack(tokens)).hexdigest())
                decoded.append(hashlib.sha256(bpe.decode(tokens).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = short.mapInArrow(digests, f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    sha: Column = F.sha2(decoder(docs.sparkSession, path)("ids").cast("binary"), 256)
    more = whole.select("key", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), sha.alias("decoded_sha256"))
    return rows.unionByName(more).withColumnRenamed("key", id_col)
