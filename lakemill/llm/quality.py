"""Quality classification by nearest-neighbour voting in a latent-semantic space.

A text becomes a vector of hashed byte trigrams (log counts) and of a few
marked ranges of its shape, weighted by inverse document frequency.  The
leading eigenvectors of the labelled sample's Gram matrix give the latent space
(latent semantic analysis).  The labelled vectors are broadcast - their number
and size are bounded by parameters - and each document's cosines with all of
them are computed exactly, block by block.  The nearest vote with weights that
grow with their similarity.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakemill.llm.common import ready, text_of

#: Hash buckets, latent dimensions, neighbours, power of the similarity, and the bound of the labelled sample.
BUCKETS, LATENT, NEIGHBOURS, POWER, MOST_LABELLED = 2048, 64, 15, 8, 4000
BLOCK = 512
#: Edges of the ranges of each measure of shape (see shape); a text marks the range that it falls into.
EDGES = {
    "words": (1, 20, 50, 200, 1000),
    "distinct_words": (0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6),
    "distinct_pairs": (0.1, 0.3, 0.5, 0.7, 0.85, 0.95),
    "distinct_lines": (0.2, 0.4, 0.6, 0.8, 0.95),
    "capitals": (0.05, 0.1, 0.2, 0.4),
    "marks": (0.02, 0.05, 0.1, 0.2, 0.4),
    "length": (3.0, 4.0, 5.0, 6.0, 7.0, 9.0),
}
SHAPE_WEIGHT = 3.0
WIDTH = BUCKETS + sum(len(x) + 1 for x in EDGES.values())
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MARKS = b"#*$%&|<>!?=+~^_{}[]/\\@"


def shape(raw: bytes) -> list[float]:
    words = raw.split()
    n = max(1, len(words))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    size = sum(map(len, words))
    return [len(words), len(set(words)) / n, len(set(zip(words, words[1:], strict=False))) / max(1, n - 1), len(set(lines)) / max(1, len(lines)), (len(raw) - len(raw.translate(None, CAPITALS))) / max(1, size), (len(raw) - len(raw.translate(None, MARKS))) / n, size / n]


def counts(text: str) -> np.ndarray:
    """The unweighted vector of a text."""
    raw = text.encode()
    v = np.zeros(WIDTH, np.float32)
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    if len(b) >= 3:
        code = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
        v[:BUCKETS] = np.log1p(np.bincount((code * np.uint32(2654435761)) >> np.uint32(21), minlength=BUCKETS))
        v[:BUCKETS] /= max(1e-9, float(np.linalg.norm(v[:BUCKETS])))
    at = BUCKETS
    for value, edges in zip(shape(raw), EDGES.values(), strict=True):
        v[at + int(np.searchsorted(edges, value, side="right"))] = 1.0 / len(EDGES) ** 0.5
        at += len(edges) + 1
    return v


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = MOST_LABELLED) -> dict | None:
    """The latent space and the labelled vectors in it, from at most ``most`` labelled rows taken by a hash of the id.

    ``labels`` holds the rows that may be learned from.  Labels other than 0 and
    1 and null ids are left out; a repeated id counts once, with its larger
    label and, of its texts, that whose vector has the least bytes.  None if there is nothing to learn from.
    """
    ready(docs.sparkSession)
    usable = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("label_id")).agg(F.max(label_col).cast("int").alias("label"))
    sample = usable.orderBy(F.xxhash64("label_id"), "label_id").limit(most)

    def vectors(batches):
        for batch in batches:
            rows = [counts(x.as_py() or "").tobytes() for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.binary())], names=["id", "label", "v"])

    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), F.col("id") == F.col("label_id"))
    kind = docs.schema[id_col].dataType.simpleString()
    got = chosen.select("id", "label", "text").mapInArrow(vectors, f"id {kind}, label int, v binary")
    got = got.groupBy("id").agg(F.max("label").alias("label"), F.min("v").alias("v")).collect()
    if not got:
        return None
    got.sort(key=lambda r: r["id"])
    x = np.frombuffer(b"".join(r["v"] for r in got), np.float32).reshape(len(got), WIDTH).astype(np.float64)
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))) + 0.1
    idf[BUCKETS:] = SHAPE_WEIGHT
    x *= idf
    x = unit(x)
    # Leading eigenvectors of the Gram matrix by subspace iteration from a fixed start.
    basis = np.linalg.qr(np.random.Generator(np.random.PCG64(1)).normal(size=(WIDTH, LATENT + 32)))[0]
    for _ in range(12):
        basis = np.linalg.qr(x.T @ (x @ basis))[0]
    inner = x @ basis
    space = basis @ np.linalg.eigh(inner.T @ inner)[1][:, ::-1][:, :LATENT]
    return {"space": (idf[:, None] * space).astype(np.float32), "known": unit(x @ space).astype(np.float32), "labels": np.array([r["label"] for r in got], np.float32)}


def vote(model: dict, texts: list[str]) -> np.ndarray:
    """The weighted share of good labels among each text's nearest neighbours."""
    out = np.full(len(texts), 0.5)
    k = min(NEIGHBOURS, len(model["labels"]))
    for at in range(0, len(texts), BLOCK):
        x = np.stack([counts(t) for t in texts[at : at + BLOCK]])
        cosine = unit(x @ model["space"]) @ model["known"].T
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 1e-6).astype(np.float64) ** POWER
        out[at : at + len(x)] = (weight * model["labels"][near]).sum(axis=1) / weight.sum(axis=1)
    return np.clip(out, 0.0, 1.0)


def score(docs: DataFrame, model: dict | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``score``, ``predicted``.

    A null text is an empty one; both are scored like any other.  Without a
    model every score is 0.5.  Only id and text are read; ids may be null or
    repeat.
    """
    shipped = ready(docs.sparkSession).sparkContext.broadcast(model)  # under 3 MB by the bounds above

    @F.arrow_udf("double")
    def voted(texts: pa.Array) -> pa.Array:
        rows = [x.as_py() for x in texts]
        return pa.array(vote(shipped.value, rows) if shipped.value else [0.5] * len(rows), pa.float64())

    rows = docs.select(F.col(id_col), voted(text_of(text_col)).alias("score"))
    return rows.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int"))
