"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1.  A letter trigram is the product
(binding) of its letters' vectors, each rotated (permuted) by its place.  A text
is the sum (bundle) of its trigrams' vectors, a language the sum of its texts'
vectors at unit length, and a text gets the language whose vector has the
highest cosine with its own.

Trigrams repeat within a block of texts, so a block is one product of a count
matrix and the vectors of the trigrams that it has.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakemill.llm.common import ready

DIMENSIONS, SEED = 1024, 20_011
#: Texts of each language that are learned from, as many on average, and how many languages: the commonest.
PER_LANGUAGE, MOST_LANGUAGES = 1500, 4096
BLOCK_BYTES, BLOCK_TEXTS = 1 << 20, 256
#: Trigrams of a block that are bound at once, and the steps of a unit vector's numbers when they are added up.
BOUND, STEPS = 8192, 1 << 24
_CODE = 21  # bits of a code point


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Code point to itself if it is a letter, else to 0."""
    return np.array([c if chr(c).isalpha() else 0 for c in range(0x110000)], np.int64)


def letter_vectors(points: np.ndarray) -> np.ndarray:
    """The +1 and -1 vector of each code point, made from its number and the seed alone."""
    with np.errstate(over="ignore"):
        x = points.astype(np.uint64)[:, None] * np.uint64(DIMENSIONS // 64) + np.arange(1, DIMENSIONS // 64 + 1, dtype=np.uint64) + np.uint64(SEED) * np.uint64(0x9E3779B97F4A7C15)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        x ^= x >> np.uint64(31)
    return np.unpackbits(x.astype("<u8").view(np.uint8).reshape(len(points), -1), axis=1, bitorder="little").astype(np.int8) * 2 - 1


def trigrams(text: str) -> np.ndarray:
    """Codes of the trigrams whose middle is a letter; word edges count as code point 0."""
    found = letters()[np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), "<u4")]
    keep = (found[1:] != 0) | (found[:-1] != 0)
    found = found[np.r_[True, keep]]
    codes = found[:-2] << 2 * _CODE | found[1:-1] << _CODE | found[2:]
    return codes[found[1:-1] != 0]


def bound(codes: np.ndarray) -> np.ndarray:
    """The vectors of trigrams: their letters' vectors, rotated by their places and multiplied."""
    mask, out = (1 << _CODE) - 1, None
    for place in (2, 1, 0):
        points, at = np.unique(codes >> place * _CODE & mask, return_inverse=True)
        turned = np.roll(letter_vectors(points), place, axis=1)[at]
        out = turned if out is None else out * turned
    return out


def vectors(block: list[np.ndarray]) -> np.ndarray:
    """The bundle of each array of trigram codes, one row each."""
    every = np.concatenate(block) if block else np.zeros(0, np.int64)
    out = np.zeros((len(block), DIMENSIONS), np.float32)
    if not len(every):
        return out
    used, column = np.unique(every, return_inverse=True)
    row = np.repeat(np.arange(len(block)), [len(x) for x in block])
    for lo in range(0, len(used), BOUND):
        n = min(BOUND, len(used) - lo)
        own = slice(None) if n == len(used) else (column >= lo) & (column < lo + n)
        counts = np.bincount(row[own] * n + column[own] - lo, minlength=len(block) * n).reshape(len(block), n)
        out += counts.astype(np.float32) @ bound(used[lo : lo + n]).astype(np.float32)
    return out


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)


def _blocks(texts: list[str]):
    """(start, codes) for runs of texts of bounded size; codes of a text come with it."""
    at, size, block = 0, 0, []
    for i, t in enumerate(texts):
        if block and (size + len(t) > BLOCK_BYTES or len(block) == BLOCK_TEXTS):
            yield at, block
            at, size, block = i, 0, []
        block.append(trigrams(t))
        size += len(t)
    if block:
        yield at, block


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds))


def learn(docs: DataFrame, label_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", per_language: int = PER_LANGUAGE) -> dict[str, list[float]]:
    """Language vectors from rows with a label, about ``per_language`` texts for each, chosen by a hash of the id.

    Of more than MOST_LANGUAGES labels the commonest are learned, equal ones by
    name.  Vectors are added up as whole numbers, so that their order is nothing.
    """
    ready(docs.sparkSession)
    rows = docs.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    found = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "lang").limit(MOST_LANGUAGES).collect()
    counts = {r["lang"]: r["n"] for r in found}
    if not counts:
        return {}
    shares = docs.sparkSession.createDataFrame([(k, min(1.0, per_language / n)) for k, n in sorted(counts.items())], "lang string, share double")
    chosen = rows.join(F.broadcast(shares), "lang").where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < F.col("share") * 1_000_000)

    def packed(sums: dict[str, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["lang", "v"])

    def bundle(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at, block in _blocks(texts):
                for lang, v in zip(langs[at : at + len(block)], np.rint(unit(vectors(block)) * STEPS).astype("<i8"), strict=True):
                    sums[lang] = sums[lang] + v if lang in sums else v
        yield packed(sums)

    def total(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[lang] = sums.get(lang, 0) + np.frombuffer(v, "<i8")
        yield packed(sums)

    # Texts are dealt out by their ids, languages by name; one row a language comes to the driver.
    parts = chosen.repartition(F.xxhash64("id")).select("lang", "text").mapInArrow(bundle, "lang string, v binary")
    rows = parts.repartition("lang").mapInArrow(total, "lang string, v binary").collect()
    return {r["lang"]: np.frombuffer(r["v"], "<i8").astype(np.float64).tolist() for r in sorted(rows, key=lambda r: r["lang"])}


def predict(docs: DataFrame, profiles: dict[str, list[float]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``lang_pred``, ``score`` (cosine, 0 to 1).

    A null text, one without letters, and any text when nothing was learned get
    ``und`` and 0.  Of equal cosines the first language by name wins.  Only id
    and text are read.
    """
    names = sorted(profiles)
    table = unit(np.array([profiles[k] for k in names], np.float32)) if names else np.zeros((0, DIMENSIONS), np.float32)
    shipped = ready(docs.sparkSession).sparkContext.broadcast(table)  # at most 4 KB a language

    @F.arrow_udf("lang string, score double")
    def best(texts: pa.Array) -> pa.Array:
        langs, scores, table = [], [], shipped.value
        for _, block in _blocks([x.as_py() or "" for x in texts]):
            if not len(table):
                langs += ["und"] * len(block)
                scores += [0.0] * len(block)
                continue
            cosine = unit(vectors(block)) @ table.T
            top = cosine.argmax(axis=1)
            some = [len(x) > 0 for x in block]
            langs += [names[k] if s else "und" for k, s in zip(top, some, strict=True)]
            scores += [float(min(1.0, max(0.0, c[k]))) if s else 0.0 for c, k, s in zip(cosine, top, some, strict=True)]
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["lang", "score"])

    rows = docs.select(F.col(id_col), best(F.col(text_col)).alias("p"))
    return rows.select(id_col, F.col("p.lang").alias("lang_pred"), "p.score")
