"""Full-text and vector search.

A full-text index is a table of postings (term, document, frequency), dealt out
and sorted by term; searching joins the few query terms with it, so only their
postings are read.  Vector search is exact - one pass over the vectors with a
bounded heap per task (``TakeOrderedAndProject``) - or by random projections.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakemill.functions.registry import literal

#: Full-width forms of ASCII and the distance to it (fixed values).
_FULL_WIDTH = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
_HALF_WIDTH = "".join(chr(c) for c in range(0x21, 0x7F)) + " "
_WORD = r"[A-Za-z0-9_\\u00C0-\\u024F]+|[\\u3400-\\u9FFF\\uF900-\\uFAFF]"
SEGMENTERS = ("none", "unigram", "bigram", "standard")
#: Word segmenters that need dictionaries which are not here; the standard one takes their place.
EXTERNAL = ("wordrank", "wordrank_q2b_icase", "wordrank_q2b_icase_unlimit", "wordseg_basic")


def folded(text: Column) -> Column:
    """Half-width, lower-case text."""
    return F.lower(F.translate(text, _FULL_WIDTH, _HALF_WIDTH))


def segments(text: Column, segmenter: str = "standard") -> Column:
    """The terms of a text: ``none`` (whole), character ``unigram`` or ``bigram``, or ``standard`` (words and single CJK characters)."""
    t = folded(F.coalesce(text, F.lit("")))
    segmenter = "standard" if segmenter.lower() in EXTERNAL else segmenter
    if segmenter == "none":
        return F.filter(F.array(t), lambda x: x != "")
    if segmenter == "standard":
        return F.regexp_extract_all(t, F.lit(_WORD.replace("\\\\", "\\")), F.lit(0))
    if segmenter not in SEGMENTERS:
        raise ValueError(f"unknown segmenter {segmenter!r}")
    n = 1 if segmenter == "unigram" else 2
    clean = F.regexp_replace(t, r"\s+", "")
    size = F.char_length(clean)
    places = F.when(size >= n, F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.substring(clean, i, F.lit(n)))


def postings(docs: DataFrame, id_col: str, text_col: str, segmenter: str = "standard") -> DataFrame:
    """The inverted index: (term, id, tf)."""
    terms = docs.select(F.col(id_col).alias("id"), F.explode(segments(F.col(text_col), segmenter)).alias("term"))
    return terms.groupBy("term", "id").agg(F.count("*").alias("tf"))


def write_index(docs: DataFrame, path: str, id_col: str, text_col: str, segmenter: str = "standard") -> None:
    """Write postings sorted by term, so that a search skips all other row groups."""
    postings(docs, id_col, text_col, segmenter).repartitionByRange("term", "id").sortWithinPartitions("term", "id").write.mode("overwrite").parquet(path)


def _terms(query: str) -> tuple[list[str], list[str], list[str]]:
    """Words that must, must not and may occur, by their sign."""
    must, never, may = [], [], []
    for sign, quoted, word in re.findall(r'([+-]?)(?:"([^"]*)"|(\S+))', query):
        found = re.findall(_WORD.replace("\\\\u", "\\u"), (quoted or word).lower().translate(str.maketrans(_FULL_WIDTH, _HALF_WIDTH)))
        (must if sign == "+" else never if sign == "-" else may).extend(found)
    return must, never, may


def search(index: DataFrame, query: str, mode: str = "natural") -> DataFrame:
    """(id, weight) of matching documents; weight is the sum of the query terms' frequencies.

    ``natural``: any term; ``boolean``: all ``+`` terms, no ``-`` term, and any
    other term only if there is no ``+`` term; ``all``: every term.
    """
    must, never, may = _terms(query)
    if mode == "all":
        must, may = must + may, []
    elif mode == "natural":
        must, never, may = [], [], must + never + may
    wanted = sorted({*must, *never, *may})
    hits = index.where(F.col("term").isin(wanted)) if wanted else index.limit(0)
    has = lambda words: F.count_distinct(F.when(F.col("term").isin(sorted(set(words))), F.col("term"))) if words else F.lit(0)
    good = [w for w in {*must, *may}]
    found = hits.groupBy("id").agg(F.sum(F.when(F.col("term").isin(good), F.col("tf"))).alias("weight"), has(must).alias("_must"), has(never).alias("_never"))
    return found.where((F.col("_must") == len(set(must))) & (F.col("_never") == 0) & F.col("weight").isNotNull()).select("id", "weight")


def match_sql(columns: list[str], query: str, boolean: bool) -> str:
    """MATCH ... AGAINST without an index: a predicate over the terms of the columns."""
    must, never, may = _terms(query)
    if not boolean:
        must, never, may = [], [], must + never + may
    text = f"concat_ws(' ', {', '.join(columns)})"
    half = f"lower(translate({text}, {literal(_FULL_WIDTH)}, {literal(_HALF_WIDTH)}))"
    terms = f"regexp_extract_all({half}, {literal(_WORD.replace(chr(92) * 2, chr(92)))}, 0)"
    listed = lambda words: f"array({', '.join(map(literal, sorted(set(words))))})"
    parts = [f"array_contains({terms}, {literal(w)})" for w in sorted(set(must))]
    if never:
        parts.append(f"NOT arrays_overlap({terms}, {listed(never)})")
    if may and not must:
        parts.append(f"arrays_overlap({terms}, {listed(may)})")
    return f"({' AND '.join(parts)})" if parts else "FALSE"


def l2(a: Column, b: Column) -> Column:
    """Squared Euclidean distance."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda acc, x: acc + x)


def inner_product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def nearest(vectors: DataFrame, query: list[float], k: int, id_col: str = "vec_id", vector_col: str = "embedding", metric: str = "l2", where: Column | None = None) -> DataFrame:
    """The ``k`` nearest vectors, exactly: (id, score), best first, ties by id; ``where`` filters before the search."""
    rows = vectors if where is None else vectors.where(where)
    q = F.array(*[F.lit(float(x)) for x in query])
    score = l2(F.col(vector_col), q) if metric == "l2" else inner_product(F.col(vector_col), q)
    order = F.col("score") if metric == "l2" else F.col("score").desc()
    return rows.select(id_col, score.alias("score")).orderBy(order, id_col).limit(k)


def nearest_approx(vectors: DataFrame, query: list[float], k: int, id_col: str = "vec_id", vector_col: str = "embedding", width: float = 2.0, tables: int = 8) -> DataFrame:
    """The ``k`` nearest by random projections (squared L2 as score); may miss some."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.linalg import Vectors

    rows = vectors.select(id_col, array_to_vector(vector_col).alias("v"))
    model = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", bucketLength=width, numHashTables=tables, seed=1).fit(rows)
    found = model.approxNearestNeighbors(rows, Vectors.dense(query), k, distCol="d")
    return found.select(id_col, (F.col("d") * F.col("d")).alias("score")).orderBy("score", id_col)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
