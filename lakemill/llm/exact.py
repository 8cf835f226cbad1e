"""Exact deduplication by skew-safe combining, in DataFrame functions only.

Texts are equal when they are identical after deleting every ASCII white-space
character.  Three stages, each of which compares whole normalised texts beside
their SHA-256 digest, so that no digest collision can merge two texts:

1. locally, before any shuffle, each task combines its own equal rows;
2. groups of (digest, salt) meet, where the salt comes from the row's id, so
   that a text shared by a third of all rows is spread over ``salts`` tasks;
3. the few winners of the salts meet by digest and give the group's winner.

Winners go back to the rows by (digest, salt), a key that is as well spread.
Only texts whose digest occurs again have anything to be compared with, so only
they are read a second time and shuffled; a row's 64-bit hash finds them.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakemill.llm.common import ASCII_SPACE, LAST_ID, checkpointed, text_of

SALTS = 64


def normalised(text: Column) -> Column:
    """Delete the six ASCII white-space characters."""
    return F.translate(text, ASCII_SPACE, "")


def _digest(text: Column, bits: int) -> Column:
    """SHA-256 in hex; fewer bits only where a test wants collisions."""
    full = F.sha2(text.cast("binary"), 256)
    return full if bits == 256 else F.substring(full, 1, bits // 4)


def _keyed(docs: DataFrame, id_col: str, text_col: str, salts: int) -> DataFrame:
    text = text_of(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("raw"))
    return rows.withColumn("mark", F.xxhash64("raw")).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int"))


def _measured(rows: DataFrame, bits: int, *more: str) -> DataFrame:
    rows = rows.select(*more, "id", "mark", "salt", F.char_length("raw").cast("long").alias("len"), normalised(F.col("raw")).alias("norm"))
    return rows.withColumn("sha", _digest(F.col("norm"), bits))


def _again(slim: DataFrame) -> DataFrame:
    """(m, s): marks and salts of the rows whose digest occurs again; a hot digest is combined by salts before it meets."""
    marks = slim.groupBy("sha", "salt", "mark").agg(F.count("*").alias("n"))
    often = marks.groupBy(F.col("sha").alias("again")).agg(F.sum("n").alias("all")).where("all > 1")
    return marks.join(often, F.col("sha") == F.col("again"), "left_semi").select(F.col("mark").alias("m"), F.col("salt").alias("s")).distinct()


def _here() -> Column:
    """Whether a row's mark and salt are among those of :func:`_again`."""
    return (F.col("mark") == F.col("m")) & (F.col("salt") == F.col("s"))


# One decimal orders rows: more code points first, then real ids before null, then the smaller id.
_ID_SPAN, _LEN_SPAN = Decimal(10**20), Decimal(10**21)


def _big(value: Column | Decimal | int) -> Column:
    return (value if isinstance(value, Column) else F.lit(Decimal(value))).cast("decimal(38,0)")


def _packed(length: Column, ident: Column) -> Column:
    rank = F.when(ident.isNull(), _big(0)).otherwise(_big(_ID_SPAN) + _big(LAST_ID) - _big(ident))
    return (_big(length) * _big(_LEN_SPAN) + rank).cast("decimal(38,0)")


def _id_of(packed: Column) -> Column:
    rank = (packed % _big(_LEN_SPAN)).cast("decimal(38,0)")
    return F.when(rank >= _big(_ID_SPAN), (_big(LAST_ID) - (rank - _big(_ID_SPAN))).cast("long"))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS, digest_bits: int = 256) -> DataFrame:
    """One row per input row: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Of equal texts the row with the most code points stays, then the smallest
    id; a null id comes last.  Null texts count as empty, and empty texts equal
    each other.  Of fully repeated rows exactly one is kept.  Other columns are
    not read; an empty table gives an empty result.
    """
    texts = _keyed(docs, id_col, text_col, salts)
    slim = checkpointed(_measured(texts, digest_bits).select("id", "mark", "salt", "len", "sha"))
    rows = _measured(texts.join(_again(slim), _here(), "left_semi"), digest_bits)
    salted = rows.groupBy("sha", "salt", "norm").agg(F.max(_packed(F.col("len"), F.col("id"))).alias("best"), F.count("*").alias("n"))
    # Dealt out by digest alone, which serves the grouping and the count of texts below.
    groups = salted.repartition("sha").groupBy("sha", "norm").agg(F.max("best").alias("best"), F.sum("n").alias("n"), F.collect_set("salt").alias("salts"))
    alike = Window.partitionBy("sha")
    # The text itself is carried on only where different texts share a digest.
    groups = groups.withColumn("texts", F.count("*").over(alike)).withColumn("norm", F.when(F.col("texts") > 1, F.col("norm")))
    winners = checkpointed(groups.select("sha", "best", "n", F.explode("salts").alias("salt"), F.col("norm").alias("only")))
    collided = bool(winners.where(F.col("only").isNotNull()).limit(1).count())

    slim = _measured(texts, digest_bits) if collided else slim
    on = [F.col("r.sha") == F.col("w.sha"), F.col("r.salt") == F.col("w.salt")]
    if collided:
        on.append(F.col("w.only").isNull() | (F.col("w.only") == F.col("r.norm")))
    both = slim.alias("r").join(winners.alias("w"), on, "left").select("r.id", "r.len", "r.sha", "r.salt", "w.best", "w.n", "w.only")
    alone = F.col("best").isNull()
    both = both.withColumn("top", alone | (_packed(F.col("len"), F.col("id")) == F.col("best")))
    first = F.row_number().over(Window.partitionBy("sha", "salt", "id", "only", "top").orderBy("len"))
    keep = F.when(alone, F.col("id")).otherwise(_id_of(F.col("best")))
    return both.select(F.col("id").alias(id_col), keep.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), (F.col("top") & (first == 1)).alias("kept"), F.col("sha").alias("text_sha256"))


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """The rows that stay, with all their columns: the same choice as :func:`report`.

    Rows whose digest occurs once stay where they are.  For the others each stage
    ranks equal texts and keeps the first; the rank limit runs before the shuffle
    as well, which is the local stage.  Rows that agree in length and id go by
    their texts; those that agree in the text, too, count as repeats of one row,
    and any one of them stays.
    """
    slim = checkpointed(_measured(_keyed(docs, id_col, text_col, salts), 256).select("mark", "salt", "sha"))
    places = checkpointed(_again(slim))
    salt = F.pmod(F.xxhash64(F.col(id_col).cast("long")), F.lit(salts)).cast("int")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64(text_of(text_col)).alias("mark"), salt.alias("salt"))
    raw = F.coalesce(F.col(f"row.`{text_col}`").cast("string"), F.lit(""))
    kept = _measured(rows.join(places, _here(), "left_semi").select("row", F.col(f"row.`{id_col}`").cast("long").alias("id"), raw.alias("raw"), "mark", "salt"), 256, "row")
    order = [F.col("len").desc(), F.col("id").asc_nulls_last(), F.col(f"row.`{text_col}`").asc_nulls_last()]
    for keys in (["sha", "salt", "norm"], ["sha", "norm"]):
        kept = kept.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("place = 1").drop("place")
    return rows.join(places, _here(), "left_anti").select("row.*").union(kept.select("row.*"))
