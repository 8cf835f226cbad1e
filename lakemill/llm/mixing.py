"""Mixing sources to target weights by Sainte-Lague apportionment, in DataFrame functions only.

A source's words are cut into blocks of equal size.  Seats (blocks) go to the
sources by the highest quotients target / (2 s - 1), s = 1, 2, ...; then a
source's seats go to its shards by the same rule, with the shards' words as
votes.  Inside a shard the documents stand in a seeded order and their words make
numbered blocks; the shard takes whole rounds of them, and then the first
blocks in a seeded order, as its quota says.  That order permutes runs of many
blocks and keeps each run's blocks together, so that what is taken of a text is
connected.  Every quota is an integer, every part can be computed on its own,
and the same seed gives the same mix whatever the partitioning.

Seats are never listed one by one: with V votes and B seats for n parties, a
party's number of seats lies between its rounded shares at the divisors
V / (B - n/2) and V / (B + n/2).  Only seats in between, at most 2 n and a few
for rounding, are ranked.  Blocks are not listed either: whether a block is taken
follows from its number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakemill.llm.common import WORD, checkpointed, n_words

BLOCK_WORDS = 8
#: Words of a run of blocks that stays together in the seeded order.
RUN_WORDS = 256 * BLOCK_WORDS
DOCS_PER_SHARD = 50_000
MIN_SHARDS = 64
WEIGHTS = (1, 2, 3)
MOST_REPEATS = 3


def ranked(rows: DataFrame, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """Add ``_place`` (from 1) in the order of all rows, and for each ``sums`` entry (name, column) the column's sum over the rows before.

    Ranges of the order are numbered apart and shifted by what stands before them,
    of which there is one row a range; so no task sees all rows.
    """
    kept = checkpointed(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_range", F.spark_partition_id()))
    ranges = kept.groupBy("_range").agg(F.count("*").alias("_n"), *[F.sum(c).alias(f"_s{k}") for k, c in enumerate(sums.values())])
    before = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task of one stage
    shifts = ranges.select("_range", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}b") for c in ("_n", *(f"_s{k}" for k in range(len(sums))))])
    inside = Window.partitionBy("_range").orderBy(*order)
    above = inside.rowsBetween(Window.unboundedPreceding, -1)
    out = kept.join(F.broadcast(shifts), "_range").withColumn("_place", F.col("_nb") + F.row_number().over(inside))
    for k, (name, column) in enumerate(sums.items()):
        out = out.withColumn(name, F.col(f"_s{k}b") + F.coalesce(F.sum(column).over(above), F.lit(0)))
    return out.drop("_range", "_nb", *[f"_s{k}b" for k in range(len(sums))])


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = MOST_REPEATS) -> DataFrame:
    """Add ``target`` to rows (source, source_size).

    Sources by code point, null last, weigh ``weights`` in turn and share all
    words.  A target stops at ``cap`` times its source's size and the excess is
    shared again by weight.  That ends where target = min(cap size, level x
    weight); sources in the order of cap size / weight give the level directly.
    """
    by_name = F.col("source").cast("binary").asc_nulls_last()
    rows = ranked(sources, [by_name], {})
    rows = rows.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("_place") - 1) % len(weights) + 1).cast("int"))).drop("_place")
    rows = rows.withColumn("most", F.col("source_size") * float(cap)).withColumn("ratio", F.col("most") / F.col("weight"))
    rows = ranked(rows, [F.col("ratio").asc(), by_name], {"spent": "most", "used": "weight"})
    total = rows.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    rows = rows.withColumn("level", (F.lit(float(total["size"] or 0)) - F.col("spent")) / (F.lit(float(total["weight"] or 0)) - F.col("used")))
    found = rows.agg(F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("_place", "level"))).alias("first")).first()["first"]
    level = F.lit(None).cast("double") if found is None else F.lit(float(found["level"]))
    return rows.select("source", "source_size", F.least("most", level * F.col("weight")).alias("target"))


def seats(parties: DataFrame, group: list[str], party: list[str], votes: str, total: Column) -> DataFrame:
    """Sainte-Lague: add ``seats`` to ``parties``, of which each ``group`` has ``total`` seats.

    ``total`` may name ``_all``, the group's votes.  Equal quotients go by the order of ``party``.
    """
    inside = Window.partitionBy(*group) if group else None
    if group:
        rows = parties.withColumn("_all", F.sum(votes).over(inside)).withColumn("_n", F.count("*").over(inside))
    else:
        every = parties.agg(F.sum(votes).alias("votes"), F.count("*").alias("n")).first()
        rows = parties.withColumn("_all", F.lit(every["votes"])).withColumn("_n", F.lit(every["n"]))
    rows = rows.withColumn("_seats", total.cast("long"))
    share = lambda d: F.floor(F.col(votes) * d / F.col("_all") + 0.5)
    some = (F.col("_all") > 0) & (F.col("_seats") > 0)
    low = F.when(some, F.greatest(F.lit(0), share(F.col("_seats") - F.col("_n") / 2.0) - 1)).otherwise(0).cast("long")
    high = F.when(some & (F.col(votes) > 0), share(F.col("_seats") + F.col("_n") / 2.0) + 1).otherwise(0).cast("long")
    rows = rows.withColumn("_low", low)
    sure = F.sum("_low").over(inside) if group else F.lit(rows.agg(F.sum("_low")).first()[0])
    rows = rows.withColumn("_left", F.col("_seats") - sure)
    open_seats = rows.withColumn("_seat", F.explode_outer(F.when(high > F.col("_low"), F.sequence(F.col("_low") + 1, high))))
    order = [(F.col(votes) / (2 * F.col("_seat") - 1)).desc_nulls_last(), *[F.col(x).asc_nulls_last() for x in party]]
    placed = open_seats.withColumn("_place", F.row_number().over(inside.orderBy(*order))) if group else ranked(open_seats, order, {})
    won = F.sum(F.when(F.col("_seat").isNotNull() & (F.col("_place") <= F.col("_left")), 1).otherwise(0))
    keep = [c for c in parties.columns]
    return placed.groupBy(*keep, "_low").agg(won.alias("_won")).select(*keep, (F.col("_low") + F.col("_won")).cast("long").alias("seats"))


#: Run numbers are permuted by multiplication with this prime; shards have fewer runs.
STEP = 2_147_483_647


def _rank(run: Column, p: Column) -> Column:
    """The place of a run in the seeded order of its shard's whole runs; what is left of a run stands last."""
    return F.when(run < p["runs"], (run * (STEP % p["runs"]) + p["first"]) % p["runs"]).otherwise(p["runs"])


def _taken(run: Column, p: Column) -> Column:
    """How many of a run's words are taken: all, the first ones of the last run taken, or none."""
    rank, whole = _rank(run, p), p["left"] - p["left"] % p["run"]
    return F.when(rank * p["run"] < whole, p["run"]).when(rank * p["run"] == whole, p["left"] % p["run"]).otherwise(0)


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7, block_words: int = BLOCK_WORDS, docs_per_shard: int = DOCS_PER_SHARD, run_words: int = RUN_WORDS, weights: tuple[int, ...] = WEIGHTS, cap: int = MOST_REPEATS, keep: list[str] | None = None) -> DataFrame:
    """The mix, one row per input row: ``row`` (the columns ``keep`` of the input, all by default; only they are shuffled), ``size``, ``source_size``, ``target``, ``taken``, ``rounds``, ``part``, ``picks``.

    A row is taken ``rounds`` times whole and, once more, ``part`` words of it:
    those of the runs that ``picks`` describes (its first word's place in the
    shard, and the shard's run size, number of whole runs, words left to take
    and start of the order).  No row is taken more than ``cap`` times.  Null
    texts have size 0 and nothing is taken of them; a null source is a source of
    its own, the last; null ids are dealt out and ordered by their texts, and
    repeated rows are rows like others.  An empty table gives an empty result.
    """
    shards = max(MIN_SHARDS, -(-docs.count() // docs_per_shard))
    text = F.col(f"`{text_col}`")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep or docs.columns]).alias("row"), n_words(text).alias("size"), F.col(f"`{source_col}`").alias("source"), F.xxhash64(F.col(f"`{id_col}`"), text, F.lit(seed)).alias("mark"), F.col(f"`{id_col}`").alias("id"))
    rows = rows.withColumn("shard", F.pmod("mark", F.lit(shards)).cast("int"))
    # Names without nulls, so that plain equality joins carry the null source.
    rows = rows.withColumn("name", F.concat(F.when(F.col("source").isNull(), "1").otherwise("0"), F.coalesce("source", F.lit(""))))

    if keep is not None:  # rows are small then: they are written once, not counted twice
        rows = checkpointed(rows)
    parts = checkpointed(rows.groupBy("name", "shard").agg(F.sum("size").alias("words")))  # used twice, but counted once
    sizes = parts.groupBy("name").agg(F.sum("words").alias("source_size"))
    goals = targets(sizes.withColumnRenamed("name", "source"), weights, cap).withColumnRenamed("source", "name")
    all_seats = F.round(F.col("_all") / block_words)
    goals = seats(goals, [], ["name"], "target", all_seats).withColumnRenamed("seats", "source_seats")
    quotas = seats(parts.join(goals, "name"), ["name"], ["shard"], "words", F.col("source_seats"))
    quotas = quotas.select("name", "shard", "words", "source_size", "target", F.least(F.col("seats") * block_words, F.col("words") * cap).alias("quota"))

    order = [F.xxhash64("mark", F.lit(seed + 1)), F.col("id").asc_nulls_last(), F.col("size").asc()]
    ahead = Window.partitionBy("name", "shard").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("begin", F.coalesce(F.sum("size").over(ahead), F.lit(0))).join(quotas, ["name", "shard"])
    whole = F.when(F.col("words") > 0, F.floor(F.col("quota") / F.col("words"))).otherwise(0).cast("long")
    placed = placed.withColumn("rounds", whole).withColumn("left", F.col("quota") - F.col("rounds") * F.col("words"))
    runs = F.floor(F.col("words") / run_words).cast("long")
    first = F.pmod(F.xxhash64("name", "shard", F.lit(seed + 2)), F.greatest(runs, F.lit(1)))
    placed = placed.withColumn("picks", F.struct("begin", F.lit(run_words).cast("long").alias("run"), runs.alias("runs"), "left", first.alias("first")))

    def overlap(acc: Column, k: Column) -> Column:
        p = F.col("picks")
        stop = F.least(p["begin"] + F.col("size"), k * p["run"] + _taken(k, p))
        return acc + F.greatest(F.lit(0).cast("long"), stop - F.greatest(p["begin"], k * p["run"]))

    numbers = F.sequence(F.floor(F.col("begin") / run_words), F.floor((F.col("begin") + F.col("size") - 1) / run_words))
    part = F.when((F.col("size") > 0) & (F.col("left") > 0), F.aggregate(numbers, F.lit(0).cast("long"), overlap)).otherwise(0).cast("long")
    placed = placed.withColumn("part", part)
    return placed.select("row", "size", "source_size", "target", (F.col("rounds") * F.col("size") + F.col("part")).cast("long").alias("taken"), F.when(F.col("size") > 0, F.col("rounds")).otherwise(0).cast("long").alias("rounds"), "part", "picks")


def mixed(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", **options) -> DataFrame:
    """The documents of the mix, with the columns of ``docs``: whole ones as often as they are taken, then a part.

    A part holds the taken words with the white space before them, in their order.  Its length
    column, if there is one, is counted anew.
    """
    rows = plan(docs, text_col=text_col, **options)
    whole = F.when(F.col("rounds") > 0, F.array_repeat(F.lit(False), F.col("rounds").cast("int")))
    part = F.when(F.col("part") > 0, F.array(F.col("part") < F.col("size")))
    takes = F.concat(F.coalesce(whole, F.array().cast("array<boolean>")), F.coalesce(part, F.array().cast("array<boolean>")))
    rows = rows.withColumn("cut", F.explode(takes))
    words = F.regexp_extract_all(F.col(f"row.{text_col}"), F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))

    def picked(_: Column, i: Column) -> Column:
        p = F.col("picks")
        at = p["begin"] + i
        run = F.floor(at / p["run"])
        return at - run * p["run"] < _taken(run, p)

    text = F.when(F.col("cut"), F.array_join(F.filter(words, picked), "")).otherwise(F.col(f"row.{text_col}"))
    out = rows.withColumn("new", text)
    kinds = {f.name: f.dataType for f in docs.schema.fields}

    def value(name: str) -> Column:
        if name == text_col:
            return F.col("new")
        if name == length_col:
            return F.when(F.col("cut"), F.char_length("new")).otherwise(F.col(f"row.`{name}`")).cast(kinds[name])
        return F.col(f"row.`{name}`")

    return out.select(*[value(c).alias(c) for c in docs.columns])
