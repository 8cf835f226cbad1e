"""Quality rules as weak supervision.

Each rule votes for or against a document, or abstains.  Rules are not trusted
alike: expectation-maximisation over the votes of the whole corpus estimates
how often each is right, and a document's fate is its posterior probability of
being good, not whether it passes every rule.

The votes of a corpus are summed up exactly by the number of documents with
each pattern of votes.  There are at most 3 to the number of rules (2,187)
patterns, whatever the corpus; only these counts reach the driver.
"""

from __future__ import annotations

import math
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakemill.llm.common import checkpointed, ready, text_of

#: Characters that count as symbols (fixed value).
SYMBOLS = "#*$%&|<>"
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MIN_WORDS, MOST_REPEATED = 50, 50
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_shouts", "n_distinct")
#: Starting share of good documents, the votes expected of good and of bad ones, and the weight of these beliefs in documents.
PRIOR, BELIEF = 0.85, 20.0
BELIEVED = ({"+": 0.45, "0": 0.53, "-": 0.02}, {"+": 0.2, "0": 0.4, "-": 0.4})
#: Estimation ends when no share or chance moves by more than this, or after so many rounds.
STILL, ROUNDS = 1e-9, 2000


def measure(text: str) -> tuple[int, ...]:
    """The features of one text, in the order of FEATURES."""
    raw = text.encode()
    words = raw.split()  # bytes split at the six ASCII white-space characters only
    n = len(words)
    spaces = sum(map(text.count, " \t\n\x0b\x0c\r"))
    lines = [x for x in text.split("\n") if x.strip(" \t\x0b\x0c\r")]
    triples = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(set(triples)) < len(triples):
        often = Counter(triples)
        last = -1  # words before this place are counted
        for i, t in enumerate(triples):
            if often[t] > 1:
                repeated += i + 3 - max(i, last)
                last = i + 3
    upper = len(raw) - len(raw.translate(None, CAPITALS))
    return (n, len(text) - spaces, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated, len(lines), upper, text.count("!"), len(set(words)))


def features(spark: SparkSession):
    """A column function from text (null: empty) to the struct of FEATURES."""
    ready(spark)

    @F.arrow_udf(", ".join(f"{x} long" for x in FEATURES))
    def measured(texts: pa.Array) -> pa.Array:
        rows = [measure(x.as_py() or "") for x in texts]
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(FEATURES)
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=list(FEATURES))

    return measured


def base_failed(f: Column) -> Column:
    return (f["n_words"] < MIN_WORDS) | (100 * f["n_repeat_words"] > MOST_REPEATED * f["n_words"])


def votes(f: Column) -> dict[str, Column]:
    """1: good, -1: bad, 0: abstains.

    Most rules know one kind of junk and are silent otherwise; two also speak for a text.
    """

    def vote(bad: Column, good: Column | None = None) -> Column:
        v = F.when(bad, -1)
        return (v if good is None else v.when(good, 1)).otherwise(0)

    share = lambda part, whole: F.coalesce(F.try_divide(f[part].cast("double"), f[whole].cast("double")), F.lit(0.0))
    length, symbols, repeats = share("word_chars", "n_words"), share("n_symbols", "n_words"), share("n_repeat_words", "n_words")
    lines, upper, shouts = share("n_dup_lines", "n_lines"), share("n_upper", "word_chars"), share("n_shouts", "n_words")
    # Logarithms, as the share of different words itself falls with the length of any text.
    variety = F.when(f["n_words"] > 1, F.ln(f["n_distinct"].cast("double")) / F.ln(f["n_words"].cast("double"))).otherwise(1.0)
    plain = length.between(3.0, 10.0) & (symbols < 0.05) & (upper < 0.2) & (shouts < 0.05)
    return {
        "symbols": vote(symbols > 0.15),
        "shouting": vote(upper > 0.4),
        "exclamations": vote(shouts > 0.2),
        "lines": vote(lines > 0.4),
        "variety": vote(variety < 0.6),
        "repeats": vote(repeats > 0.3, repeats < 0.1),
        "prose": vote((symbols > 0.15) | (upper > 0.4) | (shouts > 0.2) | (length > 20.0), plain),
    }


def pattern(f: Column) -> Column:
    return F.concat(*[F.when(v == 1, "+").when(v == -1, "-").otherwise("0") for v in votes(f).values()])


#: A model: the share of good documents, then for each rule the chances of each vote in good and in bad documents.
Model = tuple[float, list[tuple[dict[str, float], dict[str, float]]]]


def fit(counts: dict[str, int]) -> Model:
    """Expectation-maximisation over the pattern counts.

    A rule may be good at praise and bad at blame, so its chances of each vote
    are estimated for good and for bad documents apart.  BELIEVED counts as
    BELIEF documents of each kind that were seen before.
    """
    total, m = sum(counts.values()), max((len(p) for p in counts), default=0)
    model: Model = (PRIOR, [(dict(BELIEVED[0]), dict(BELIEVED[1])) for _ in range(m)])
    for _ in range(ROUNDS):
        mass = [BELIEF * PRIOR, BELIEF * (1 - PRIOR)]
        seen = [tuple({v: BELIEF * x for v, x in kind.items()} for kind in BELIEVED) for _ in range(m)]
        base, each = math.log(model[0] / (1 - model[0])), weights(model)
        for p, n in sorted(counts.items()):
            z = base + sum(w[v] for w, v in zip(each, p, strict=True))
            good = 1 / (1 + math.exp(-z)) if z > -700 else 0.0
            for kind, part in enumerate((good, 1 - good)):
                mass[kind] += n * part
                for j, v in enumerate(p):
                    seen[j][kind][v] += n * part
        new: Model = (mass[0] / (total + BELIEF), [tuple({v: x / sum(kind.values()) for v, x in kind.items()} for kind in rule) for rule in seen])
        moved = [abs(new[0] - model[0])] + [abs(x[v] - y[v]) for a, b in zip(new[1], model[1], strict=True) for x, y in zip(a, b, strict=True) for v in x]
        model = new
        if max(moved) < STILL:
            break
    return model


def weights(model: Model) -> list[dict[str, float]]:
    """What each vote of each rule adds to the log-odds of a good document."""
    return [{v: math.log(good[v] / bad[v]) for v in good} for good, bad in model[1]]


def log_odds(model: Model, votes_cast: str) -> float:
    return math.log(model[0] / (1 - model[0])) + sum(w[v] for w, v in zip(weights(model), votes_cast, strict=True))


def accuracies(model: Model) -> list[float]:
    """How often each rule is right when it votes."""
    share, chances = model
    return [(share * g["+"] + (1 - share) * b["-"]) / (share * (g["+"] + g["-"]) + (1 - share) * (b["+"] + b["-"])) for g, b in chances]


def verdict(f: Column, model: Model) -> Column:
    """The posterior probability that a document with these features is good."""
    z = F.lit(math.log(model[0] / (1 - model[0])))
    for v, w in zip(votes(f).values(), weights(model), strict=False):
        z = z + F.when(v == 1, w["+"]).when(v == -1, w["-"]).otherwise(w["0"])
    return 1 / (1 + F.exp(-z))


def learn(measured: DataFrame, column: str = "f") -> Model:
    """Fit the model to the votes of all rows."""
    rows = measured.groupBy(pattern(F.col(column)).alias("p")).count().collect()
    return fit({r["p"]: r["count"] for r in rows})


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, features, ``base_failed``, ``probability`` (posterior), ``kept``.

    A null text is an empty one; it has no words and fails the base rules.  Ids
    may be null or repeat, other columns are not read, and an empty table gives
    an empty result.
    """
    f = features(docs.sparkSession)
    measured = checkpointed(docs.select(F.col(id_col), f(text_of(text_col)).alias("f")))
    model = learn(measured)
    col = F.col("f")
    rows = measured.select(id_col, "f.*", base_failed(col).alias("base_failed"), verdict(col, model).alias("probability"))
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("probability") >= 0.5))


def kept(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that :func:`score` keeps, with all their columns.

    The features are computed twice, which costs less than moving every text.
    """
    f = features(docs.sparkSession)(text_of(text_col))
    model = learn(docs.select(f.alias("f")))
    names = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(F.struct(*names).alias("row"), f.alias("f"))
    return rows.where(~base_failed(F.col("f")) & (verdict(F.col("f"), model) >= 0.5)).select("row.*")
