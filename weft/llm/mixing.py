"""Operator 4: mixing a corpus to target weights with soft domain membership.

The classifier of the labelled table gives each document posteriors over three domains (good, poor,
toxic). Projected gradient steps fit nonnegative document rates r such that the expected token
totals sum(r * tokens * posterior) match the targets, by least squares over the domains with a light
pull to rate 1. One step needs only the domains' totals (an aggregate of one row) and each row's own
values, so steps are distributed; rows are written out every ``CHUNK`` steps to keep plans short.

A document is taken floor(rate + u) times, u uniform by a hash of its id and text: the expected
number of copies is its rate. The total size stays that of the input.

Defined results: tokens are words of ASCII letters, digits and non-ASCII characters; null and empty
texts have none, take no part in the fit, and have rate 1. Targets are normalised; a domain without
any tokens cannot be filled and its target is shared by the rest. An empty table gives no rows.
Rates are rounded to 6 places.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm import doc_classifier
from weft.llm.scratch import materialise

DOMAINS = ["good", "poor", "toxic"]
TARGETS = {"good": 0.88, "poor": 0.12, "toxic": 0.0}
RIDGE = 0.002
MAX_STEPS = 60
CHUNK = 8
TOLERANCE = 1e-4


def domain_posteriors(docs: DataFrame, labels: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns, ``n_tokens`` and ``p_good, p_poor, p_toxic`` (sum 1) of each document."""
    names = ["quality", "toxic"]
    model = doc_classifier.learn(docs, labels, names)
    p = doc_classifier.posteriors(docs, model, names, keep)
    return p.select(*keep, F.col("n_words").alias("n_tokens"),
                    ((1 - F.col("p_toxic")) * F.col("p_quality")).alias("p_good"),
                    ((1 - F.col("p_toxic")) * (1 - F.col("p_quality"))).alias("p_poor"), "p_toxic")


def fit_rates(members: DataFrame, targets: dict[str, float] = TARGETS, ridge: float = RIDGE) -> DataFrame:
    """Adds ``rate`` to rows with ``n_tokens`` and ``p_<domain>`` columns."""
    names = list(targets)
    state = materialise(members.withColumn("rate", F.lit(1.0)), "mix")

    def totals(df: DataFrame, weight) -> list[float]:
        row = df.agg(F.sum(F.col("n_tokens").cast("double")).alias("_n"), *[F.sum(weight * F.col("n_tokens") * F.col(f"p_{d}")).alias(d) for d in names]).first()
        return [float(x or 0) for x in row]

    size, *share = totals(state, F.lit(1.0))
    if not size:
        return state
    share = [s / size for s in share]
    goal = [targets[d] if s > 0 else 0.0 for d, s in zip(names, share, strict=True)]
    goal = [g / (sum(goal) or 1.0) for g in goal]
    before = None
    for step in range(MAX_STEPS):
        got = [round(x / size, 9) for x in totals(state, F.col("rate"))[1:]]
        if before and max(abs(a - b) for a, b in zip(got, before, strict=True)) < TOLERANCE * 0.1:
            break
        before = got
        # errors relative to the domains' own shares, which makes steps of size 1 safe and quick
        pull = F.lit(0.0)
        for d, x, g, s in zip(names, got, goal, share, strict=True):
            if s > 0:
                pull = pull + F.col(f"p_{d}") * ((x - g) / s)
        moved = F.greatest(F.lit(0.0), F.col("rate") - pull - ridge * (F.col("rate") - 1))
        state = state.withColumn("rate", F.when(F.col("n_tokens") > 0, moved).otherwise(1.0))
        if step % CHUNK == CHUNK - 1:
            state = materialise(state, "mix")
    return materialise(state.withColumn("rate", F.round("rate", 6)), "mix")


def copies(rate, *key):
    """How often a document is taken: floor(rate + u) with u from a hash of the key columns."""
    u = F.pmod(F.xxhash64(*key, F.lit(17)), F.lit(1 << 30)) / (1 << 30)
    return F.floor(rate + u).cast("int")


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """``(doc_id, n_tokens, p_good, p_poor, p_toxic, rate, copies)``, one row per document."""
    docs = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("_key"))
    rates = fit_rates(domain_posteriors(docs, labels, ["doc_id", "_key"]), targets)
    return rates.select("doc_id", "n_tokens", *[F.round(f"p_{d}", 9).alias(f"p_{d}") for d in targets], "rate",
                        copies(F.col("rate"), F.col("_key")).alias("copies"), "_key")


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """The rows of ``docs``, all columns, each as often as the mix takes it."""
    taken = mix(docs, labels, targets).filter("copies > 0").select("_key", "copies").distinct()
    # the table's own columns travel as one, so no name of theirs meets one of these
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.xxhash64("doc_id", "text").alias("_key")).join(taken, "_key")
    return rows.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("_row.*")
