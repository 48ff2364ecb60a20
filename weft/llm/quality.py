"""Operator 10: quality by hierarchical empirical Bayes.

Evidence comes at three levels: the document classifier's posterior, the site (host) of the
document, and the path within the site. Sites and paths are summed up by grouped aggregates of the
posteriors, with labels in place of posteriors where a label is known. A site's mean is shrunk
towards the global mean, a path's towards its site's, by a prior weight that the spread between
sites gives (method of moments): sites with few documents say little. The document's posterior odds
are then moved by the odds of its path against the global ones, with its own share in the path
taken out first.

In this table the site is ``source`` and the path within it ``lang``; both are parameters.

Defined results: a null site or path is a group of its own; null and empty texts get the
classifier's answer for a text without words. One row per input row, repeats included; an empty table
gives no rows. Rows are kept when quality is at least ``KEEP`` and toxicity below ``TOXIC``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm import doc_classifier
from weft.llm.scratch import materialise

KEEP = 0.3
TOXIC = 0.5
MAX_PRIOR = 10_000.0
_NAMES = ["quality", "toxic"]


def _odds(p: Column) -> Column:
    q = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.log(q / (1 - q))


def shrink(rows: DataFrame, name: str) -> DataFrame:
    """Adds ``site_<name>``, ``path_<name>`` (shrunk means) and ``<name>`` (combined posterior) to
    rows with ``_site``, ``_path``, ``e_<name>`` (evidence) and ``p_<name>`` (classifier)."""
    e = F.col(f"e_{name}")
    paths = rows.groupBy("_site", "_path").agg(F.count(F.lit(1)).alias("_np"), F.sum(e).alias("_sp"))
    sites = paths.groupBy("_site").agg(F.sum("_np").alias("_ns"), F.sum("_sp").alias("_ss"))
    # between-site variance of the means beyond what sampling alone gives
    all_ = sites.agg(F.sum("_ns").alias("n"), F.sum("_ss").alias("s"), F.count(F.lit(1)).alias("k"),
                     F.sum(F.col("_ss") * F.col("_ss") / F.col("_ns")).alias("q"),
                     F.sum(F.col("_ns").cast("double") * F.col("_ns")).alias("nn")).first()
    n = float(all_["n"] or 0)
    mean = min(max(float(all_["s"]) / n, 1e-6), 1 - 1e-6) if n else 0.5
    within = mean * (1 - mean)
    spread = n - float(all_["nn"] or 0) / n if n else 0.0
    between = ((float(all_["q"] or 0) - n * mean * mean) - (all_["k"] - 1) * within) / spread if spread > 0 else 0.0
    prior = round(min(MAX_PRIOR, within / between - 1) if between > 0 and within / between > 2 else (1.0 if between > 0 else MAX_PRIOR), 6)
    mean = round(mean, 9)
    site = (mean * prior + F.col("_ss")) / (prior + F.col("_ns"))
    groups = paths.join(sites.select("_site", F.round(site, 9).alias(f"site_{name}")), "_site")
    out = rows.join(groups, ["_site", "_path"])
    path = (prior * F.col(f"site_{name}") + F.greatest(F.col("_sp") - e, F.lit(0.0))) / (prior + F.col("_np") - 1)
    out = out.withColumn(f"path_{name}", F.round(path, 9))
    joint = _odds(F.col(f"p_{name}")) + _odds(F.col(f"path_{name}")) - _odds(F.lit(mean))
    return out.withColumn(name, F.round(1 / (1 + F.exp(-joint)), 6)).drop("_np", "_sp")


def classify(docs: DataFrame, labels: DataFrame, site: str = "source", path: str = "lang") -> DataFrame:
    """One row per document with classifier, site and path posteriors, the combined ones and
    ``kept``."""
    model = doc_classifier.learn(docs, labels, _NAMES)
    docs = docs.select("doc_id", "text", F.coalesce(F.col(site).cast("string"), F.lit("")).alias("_site"),
                       F.coalesce(F.col(path).cast("string"), F.lit("")).alias("_path"))
    rows = doc_classifier.posteriors(docs, model, _NAMES, ["doc_id", "_site", "_path"])
    known = labels.select("doc_id", *_NAMES).dropna().groupBy("doc_id").agg(*[F.avg(n).alias(f"_l_{n}") for n in _NAMES])
    rows = rows.join(known, "doc_id", "left")
    rows = materialise(rows.select("doc_id", "_site", "_path", *[f"p_{n}" for n in _NAMES],
                                   *[F.coalesce(f"_l_{n}", f"p_{n}").alias(f"e_{n}") for n in _NAMES]), "quality")
    for n in _NAMES:
        rows = shrink(rows, n)
    return rows.select("doc_id", *[c for n in _NAMES for c in (f"p_{n}", f"site_{n}", f"path_{n}", n)],
                       ((F.col("quality") >= KEEP) & (F.col("toxic") < TOXIC)).alias("kept"))
