"""Quality classifier with hierarchical empirical Bayes.

A logistic model on surface features gives each document its evidence. Hosts and paths below them get posterior means: the
grouped evidence of a host is shrunk toward the global mean, that of a path toward its host's, the more the fewer documents
there are. How strongly is estimated from all data by the method of moments. A document's score is its own log-odds shifted by
how far its path's posterior lies from the global mean; that posterior comes from the site's other documents alone, so the
only document of a site gets the prior of what lies above.

The model is fitted on at most ``max_labels`` labelled documents (those of the smallest hash of their id); counts, means and
strengths cover all rows. Groups are aggregated map-side first, so a host with a third of all rows leaves one row per task; the
statistics return to the documents by a join that Spark splits where a host is hot.

Defined results: a null text counts as empty; null hosts or paths are a group of their own. Labels that are null or whose
document is absent are ignored; a document labelled more than once counts by its mean label. Without labels of both classes
the evidence is the share of good labels (0.5 without any). One row comes out for each row that goes in. Only the named
columns are read, and whole texts however long. An empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import runtime
from .quality_rules import HAS_WORD, SENTENCE_END, WORD_GAP, let

NAMES = ("log_words", "mean_word", "distinct_words", "symbols", "separators", "shouts", "upper", "digits", "open_lines", "repeated_lines")


def features(text: Column) -> Column:
    """array<double> of NAMES."""
    body = F.coalesce(text.cast("string"), F.lit(""))

    def share(pattern: str) -> Column:
        return (F.length(body) - F.length(F.regexp_replace(body, pattern, ""))) / F.greatest(F.lit(1), F.length(body))

    by_word = let(
        F.array_remove(F.split(body, WORD_GAP), ""),
        lambda w: F.array(
            F.log1p(F.size(w)),
            F.length(F.array_join(w, "")) / F.greatest(F.lit(1), F.size(w)) / 10,
            F.size(F.array_distinct(w)) / F.greatest(F.lit(1.0), F.pow(F.size(w).cast("double"), F.lit(0.85))),
        ),
    )
    by_line = let(
        F.filter(F.split(body, "\n"), lambda x: x.rlike(HAS_WORD)),
        lambda ls: F.array(
            F.size(F.filter(ls, lambda x: ~x.rlike(SENTENCE_END))) / F.greatest(F.lit(1), F.size(ls)),
            1 - F.size(F.array_distinct(ls)) / F.greatest(F.lit(1), F.size(ls)),
        ),
    )
    shares = F.array(share(r"[#*$%&<>]+"), share(r"[|»•·›]+"), share(r"[!?]{2,}"), share(r"\p{Lu}+"), share(r"\p{N}+"))
    return F.concat(by_word, shares, by_line)


def fit(rows: list[tuple[list[float], float]], ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights (bias last), means and deviations of a ridge logistic regression, by Newton's steps."""
    width = len(NAMES)
    y = np.array([r[1] for r in rows])
    if not len(y) or y.min() == y.max():
        m = (y.sum() + 1) / (len(y) + 2)
        return np.append(np.zeros(width), np.log(m / (1 - m))), np.zeros(width), np.ones(width)
    x = np.array([r[0] for r in rows])
    mean, dev = x.mean(0), x.std(0) + 1e-9
    x = np.hstack([(x - mean) / dev, np.ones((len(x), 1))])
    w = np.zeros(width + 1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * np.append(w[:-1], 0)
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + ridge * np.diag(np.append(np.ones(width), 1e-6))
        step = np.linalg.solve(h, g)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w, mean, dev


def evidence(x: Column, model: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Column:
    """Log-odds that a document is good."""
    w, mean, dev = model
    z = F.lit(float(w[-1]))
    for i in range(len(NAMES)):
        if w[i]:
            z = z + F.lit(float(w[i])) * (x[i] - F.lit(float(mean[i]))) / F.lit(float(dev[i]))
    return F.least(F.lit(12.0), F.greatest(F.lit(-12.0), z))


def _sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _strength(groups: DataFrame, mean: Column) -> Column:
    """Pseudo-count of a group's prior: the variance inside groups over that between them (1 to 10,000; 10,000
    where groups differ by no more than their rows do).

    groups: n, s (sum) and s2 (sum of squares) of each group, with at least two rows."""
    big = F.col("n") >= 2
    inside = F.sum(F.when(big, F.col("s2") - F.col("s") * F.col("s") / F.col("n"))) / F.sum(F.when(big, F.col("n") - 1))
    spread = F.sum(F.when(big, F.col("n") * F.pow(F.col("s") / F.col("n") - mean, 2)))
    count, total = F.sum(F.when(big, 1)), F.sum(F.when(big, F.col("n")))
    between = F.try_divide(spread - count * inside, total)
    return F.when(between > 0, F.least(F.lit(10_000.0), F.greatest(F.lit(1.0), inside / between))).otherwise(10_000.0)


def score(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host: Column | None = None, path: Column | None = None, label_col: str = "quality", max_labels: int = 20_000, threshold: float = 0.5
) -> DataFrame:
    """``id_col``, p_doc (evidence), host_mean, path_mean (posteriors from the site's other documents), score (0 to 1) and kept
    (score >= threshold)."""
    host = docs["source"] if host is None else host
    path = docs["lang"] if path is None else path
    rows = runtime.materialize(docs.select(docs[id_col].alias("id"), host.cast("string").alias("host"), path.cast("string").alias("path"), features(docs[text_col]).alias("x")), "features")
    known = labels.where(labels[label_col].isNotNull()).groupBy(labels[id_col].alias("id")).agg(F.avg(labels[label_col].cast("double")).alias("y"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(max_labels)  # no more than max_labels rows reach the driver
    sample = chosen.join(rows, "id").select("x", "y").orderBy(F.xxhash64("x"), "y").limit(max_labels).collect()
    model = fit([(r["x"], r["y"]) for r in sample])
    judged = rows.select("id", "host", "path", evidence(F.col("x"), model).alias("z"))
    paths = judged.withColumn("p", _sigmoid(F.col("z"))).groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("s2"))
    paths = runtime.materialize(paths, "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("s2").alias("s2"))
    whole = paths.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    mean = float(min(max((whole["s"] or 0.0) / whole["n"], 1e-6), 1 - 1e-6)) if whole["n"] else 0.5
    k_host = hosts.agg(_strength(hosts, F.lit(mean)).alias("k")).first()["k"]
    hosts = hosts.select("host", ((F.col("s") + k_host * mean) / (F.col("n") + k_host)).alias("host_mean"), F.col("n").alias("host_n"), F.col("s").alias("host_s"))
    with_host = paths.join(hosts, paths["host"].eqNullSafe(hosts["host"])).drop(hosts["host"])
    k_path = with_host.agg(_strength(with_host, F.col("host_mean")).alias("k")).first()["k"]
    sites = with_host.select(F.col("host").alias("g_host"), F.col("path").alias("g_path"), "n", "s", "host_n", "host_s")
    out = judged.join(sites, judged["host"].eqNullSafe(sites["g_host"]) & judged["path"].eqNullSafe(sites["g_path"]))
    # posteriors from the site's other documents, so that no document counts its own evidence twice
    p = _sigmoid(F.col("z"))
    others = lambda s, k, prior, n: (F.greatest(F.col(s) - p, F.lit(0.0)) + k * prior) / (F.col(n) - 1 + k)
    out = out.withColumn("host_mean", others("host_s", k_host, F.lit(mean), "host_n"))
    out = out.withColumn("path_mean", others("s", k_path, F.col("host_mean"), "n"))
    final = _sigmoid(F.col("z") + _logit(F.col("path_mean")) - float(np.log(mean / (1 - mean))))
    return out.select(F.col("id").alias(id_col), F.round(_sigmoid(F.col("z")), 6).alias("p_doc"), F.round("host_mean", 6).alias("host_mean"), F.round("path_mean", 6).alias("path_mean"), F.round(final, 6).alias("score"), (final >= threshold).alias("kept"))
