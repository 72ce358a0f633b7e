"""Quality by hierarchical empirical Bayes.

A linear classifier turns each text into evidence of its own. Sites then speak for their
documents: evidence is averaged by host and by path within host in grouped aggregation, a
host's mean is shrunk toward the global one and a path's toward its host's, each with a
strength that the spread between groups sets (method of moments), so sparse sites stay near
the prior. A document's posterior log-odds are its own evidence plus what the posterior of its path, from
the other documents there, adds to the global prior; a document alone at its site keeps its own evidence. Sites of a
1/HOT of all rows or more, HOT of them at most, are broadcast to the documents, so a
host with a third of all rows is not one task's.

The classifier is fitted on at most FIT_ROWS labelled rows (those with the smallest
hashes of doc_id and text); everything else covers all rows. Defined results: null text counts as empty and an
empty text has zero features; null host or path is a group of its own; without labels of
both kinds every score is 0.5 and is kept; repeated rows are scored row by row; an empty table gives
none; extra columns are passed over.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import DOCUMENT_COLUMNS, hash_sample, hot_join, stash, table

FIT_ROWS = 20_000
HOT = 4096
KEEP = 0.5
#: Weight of what the site adds; a document's own text speaks louder than its neighbours.
SITE_WEIGHT = 0.5
FEATURES = ["symbol_chars", "upper_chars", "digit_chars", "adjacent_repeats", "top_word", "bare_marks", "ends_in_marks", "inner_unique"]

_KIND = np.zeros(0x110000, "u1")  # 1 letter, 2 upper-case letter, 3 digit, 4 white space, 5 plain punctuation, 0 symbol


def kinds() -> np.ndarray:
    if not _KIND[65]:
        for c in range(0x110000):
            s = chr(c)
            _KIND[c] = 4 if s.isspace() else 3 if s.isdigit() else 2 if s.isupper() else 1 if s.isalpha() else 5 if s in ".,;:'\"-()?" else 0
    return _KIND


def features_of(text: str) -> list[float]:
    words = text.split()
    if not words:
        return [0.0] * len(FEATURES)
    chars = np.bincount(kinds()[np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")], minlength=6)
    seen = max(1, chars.sum() - chars[4])
    n, bare = len(words), Counter(w for w in words if not w.isalnum())
    marks = sum(k for w, k in bare.items() if not any(c.isalnum() for c in w))
    ends = sum(k for w, k in bare.items() if len(w) > 2 and w[-1] == w[-2] and not w[-1].isalnum())
    same = sum(a == b for a, b in zip(words, words[1:])) / max(1, n - 1)
    top = Counter(words).most_common(1)[0][1] / n if n >= 20 else 0.0
    block = [len(set(words[k : k + 50])) / 50 for k in range(0, n - 49, 50)]
    return [chars[0] / seen, chars[2] / seen, chars[3] / seen, same, top, marks / n, ends / n, 1 - float(np.mean(block)) if block else 0.0]


def with_features(df: DataFrame, text: str = "text") -> DataFrame:
    @F.pandas_udf("array<double>")
    def run(col: pd.Series) -> pd.Series:
        return col.map(lambda t: features_of(t or ""))

    return df.withColumn("_f", run(F.col(text)))


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights of a logistic regression (bias first) by Newton steps; soft targets are allowed."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w, penalty = np.zeros(x.shape[1]), np.eye(x.shape[1]) * ridge
    penalty[0, 0] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step * min(1, 5 / (np.abs(step).max() + 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return w


def logit(c: Column) -> Column:
    c = F.least(F.greatest(c, F.lit(1e-4)), F.lit(1 - 1e-4))
    return F.log(c / (1 - c))


def strength(groups: DataFrame, mean: str, n: str, around: str) -> Column:
    """How many documents the prior counts for: the binomial spread over the spread between
    groups (of their means around the prior, less what chance gives), as a scalar subquery."""
    chance = F.col(around) * (1 - F.col(around))
    between = F.sum(F.pow(F.col(mean) - F.col(around), 2) - chance / F.col(n))
    return groups.agg(F.least(F.lit(1e4), F.greatest(F.lit(1.0), F.sum(chance) / F.greatest(between, F.lit(1e-9)))).alias("k")).scalar()


def posteriors(df: DataFrame, p: str, host: str, path: str) -> DataFrame:
    """df with host_posterior, path_posterior (both from the other documents) and posterior from the
    evidence in column p."""
    site = F.xxhash64(*(F.coalesce(F.col(c).cast("string"), F.lit("\u0000null")) for c in (host, path)))
    df = df.withColumn("_site", site)
    groups = stash(df.groupBy("_site", F.col(host).alias("_host")).agg(F.count(F.lit(1)).alias("_n"), F.sum(p).alias("_sum")))
    hosts = groups.groupBy("_host").agg(F.sum("_n").alias("_hn"), F.sum("_sum").alias("_hsum"))
    prior = groups.agg(F.coalesce(F.sum("_sum") / F.sum("_n"), F.lit(0.5)).alias("m")).scalar()
    hosts = hosts.withColumn("_prior", prior).withColumn("_hmean", F.col("_hsum") / F.col("_hn"))
    hosts = hosts.withColumn("_hk", strength(hosts, "_hmean", "_hn", "_prior"))
    shrunk = lambda k, around, total, n: (F.col(k) * F.col(around) + total) / (F.col(k) + n)
    hosts = hosts.withColumn("_hpost", shrunk("_hk", "_prior", F.col("_hsum"), F.col("_hn"))).withColumnRenamed("_host", "_host2")
    paths = groups.join(hosts, F.col("_host").eqNullSafe(F.col("_host2"))).withColumn("_mean", F.col("_sum") / F.col("_n"))
    paths = paths.withColumn("_pk", strength(paths, "_mean", "_n", "_hpost"))
    paths = stash(paths.select("_site", "_n", "_sum", "_hn", "_hsum", "_prior", "_hk", "_pk"))
    paths = paths.withColumn("_hot", F.col("_n") * HOT >= paths.agg(F.sum("_n").alias("n")).scalar())
    out = hot_join(df, paths, "_site", "_hot", ["_k"])
    out = out.withColumn("host_posterior", shrunk("_hk", "_prior", F.col("_hsum") - F.col(p), F.col("_hn") - 1))
    out = out.withColumn("path_posterior", shrunk("_pk", "host_posterior", F.col("_sum") - F.col(p), F.col("_n") - 1))
    total = logit(F.col(p)) + SITE_WEIGHT * (logit(F.col("path_posterior")) - logit(F.col("_prior")))
    return out.withColumn("posterior", 1 / (1 + F.exp(-total))).select(*df.drop("_site").columns, "host_posterior", "path_posterior", "posterior")


def score_quality(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang") -> DataFrame:
    """doc_id, evidence, host_posterior, path_posterior, posterior, kept and _k (the hash of
    doc_id and text) of every row."""
    rows = with_features(docs.select("doc_id", "text", F.col(host).alias("host"), F.col(path).alias("path"))).withColumn("_k", F.xxhash64("doc_id", "text")).drop("text")
    rows = stash(rows)
    known = labels.where(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    labelled = stash(rows.join(known, "doc_id").select("doc_id", "_k", "_f", "quality"))
    sample = hash_sample(labelled, FIT_ROWS, "doc_id", "_k").select("_f", "quality").toPandas()
    if sample["quality"].nunique() == 2:
        w = fit(np.array(sample["_f"].tolist()), sample["quality"].to_numpy(float), ridge=0.1)
    else:
        w = np.zeros(len(FEATURES) + 1)
    z = F.lit(float(w[0]))
    for k, v in enumerate(w[1:]):
        z = z + F.lit(float(v)) * F.col("_f")[k]
    rows = rows.withColumn("evidence", 1 / (1 + F.exp(-z))).drop("_f")
    return posteriors(rows, "evidence", "host", "path").drop("host", "path").withColumn("kept", F.col("posterior") >= KEEP)


def op5_quality_posterior(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("_k")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    judged = score_quality(docs, table(spark, sf_dir, "labels")).where(~F.col("kept")).select("_k").distinct()
    rows = docs.select(*DOCUMENT_COLUMNS, F.xxhash64("doc_id", "text").alias("_k"))
    return rows.join(judged, "_k", "left_anti").select(*DOCUMENT_COLUMNS)


QUERIES = {"op5_quality_posterior": op5_quality_posterior}
SQL: dict[str, str] = {}
