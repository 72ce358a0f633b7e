"""Retrieval: sparse and dense similarity with top-k, as joins and aggregates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed weights of the composite score.
WEIGHTS = {"semantic": 0.55, "fuzzy": 0.25, "keyword": 0.15, "domain": 0.05}
#: Vectors in a pack, of queries or of rows.
BLOCK = 1024


def terms(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    return df.select(key, F.explode(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]{2,}"), F.lit(0))).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def tfidf_scores(queries: DataFrame, docs: DataFrame, q: str, d: str) -> DataFrame:
    """q, d, score: dot products of L2-normalised TF-IDF vectors with smooth idf, by a join
    on shared terms; pairs without a shared term do not come up."""
    tf = terms(docs, d)
    n = docs.agg(F.count(F.lit(1)).alias("n")).scalar()
    idf = tf.groupBy("term").agg((F.log((1 + n) / (1 + F.count(F.lit(1)))) + 1).alias("w"))

    def vectors(tf: DataFrame, key: str, out: str) -> DataFrame:
        w = tf.join(idf, "term").select(key, "term", (F.col("tf") * F.col("w")).alias("w"))
        length = w.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("l"))
        return w.join(length, key).select(key, "term", (F.col("w") / F.col("l")).alias(out))

    return vectors(terms(queries, q), q, "x").join(vectors(tf, d, "y"), "term").groupBy(q, d).agg(F.sum(F.col("x") * F.col("y")).alias("score"))


def overlap_scores(queries: DataFrame, docs: DataFrame, kind: str, also: str | None = None) -> DataFrame:
    """q, d, score (and share) from rows (k, x: token set) that share a token: the common count
    over sqrt(|q| |d|) (cosine) or over |d| (share)."""
    left = queries.select(F.col("k").alias("q"), F.size("x").alias("nq"), F.explode("x").alias("w"))
    right = docs.select(F.col("k").alias("d"), F.size("x").alias("nd"), F.explode("x").alias("w"))
    both = left.join(right, "w").groupBy("q", "d", "nq", "nd").agg(F.count(F.lit(1)).alias("n"))
    value = {"cosine": F.col("n") / F.sqrt(F.col("nq") * F.col("nd")), "share": F.col("n") / F.col("nd")}
    return both.select("q", "d", value[kind].alias("score"), *([value[also].alias(also)] if also else []))


def common_length(a: str, b: str) -> int:
    """The length of the longest common subsequence, with the places of a as bits of one number."""
    places: dict[str, int] = {}
    for k, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << k
    every = row = (1 << len(a)) - 1
    for c in b:
        hit = row & places.get(c, 0)
        row = (row + hit | row - hit) & every
    return len(a) - row.bit_count()


def token_sort_ratios(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """q, d, ratio of pairs (q, d) of texts (k, text): 2 LCS / (|a| + |b|) of the whole texts with their words sorted."""

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"q": b["q"], "d": b["d"], "ratio": [2 * common_length(x, y) / (len(x) + len(y)) if x or y else 1.0 for x, y in zip(b["a"], b["b"])]})

    kept = texts.select("k", F.array_join(F.array_sort(F.split(F.trim(F.lower("text")), r"\s+")), " ").alias("s"))
    both = pairs.join(kept.select(F.col("k").alias("q"), F.col("s").alias("a")), "q").join(kept.select(F.col("k").alias("d"), F.col("s").alias("b")), "d")
    return both.select("q", "d", "a", "b").mapInPandas(run, "q bigint, d bigint, ratio double")


def packed(df: DataFrame, key: str, vector: str, rows: int, out: str, name: str) -> DataFrame:
    """out (number), name (array of (k, v)): df in about equal packs of rows vectors, dealt by hash."""
    n = max(1, -(-df.count() // rows))
    dealt = df.select(F.pmod(F.xxhash64(key), F.lit(n)).alias(out), F.struct(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v")).alias("x"))
    return dealt.groupBy(out).agg(F.collect_list("x").alias(name))


def cosine_top(queries: DataFrame, rows: DataFrame, key: str, vector: str, k: int, digits: int = 6) -> DataFrame:
    """q, d, cos: the k nearest rows of each query row; vectors have unit length. Queries and rows go in packs of about BLOCK;
    each pack of rows meets each pack of queries as one matrix product in some task, which keeps its best k a query, and
    the partial results are ranked by aggregation. Nothing is held on the driver."""
    from .shape import top_k

    asked, held = packed(queries, key, vector, BLOCK, "block", "a"), packed(rows, key, vector, BLOCK, "pack", "b")
    packs = max(1, -(-rows.count() // BLOCK))
    pairs = asked.withColumn("pack", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(packs - 1).cast("bigint")))).join(held, "pack").select("a", "b")

    def run(batches):
        for batch in batches:
            for a, b in zip(batch["a"], batch["b"]):
                own, ids = np.array([x["k"] for x in b]), [x["k"] for x in a]
                cos = np.round(np.array([x["v"] for x in a], "f8") @ np.array([x["v"] for x in b], "f8").T, digits)
                for i, q in enumerate(ids):
                    keep = own != q
                    order = np.lexsort((own[keep], -cos[i][keep]))[:k]
                    yield pd.DataFrame({"q": q, "d": own[keep][order], "cos": cos[i][keep][order]})

    return top_k(pairs.mapInPandas(run, "q bigint, d bigint, cos double"), ["q"], [F.desc("cos"), "d"], k)


def composite(parts: dict[str, Column]) -> Column:
    """The weighted mean over the parts that there are."""
    return sum((WEIGHTS[n] * c for n, c in parts.items()), F.lit(0.0)) / sum(WEIGHTS[n] for n in parts)


def band(score: Column) -> Column:
    return F.when(score >= 0.8, "High").when(score >= 0.55, "Medium").otherwise("Low")
