"""Line dedup by distinct-site spread.

Each line's hash carries a HyperLogLog sketch of the sites that show it; sketches merge by
aggregation, so a line that a third of all rows share moves as one small sketch per task. A
line whose estimate is near the threshold gets an exact distinct count, for which (line,
site) pairs are made distinct first. Boilerplate, a line on at least ``min_sites`` sites,
stays at its first place (smallest doc_id, then line number) and goes everywhere else.

Lines meet the tables of lines in two ways: the lines that make up a 1/HOT of all lines or more,
HOT of them at most, are broadcast, so that no task gets all copies of one; the others are
shuffled.

Lines are compared without outer white space; blank lines always stay. Defined results: a
null site is a site of its own; null text stays null and an empty text stays empty; rows
that repeat both doc_id and text are one document with one decision; null doc_id sorts
first; a document all of whose lines go keeps an empty text; an empty table gives none;
columns of any other name stay as they are, but n_lines and n_removed are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import DOCUMENT_COLUMNS, fresh, hot_join, stash, table

MIN_SITES = 10
#: Sketch size 2^LG_K; its relative standard error is about 1.04 / 2^(LG_K/2).
LG_K = 11
NEAR = 0.15  # more than six standard errors
HOT = 4096


def exploded(df: DataFrame, text: str, site: str, key: str) -> DataFrame:
    """_k (hash of document), _key, _site, _no, _h for each line that is not blank."""
    lines = df.where(F.col(text).isNotNull()).select(F.xxhash64(key, text).alias("_k"), F.col(key).alias("_key"), F.coalesce(F.col(site).cast("string"), F.lit("\u0000null")).alias("_site"), F.posexplode(F.transform(F.split(text, "\n"), lambda x: F.xxhash64(F.regexp_replace(x, r"^\s+|\s+$", "")))).alias("_no", "_h"))
    return lines.where(F.col("_h") != F.xxhash64(F.lit("")))


def sketches(lines: DataFrame, min_sites: int) -> DataFrame:
    """_h, _sites (estimate), _first (key, no), _hot of the lines that stand min_sites times at least."""
    found = lines.groupBy("_h").agg(F.hll_sketch_agg("_site", F.lit(LG_K)).alias("_sketch"), F.min(F.struct("_key", "_no")).alias("_first"), F.count(F.lit(1)).alias("_n"))
    often = stash(found.where(F.col("_n") >= min_sites).select("_h", F.hll_sketch_estimate("_sketch").alias("_sites"), "_first", "_n"))
    return often.withColumn("_hot", F.col("_n") * HOT >= often.agg(F.sum("_n").alias("n")).scalar()).drop("_n")


def spread(df: DataFrame, text: str = "text", site: str = "source", key: str = "doc_id", min_sites: int = MIN_SITES) -> DataFrame:
    """_h, _sites, _first (key, no), _hot of the lines on at least min_sites sites."""
    lines = exploded(df, text, site, key)
    sketched = sketches(lines, min_sites)
    low, high = min_sites * (1 - NEAR), min_sites * (1 + NEAR)
    clear = sketched.where(F.col("_sites") > high)
    near = sketched.where(F.col("_sites").between(low, high))
    pairs = hot_join(lines.select("_h", "_site", "_k", "_no"), near.select("_h", "_hot", F.lit(1).alias("_near")), "_h", "_hot", ["_k", "_no"]).groupBy("_h", "_site").agg(F.lit(1).alias("_one"))
    exact = pairs.groupBy("_h").agg(F.count(F.lit(1)).alias("_exact"))
    near = near.join(exact, "_h").where(F.col("_exact") >= min_sites).withColumn("_sites", F.col("_exact"))
    return clear.unionByName(near.select(clear.columns))


def remove_boilerplate(df: DataFrame, text: str = "text", site: str = "source", key: str = "doc_id", min_sites: int = MIN_SITES) -> DataFrame:
    """df with the cleaned text, and with n_lines and n_removed."""
    common = stash(spread(df, text, site, key, min_sites))
    lines = hot_join(exploded(df, text, site, key).select("_h", "_k", "_key", "_no"), common.select("_h", "_first", "_hot"), "_h", "_hot", ["_k", "_no"])
    again = ~(F.col("_first._key").eqNullSafe(F.col("_key")) & (F.col("_first._no") == F.col("_no")))
    gone = lines.where(again).groupBy("_k").agg(F.collect_set("_no").alias("_gone"))
    df = df.drop(*(c for c in df.columns if c.lower() in ("n_lines", "n_removed")))
    k, g = fresh(df, "_k", "_gone")
    out = df.withColumn(k, F.xxhash64(key, text)).join(gone.withColumnsRenamed({"_k": k, "_gone": g}), k, "left")
    parts = F.split(text, "\n")
    places = lambda ps: F.array_except(F.sequence(F.lit(0), F.size(ps) - 1), F.col(g))
    left = F.transform(F.array(parts), lambda ps: F.array_join(F.transform(places(ps), lambda i: F.get(ps, i)), "\n"))
    cleaned = F.when(F.col(g).isNull(), F.col(text)).otherwise(F.get(left, F.lit(0)))
    counts = {"n_lines": F.coalesce(F.size(parts), F.lit(0)).cast("bigint"), "n_removed": F.coalesce(F.size(g), F.lit(0)).cast("bigint")}
    return out.withColumns(counts).withColumn(text, cleaned).drop(k, g)


def op1_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_boilerplate(table(spark, sf_dir, "documents").select(*DOCUMENT_COLUMNS))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that lose every line to earlier ones go; the others keep what is left."""
    out = remove_boilerplate(docs.select(*DOCUMENT_COLUMNS)).where((F.col("n_removed") == 0) | F.col("text").rlike(r"\S"))
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(*DOCUMENT_COLUMNS)


QUERIES = {"op1_line_spread": op1_line_spread}
SQL = {
    "op1_line_spread": f"""
WITH docs AS (SELECT doc_id, text, source, string_split(text, chr(10)) AS ls FROM documents),
ex AS (SELECT doc_id, source, generate_subscripts(ls, 1) AS no, unnest(ls) AS line FROM docs),
ln AS (SELECT doc_id, source, no, line, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS t FROM ex),
common AS (SELECT t, min(struct_pack(d := doc_id, n := no)) AS first FROM ln WHERE t <> '' GROUP BY t
           HAVING count(DISTINCT coalesce(source, chr(1))) >= {MIN_SITES}),
marked AS (SELECT ln.*, common.t IS NOT NULL AND NOT (first.d = doc_id AND first.n = no) AS gone
           FROM ln LEFT JOIN common ON ln.t = common.t)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (WHERE NOT gone), '')) AS text_sha256
FROM marked GROUP BY doc_id
"""
}
