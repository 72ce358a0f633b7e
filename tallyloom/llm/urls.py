"""URL filter by a character language-model ratio, in DataFrame functions alone.

Two smoothed variable-order Markov models, one of accepted and one of rejected URLs, are
counted from the URLs that the rules decide (a fifth of them is held out). Counts are exact:
the distinct grams of ORDER + 1 characters are a table, the shorter ones are sums of it, and
each order is interpolated with the next lower one by joins of distinct grams, of which a key
meets one row a character of the alphabet at most. The characters of the URLs are joined with
the table of log ratios; the grams that stand for a 1/HOT of all characters or more, HOT at most,
are broadcast, so the other join has no hot key. A URL's score is its mean log-likelihood
difference per character; the held-out URLs set the threshold between the two classes.

Defined results: a null URL counts as empty; a URL without ``://`` has an empty host and
path, meets no rule and is scored like any other; repeated rows and ids are judged row by
row; without both classes of held-out URLs the threshold is 0; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stash, table

#: Fixed by the query's contract: host, path prefix, verdict.
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
HOT = 4096
ORDER = 4
ALPHA = 2.0
START, END = "\u0002", "\u0003"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def rule_case(host: Column, path: Column, rules: Sequence[tuple[str, str, str]], value) -> Column:
    """value(rule) of the longest rule that fits, else null."""
    out = None
    for r in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((host == r[0]) | host.endswith("." + r[0])) & path.startswith(r[1])
        out = F.when(fits, value(r)) if out is None else out.when(fits, value(r))
    return F.lit(None).cast("string") if out is None else out


def with_grams(df: DataFrame) -> DataFrame:
    """A row for each character of _u (and one for its end): _g is the character behind its longest context."""
    text = F.concat(F.lit(START * ORDER), F.regexp_replace(F.translate("_u", UPPER, LOWER), "[0-9]", "0"), F.lit(END))
    df = df.withColumn("_s", text).withColumn("_i", F.explode(F.sequence(F.lit(1), F.length("_s") - ORDER)))
    return df.withColumn("_g", F.col("_s").substr(F.col("_i"), F.lit(ORDER + 1))).drop("_s", "_i")


def log_ratios(rows: DataFrame) -> DataFrame:
    """_g, _n, _d: each distinct gram of the rows' _u, how often it stands there, and the log ratio of its
    last character's chances, from the rows whose _y is 1 (accepted) or 0 (rejected)."""
    y = F.col("_y")
    grams = {ORDER: stash(with_grams(rows.select("_u", "_y")).groupBy("_g").agg(F.count(F.lit(1)).alias("_n"), F.count_if(y == 1).alias("a"), F.count_if(y == 0).alias("r")))}
    for k in range(ORDER - 1, -1, -1):
        grams[k] = grams[k + 1].groupBy(F.substring("_g", 2, k + 1).alias("_g")).agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
    lower = None
    for k in range(ORDER + 1):
        own = grams[k].withColumn("_c", F.substring("_g", 1, k))
        contexts = own.groupBy("_c").agg(F.sum("a").alias("_ca"), F.sum("r").alias("_cr"))
        own = own.join(contexts, "_c").withColumn("_l", F.substring("_g", 2, k))
        own = own.withColumns({"pa": F.lit(1 / 128), "pr": F.lit(1 / 128)}) if lower is None else own.join(lower, "_l")
        chance = {f"p{x}": (F.col(x) + ALPHA * F.col(f"p{x}")) / (F.col(f"_c{x}") + ALPHA) for x in "ar"}
        own = stash(own.withColumns(chance).select("_g", "pa", "pr", *(["_n"] if k == ORDER else [])))
        lower = own.withColumnRenamed("_g", "_l")
    return own.select("_g", "_n", (F.log("pa") - F.log("pr")).alias("_d"))


def scored(rows: DataFrame, ratios: DataFrame) -> DataFrame:
    """rows (unique by _row) with score, the mean log-likelihood difference of _u's characters."""
    hot = F.col("_n") * HOT >= ratios.agg(F.sum("_n").alias("n")).scalar()
    single = with_grams(rows.select("_row", "_u"))
    often = single.join(F.broadcast(ratios.where(hot).select("_g", "_d")), "_g", "left")
    rare = often.where(F.col("_d").isNull()).drop("_d").join(ratios.where(~hot).select("_g", "_d"), "_g")
    every = often.where(F.col("_d").isNotNull()).select("_row", "_d").unionByName(rare.select("_row", "_d"))
    return rows.join(every.groupBy("_row").agg(F.avg("_d").alias("score")), "_row")


def judge_urls(df: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, url: str = "url", key: str = "page_id") -> DataFrame:
    """key, host, path, rule, verdict, score, threshold for every row."""
    host, path = host_and_path(F.col("_u"))
    rows = df.select(F.col(key).alias("_key"), F.coalesce(F.col(url), F.lit("")).alias("_u")).withColumns({"_host": host, "_path": path})
    rows = rows.withColumns({"_rule": rule_case(F.col("_host"), F.col("_path"), rules, lambda r: F.lit(r[0] + r[1])), "_ruled": rule_case(F.col("_host"), F.col("_path"), rules, lambda r: F.lit(r[2]))})
    rows = stash(rows.withColumns({"_row": F.monotonically_increasing_id(), "_y": (F.col("_ruled") == "allow").cast("long"), "_out": F.pmod(F.xxhash64("_u"), F.lit(5)) == 0}))
    ratios = stash(log_ratios(rows.withColumn("_y", F.when(~F.col("_out"), F.col("_y")))))
    rows = stash(scored(rows, ratios))
    held = rows.where(F.col("_out") & F.col("_y").isNotNull())
    stats = held.agg(*(f(F.when(F.col("_y") == y, F.col("score"))).alias(n) for y, f, n in ((1, F.avg, "ma"), (0, F.avg, "mr"), (1, F.stddev_pop, "sa"), (0, F.stddev_pop, "sr"))))
    spread = F.col("sa") + F.col("sr")
    middle = F.when(spread > 0, (F.col("ma") * F.col("sr") + F.col("mr") * F.col("sa")) / spread).otherwise((F.col("ma") + F.col("mr")) / 2)
    threshold = stash(stats.select(F.coalesce(middle, F.lit(0.0)).alias("t"))).scalar()
    out = rows.withColumn("threshold", threshold)
    verdict = F.coalesce("_ruled", F.when(F.col("score") >= F.col("threshold"), "allow").otherwise("block"))
    return out.select(F.col("_key").alias(key), F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule").alias("rule"), verdict.alias("verdict"), "score", "threshold")


def op3_url_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


QUERIES = {"op3_url_ratio": op3_url_ratio}
SQL: dict[str, str] = {}
