"""Row-shaped operators: dedup, islands, hierarchies, sections, ranked retrieval."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def first_wins(df: DataFrame, keys: Sequence[Column | str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key; order must end in a unique column."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], k: int, rank: str = "rank") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)


def islands(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], key: str, out: str = "island") -> DataFrame:
    """Numbers the runs of equal key in order, from 1."""
    w = Window.partitionBy(*by).orderBy(*order)
    turn = (~F.col(key).eqNullSafe(F.lag(key).over(w)) | (F.row_number().over(w) == 1)).cast("int")
    return df.withColumn("_turn", turn).withColumn(out, F.sum("_turn").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("bigint")).drop("_turn")


def covered_by(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], anchor: Column, out: str = "anchor") -> DataFrame:
    """The last anchor value at or before each row: an interval join as a running window."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.last(anchor, ignorenulls=True).over(w))


def parent_path(df: DataFrame, by: Sequence[str], order: str, level: str, title: str, deepest: int, out: str = "path") -> DataFrame:
    """Titles from the outermost open entry to this one. An entry of level L is open for what
    follows until an entry of level <= L: per level, the last entry before counts if no entry
    of a lower level came after it."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    seen = {k: F.last(F.when(F.col(level) == k, F.struct(F.col(order).alias("o"), F.col(title).alias("t"))), ignorenulls=True).over(w) for k in range(1, deepest + 1)}
    df = df.withColumns({f"_l{k}": c for k, c in seen.items()})
    parts = []
    for k in range(1, deepest + 1):
        open_ = (F.col(level) > k) & F.col(f"_l{k}").isNotNull()
        for j in range(1, k):
            open_ = open_ & (F.col(f"_l{j}").isNull() | (F.col(f"_l{j}.o") < F.col(f"_l{k}.o")))
        parts.append(F.when(open_, F.col(f"_l{k}.t")))
    return df.withColumn(out, F.concat_ws(" > ", *parts, title)).drop(*(f"_l{k}" for k in range(1, deepest + 1)))


def section_end(df: DataFrame, by: Sequence[str], order: str, level: str, page: str, deepest: int, out: str = "page_end") -> DataFrame:
    """The page before the next entry of this level or a lower one (this page at least);
    where none follows, the largest page from here on. Windows, not a self-join."""
    ahead = Window.partitionBy(*by).orderBy(order).rowsBetween(1, Window.unboundedFollowing)
    rest = Window.partitionBy(*by).orderBy(order).rowsBetween(0, Window.unboundedFollowing)
    end = None
    for k in range(1, deepest + 1):
        follows = F.first(F.when(F.col(level) <= k, F.col(page)), ignorenulls=True).over(ahead)
        value = F.when(follows.isNotNull(), F.greatest(F.col(page), follows - 1)).otherwise(F.max(page).over(rest))
        end = F.when(F.col(level) == k, value) if end is None else end.when(F.col(level) == k, value)
    return df.withColumn(out, end)


def low_streak(df: DataFrame, by: Sequence[str], order: str, low: Column, length: int) -> DataFrame:
    """The first place at which ``length`` low rows in a row have been seen, for each group."""
    flagged = islands(df.withColumn("_low", low), by, [order], "_low")
    runs = flagged.where("_low").groupBy(*by, "island").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    return runs.where(F.col("n") >= length).groupBy(*by).agg(F.min("first").alias("streak_start"))


def gap_cut(df: DataFrame, by: Sequence[str], page: str, factor: float = 8, least: float = 30, pages: int = 4) -> DataFrame:
    """Where a sorted page list breaks: the page before the first gap above
    max(factor x upper median of the first half of the gaps, least); null for none."""
    w = Window.partitionBy(*by).orderBy(page)
    gaps = df.withColumn("_no", F.row_number().over(w)).withColumn("_gap", F.lead(page).over(w) - F.col(page))
    size = gaps.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.collect_list(F.when(F.col("_gap").isNotNull(), F.struct("_no", F.col(page).alias("_page"), "_gap"))).alias("_g"))
    half = F.floor(F.col("_n") / 2).cast("int")
    lead = F.sort_array(F.transform(F.filter("_g", lambda s: s["_no"] <= half + 1), lambda s: s["_gap"]))
    median = F.get(lead, F.floor(F.size(lead) / 2).cast("int"))
    bar = F.greatest(factor * F.col("_m"), F.lit(least))
    cut = F.array_min(F.transform(F.filter("_g", lambda s: s["_gap"] > F.col("_bar")), lambda s: s["_page"]))
    return size.withColumn("_m", median).withColumn("_bar", bar).select(*by, F.when(F.col("_n") >= pages, cut).alias("cut_page"))
