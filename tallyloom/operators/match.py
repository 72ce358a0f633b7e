"""Requirements against a catalog: hard predicates, fit scores, closest-fit ranking."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


@dataclass(frozen=True)
class Field:
    """A numeric field: column need_<name> of requirements, has_<name> of products."""

    name: str
    weight: float = 1.0
    tolerance: float = 1.0  # the share of a whole-number requirement that already passes

    @property
    def need(self) -> Column:
        return F.col(f"need_{self.name}")

    @property
    def has(self) -> Column:
        return F.col(f"has_{self.name}")

    def passes(self, missing_passes: bool = False) -> Column:
        """A null or zero requirement asks for nothing; a missing value fails unless the
        provider lets it pass."""
        near = F.lit(False) if self.tolerance == 1.0 else (F.abs(self.need - F.round(self.need)) < 0.01) & (self.has >= self.tolerance * self.need)
        met = F.coalesce((self.has >= self.need) | near, F.lit(missing_passes))
        return F.coalesce(self.need, F.lit(0)).eqNullSafe(F.lit(0)) | met

    def overshoot(self) -> Column:
        """ln of available over required, 0 at least; null where either is missing."""
        return F.when((self.need > 0) & (self.has > 0), F.log(F.greatest(F.lit(1.0), self.has / self.need)))


def all_pass(fields: Sequence[Field], missing_passes: bool = False) -> Column:
    out = F.lit(True)
    for f in fields:
        out = out & f.passes(missing_passes)
    return out


def named(fields: Sequence[Field], good: bool) -> Column:
    """The required fields that pass (or don't), in order, comma-joined."""
    return F.concat_ws(",", *(F.when((f.need > 0) & (f.passes() == F.lit(good)), F.lit(f.name)) for f in fields))


def scores(fields: Sequence[Field]) -> dict[str, Column]:
    over = [F.coalesce(f.overshoot(), F.lit(0.0)) for f in fields]
    there = [F.when(f.overshoot().isNotNull(), 1.0).otherwise(0.0) for f in fields]
    total = lambda xs: sum(xs, F.lit(0.0))
    weight = total([t * f.weight for t, f in zip(there, fields)])
    ratios = total([F.when(t > 0, f.need / f.has).otherwise(0.0) * f.weight for t, f in zip(there, fields)])
    asked = total([F.when(f.need > 0, 1.0).otherwise(0.0) for f in fields])
    return {
        "weighted_penalty": F.round(F.coalesce(total([o * f.weight for o, f in zip(over, fields)]) / F.nullif(weight, F.lit(0.0)), F.lit(0.0)), 9),
        "worst": F.round(F.greatest(*(o * f.weight for o, f in zip(over, fields)), F.lit(0.0)), 9),
        "penalty": F.round(F.coalesce(total(over) / F.nullif(total(there), F.lit(0.0)), F.lit(0.0)), 9),
        "closeness": F.round(F.coalesce(ratios / F.nullif(weight, F.lit(0.0)), F.lit(0.75)), 9),
        "coverage": F.round(F.least(F.lit(1.0), total(there) / F.greatest(asked, F.lit(1.0))), 9),
    }


def candidates(requirements: DataFrame, products: DataFrame, on: Sequence[str], fields: Sequence[Field], missing_passes: bool = False) -> DataFrame:
    """Equi-join on category (and the like), then every hard predicate."""
    return requirements.join(products, list(on)).where(all_pass(fields, missing_passes))


def ranked(cands: DataFrame, fields: Sequence[Field], by: Sequence[str], tie: Sequence[str]) -> DataFrame:
    """Candidates with their scores and rank (closest fit first) within ``by``."""
    cands = cands.withColumns(scores(fields))
    order = Window.partitionBy(*by).orderBy("weighted_penalty", "worst", "penalty", F.desc("coverage"), *tie)
    return cands.withColumn("rank", F.row_number().over(order))


def closest_fit(requirements: DataFrame, products: DataFrame, on: Sequence[str], fields: Sequence[Field], tie: Sequence[str], top: int = 1, missing_passes: bool = False) -> DataFrame:
    """The ``top`` products of each distinct requirement profile; rows that ask for the same
    are matched once (join the result back on ``on`` and the need columns)."""
    keys = [*on, *(f"need_{f.name}" for f in fields)]
    profiles = requirements.select(*keys).distinct()
    cands = candidates(profiles, products, on, fields, missing_passes)
    if top == 1:  # the least struct of a group needs no sort, and partial results go before the shuffle
        cands = cands.withColumns(scores(fields)).withColumn("_less", -F.col("coverage"))
        rest = [c for c in cands.columns if c not in keys and c != "_less"]
        order = ["weighted_penalty", "worst", "penalty", "_less", *tie]
        best = cands.groupBy(*keys).agg(F.min(F.struct(*order, F.struct(*rest).alias("_row"))).alias("_best"))
        return best.select(*keys, "_best._row.*").withColumn("rank", F.lit(1))
    return ranked(cands, fields, keys, tie).where(F.col("rank") <= top)
