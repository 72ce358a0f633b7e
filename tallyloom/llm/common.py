"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until df has no column of that name, whatever the case."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a new temporary
    folder where the session names none and runs on one machine. A cluster must name one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tallyloom-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def stash(df: DataFrame) -> DataFrame:
    """Write df as Parquet into the shared folder and return the reread table: lineage
    ends there, and the loss of an executor costs no recomputation."""
    path = f"{shared_dir(df.sparkSession)}/stash-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hash_sample(df: DataFrame, n: int, *cols: str) -> DataFrame:
    """The n rows with the least hash of cols (all rows, where there are fewer). Hashes are
    spread evenly, so a cut a fifth above the share of n rows goes first and each partition
    sends its share of them, not n rows of its own."""
    h, share = F.xxhash64(*cols), 1.2 * n / max(1, df.count())
    near = df.where(h < int(share * (1 << 64)) - (1 << 63)) if share < 1 else df
    return near.orderBy(h, *cols).limit(n)


def hot_join(rows: DataFrame, known: DataFrame, key: str, hot: str, own: list[str]) -> DataFrame:
    """rows with the columns of their row of known (unique by key; the boolean column hot is left
    out); rows without one go. The hot rows of known, whose number the caller bounds, are broadcast, so no
    key gathers its rows in one task; rows that the broadcast has met go through the shuffle
    under the hash of their own columns, the others under their key."""
    cols = [c for c in known.columns if c not in (key, hot)]
    once, rest = (known.where(c).select(F.col(key).alias(k), F.struct(*cols).alias(x)) for c, k, x in ((hot, key, "_x"), (f"not {hot}", "_j", "_y")))
    met = rows.join(F.broadcast(once), key, "left")
    met = met.withColumn("_j", F.when(F.col("_x").isNull(), F.col(key)).otherwise(F.xxhash64(*own, key)))
    met = met.join(rest, "_j", "left").withColumn("_x", F.coalesce("_x", F.when(F.col("_j") == F.col(key), F.col("_y"))))
    return met.where(F.col("_x").isNotNull()).select(*rows.columns, *(F.col(f"_x.{c}").alias(c) for c in cols))
