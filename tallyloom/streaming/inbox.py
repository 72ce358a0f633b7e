"""A folder of arriving sheet documents as a stream, run through a batch plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import sheets as ss


def arriving(spark: SparkSession, path: str, files_a_batch: int = 1000) -> DataFrame:
    """doc_id (the file's name), json of each new JSON file of a folder."""
    stream = spark.readStream.format("text").schema("value string").option("wholetext", True).option("pathGlobFilter", "*.json").option("maxFilesPerTrigger", files_a_batch)
    return stream.load(path).select(F.col("_metadata.file_name").alias("doc_id"), F.col("value").alias("json"))


def run_inbox(spark: SparkSession, inbox: str, out: str, checkpoint: str, plan: Callable[[DataFrame], DataFrame] = ss.flatten_rows, once: bool = True) -> StreamingQuery:
    """Writes plan(documents) of each batch as Parquet under out/batch_no=N, in place of what an
    interrupted try of the same batch left, so each file counts once. Columns of kind VARIANT
    are written as JSON text. once: what is there now, then stop."""

    def write(batch: DataFrame, no: int) -> None:
        done = plan(batch)
        shown = [F.to_json(c.name).alias(c.name) if c.dataType.simpleString() == "variant" else F.col(c.name) for c in done.schema]
        done.select(*shown).write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch_no={no}")

    query = arriving(spark, inbox).writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return (query.trigger(availableNow=True) if once else query).start()
