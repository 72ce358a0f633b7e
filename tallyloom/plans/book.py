"""Registers a query with its SQL under the name of its function."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


class Book:
    def __init__(self):
        self.queries, self.sql = {}, {}

    def query(self, sql: str | None = None):
        def put(f):
            self.queries[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
            if sql:
                self.sql[f.__name__] = sql
            return f

        return put
