"""Product catalogs as JSON files: a folder in, one row a product out."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import rules as R
from ..operators import shape as sh


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """file, raw of each JSON file of a folder; Spark lists and reads it, whatever the store."""
    rows = spark.read.option("pathGlobFilter", "*.json").text(path, wholetext=True)
    return rows.select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("raw"))


def products(files: DataFrame, vendor: str | None = None) -> DataFrame:
    """file, pos, vendor, model, category, url, product (VARIANT) of files (file, raw): a list of
    products, or an object that holds one as ``products`` or ``items``. A broken file has no
    rows; vendor, where given, is that of all products. The datasheet's address counts before
    the product's."""
    root = files.select("file", F.try_parse_json(F.regexp_replace("raw", "^﻿", "")).alias("v"))
    listed = F.coalesce(*(F.try_variant_get("v", p, "array<variant>") for p in ("$.products", "$.items", "$")))
    rows = root.select("file", F.posexplode(listed).alias("pos", "product"))
    get = lambda k: F.nullif(F.trim(F.try_variant_get("product", f"$.{k}", "string")), F.lit(""))
    return rows.select(
        "file",
        F.col("pos").cast("bigint").alias("pos"),
        (F.lit(vendor) if vendor else get("vendor")).alias("vendor"),
        F.coalesce(get("model"), get("product_name")).alias("model"),
        get("category").alias("category"),
        F.coalesce(get("datasheet_url"), get("product_url")).alias("url"),
        "product",
    )


def first_of_each(rows: DataFrame, keys: Sequence[str] = ("vendor", "model")) -> DataFrame:
    """Products with a vendor and a model, the first of each key whatever its case, by file
    name and place."""
    known = rows.where(F.col("vendor").isNotNull() & F.col("model").isNotNull())
    return sh.first_wins(known, [F.lower(k) for k in keys], ["file", "pos"])


def numbered(rows: DataFrame) -> DataFrame:
    """rows with ord, their place over all files: the file's in the order of names, then the product's."""
    files = rows.select("file").distinct().withColumn("_f", F.row_number().over(Window.orderBy("file")))
    return rows.join(F.broadcast(files) if files.count() <= 100_000 else files, "file").withColumn("ord", F.col("_f") * (1 << 32) + F.col("pos")).drop("_f")


#: Catalogs in their order.
NETWORK_FILES = ["fortinet_scraped.json", "fortinet.json"]
JUNIPER_FILE = "juniper.json"


def network_catalog(rows: DataFrame, provider: str = "fortinet", include_juniper: bool = True) -> DataFrame:
    """vendor, model, category, url, product, ord of a scan: for juniper its own file with the vendor set, else the files in
    their fixed order, network vendors only, with curated products that they lack. The first of each vendor, model and category counts."""
    order = [JUNIPER_FILE] if provider == "juniper" else NETWORK_FILES + [JUNIPER_FILE] * include_juniper
    place = F.array_position(F.array(*map(F.lit, order)), F.col("file"))
    rows = rows.where(F.col("file").isin(*order) & F.col("model").isNotNull()).withColumn("ord", place * (1 << 32) + F.col("pos"))
    if provider == "juniper":
        rows = rows.withColumn("vendor", F.lit("Juniper"))
    else:
        rows = rows.where(F.lower("vendor").isin("fortinet", "juniper"))
        goods = rows.sparkSession.createDataFrame([("", json.dumps(R.CURATED))], "file string, raw string")
        rows = rows.unionByName(products(goods).withColumn("ord", (len(order) + 1) * F.lit(1 << 32) + F.col("pos")))
    key = [F.lower("vendor"), F.lower("model"), F.lower(F.coalesce("category", F.lit("")))]
    return sh.first_wins(rows, key, ["ord"]).drop("file", "pos")


def spec(product: Column, *names: str) -> Column:
    """The first of the names that the product has as a number: a number, a text, or an object
    whose max, value, required or min counts, in this order."""
    from ..functions.text import number

    found = []
    for n in names:
        found += [F.try_variant_get(product, f"$.{n}.{k}", "string") for k in ("max", "value", "required", "min")]
        plain = F.try_variant_get(product, f"$.{n}", "string")
        found.append(F.when(~plain.startswith("{"), plain))
    return number(F.coalesce(*(F.nullif(x, F.lit("")) for x in found)))


def storage_tb(product: Column) -> Column:
    return F.coalesce(spec(product, "storage_tb"), spec(product, "storage_gb", "local_storage_gb") / 1024)


def with_curated(rows: DataFrame, curated: DataFrame, keys: Sequence[str] = ("vendor", "model")) -> DataFrame:
    """rows, and those curated ones whose key they lack."""
    return rows.unionByName(curated.join(rows.select(*keys), list(keys), "left_anti"), allowMissingColumns=True)
