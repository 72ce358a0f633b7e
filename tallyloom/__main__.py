"""python -m tallyloom <command>: detect, cost, index, inject and workbook on files of this machine or any store."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import detect, fit, guide, inject, plain, power
from .plans.documents import PRICES, estimated_cost, price_of
from .sources import catalogs, sheets, volumes, workbook


def documents(spark: SparkSession, path: str):
    rows = spark.read.option("pathGlobFilter", "*.json").text(path, wholetext=True)
    return sheets.flatten_rows(rows.select(F.col("_metadata.file_name").alias("doc_id"), F.col("value").alias("json")))


def detected(spark, a) -> None:
    facts = detect.page_facts(volumes.read_pages(spark, a.input))
    volumes.write_json(detect.detect_sections(facts), a.output)


def cost(spark, a) -> None:
    pages = volumes.read_pages(spark, a.input)
    rows = estimated_cost(pages.groupBy("doc").agg(F.count(F.lit(1)).alias("p"), F.sum(F.length("text")).alias("c")), [price_of(a.model)] if a.model else PRICES)
    for r in rows.orderBy("doc", "model").toLocalIterator():
        print(f"{r['doc']}\t{r['model']}\t{r['tokens_in']} tokens in\t{r['tokens_out']} out\t{r['usd']:.6f} USD")
    if a.confirm and input("Go on? ").strip().lower() != "yes":
        raise SystemExit(1)


def outline(spark, a) -> None:
    toc = spark.read.schema("doc string, idx int, level int, title string, page int, dest_page int, n_pages int, uri string").json(a.input)
    volumes.write_json(guide.flat_index(toc).orderBy("doc", "idx"), a.output)


def injected(spark, a) -> None:
    rows, scan = documents(spark, a.input), catalogs.products(catalogs.read_files(spark, a.catalog))
    if a.provider == "vertiv":
        out = power.inject_power_references(rows, power.load_catalog(catalogs.numbered(scan)))
    elif a.provider == "rules":
        out = plain.inject_hardware_references(rows, catalogs.numbered(catalogs.first_of_each(scan)))
    else:
        config = volumes.Config.from_env()
        goods = catalogs.network_catalog(scan, a.provider, config.include_juniper)
        out = inject.inject_references(rows, goods, inject.Provider(name=a.provider, top_k=config.top_k, may_override=config.may_override))
    out = out.select("doc_id", "sheet_no", "title", "headers", "row_no", "row_type", "cells")
    (workbook.to_workbooks(out) if a.workbook else volumes.as_documents(out)).write.mode("errorifexists").parquet(a.output)


def matched(spark, a) -> None:
    goods = fit.with_specs(catalogs.numbered(catalogs.first_of_each(catalogs.products(catalogs.read_files(spark, a.catalog)))))
    asked = spark.createDataFrame([(0, a.text)], "id int, text string")
    print(json.dumps(fit.match_text(asked, "id", "text", goods).first().asDict(recursive=True), ensure_ascii=False, indent=2))


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="tallyloom", description=__doc__)
    own = p.add_subparsers(required=True)

    def command(name, f, *options):
        c = own.add_parser(name)
        for o in options:
            c.add_argument(o if o.startswith("--") else o, **({"action": "store_true"} if o in ("--confirm", "--workbook") else {}))
        c.set_defaults(run=f)
        return c

    command("detect", detected, "input", "output")
    command("cost", cost, "input", "--model", "--confirm")
    command("index", outline, "input", "output")
    command("match", matched, "catalog", "text")
    command("inject", injected, "input", "catalog", "output", "--workbook").add_argument("--provider", default="fortinet", choices=["fortinet", "juniper", "vertiv", "rules"])
    a = p.parse_args(argv)
    a.run(SparkSession.builder.appName("tallyloom").getOrCreate(), a)


if __name__ == "__main__":
    main()
