"""Catalog folders, workbooks and the inbox stream on small files."""

import json

from pyspark.sql import functions as F

from tallyloom.sources import catalogs as ct
from tallyloom.sources import workbook as wb
from tallyloom.streaming import inbox


def test_catalog_folder(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"vendor": "V", "model": "M 1", "storage_gb": "512", "product_url": "u"}, {"vendor": "V", "model": ""}]))
    (tmp_path / "b.json").write_text("﻿" + json.dumps({"products": [{"vendor": "v", "model": "m 1"}, {"vendor": "W", "model": "N", "speed": {"min": 1, "max": "10 to 20"}, "datasheet_url": "d", "product_url": "u"}]}))
    (tmp_path / "c.json").write_text("broken")
    rows = ct.products(ct.read_files(spark, str(tmp_path)))
    got = {(r["vendor"], r["model"], r["url"], r["tb"], r["speed"]) for r in ct.first_of_each(rows).select("vendor", "model", "url", ct.storage_tb(F.col("product")).alias("tb"), ct.spec(F.col("product"), "speed").alias("speed")).collect()}
    assert got == {("V", "M 1", "u", 0.5, None), ("W", "N", "d", None, 20.0)}
    curated = spark.createDataFrame([("W", "N"), ("X", "O")], "vendor string, model string")
    assert {r["model"] for r in ct.with_curated(ct.first_of_each(rows), curated).collect()} == {"M 1", "N", "O"}


def test_workbook(spark):
    rows = [(1, 0, "A/B", ["h1", "h2"], 0, "data", ["x & <y>", None, "cut"]), (1, 0, "A/B", ["h1", "h2"], 1, "section", ["é\n1"]), (1, 1, "ab", ["h"], 0, "data", None), (2, 0, None, None, 0, "data", ["z"])]
    df = spark.createDataFrame(rows, "doc_id int, sheet_no int, title string, headers array<string>, row_no int, row_type string, cells array<string>")
    books = wb.to_workbooks(df)
    got = {(r["doc_id"], r["title"], r["row_no"]): r["cells"] for r in wb.from_workbooks(books).collect()}
    assert got == {(1, "AB", 0): ["h1", "h2"], (1, "AB", 1): ["x & <y>", ""], (1, "AB", 2): ["é\n1", ""], (1, "ab_1", 0): ["h"], (1, "ab_1", 1): [""], (2, "Sheet", 0): [], (2, "Sheet", 1): []}
    assert wb.from_workbooks(spark.createDataFrame([(1, None), (2, b"no")], "doc_id int, workbook binary")).count() == 0


def test_columns_and_titles():
    assert [wb.column(k) for k in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]
    long = "t" * 40
    assert wb.titles([long, long.upper(), "", "sheet"]) == ["t" * 28, "T" * 28 + "_1", "Sheet", "sheet_1"]


def test_inbox(spark, tmp_path):
    (tmp_path / "in").mkdir()
    doc = {"sheets": [{"title": "T", "headers": ["a"], "rows": [["x"], {"row_type": "section", "data": ["y"]}]}]}
    for name in ("one", "two"):
        (tmp_path / "in" / f"{name}.json").write_text(json.dumps(doc))
        query = inbox.run_inbox(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark"))
        assert query.awaitTermination(60)
    got = spark.read.parquet(str(tmp_path / "out")).groupBy("doc_id").count().collect()
    assert {(r["doc_id"], r["count"]) for r in got} == {("one.json", 2), ("two.json", 2)}
