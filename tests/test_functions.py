from pyspark.sql import functions as F

from tallyloom.functions import text as tx
from tallyloom.operators import match as mt
from tallyloom.operators import shape as sh
from tallyloom.sources import sheets as ss


def one(spark, make, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{k} string" for k in range(len(values))))
    return df.select(make(*(F.col(f"c{k}") for k in range(len(values)))).alias("x")).first()["x"]


def test_numbers(spark):
    assert one(spark, tx.number, "1,234") == 1234
    assert one(spark, tx.number, "12 Million") == 12e6
    assert one(spark, tx.number, "10 to 20") == 20
    assert one(spark, tx.number, "none") is None


def test_extraction(spark):
    assert one(spark, tx.numbered_sections, "a 1.2 b 1.2.1 c") == ["1.2 b", "1.2.1 c"]
    assert one(spark, tx.inline_bullets, "x a) y 1. z") == "x\na) y\n1. z"
    assert abs(one(spark, tx.token_sort_ratio, "new york", "york new") - 1) < 1e-9
    assert abs(one(spark, tx.token_sort_ratio, "abc", "abd") - 4 / 6) < 1e-9


def test_hard_filter_never_lets_under_specified_pass(spark):
    need = spark.createDataFrame([(1, 10.0, 1.0), (2, None, 2.0)], "r int, need_a double, need_storage double")
    have = spark.createDataFrame([(1, 9.9, 1.0), (2, 10.0, 0.9375), (3, None, 3.0), (4, 50.0, 1.5)], "product_id int, has_a double, has_storage double")
    fields = [mt.Field("a"), mt.Field("storage", tolerance=0.93)]
    got = {(x["r"], x["product_id"]) for x in need.crossJoin(have).where(mt.all_pass(fields)).collect()}
    assert got == {(1, 2), (1, 4), (2, 3)}


def test_outline(spark):
    rows = [(1, k, lvl, f"t{k}", page) for k, (lvl, page) in enumerate([(1, 1), (2, 2), (3, 4), (2, 6), (1, 9), (3, 9)])]
    df = spark.createDataFrame(rows, "d int, i int, lvl int, t string, p int")
    path = {r["i"]: r["path"] for r in sh.parent_path(df, ["d"], "i", "lvl", "t", 3).collect()}
    assert path == {0: "t0", 1: "t0 > t1", 2: "t0 > t1 > t2", 3: "t0 > t3", 4: "t4", 5: "t4 > t5"}
    end = {r["i"]: r["page_end"] for r in sh.section_end(df, ["d"], "i", "lvl", "p", 3).collect()}
    assert end == {0: 8, 1: 5, 2: 5, 3: 8, 4: 9, 5: 9}


def test_sheets(spark):
    doc = '{"sheets":[{"name":"N","headers":["a"],"rows":[["x",null],{"row_type":"section","data":["y"],"metadata":{"k":1}}]}]}'
    rows = ss.flatten_rows(spark.createDataFrame([(1, doc), (2, "broken")], "doc_id int, json string")).orderBy("row_no").collect()
    assert [(r["title"], r["row_type"], r["cells"]) for r in rows] == [("N", "data", ["x", None]), ("N", "section", ["y"])]
