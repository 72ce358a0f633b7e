"""Power and cooling: catalog hydration, requirement reading, references of sheets."""

import json

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import power
from tallyloom.sources import catalogs, sheets

PDF = "https://www.vertiv.com/products/"
SCRAPED = [
    {"product_name": "Vertiv Liebert EXM UPS", "category": "Uninterruptible", "product_url": PDF + "exm", "datasheet_url": PDF + "exm-brochure.pdf", "power_capacity_kva": 80},
    {"model": "Liebert EXM UPS", "category": "UPS", "datasheet_url": PDF + "exm-datasheet.pdf", "power_capacity_kva": {"min": 10, "max": 200}, "note": "dual power, n+1"},
    {"model": "Liebert APS", "category": "UPS", "power_capacity_kva": "20"},
    {"model": "Liebert APS modular", "category": "UPS", "datasheet_url": PDF + "aps-datasheet.pdf"},
    {"model": "Liebert CRV4", "category": "thermal management", "subheading": "In-Row cooling", "cooling_capacity_kw": "40 kW", "datasheet_url": "https://x.example/obsolete/crv.pdf"},
    {"model": "Geist rPDU", "category": "Rack PDU", "outlet_count": 24, "datasheet_url": PDF + "geist.pdf"},
    {"vendor": "Other", "model": "Foreign UPS", "category": "UPS"},
]
EXTRACTED = [{"model": "Liebert CRV4 unit", "category": "cooling", "technical_specifications": {"normalized_summary": {"rack_units": 42}}}]


def scan(spark, goods):
    return catalogs.products(spark.createDataFrame([("a", json.dumps({"items": goods}))], "file string, raw string")).withColumnRenamed("pos", "ord")


@pytest.fixture(scope="module")
def catalog(spark):
    return power.load_catalog(scan(spark, SCRAPED), scan(spark, EXTRACTED))


def test_catalog_is_hydrated_and_merged(catalog):
    by = {r["model"]: r for r in catalog.collect()}
    assert "Foreign UPS" not in by and len(by) == 6
    ups = by["Vertiv Liebert EXM UPS"]
    assert ups["datasheet_url"] == PDF + "exm-datasheet.pdf" and ups["product_url"] == PDF + "exm" and ups["p_fields"]["power_capacity_kva"] == 80
    assert by["Liebert APS"]["datasheet_url"] == PDF + "aps-datasheet.pdf" and by["Liebert APS"]["category"] == "UPS"
    assert by["Liebert CRV4"]["category"] == "COOLING" and by["Liebert CRV4"]["p_fields"] == {"cooling_capacity_kw": 40, "rack_units": 42}


@pytest.mark.parametrize(
    "text, need, fields, unsupported",
    [
        ("Online UPS 60 kVA with N+1", "UPS", {"power_capacity_kva": 60}, None),
        ("In-row cooling 30 kW 42U", "COOLING", {"cooling_capacity_kw": 30, "rack_units": 42}, None),
        ("Cable manager 2U for the rack", "RACK", {}, None),
        ("Lithium-ion battery rack of 40 kW", "ENERGY_STORAGE", {}, None),
        ("rack PDU with 24 outlets", "POWER_DISTRIBUTION", {"outlet_count": 24}, None),
        ("hot aisle containment", "INTEGRATED_RACK_SOLUTION", {}, None),
        ("temperature and humidity sensor", "COOLING_CONTROL", {}, None),
        ("split AC of 2 ton", None, {}, "SPLIT_AC"),
        ("static load 1,500 kg", None, {"static_load_kg": 1500}, None),
        (None, None, {}, None),
    ],
)
def test_requirements(spark, text, need, fields, unsupported):
    r = power.parse(spark.createDataFrame([(text,)], "t string"), "t").first()
    assert (r["category"], r["fields"], r["unsupported"]) == (need, fields, unsupported)
    assert r["redundancy"] in (None, "N+1" in (text or ""))


def test_references_of_sheets(spark, catalog):
    head = ["SN", "Requirement"]
    tables = [
        {"title": "Power", "headers": head, "rows": [["1", "Online UPS of 60 kVA with redundancy"], ["2", "Precision in-row cooling unit 30 kW"], ["3", "IP camera with NVR"], ["4", "Installation of the UPS"], ["5", "UPS of 500 kVA"]]},
        {"title": "Racks", "headers": head, "rows": [{"row_type": "data", "data": ["1", "Rack PDU with 20 outlets"], "metadata": {"is_product_spec_continuation": True}}]},
        {"title": "Evaluation criteria", "headers": head, "rows": [["1", "UPS of 60 kVA"]]},
    ]
    rows = sheets.flatten_rows(spark.createDataFrame([("d", json.dumps(tables))], "doc_id string, json string"))
    got = {(r["sheet_no"], r["row_no"]): r for r in power.inject_power_references(rows, catalog).collect()}
    assert got[0, 0]["reference"] == f"Vertiv: Vertiv Liebert EXM UPS - {PDF}exm-datasheet.pdf"
    assert got[0, 1]["reference"] == "Vertiv: Liebert CRV4" and "CCTV scope" in got[0, 2]["reasoning"] and got[0, 3]["reference"] == ""
    assert got[0, 4]["reference"].startswith("Vertiv: ") and json.loads(got[0, 0]["details"])["provider"] == "vertiv"
    assert got[1, 0]["reference"] == f"Vertiv: Geist rPDU - {PDF}geist.pdf" and got[2, 0]["cells"] == ["1", "UPS of 60 kVA"]


def test_addresses(spark):
    urls = [None, "", "ftp://a/x.pdf", "https://a/x.html", "https://a/ethics/x.pdf", " https://a/x.PDF "]
    got = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "k int, u string").select("k", power.datasheet(F.col("u")).alias("d"), power.product_page(F.col("u")).alias("p")).orderBy("k").collect()
    assert [r["d"] for r in got] == [None] * 5 + ["https://a/x.PDF"] and [r["p"] is None for r in got] == [True, True, True, False, False, False]
