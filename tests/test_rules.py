"""Rule-based references, the guide's citations and the detector on small cases."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import detect, guide, plain
from tallyloom.operators import retrieve as rt
from tallyloom.sources import catalogs, sheets

from .test_inject import CATALOG


@pytest.fixture(scope="module")
def products(spark):
    raw = spark.createDataFrame([("a.json", json.dumps(CATALOG))], "file string, raw string")
    return catalogs.first_of_each(catalogs.products(raw)).withColumnRenamed("pos", "ord")


def test_hardware_references_by_group(spark, products):
    head = ["SN", "Requirement"]
    tables = [
        {"title": "Firewall appliance", "headers": head, "rows": [["1", "Firewall IPSec VPN throughput 1 Gbps"], ["2.", "Firewall with 5 x 1GE RJ45 copper ports"], {"row_type": "section", "data": ["", "Other"]}, ["3", "Firewall IPSec VPN throughput 10 Gbps"], ["4", "diesel generator for the firewall"]]},
        {"title": "Others", "headers": head, "rows": [["x", "We like the FortiGate-40A and FORTIGATE  800A firewall appliance"], {"row_type": "data", "data": ["y", "firewall"], "metadata": {"requires_reference": False, "fortinet_feature_candidates": ["ssl vpn", "ha"]}}]},
        {"title": "Bidder qualification", "headers": head, "rows": [["1", "Firewall IPSec VPN throughput 1 Gbps"]]},
    ]
    rows = sheets.flatten_rows(spark.createDataFrame([("d", json.dumps(tables))], "doc_id string, json string"))
    got = {(r["sheet_no"], r["row_no"]): r for r in plain.inject_hardware_references(rows, products).collect()}
    assert got[0, 0]["group_id"] == got[0, 1]["group_id"] and got[0, 0]["group_id"].startswith("AUTO_1_firewall_appliance")
    assert "Fortinet: FortiGate 60A — " in got[0, 0]["reference"] and got[0, 1]["reference"] == got[0, 0]["reference"]
    assert got[0, 0]["reasoning"] and not got[0, 1]["reasoning"]
    assert got[0, 3]["group_id"] != got[0, 0]["group_id"] and "200A" in got[0, 3]["reference"] and got[0, 4]["group_id"] is None
    assert got[1, 0]["headers"] == head + plain.OUTPUT and len(got[1, 0]["cells"]) == 8
    assert got[1, 1]["group_id"] is None and json.loads(got[1, 1]["tag"])["lookup_query"] == "ssl vpn ha"
    assert got[2, 0]["headers"] == head and got[2, 0]["reference"] == ""
    direct = plain.mentions(spark.createDataFrame([(1, "the FortiGate-40A, FORTIGATE  800A; xFortiGate 60A, FortiGate 200Ab")], "k int, t string"), products, "t", ["k"]).first()["direct"]
    assert [d.split(" — ")[0] for d in direct] == ["Fortinet: FortiGate 800A", "Fortinet: FortiGate 40A"]


def test_guide_enrichment(spark):
    toc = [(0, 1, "VPN", 10, None), (1, 2, "SSL VPN portals", 12, None), (2, 2, "IPsec tunnels", None, 19), (3, 1, "High Availability", 40, None), (4, 2, "HA cluster setup", 99, None)]
    raw = spark.createDataFrame([("g", k, level, title, page, dest, 50, "file:///g.pdf#x") for k, level, title, page, dest in toc], "doc string, idx int, level int, title string, page int, dest_page int, n_pages int, uri string")
    index = guide.flat_index(raw, spark.createDataFrame([("g", "b", 39), ("g", "a", 39), ("g", "z", None)], "doc string, name string, dest_page int")).withColumn("url", F.lit("")).cache()
    by = {r["idx"]: r for r in index.collect()}
    assert by[1]["section_path"] == "VPN > SSL VPN portals" and by[1]["pdf_uri"] == "file:///g.pdf#page=12" and by[2]["page"] == 20 and by[4]["page"] == 50
    assert by[0]["page_end"] == 39 and by[3]["named_destination"] == "a" and by[1]["domains"] == ["VPN"] and by[4]["domains"] == ["High Availability"]
    tag = json.dumps({"reference_needed": True, "fortinet_feature_candidates": ["ssl vpn portals", "ha cluster setup", "ssl vpn portals"], "fortinet_domains": ["remote access"]})
    rows = spark.createDataFrame([("g", 1, "x", tag), ("g", 2, "The firewall must support IPsec tunnels", None), ("g", 3, "price of it", None), ("g", 4, None, "see {\"reference_needed\": 1, \"lookup_query\": \"high availability\"} here"), ("g", 5, "x", "{\"reference_needed\": false}")], "doc string, k int, t string, tag string")
    got = {r["k"]: r for r in guide.enrich(rows, index, ["k"], "t", "tag").collect()}
    assert got[1]["reference"].count("FortiOS Admin Guide - ") == 2 and "VPN (Page 10)\nfile:///g.pdf#page=10" in got[1]["reference"]
    assert "IPsec tunnels (Page 20)" in got[2]["reference"] and "High Availability (Page 40)" in got[4]["reference"]
    assert got[3]["status"] is None and got[3]["reference"] == "" and got[5]["status"] is None
    assert got[1]["status"] in ("Matched", "Manual Review Required") and "[Review Required]" in got[2]["reference"] or got[2]["status"] == "Matched"


def test_best_entry_equals_brute_force(spark):
    rng = random.Random(1)
    words = ["vpn", "ssl", "ha", "cluster", "policy", "route", "static", "log", "user"]
    entries = [("g", k, " ".join(rng.choices(words, k=rng.randrange(1, 5)))) for k in range(30)]
    index = spark.createDataFrame(entries, "doc string, idx int, title string").withColumns({"page": F.col("idx"), "section_path": F.col("title"), "pdf_uri": F.lit(""), "url": F.lit(""), "embedding_text": F.col("title"), "keywords": F.array_sort(F.array_distinct(F.split("title", " "))), "domains": F.array(F.lit("VPN"))})
    asked = [(k, "g", " ".join(rng.choices(words, k=rng.randrange(1, 8))), ["VPN"] if k % 2 else []) for k in range(25)]
    got = {r["q"]: (r["idx"], r["score"]) for r in guide.best_entries(spark.createDataFrame(asked, "q int, doc string, query string, tag_domains array<string>"), index).collect()}

    def score(query, title, domains):
        order = lambda t: " ".join(sorted(t.split()))
        a, b = order(query), order(title)
        fuzzy = 2 * rt.common_length(a, b) / (len(a) + len(b))
        own, held = set(title.split()), set(query.split())
        return (0.25 * max(fuzzy, 0.85 if own <= held else 0) + 0.15 * len(own & held) / len(own) + 0.05 * (1.0 if domains else 0.0)) / 0.45

    for q, _, query, domains in asked:
        best = max(range(30), key=lambda k: (round(score(query, entries[k][2], domains), 12), -k))
        assert got[q] == (best, pytest.approx(score(query, entries[best][2], domains), abs=1e-4))


def test_encoder_narrows_the_entries(spark):
    encode = lambda df, text: df.withColumn("vector", F.array(F.length(text).cast("double"), F.lit(1.0)))
    index = spark.createDataFrame([("g", k, "w" * k) for k in range(1, 40)], "doc string, idx int, title string").withColumns({"page": F.col("idx"), "section_path": F.col("title"), "pdf_uri": F.lit(""), "url": F.lit(""), "embedding_text": F.col("title"), "keywords": F.array(F.col("title")), "domains": F.array(F.lit("VPN"))})
    got = guide.best_entries(spark.createDataFrame([(1, "g", "wwww", ["VPN"])], "q int, doc string, query string, tag_domains array<string>"), index, encode).first()
    assert got["idx"] == 4 and got["method"] == "hybrid_semantic_fuzzy" and got["confidence"] == "High"


def test_page_ranges():
    assert detect.checked_range(None, "", 9) is None and detect.checked_range("2", 9, 9) == (2, 9)
    for bad in ((1, None), ("a", 2), (0, 2), (3, 2), (1, 10)):
        with pytest.raises(ValueError):
            detect.checked_range(*bad, 9)
