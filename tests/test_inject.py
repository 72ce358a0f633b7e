"""References for sheets: the behaviours of the matching rules, on a catalog of our own."""

import json

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import constraints as cs
from tallyloom.operators import fit, inject
from tallyloom.sources import catalogs, sheets

DS = "https://vendor.example/data-sheets/"


def wall(model, **specs):
    return {"vendor": "Fortinet", "model": f"FortiGate {model}", "category": "NGFW", "datasheet_url": f"{DS}fortigate-{model.lower()}.pdf", **specs}


FULL = {"ngfw_throughput_gbps": 24, "ips_throughput_gbps": "26", "threat_protection_gbps": 22, "ssl_tls_inspection_gbps": 17, "ssl_vpn_gbps": 16, "concurrent_sessions": "14 million", "connections_per_second": "550,000", "policies": 100_000, "storage_tb": 0.9375, "ipsec_vpn_throughput_gbps": 50, "ssl_vpn_users": 25_000, "interfaces": {"25g_sfp28": 6, "10g_sfp_plus": 10, "1_10g_rj45": 4, "1g_rj45": 8}, "ha_modes": ["Active-Passive", "Active-Active", "Clustering"], "ha_port": True, "management_port": True, "console_port": True, "redundant_power": True}
CATALOG = [
    wall("800A", **FULL),
    wall("3500A", **{**FULL, "ngfw_throughput_gbps": 90, "ips_throughput_gbps": 95, "threat_protection_gbps": 90, "ssl_vpn_users": 30_000, "concurrent_sessions": 200_000_000}),
    wall("790A", **{**FULL, "ngfw_throughput_gbps": 19}),
    wall("810A", **{k: v for k, v in FULL.items() if k != "policies"}),
    wall("40A", ipsec_vpn_throughput_gbps=0.4, interfaces={"1g_rj45": 5}),
    wall("60A", ipsec_vpn_throughput_gbps=2, interfaces={"1g_rj45": 8}, redundant_power=True, ha_modes="Active-Passive"),
    wall("200A", ipsec_vpn_throughput_gbps=13, concurrent_sessions=21_000_000, interfaces={"10g_sfp_plus": 8, "1g_rj45": 8}, redundant_power=True),
    {"vendor": "Fortinet", "model": "FortiSwitch 1000A", "category": "DATACENTER_SWITCH", "switching_capacity_gbps": 1800, "interfaces": {"10g_sfp_plus": 48, "40g_qsfp_plus": 6}, "management_port": True, "datasheet_url": DS + "switch.pdf"},
    {"vendor": "Fortinet", "model": "FortiLogger", "category": "LOGGING", "product_url": "https://logger.example/"},
    {"vendor": "Fortinet", "model": "FortiAnalyzer 800A", "category": "LOGGING", "logs_per_day_gb": 300, "performance_eps": 9000, "datasheet_url": DS + "analyzer.pdf"},
    {"vendor": "Juniper", "model": "SRX1", "category": "NGFW", "ipsec_vpn_throughput_gbps": 1},
]
SECTION = ["Section", "SN", "Requirement", "Required Value / Spec"]
WALL_ROWS = [
    ["Perimeter Firewalls", "", "", ""], ["", "1.", "Next Generation Firewall Throughput", "20Gbps"], ["", "2.", "IPS Throughput", "20Gbps"], ["", "3.", "Concurrent sessions", "12 Million"],
    ["", "4.", "Connections Per Seconds", "500,000"], ["", "5.", "Policies", "100,000"], ["", "6.", "Storage Support (Usable)", "1TB"], ["", "7.", "Threat protection throughput", "20Gbps"],
    ["", "8.", "SSL/TLS Inspection throughput", "15Gbps"], ["", "9.", "SSL VPN Throughput", "15Gbps"], ["Interfaces", "1.", "25 GE SFP28 interfaces with matched transceivers", "4"],
    ["", "2.", "10 GE SFP+ interfaces with matched transceivers", "8"], ["", "3.", "1/10 GE RJ45", "2"],
]
THREE = ["SN", "Requirement", "Required Value / Spec"]
REMOTE = "Total Remote Sites Firewalls = 196x Remote Site Equipment Hardware Capacity: a) IPSec VPN throughput with all features 200 Mbps b) Interfaces Copper 1Gig = 5"
REMOTE_HA = "Total Remote Sites Firewalls = 04x Remote Site Equipment Hardware Capacity: a) IPSec VPN throughput with all features 1 Gbps b) Interfaces Copper 1Gig = 5 c) Must support HA configuration with Active/Passive d) Redundant power supply."
SDWAN = "1.2.1 Aggregation Firewalls for PR & DR must comply: IPSec VPN throughput with all features 10 Gbps; Equipment must support 2000+ IPSec VPNs; Minimum 8x 10Gig Interfaces other than HA; Concurrent Sessions 20Million; Redundant Power Supplies. "


def data(cells, kind="data", **meta):
    return {"row_type": kind, "data": cells, "metadata": meta}


#: title, headers, rows, and the rows that get a reference with a part of it.
SHEETS = {
    "t1": ("Technical Requirements", SECTION, WALL_ROWS + [["Features", "1.", "High Availability", "Active/Active, Active/Passive, Clustering"], ["", "34.", "All hardware equipment must be Dual Power Supply", "Yes"]], {1: "FortiGate 800A"}),
    "t6": ("Technical Compliance", ["S#", "Description"], [data(["1.", "Bidder should propose complete SD-WAN solution for 200x remote sites. " + SDWAN + "1.2.2 Redundant Controllers for PR & DR Sites must comply: bidder should provide licenses for 200x Firewalls and centrally manage SDWAN feature sets."], device_type="CENTRALIZED_MANAGEMENT", detected_specs={"max_devices_vdoms": 200})], {0: "FortiGate 200A"}),
    "t9": ("Hardware Based Next Generation Firewall", THREE, [data(["Perimeter Firewalls", "", ""], requires_reference=False, product_group_primary_row=False), data(["1.", "Next Generation Firewall Throughput", "20Gbps"], requires_reference=False, product_group_primary_row=False), *(data(r, is_product_spec_continuation=True) for r in (["2.", "IPS Throughput", "20Gbps"], ["3.", "SSL VPN Throughput", "15Gbps"], ["4.", "25 GE SFP28 interfaces with matched transceivers", "4"], ["6.", "All hardware equipment must be Dual Power Supply", "Yes"]))], {1: "FortiGate"}),
    "t10": ("Hardware Based Next Generation Firewall", THREE, [data(["", "Perimeter Firewalls", ""], "section", requires_reference=False), *(data(["1.", *r[2:]], "section", requires_reference=False) for r in WALL_ROWS[1:10])], {1: "FortiGate"}),
    "t11": ("Network Hardware", SECTION, WALL_ROWS + [["Features", "1.", "High Availability", "Active/Passive"], ["", "2.", "All hardware equipment must be Dual Power Supply", "Yes"], ["Data Center Switches", "", "", ""], ["", "1.", "Switching Capacity", "1Tbps"], ["", "2.", "10 GE SFP+ interfaces", "24"], ["", "3.", "Management Port", "Yes"]], {1: "FortiGate 800A", 16: "FortiSwitch 1000A"}),
    "t12": ("Technical Compliance Sheet", ["S#", "Description", "Compliance"], [["2.", REMOTE, ""], ["4.", "Provided equipment must load balance, load sharing and fail-over between network links.", ""], ["5.", "Proposed equipment must provide SDWAN features including link bundling and traffic steering.", ""]], {0: "FortiGate 40A"}),
    "t13": ("Technical Compliance Sheet", ["S#", "Description", "Compliance"], [data(["2.", REMOTE, ""], device_category="ngfw", requires_reference=False, product_group_primary_row=False, is_product_spec_continuation=True, detected_specs={"ipsec_vpn_throughput_gbps": 0.2, "interfaces_1g": 5}), data(["3.", REMOTE_HA, ""], device_category="ngfw", requires_reference=False, product_group_primary_row=False, is_product_spec_continuation=True, detected_specs={"ipsec_vpn_throughput_gbps": 1.0, "interfaces_1g": 5, "redundant_power": True}), data(["4.", "Provided equipment must load balance, load sharing and fail-over between network links.", ""], device_category="ngfw", is_product_spec_continuation=True)], {0: "FortiGate 40A", 1: "FortiGate 60A"}),
    "t14": ("Logging Hardware", THREE, [["1.", "Hardware logging appliance for firewall logs, log reporting and log backup", "Yes"]], {0: "FortiLogger"}),
    "t15": ("General Content", ["Description"], [["Procurement Title: Supply, Installation, Configuration and Maintenance of SSL-VPN Solution"], ["Scope of Work: The bidder shall provide services, support, warranty and documentation."]], {}),
    "t16": ("Connectivity Requirements", THREE, [["1.", "SSL-VPN solution shall be provided for remote users as part of project scope", "Yes"]], {}),
    "t17": ("SSL-VPN Users", THREE, [["Deployment and Hardware", "", ""], ["1.", "All solution and its components must be deployed on-prem", "Yes"], ["2.", "All proposed hardware must have minimum 4 x 10/25 fiber and 4 x 10G fiber ready to use interfaces", "Yes"], ["Scalability", "", ""], ["1.", "Fully licensed SSL-VPN concurrent users", "17,000"], ["2.", "Hardware must be scalable to handle 47,000 concurrent SSL VPN users", "Yes"], ["Security", "", ""], ["1.", "MFA and access control policies must be supported", "Yes"]], {4: DS}),
    "t18": ("Hardware Based Logging Solution", ["No.", "Requirement Description", "Compliance"], [["1.", "Reporting", "Yes"], ["2.", "Logging", "Yes"], ["3.", "Must support 100GB Per day Or 10,000EPS and quote the solution accordingly.", "100GB Logs Per day Or 10,000 EPS"], ["4.", "Centralized logging", "Yes"], ["5.", "Must provide all type of logs including firewall logs, traffic logs, attack and audit logs.", "Yes"]], {2: "FortiLogger"}),
    "skip": ("Bidder Qualification", SECTION, WALL_ROWS, {}),
    "empty": ("Empty", [], [[], [None, ""]], {}),
}


@pytest.fixture(scope="module")
def products(spark):
    raw = spark.createDataFrame([("a.json", json.dumps({"products": CATALOG}))], "file string, raw string")
    return catalogs.first_of_each(catalogs.products(raw)).withColumnRenamed("pos", "ord")


@pytest.fixture(scope="module")
def rows(spark):
    docs = [(k, json.dumps({"sheets": [{"title": t, "headers": h, "rows": r}]})) for k, (t, h, r, _) in SHEETS.items()]
    return sheets.flatten_rows(spark.createDataFrame(docs, "doc_id string, json string"))


@pytest.fixture(scope="module")
def table(rows, products):
    return inject.inject_references(rows, products).cache()


@pytest.fixture(scope="module")
def injected(table):
    return {(r["doc_id"], r["row_no"]): r for r in table.collect()}


@pytest.mark.parametrize("name", SHEETS)
def test_references_of_sheets(injected, name):
    want = SHEETS[name][3]
    got = {no: r["reference"] for (k, no), r in injected.items() if k == name and r["reference"]}
    assert set(got) == set(want), got
    for no, part in want.items():
        assert part in got[no] and "Fortinet: " in got[no]


def test_written_rows(injected):
    r = injected["t1", 1]
    assert r["headers"][-3:] == ["References", "Hardware_Reference_Reasoning", "Reference_Match_Details"] and len(r["cells"]) == len(r["headers"]) == 7
    assert r["cells"][4] == r["reference"] and "Key checks" in r["cells"][5]
    details = json.loads(r["cells"][6])["segments"]
    assert [d["vendor"] for d in details] == ["Fortinet", "Juniper"] and details[0]["constraints"]["interfaces"]["1_10g_rj45"] == 2
    assert details[1]["match_status"] == "no_safe_match" and len(details[0]["top_candidates"]) == 8
    assert injected["skip", 1]["cells"] == WALL_ROWS[1] and injected["empty", 1]["cells"] == ["", "", ""]
    assert "capped" in injected["t17", 4]["reasoning"] and "30000" in injected["t17", 4]["reasoning"]


def test_counters(table):
    c = inject.stats(table.where("doc_id IN ('t10', 't13', 't15')")).first()
    assert (c["rows_seen"], c["matched_rows"], c["unmatched_rows"], c["sections_skipped"]) == (15, 3, 0, 9)


def test_another_judge_may_not_choose_an_oversized_product(spark, rows, products):
    one = rows.where("doc_id = 't1'")
    said = spark.createDataFrame([("Technical Requirements:2:segment-1", "Fortinet", "FortiGate 3500A", "safe_match", 0.99, "the largest")], "row_id string, vendor string, selected_model string, match_status string, confidence double, reasoning string")
    got = inject.inject_references(one, products, inject.Provider(may_override=True), said).where("row_no = 1").first()
    assert "800A" in got["reference"] and "largest" not in got["reasoning"]
    same = said.withColumn("selected_model", F.lit("fortigate 800a"))
    got = inject.inject_references(one, products, decisions=same).where("row_no = 1").first()
    assert "800A" in got["reference"] and "largest" in got["reasoning"]


def constraints(spark, text, meta=None):
    df = spark.createDataFrame([(text, json.dumps(meta or {}))], "t string, j string").withColumn("m", cs.metadata(F.try_parse_json("j")))
    return cs.parse_constraints(df, "t", "m").first()


LONG_WALL = "Perimeter Firewalls Next Generation Firewall Throughput 20Gbps IPS Throughput 20Gbps Concurrent sessions 12 Million Connections Per Seconds 500,000 Policies 100,000 Storage Support (Usable) 1TB Threat protection throughput 20Gbps SSL/TLS Inspection throughput 15Gbps SSL VPN Throughput 15Gbps Interfaces 25 GE SFP28 interfaces with matched transceivers 4 10 GE SFP+ interfaces with matched transceivers 8 1/10 GE RJ45 2 HA Port Yes Console Port Yes Management Port RJ-45 Yes High Availability Active/Active, Active/Passive, Clustering"


def test_constraints_of_one_long_text(spark):
    c = constraints(spark, LONG_WALL)
    n = c["numbers"]
    assert c["device_type"] == "NGFW" and c["interfaces"]["1_10g_rj45"] == 2 and c["interfaces"]["25g_sfp28"] == 4
    assert (n["ngfw_throughput_gbps"], n["concurrent_sessions"], n["connections_per_second"], n["policies"], n["storage_tb"]) == (20, 12e6, 5e5, 1e5, 1)
    assert set(c["flags"]) >= {"ha_supported", "ha_port", "console_port", "management_port"}


def test_constraints_over_metadata(spark):
    text = "Bidder should propose complete SD-WAN solution for 200x remote sites. PR Site Aggregation Firewalls (Hardware) Qty 2. " + SDWAN + "1.2.2 Redundant Controllers for PR & DR Sites must provide licenses for 200x Firewalls and centrally manage SDWAN feature sets."
    c = constraints(spark, text, {"device_type": "CENTRALIZED_MANAGEMENT", "detected_specs": {"ipsec_vpn_throughput_gbps": 10, "concurrent_sessions": 20_000_000, "interfaces_10g": 8, "redundant_power": True, "max_devices_vdoms": 200}})
    assert c["device_type"] == "NGFW" and "max_devices_vdoms" not in c["numbers"] and c["numbers"]["ipsec_vpn_throughput_gbps"] == 10 and "max_devices_vdoms" in c["notes"][-1]
    c = constraints(spark, "Core switch must provide minimum 3x 40G interfaces and 1 Tbps switching capacity.", {"device_type": "DATACENTER_SWITCH", "detected_specs": {"interfaces_40g": 120, "switching_capacity_gbps": 1000}})
    assert c["interfaces"]["40g_qsfp_plus"] == 3 and "40g_qsfp_plus" in c["notes"][0]
    c = constraints(spark, "Aggregation Firewalls must comply: IPSec VPN throughput 10 Gbps; Minimum 8x 10Gig Interfaces other than HA; for 200x remote sites.", {"device_type": "NGFW", "detected_specs": {"interfaces_10g": 20_000_008}})
    assert c["interfaces"]["10g_sfp_plus"] == 8


def test_normalized_metadata(spark):
    meta = {
        "device_category": "next generation firewall", "throughput_mbps": "2,500", "source_text": "x", "ports": "24 to 48", "storage_gb": 512, "ha_modes": ["Active/Passive"], "interfaces": {"10g_sfp_plus": "4", "1g_sfp": None},
        "detected_specs": {"switching_capacity_tbps": 1.5, "cps": "10k", "interfaces_10g": 6, "ha_port": True, "power_capacity_kw": {"min": 10, "max": 20}, "policies": None},
        "requirements": {"policies": 9, "email_domains": 3},
    }
    df = spark.createDataFrame([(json.dumps(meta), "ssl vpn of it")], "j string, t string").withColumn("m", cs.metadata(F.try_parse_json("j")))
    c = cs.normalized(df, "m", F.col("t")).first()
    assert c["device_type"] == "NGFW" and c["ha_modes"] == ["active-passive"] and set(c["flags"]) == {"ha_port", "ha_supported"}
    assert c["numbers"] == {"ports": 48, "ssl_vpn_gbps": 2.5, "storage_tb": 0.5, "switching_capacity_gbps": 1500, "connections_per_second": 10_000, "power_capacity_kw": 10, "email_domains": 3}
    assert c["interfaces"] == {"10g_sfp_plus": 6}
    none = cs.normalized(spark.createDataFrame([(None, None)], "j string, t string").withColumn("m", cs.metadata(F.try_parse_json("j"))), "m", F.col("t")).first()
    assert none["numbers"] == {} and none["device_type"] is None


def test_match_text(spark, products):
    plain = "Next Generation Firewall Throughput 20Gbps, IPS Throughput 20Gbps, Concurrent sessions 12 Million, Storage 1 TB disk"
    texts = [(1, plain), (2, "diesel generator"), (3, "firewall of good quality"), (4, None), (5, "Access switch with 10 x 10G SFP+ ports")]
    got = {r["k"]: r for r in fit.match_text(spark.createDataFrame(texts, "k int, t string"), "k", "t", fit.with_specs(products)).collect()}
    assert got[1]["reference"] == f"Fortinet: FortiGate 800A — {DS}fortigate-800a.pdf" and len(got) == 5
    assert all(got[k]["reference"] == "" for k in (2, 3, 4, 5))
    one = fit.matched(cs.parse_constraints(spark.createDataFrame([(1, LONG_WALL)], "k int, t string"), "t"), fit.with_specs(products), ["k"], cs.words(["fortinet"])).first()
    assert one["valid"] == 2 and one["top"] == ["FortiGate 800A", "FortiGate 3500A"] and 0.5 <= one["confidence"] <= 0.99
    assert {r["model"]: r["missing"] for r in one["rejected"]}["FortiGate 790A"] == ["ngfw_throughput_gbps"]


def test_specs_of_products(spark):
    goods = [
        {"vendor": "A", "model": "M 24", "category": "SWITCH", "main_port_options": [8, 24, 48], "main_port_speed": "10G / 25G", "throughput_mbps": "500", "local_storage_gb": 960},
        {"vendor": "A", "model": "plain", "category": "SWITCH", "interfaces": {"1g_rj45": 4, "10g_sfp_plus": "2"}, "vpn_throughput_gbps": 3, "ngfw_throughput_gbps": {"min": 1, "max": 8}, "ha_port": True},
    ]
    raw = spark.createDataFrame([("f", json.dumps(goods))], "file string, raw string")
    df = fit.with_specs(catalogs.products(raw)).withColumns({"o": fit.port_count(F.lit(20.0)), "x": fit.port_count(F.lit(99.0)), "i25": fit.interface_count(F.lit("25g_sfp28"), F.lit(20.0)), "i40": fit.interface_count(F.lit("40g_qsfp_plus"), F.lit(20.0))})
    a, b = df.orderBy("model").collect()
    assert (a["o"], a["x"], a["i25"], a["i40"], a["p_numbers"]["storage_tb"], a["p_numbers"]["throughput_gbps"], a["p_scale"]) == (24, 48, 24, 0, 0.9375, 0.5, 24)
    assert (b["o"], b["p_numbers"]["ipsec_vpn_throughput_gbps"], b["p_numbers"]["ngfw_throughput_gbps"], b["p_numbers"]["firewall_throughput_gbps"]) == (6, 3, 8, 8)


def test_equal_products_are_one_class(spark):
    goods = [{"vendor": "Any", "model": f"m{k % 7} {k}", "category": "NGFW", "ngfw_throughput_gbps": 1 if k == 9 else 5, "interfaces": {"1g_rj45": 8}} for k in range(41)]
    raw = spark.createDataFrame([("a.json", json.dumps({"products": goods}))], "file string, raw string")
    products = fit.with_specs(catalogs.products(raw).withColumnRenamed("pos", "ord"))
    assert sorted(r["n"] for r in fit.classes(products, "ord", False).collect()) == [1, 40]
    asks = spark.sql("SELECT 1 AS k, 'NGFW' AS device_type, map('ngfw_throughput_gbps', 4D) AS numbers, map('1g_rj45', 2L) AS interfaces, array() :: array<string> AS flags, array() :: array<string> AS ha_modes")
    got = fit.matched(asks, products, ["k"], cs.words(["any"])).first()
    assert (got["valid"], got["top"], [r["model"] for r in got["rejected"]]) == (40, ["m0 0", "m1 1", "m2 2", "m3 3", "m4 4"], ["m2 9"])


def test_metadata_is_parsed_once(spark):
    df = spark.createDataFrame([('{"ports": "1,200", "detected_specs": {"policies": 7}}',)], "j string")
    plan = lambda c: df.select(c.alias("c"))._jdf.queryExecution().analyzed().toString()
    assert plan(cs.metadata(F.parse_json("j"))).count("parse_json(") == 1
    assert plan(cs.put(cs.empty(cs.NUMBERS), "a", F.length("j").cast("double"))).count("length(") == 1
    got = cs.normalized(df.select(cs.metadata(F.parse_json("j")).alias("m")), "m", F.lit("")).first()
    assert got["numbers"] == {"ports": 1200.0, "policies": 7.0}


def test_each_distinct_text_is_read_once(spark):
    rows = spark.createDataFrame([(k, [None, "Firewall: NGFW throughput 5 Gbps", "SWITCH"][k % 3], [None, '{"policies": 9}'][k % 2]) for k in range(12)], "k int, text string, meta string")
    got = {r["k"]: (r["text"], r["device_type"], r["numbers"]) for r in cs.parse_distinct(rows, "text", "meta").collect()}
    assert sorted(got) == list(range(12)) and got[0] == (None, None, {}) and got[3] == (None, None, {"policies": 9.0})
    assert got[1][1:] == ("NGFW", {"policies": 9.0, "ngfw_throughput_gbps": 5.0}) and got[2][1:] == ("SWITCH", {})
