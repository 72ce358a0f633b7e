"""Queries of constraints, gates, blocks, references, requirements of power and cooling, and the guide.

The test tables hold no network vocabulary, so each nation gets the same sheets, texts or products of
our own; what must come out for them is stated in the SQL as values. Where the outcome follows from numbers, they come from
the tables.
"""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions import constraints as cs
from ..operators import blocks as bl
from ..operators import fit, gates, guide, inject, plain, power
from ..sources import catalogs as ct
from ..sources import sheets as ss
from ..sources import volumes as vo
from ..sources.staged import spread
from .book import Book

BOOK = Book()


def literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    return str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"


def expected(columns: str, rows: list[tuple]) -> str:
    """SQL of each nation with rows of expected values."""
    values = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows)
    return f"SELECT n_nationkey, c.* FROM nation, (VALUES {values}) c({columns})"


def each(t, name: str, values: list) -> object:
    """n_nationkey, k, name: each nation with each of the values, numbered from 0."""
    return t.nation.select("n_nationkey", F.posexplode(F.array(*map(F.lit, values))).alias("k", name))


def products(t, goods: list[dict]):
    """One catalog file, scanned."""
    files = t.nation.agg(F.lit(json.dumps({"products": goods})).alias("raw"), F.lit("a.json").alias("file"))
    return ct.first_of_each(ct.products(files)).withColumnRenamed("pos", "ord")


DS = "https://vendor.example/data-sheets/"


def wall(model: str, **specs) -> dict:
    return {"vendor": "Fortinet", "model": f"FortiGate {model}", "category": "NGFW", "datasheet_url": f"{DS}{model.lower()}.pdf", **specs}


GOODS = [
    wall("40A", ipsec_vpn_throughput_gbps=0.4, ngfw_throughput_gbps=0.6, interfaces={"1g_rj45": 5}),
    wall("60A", ipsec_vpn_throughput_gbps=2, ngfw_throughput_gbps=1.5, interfaces={"1g_rj45": 8}, redundant_power=True, ha_modes="Active-Passive"),
    wall("200A", ipsec_vpn_throughput_gbps=13, ngfw_throughput_gbps=9, ips_throughput_gbps=10, interfaces={"10g_sfp_plus": 8, "1g_rj45": 8}, redundant_power=True),
    wall("900A", ipsec_vpn_throughput_gbps=60, ngfw_throughput_gbps=40, ips_throughput_gbps="45", interfaces={"25g_sfp28": 6, "10g_sfp_plus": 10}, redundant_power=True, ha_modes=["Active-Active", "Active-Passive"]),
    {"vendor": "Fortinet", "model": "FortiSwitch 1000A", "category": "DATACENTER_SWITCH", "switching_capacity_gbps": 1800, "interfaces": {"10g_sfp_plus": 48}, "datasheet_url": DS + "switch.pdf"},
    {"vendor": "Fortinet", "model": "FortiLogger", "category": "LOGGING", "product_url": "https://logger.example/"},
    {"vendor": "Juniper", "model": "SRX300", "category": "NGFW", "ipsec_vpn_throughput_gbps": 1, "ngfw_throughput_gbps": 1, "interfaces": {"1g_rj45": 8}},
]


def reference(model: str, sheet: str | None = None, vendor: str = "Fortinet", dash: str = " - ") -> str:
    return f"{vendor}: {model}" + (f"{dash}{DS}{sheet}.pdf" if sheet else "")


@BOOK.query("""WITH p AS (SELECT p_partkey AS k, p_size AS s FROM part)
SELECT k AS p_partkey, 'NGFW' AS device_type, CAST(CASE WHEN k % 2 = 0 THEN s ELSE s / 1000.0 END AS DOUBLE) AS ngfw, CAST(k % 7 + 1 AS DOUBLE) * 1000000 AS sessions, CAST(s AS BIGINT) AS ports, CAST(CASE WHEN k % 3 = 0 THEN s * 10 END AS DOUBLE) AS users,
 CAST((CASE WHEN k % 4 < 2 THEN 1 ELSE 0 END) + 1 AS BIGINT) AS n_notes, k % 5 = 0 AS ha FROM p""")
def constraint_chain(t):
    """Text over metadata: labels, interface counts (multiplied, far too large, too small), users, controllers' fields."""
    k, s = F.col("p_partkey"), F.col("p_size")
    text = F.concat(F.lit("Firewall: NGFW throughput "), s.cast("string"), F.when(k % 2 == 0, " Gbps").otherwise(" Mbps"), F.lit(", concurrent sessions "), (k % 7 + 1).cast("string"), F.lit(" million"), F.when(k % 3 == 0, F.concat(F.lit(", SSL VPN for "), (s * 10).cast("string"), F.lit(" users"))).otherwise(""), F.when(k % 5 == 0, ", active/passive").otherwise(""), F.lit(", "), s.cast("string"), F.lit(" x 10G SFP+ interfaces"))
    listed = F.when(k % 4 == 0, s * 10).when(k % 4 == 1, s * 1000 + 1000).when(k % 4 == 2, s - 1).otherwise(s)
    meta = F.to_json(F.struct(F.lit("CENTRALIZED_MANAGEMENT").alias("device_type"), F.struct(listed.alias("interfaces_10g"), F.lit(200).alias("max_devices_vdoms")).alias("detected_specs")))
    got = cs.parse_distinct(t.part.select("p_partkey", "p_size", text.alias("text"), meta.alias("meta")), "text", "meta")
    n = lambda f: F.try_element_at(F.col("numbers"), F.lit(f))
    return got.select("p_partkey", "device_type", F.round(n("ngfw_throughput_gbps"), 9).alias("ngfw"), n("concurrent_sessions").alias("sessions"), F.col("interfaces")["10g_sfp_plus"].alias("ports"), n("ssl_vpn_users").alias("users"), F.size("notes").cast("bigint").alias("n_notes"), F.array_contains("flags", "ha_supported").alias("ha"))


@BOOK.query("""WITH o AS (SELECT o_orderkey AS k, o_custkey AS c FROM orders)
SELECT k AS o_orderkey, CASE k % 4 WHEN 0 THEN 'NGFW' WHEN 1 THEN 'DATACENTER_SWITCH' WHEN 2 THEN 'FIRE ALARMS' END AS device_type, CAST(CASE WHEN k % 3 = 0 THEN k % 100 WHEN k % 3 = 1 THEN c % 100 ELSE 7 END AS DOUBLE) AS policies, c / 1024.0::DOUBLE AS storage_tb,
 CAST(k % 9 + 1 AS DOUBLE) * 1000 AS switching, CAST(greatest(k % 8, c % 8) AS BIGINT) AS ports, CAST(CASE WHEN c % 2 = 0 THEN 10 END AS DOUBLE) AS power_kw, CASE WHEN k % 2 = 0 THEN 'active-passive,clustering' ELSE '' END AS modes FROM o""")
def metadata_normalize(t):
    """Top before detected before nested, units, aliases, ranges, categories, interface fields, modes."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    kind = F.when(k % 4 == 0, "Next Generation Firewall").when(k % 4 == 1, "data-center switch").when(k % 4 == 2, "fire alarms").otherwise("unknown")
    detected = F.struct(F.when(k % 3 != 2, c % 100).alias("policies"), (k % 9 + 1).alias("switching_capacity_tbps"), (c % 8).alias("interfaces_10g"), F.when(c % 2 == 0, F.struct(F.lit(10).alias("min"), F.lit(20).alias("max"))).alias("power_capacity_kw"))
    meta = F.to_json(F.struct(kind.alias("device_category"), F.when(k % 3 == 0, (k % 100).cast("string")).alias("policies"), c.alias("storage_gb"), F.struct((k % 8).cast("string").alias("10g_sfp_plus")).alias("interfaces"), F.when(k % 2 == 0, F.array(F.lit("Active/Passive"), F.lit("Cluster"))).alias("ha_modes"), detected.alias("detected_specs"), F.struct(F.lit(7).alias("policies")).alias("requirements")))
    got = cs.normalized(spread(t.orders.select("o_orderkey", "o_custkey")).select("o_orderkey", cs.metadata(F.parse_json(meta)).alias("meta")), "meta", F.lit(""))
    n = lambda f: F.try_element_at(F.col("numbers"), F.lit(f))
    return got.select("o_orderkey", "device_type", n("policies").alias("policies"), n("storage_tb").alias("storage_tb"), n("switching_capacity_gbps").alias("switching"), F.col("interfaces")["10g_sfp_plus"].alias("ports"), n("power_capacity_kw").alias("power_kw"), F.array_join("ha_modes", ",").alias("modes"))


REMOTE = "Total Remote Sites Firewalls = 196x Remote Site Equipment Hardware Capacity: a) IPSec VPN throughput with all features 200 Mbps b) Interfaces Copper 1Gig = 5"
#: text, and anchor, heading, capacity row, bullet, service, guide, product intent, unsupported.
TEXTS = [
    ("Perimeter Firewalls", True, True, False, False, False, True, False, None),
    ("Data Center Switches with 24 ports", True, False, False, False, False, False, True, None),
    (REMOTE, False, False, True, False, False, True, True, None),
    ("quoted firewall must be in Gartner leaders", False, False, False, False, False, True, False, None),
    ("a) support and warranty with RMA", False, False, False, True, True, False, False, None),
    ("IP Camera with NVR", False, False, False, False, False, False, False, "CCTV"),
    ("Bidder training on firewall appliance", True, True, False, False, True, False, False, None),
    ("Fire suppression, clean agent FK-5-1-12", False, False, False, False, False, False, False, "FIRE_SYSTEM"),
    ("", False, False, False, False, False, False, False, None),
    ("FortiAnalyzer for log reporting", True, False, False, False, False, False, True, None),
    ("virtual routers of the firewall", False, False, False, False, False, True, False, None),
    ("split A/C unit of 2 ton", False, False, False, False, False, False, False, "SPLIT_AC"),
]


@BOOK.query(expected("k, anchor, heading, capacity, bullet, service, guide, intent, unsupported", [(k, *r[1:]) for k, r in enumerate(TEXTS)]))
def row_gates(t):
    c = F.col("text")
    rows = cs.parse_constraints(each(t, "text", [r[0] for r in TEXTS]), "text")
    flags = {"anchor": gates.anchor_text(c), "heading": gates.section_only(c), "capacity": gates.capacity_row(c), "bullet": gates.bullet_fragment(c), "service": gates.service_only(c), "guide": gates.guide_reference(c), "intent": gates.product_intent(c)}
    return rows.select("n_nationkey", F.col("k").cast("int").alias("k"), *(v.alias(n) for n, v in flags.items()), gates.unsupported(c).alias("unsupported"))


TITLES = [("Bidder Qualification", True, False), ("General Content", False, True), ("Support and warranty", False, True), ("Network Hardware", False, False), ("Bid Evaluation notes", True, True), ("", False, False)]


@BOOK.query(expected("k, skipped, narrative", [(k, *r[1:]) for k, r in enumerate(TITLES)]))
def sheet_gates(t):
    rows = each(t, "title", [r[0] for r in TITLES])
    return rows.select("n_nationkey", F.col("k").cast("int").alias("k"), gates.skipped_sheet(F.col("title")).alias("skipped"), gates.admin_sheet(F.col("title")).alias("narrative"))


HEAD = ["SN", "Requirement", "Spec"]
#: sheet: title, rows (text, kind), and start, anchor and end of each row's block.
BLOCKS = [
    ("Network", ["about it", "Perimeter Firewalls", "IPS throughput 20Gbps", "", "Core Switches", "Access switches", "10G ports 24", REMOTE.replace("Total Remote Sites Firewalls", "Remote site firewall"), "other words"], [(None,) * 3, *[(1, 2, 3)] * 3, *[(4, 5, 6)] * 3, (7, 7, 7), (7, 7, 7)]),
    ("Logging solution", ["Reporting", "10,000 EPS of logs", "more"], [(0, 1, 2)] * 3),
    ("Plain", ["nothing", "of interest"], [(None,) * 3] * 2),
]


def block_rows(t):
    docs = each(t, "json", [json.dumps({"sheets": [{"title": title, "headers": HEAD, "rows": [["1", x, ""] for x in texts]} for title, texts, _ in BLOCKS]})]).select(F.col("n_nationkey").alias("doc_id"), "json")
    rows = ss.flatten_rows(docs)
    return rows.withColumn("text", bl.row_text(F.col("headers"), F.col("cells")))


@BOOK.query(expected("sheet_no, row_no, start_row, anchor_row, end_row", [(n, k, *b) for n, (_, _, bs) in enumerate(BLOCKS) for k, b in enumerate(bs)]).replace("SELECT n_nationkey, c.*", "SELECT n_nationkey, sheet_no, row_no, CAST(start_row AS INT) AS start_row, CAST(anchor_row AS INT) AS anchor_row, CAST(end_row AS INT) AS end_row"))
def product_blocks(t):
    got = bl.with_blocks(block_rows(t).select("doc_id", "sheet_no", "title", "row_no", "text"))
    return got.select(F.col("doc_id").alias("n_nationkey"), "sheet_no", F.col("row_no").cast("int").alias("row_no"), *(F.col(c).cast("int").alias(c) for c in ("start_row", "anchor_row", "end_row")))


#: Sheets of the injection: title, headers, rows, references by row.
SHEETS = [
    ("Technical Requirements", ["Section", "SN", "Requirement", "Spec"], [["Perimeter Firewalls", "", "", ""], ["", "1.", "Next Generation Firewall Throughput", "20Gbps"], ["", "2.", "IPS Throughput", "20Gbps"], ["", "3.", "10 GE SFP+ interfaces", "8"], ["Data Center Switches", "", "", ""], ["", "1.", "Switching Capacity", "1Tbps"]], {1: reference("FortiGate 900A", "900a"), 5: reference("FortiSwitch 1000A", "switch")}),
    ("Compliance", ["S#", "Description"], [["1", REMOTE], ["2", "Provided equipment must balance the load of links."], ["3", REMOTE.replace("200 Mbps", "1 Gbps") + " c) Must support HA configuration with Active/Passive d) Redundant power supply."]], {0: reference("FortiGate 40A", "40a") + " | " + reference("SRX300", vendor="Juniper"), 2: reference("FortiGate 60A", "60a")}),
    ("Logging Hardware", HEAD, [["1.", "Hardware logging appliance for firewall logs and log backup", "Yes"]], {0: "Fortinet: FortiLogger - https://logger.example/"}),
    ("General Content", ["Description"], [["Scope of Work: the bidder shall provide services"]], {}),
    ("Eligibility", ["Description"], [[REMOTE]], {}),
]


def sheet_docs(t, tables) -> object:
    body = json.dumps({"sheets": [{"title": a, "headers": h, "rows": r} for a, h, r, _ in tables]})
    return ss.flatten_rows(each(t, "json", [body]).select(F.col("n_nationkey").alias("doc_id"), "json"))


def by_row(tables) -> list[tuple]:
    return [(n, k, refs.get(k, "")) for n, (_, _, rows, refs) in enumerate(tables) for k in range(len(rows))]


def referenced(df):
    return df.select(F.col("doc_id").alias("n_nationkey"), "sheet_no", F.col("row_no").cast("int").alias("row_no"), "reference")


@BOOK.query(expected("sheet_no, row_no, reference", by_row(SHEETS)))
def inject_references(t):
    return referenced(inject.inject_references(sheet_docs(t, SHEETS), products(t, GOODS)))


@BOOK.query("SELECT count(*) * 13 AS rows_seen, 0 * count(*) AS sections_skipped, count(*) * 5 AS groups_seen, count(*) * 5 AS matched_rows, 0 * count(*) AS unmatched_rows FROM nation".replace("* 13", f"* {sum(len(s[2]) for s in SHEETS[:4])}"))
def injection_stats(t):
    return inject.stats(inject.inject_references(sheet_docs(t, SHEETS), products(t, GOODS)))


PLAIN = [
    ("Firewall appliance", ["SN", "Requirement"], [["1", "Firewall IPSec VPN throughput 1 Gbps"], ["2.", "Firewall with 5 x 1GE RJ45 copper ports"], ["3", "diesel generator of the firewall"]], {0: reference("FortiGate 60A", "60a", dash=" — ") + " | " + reference("SRX300", vendor="Juniper"), 1: reference("FortiGate 60A", "60a", dash=" — ") + " | " + reference("SRX300", vendor="Juniper")}),
    ("Others", ["SN", "Requirement"], [["x", "We run the FortiGate-40A firewall"], ["y", "words"]], {0: "[Review Required] No compliant catalog match found for NGFW."}),
]


@BOOK.query(expected("sheet_no, row_no, reference", by_row(PLAIN)))
def hardware_references(t):
    return referenced(plain.inject_hardware_references(sheet_docs(t, PLAIN), products(t, GOODS)))


MENTIONS = [("the FortiGate-40A and FORTIGATE  900A", f"{reference('FortiGate 40A', '40a', dash=' — ')};{reference('FortiGate 900A', '900a', dash=' — ')}"), ("xFortiGate 60A, FortiGate 200Ab", None), ("an SRX300.", reference("SRX300", vendor="Juniper")), ("", None)]


@BOOK.query(expected("k, named", [(k, n) for k, (_, n) in enumerate(MENTIONS)]))
def model_mention_join(t):
    """Models that a text names, with blanks and hyphens between their parts."""
    rows = each(t, "text", [m[0] for m in MENTIONS])
    got = plain.mentions(rows, products(t, GOODS), "text", ["n_nationkey", "k"])
    return rows.select("n_nationkey", "k").join(got, ["n_nationkey", "k"], "left").select("n_nationkey", F.col("k").cast("int").alias("k"), F.array_join("direct", ";").alias("named"))


ASKED = [
    ("Firewall, IPSec VPN throughput 10 Gbps", reference("FortiGate 200A", "200a", dash=" — ")), ("Firewall, IPSec VPN throughput 99 Gbps", ""), ("Firewall of quality", ""), ("diesel generator", ""),
    ("Data center switch, switching capacity 1 Tbps", reference("FortiSwitch 1000A", "switch", dash=" — ")),
]


@BOOK.query(expected("k, reference", [(k, r) for k, (_, r) in enumerate(ASKED)]))
def match_text(t):
    rows = each(t, "text", [a[0] for a in ASKED]).withColumn("id", F.col("n_nationkey") * 100 + F.col("k"))
    got = fit.match_text(rows, "id", "text", fit.with_specs(products(t, GOODS)))
    return got.select(F.floor(F.col("id") / 100).cast("int").alias("n_nationkey"), (F.col("id") % 100).cast("int").alias("k"), "reference")


@BOOK.query("""WITH g AS (SELECT p_partkey AS ord, p_name AS model, p_type AS category, CAST(p_size AS DOUBLE) AS n, CAST(p_partkey % 12 AS DOUBLE) AS i, p_partkey % 5 AS s FROM part),
r AS (SELECT n_nationkey AS k, CAST(n_nationkey * 2 + 1 AS DOUBLE) AS n, CAST(n_nationkey % 5 + 1 AS DOUBLE) AS i, n_nationkey % 3 + 1 AS s, c.category FROM nation, (SELECT DISTINCT p_type AS category FROM part) c),
x AS (SELECT r.k, r.category, g.ord, g.model, ln(greatest(1, g.n / r.n)) a, ln(greatest(1, g.i / r.i)) b, ln(greatest(1, g.s / r.s)) c FROM r JOIN g USING (category) WHERE g.n >= r.n AND g.i >= r.i AND g.s >= 0.93 * r.s),
y AS (SELECT *, (1.55 * a + 1.35 * b + 0.9 * c) / 3.8 p, greatest(1.55 * a, 1.35 * b, 0.9 * c) w, (a + b + c) / 3 m FROM x),
z AS (SELECT *, row_number() OVER (PARTITION BY k, category ORDER BY round(p, 9), round(w, 9), round(m, 9), ord) rn, count(*) OVER (PARTITION BY k, category) valid FROM y)
SELECT r.k AS n_nationkey, r.category, CAST(coalesce(valid, 0) AS BIGINT) AS valid, round(p, 6) AS penalty FROM r LEFT JOIN (SELECT * FROM z WHERE rn = 1) z ON r.k = z.k AND r.category = z.category""")
def closest_products(t):
    """Numbers, interfaces and storage of each nation's wish against all parts of each category."""
    spec = F.struct(F.col("p_size").alias("ngfw_throughput_gbps"), (F.col("p_partkey") % 5).alias("storage_tb"), F.struct((F.col("p_partkey") % 12).alias("10g_sfp_plus")).alias("interfaces"))
    goods = t.part.select(F.col("p_partkey").alias("ord"), F.lit("Any").alias("vendor"), F.col("p_name").alias("model"), F.col("p_type").alias("category"), F.parse_json(F.to_json(spec)).alias("product"))
    kinds = F.array(*map(F.lit, sorted(r[0] for r in t.part.select("p_type").distinct().limit(1000).collect())))
    n = F.col("n_nationkey")
    wish = t.nation.select("n_nationkey", F.explode(kinds).alias("device_type"), F.create_map(F.lit("ngfw_throughput_gbps"), (n * 2 + 1).cast("double"), F.lit("storage_tb"), (n % 3 + 1).cast("double")).alias("numbers"), F.create_map(F.lit("10g_sfp_plus"), (n % 5 + 1).cast("bigint")).alias("interfaces"), cs.words([]).alias("flags"), cs.words([]).alias("ha_modes"))
    goods = spread(goods)
    got = fit.matched(wish.withColumn("category_asked", F.col("device_type")), fit.with_specs(goods), ["n_nationkey", "category_asked"], cs.words(["any"]))
    return got.select("n_nationkey", F.col("category_asked").alias("category"), F.col("valid").cast("bigint").alias("valid"), F.round("weighted_overprovision_penalty", 6).alias("penalty"))


VERTIV = "https://www.vertiv.com/products/"
RACKS = [
    {"product_name": "Vertiv Liebert EXM UPS", "category": "Uninterruptible", "datasheet_url": VERTIV + "exm-brochure.pdf", "power_capacity_kva": 80},
    {"model": "Liebert EXM UPS", "category": "UPS", "datasheet_url": VERTIV + "exm-datasheet.pdf", "note": "dual power, n+1"},
    {"model": "Liebert CRV4", "category": "thermal management", "subheading": "In-Row cooling", "cooling_capacity_kw": "40 kW"},
    {"model": "Geist rPDU", "category": "Rack PDU", "outlet_count": 24, "datasheet_url": VERTIV + "geist.pdf"},
]
POWER = [
    ("Power", ["SN", "Requirement"], [["1", "Online UPS of 60 kVA with redundancy"], ["2", "Precision in-row cooling unit 30 kW"], ["3", "IP camera with NVR"], ["4", "Installation of the UPS"]], {0: f"Vertiv: Vertiv Liebert EXM UPS - {VERTIV}exm-datasheet.pdf", 1: "Vertiv: Liebert CRV4"}),
    ("Racks", ["SN", "Requirement"], [{"row_type": "data", "data": ["1", "Rack PDU with 20 outlets"], "metadata": {"is_product_spec_continuation": True}}], {0: f"Vertiv: Geist rPDU - {VERTIV}geist.pdf"}),
]


@BOOK.query(expected("sheet_no, row_no, reference", by_row(POWER)))
def power_references(t):
    scan = t.nation.agg(F.lit("a.json").alias("file"), F.lit(json.dumps({"items": RACKS})).alias("raw"))
    return referenced(power.inject_power_references(sheet_docs(t, POWER), power.load_catalog(ct.products(scan).withColumnRenamed("pos", "ord"))))


WISHES = [
    ("Online UPS 60 kVA with N+1", "UPS", 60.0, True, None), ("In-row cooling 30 kW 42U", "COOLING", None, False, None), ("Lithium-ion battery rack of 40 kW", "ENERGY_STORAGE", None, False, None),
    ("hot aisle containment", "INTEGRATED_RACK_SOLUTION", None, False, None), ("rack PDU of 10 kVA", "POWER_DISTRIBUTION", 10.0, False, None), ("video wall display", None, None, False, "VIDEO_WALL"), ("monitoring server", "MONITORING", None, False, None),
]


@BOOK.query(expected("k, category, kva, redundancy, unsupported", [(k, *w[1:]) for k, w in enumerate(WISHES)]).replace("c.*", "k, category, CAST(kva AS DOUBLE) AS kva, redundancy, unsupported"))
def power_requirements(t):
    got = power.parse(each(t, "text", [w[0] for w in WISHES]), "text")
    return got.select("n_nationkey", F.col("k").cast("int").alias("k"), "category", F.try_element_at("fields", F.lit("power_capacity_kva")).alias("kva"), "redundancy", "unsupported")


URLS = [("https://a.example/products/x-datasheet.pdf", "x", 7), ("https://a.example/obsolete/x.pdf", None, -3), ("http://partners.vertiv.com/english/directory/x.pdf", None, 1), ("ftp://x.pdf", None, 1), ("https://a.example/shared/x-br-1.pdf", "x", 6)]


@BOOK.query(expected("k, public, quality", [(k, u if p else None, q) for k, (u, p, q) in enumerate(URLS)]))
def url_quality(t):
    rows = each(t, "u", [u[0] for u in URLS])
    return rows.select("n_nationkey", F.col("k").cast("int").alias("k"), power.datasheet(F.col("u")).alias("public"), power.url_quality(F.col("u"), F.lit("Vertiv pdf")).cast("int").alias("quality"))


TAGS = [
    (json.dumps({"reference_needed": True, "fortinet_feature_candidates": ["ssl vpn", " ", "ha"]}), "x", "tag", "ssl vpn;ha", ""), ('see {"reference_needed": 1, "lookup_query": "bgp"} here', "x", "tag", "bgp", ""),
    ('{"reference_needed": false}', "the firewall  needs an ipsec vpn", "text", "the firewall needs an ipsec vpn", "VPN;Firewall Policy;Security Profiles"), ("None", "price of a firewall", None, "", ""), ("", "short", None, "", ""),
]


@BOOK.query(expected("k, origin, lookups, domains", [(k, *r[2:]) for k, r in enumerate(TAGS)]))
def guide_tags(t):
    rows = each(t, "tag", [r[0] for r in TAGS]).withColumn("text", F.get(F.array(*(F.lit(r[1]) for r in TAGS)), F.col("k")))
    got = guide.with_tags(rows, "text", "tag")
    return got.select("n_nationkey", F.col("k").cast("int").alias("k"), "origin", F.array_join("lookups", ";").alias("lookups"), F.array_join("tag_domains", ";").alias("domains"))


PATHS = [("VPN > SSL VPN portals", "VPN"), ("System > HA cluster", "High Availability"), ("Policy and routing", "Firewall Policy,Routing"), ("SD-WAN rules for users", "SD-WAN"), ("Dashboards", "General"), ("Log in by LDAP", "Authentication,Logging"), ("shape of things", "General")]


@BOOK.query(expected("k, domains", [(k, d) for k, (_, d) in enumerate(PATHS)]))
def domain_tags(t):
    return each(t, "path", [p[0] for p in PATHS]).select("n_nationkey", F.col("k").cast("int").alias("k"), F.array_join(guide.domains(F.col("path")), ",").alias("domains"))


BOOSTS = [("VPN", "VPN", 1.0), ("VPN", "Routing", 0.2), ("", "VPN", 0.0), ("Network Security", "Routing;VPN", 0.5), ("remote access", "SSL VPN", 1.0)]


@BOOK.query(expected("k, boost", [(k, b) for k, (_, _, b) in enumerate(BOOSTS)]).replace("c.*", "k, CAST(boost AS DOUBLE) AS boost"))
def domain_boosts(t):
    parts = lambda i: F.filter(F.split(F.get(F.array(*(F.lit(b[i]) for b in BOOSTS)), F.col("k")), ";"), lambda x: x != "")
    rows = each(t, "x", [b[0] for b in BOOSTS])
    return rows.select("n_nationkey", F.col("k").cast("int").alias("k"), guide.domain_boost(parts(0), parts(1)).cast("double").alias("boost"))


TOC = [(0, 1, "VPN", 10), (1, 2, "SSL VPN portals", 12), (2, 2, "IPsec tunnels", 20), (3, 1, "High Availability", 40)]


def guide_index(t):
    rows = t.nation.select(F.col("n_nationkey").alias("doc"), F.explode(F.array(*(F.struct(F.lit(i).alias("idx"), F.lit(lv).alias("level"), F.lit(x).alias("title"), F.lit(p).alias("page")) for i, lv, x, p in TOC))).alias("e"))
    return guide.flat_index(rows.select("doc", "e.*", F.lit(None).cast("int").alias("dest_page"), F.lit(50).alias("n_pages"), F.lit("file:///g.pdf").alias("uri")), deepest=3).withColumn("url", F.lit(""))


INDEXED = [(0, 10, 39, "VPN", "#page=10", "VPN"), (1, 12, 19, "VPN > SSL VPN portals", "#page=12", "VPN"), (2, 20, 39, "VPN > IPsec tunnels", "#page=20", "VPN"), (3, 40, 40, "High Availability", "#page=40", "High Availability")]


@BOOK.query(expected("idx, page, page_end, section_path, anchor, domains", INDEXED))
def outline_index(t):
    return guide_index(t).select(F.col("doc").alias("n_nationkey"), "idx", F.col("page").cast("int").alias("page"), F.col("page_end").cast("int").alias("page_end"), "section_path", "anchor", F.array_join("domains", ",").alias("domains"))


CITED = [("The firewall must offer high availability", "High Availability (Page 40)"), ("SSL VPN portals for the firewall", "VPN (Page 10)"), ("price list", "")]


@BOOK.query(expected("k, cited", [(k, c) for k, (_, c) in enumerate(CITED)]))
def guide_citations(t):
    rows = each(t, "text", [c[0] for c in CITED]).withColumn("doc", F.col("n_nationkey"))
    got = guide.enrich(rows, guide_index(t), ["n_nationkey", "k"], "text")
    return got.select("n_nationkey", F.col("k").cast("int").alias("k"), F.regexp_extract("reference", r"Guide - ([^\n]*)", 1).alias("cited"))


LINKS = [(0, 3, None, 1, 4, None, "#page=4"), (0, -1, "http://x", 1, None, "http://x", ""), (2, None, None, None, None, None, None), (5, 0, "http://y", 6, 1, None, "#page=1")]


@BOOK.query(expected("source_page, target_page, uri, anchor", [r[3:] for r in LINKS if r[3]]))
def internal_links(t):
    rows = t.nation.select(F.col("n_nationkey").alias("doc"), F.posexplode(F.array(*(F.struct(F.lit(s).alias("source_page"), F.lit(g).cast("int").alias("target_page"), F.lit(u).cast("string").alias("uri")) for s, g, u, *_ in LINKS))).alias("no", "l"))
    got = guide.internal_links(rows.select("doc", "no", "l.*"))
    return got.select(F.col("doc").alias("n_nationkey"), "source_page", "target_page", "uri", "anchor")


REPLIES = [('{"n": 1} then {"n": 2}', 1), ("Sure:\n```json\n[{\"n\": 3}]\n```", None), ('﻿ [{"n": 4}, 5] trailing', None), ('{"n": ', None), ("", None), ('so {"n": 6}', 6)]


@BOOK.query(expected("k, parsed, n", [(0, True, 1), (1, True, None), (2, True, None), (3, False, None), (4, False, None), (5, True, 6)]).replace("c.*", "k, parsed, CAST(n AS BIGINT) AS n"))
def reply_first_value(t):
    rows = each(t, "reply", [r[0] for r in REPLIES]).withColumn("v", F.try_parse_json(ss.first_value(F.col("reply"))))
    return rows.select("n_nationkey", F.col("k").cast("int").alias("k"), F.col("v").isNotNull().alias("parsed"), F.try_variant_get("v", "$.n", "bigint").alias("n"))


SHEETS_LINKS = [("FortiGate 2601F", "https://x/infographic.pdf", "https://www.fortinet.com/content/dam/fortinet/assets/data-sheets/fortigate-2600f-series.pdf"), ("FortiGate 90G", "https://x/infographic.pdf", "https://x/infographic.pdf"), ("FortiGate 700G", "https://x/y.pdf", "https://x/y.pdf"), ("FortiGate 201g", "https://x/Infographic-a", "https://www.fortinet.com/content/dam/fortinet/assets/data-sheets/fortigate-200g-series.pdf")]


@BOOK.query(expected("k, url", [(k, u) for k, (_, _, u) in enumerate(SHEETS_LINKS)]))
def datasheet_links(t):
    rows = each(t, "model", [x[0] for x in SHEETS_LINKS]).withColumn("u", F.get(F.array(*(F.lit(x[1]) for x in SHEETS_LINKS)), F.col("k")))
    return rows.select("n_nationkey", F.col("k").cast("int").alias("k"), vo.datasheet_link(F.lit("Fortinet"), F.col("model"), F.col("u")).alias("url"))


@BOOK.query(f"""WITH s AS ({expected("sheet_no, row_no, description, fortinet, juniper", [(0, 1, "Next Generation Firewall Throughput", "FortiGate 900A - " + DS + "900a.pdf", ""), (0, 5, "Switching Capacity", "FortiSwitch 1000A - " + DS + "switch.pdf", ""), (1, 0, REMOTE, "FortiGate 40A - " + DS + "40a.pdf", "SRX300"), (1, 2, SHEETS[1][2][2][1], "FortiGate 60A - " + DS + "60a.pdf", ""), (2, 0, SHEETS[2][2][0][1], "FortiLogger - https://logger.example/", "")])}) SELECT * FROM s""")
def reference_summary(t):
    """All rows with a reference, a column a vendor."""
    out = vo.summary(inject.inject_references(sheet_docs(t, SHEETS), products(t, GOODS)))
    return out.select(F.col("doc_id").alias("n_nationkey"), "sheet_no", F.col("row_no").cast("int").alias("row_no"), "description", "fortinet", "juniper")


HEADS = [("S#|Description of work", 1), ("A|B|Technical details", 2), ("A|B", 1), ("only", 0), ("Text|x", 0)]


@BOOK.query(expected("k, place", [(k, p) for k, (_, p) in enumerate(HEADS)]))
def description_column(t):
    rows = each(t, "h", [h[0] for h in HEADS])
    return rows.select("n_nationkey", F.col("k").cast("int").alias("k"), vo.description_column(F.split("h", r"\|")).alias("place"))


FILES = {"fortinet.json": [{"vendor": "Fortinet", "model": "B", "category": "NGFW", "n": 2}, {"vendor": "Other", "model": "C"}], "fortinet_scraped.json": [{"vendor": "fortinet", "model": "b", "category": "ngfw", "n": 1}, {"vendor": "Fortinet"}], "juniper.json": [{"model": "J"}, {"vendor": "Juniper", "model": "K", "category": "ROUTER"}], "x.json": [{"vendor": "Fortinet", "model": "X"}]}


@BOOK.query(expected("vendor, model", [("fortinet", "b"), ("Juniper", "K"), ("Fortinet", "FortiLogger"), ("Fortinet", "FortiSwitch 1048E")]).replace("SELECT n_nationkey, c.*", "SELECT DISTINCT c.*"))
def network_catalog(t):
    files = t.nation.groupBy().agg(F.lit(1).alias("x")).select(F.explode(F.array(*(F.struct(F.lit(f).alias("file"), F.lit(json.dumps({"products": g})).alias("raw")) for f, g in FILES.items()))).alias("f")).select("f.*")
    return ct.network_catalog(ct.products(files)).select("vendor", "model")
