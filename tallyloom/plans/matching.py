"""Queries of the catalog side: match, filter, rank, dedup, hydrate."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from ..operators import match as mt
from ..operators import shape as sh
from .book import Book

BOOK = Book()
FIELDS = [mt.Field("ngfw", 1.55), mt.Field("ports", 1.20), mt.Field("storage", 0.90, tolerance=0.93)]
TIE = ["product_id"]


def catalog(t):
    """part as a product catalog."""
    return t.part.select(F.col("p_partkey").alias("product_id"), F.col("p_brand").alias("vendor"), F.col("p_name").alias("model"), F.col("p_type").alias("category"), F.col("p_size").cast("double").alias("has_ngfw"), (F.col("p_partkey") % 48 + 1).cast("double").alias("has_ports"), (F.floor(F.col("p_retailprice") / 10) / 16).alias("has_storage"))


CATALOG = "cat AS (SELECT p_partkey product_id, p_brand vendor, p_name model, p_type category, CAST(p_size AS DOUBLE) has_ngfw, CAST(p_partkey % 48 + 1 AS DOUBLE) has_ports, floor(p_retailprice / 10) / 16 has_storage FROM part)"


def requirements(t):
    """Each line item asks for a product of its part's category."""
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").alias("need_ngfw"), (F.col("l_linenumber") * 5).cast("double").alias("need_ports"), (F.col("l_linenumber") % 4).cast("double").alias("need_storage"))
    return rows.join(t.part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("category")), "l_partkey")


REQS = "req AS (SELECT l_orderkey, l_linenumber, p_type category, l_quantity need_ngfw, CAST(l_linenumber * 5 AS DOUBLE) need_ports, CAST(l_linenumber % 4 AS DOUBLE) need_storage FROM lineitem JOIN part ON l_partkey = p_partkey)"
PROFILES = "prof AS (SELECT DISTINCT category, need_ngfw, need_ports, need_storage FROM req)"
PASS = "has_ngfw >= need_ngfw AND has_ports >= need_ports AND (need_storage = 0 OR has_storage >= 0.93 * need_storage)"
SCORED = f"""
sc AS (SELECT *, ln(greatest(1, has_ngfw / need_ngfw)) o1, ln(greatest(1, has_ports / need_ports)) o2,
  CASE WHEN need_storage > 0 THEN ln(greatest(1, has_storage / need_storage)) ELSE 0 END o3, CASE WHEN need_storage > 0 THEN 1 ELSE 0 END s
  FROM prof JOIN cat USING (category) WHERE {PASS}),
rk AS (SELECT *, round((1.55 * o1 + 1.2 * o2 + 0.9 * o3) / (1.55 + 1.2 + 0.9 * s), 9) weighted_penalty, round(greatest(1.55 * o1, 1.2 * o2, 0.9 * o3, 0), 9) worst,
  round((o1 + o2 + o3) / (2 + s), 9) penalty FROM sc),
rn AS (SELECT *, row_number() OVER (PARTITION BY category, need_ngfw, need_ports, need_storage ORDER BY weighted_penalty, worst, penalty, product_id) AS "rank" FROM rk)"""


@BOOK.query(f"""WITH {CATALOG}, {REQS}, {PROFILES}, {SCORED}
SELECT l_orderkey, l_linenumber, category, model, vendor, round(weighted_penalty, 6) AS weighted_penalty
FROM req JOIN (SELECT * FROM rn WHERE "rank" = 1) USING (category, need_ngfw, need_ports, need_storage)""")
def match_catalog_top1(t):
    reqs = requirements(t)
    best = mt.closest_fit(reqs, catalog(t), ["category"], FIELDS, TIE)
    keys = ["category", "need_ngfw", "need_ports", "need_storage"]
    return reqs.join(best.select(*keys, "model", "vendor", "weighted_penalty"), keys).select("l_orderkey", "l_linenumber", "category", "model", "vendor", F.round("weighted_penalty", 6).alias("weighted_penalty"))


@BOOK.query(f"""WITH {CATALOG}, {REQS}, {PROFILES}, {SCORED}
SELECT category, need_ngfw, need_ports, need_storage, "rank", product_id, model FROM rn WHERE "rank" <= 5""")
def match_top5_candidates(t):
    return mt.closest_fit(requirements(t), catalog(t), ["category"], FIELDS, TIE, top=5).select("category", "need_ngfw", "need_ports", "need_storage", F.col("rank").cast("bigint").alias("rank"), "product_id", "model")


@BOOK.query(f"""WITH {CATALOG}, {REQS}, {PROFILES}
SELECT category, need_ngfw, need_ports, need_storage, count(*) AS n_products, CAST(count(*) FILTER (WHERE {PASS}) AS BIGINT) AS n_pass,
 CAST(count(*) FILTER (WHERE has_ngfw < need_ngfw) AS BIGINT) AS n_slow, CAST(count(*) FILTER (WHERE has_ports < need_ports) AS BIGINT) AS n_narrow
FROM prof JOIN cat USING (category) GROUP BY ALL""")
def hard_filter_matrix(t):
    keys = ["category", "need_ngfw", "need_ports", "need_storage"]
    pairs = requirements(t).select(*keys).distinct().join(catalog(t), "category")
    return pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_products"), F.count_if(mt.all_pass(FIELDS)).alias("n_pass"), F.count_if(~FIELDS[0].passes()).alias("n_slow"), F.count_if(~FIELDS[1].passes()).alias("n_narrow"))


@BOOK.query(f"""WITH {CATALOG}, {REQS}, {PROFILES},
bad AS (SELECT *, row_number() OVER (PARTITION BY category, need_ngfw, need_ports, need_storage ORDER BY product_id) rn FROM prof JOIN cat USING (category) WHERE NOT ({PASS}))
SELECT category, need_ngfw, need_ports, need_storage, string_agg(CAST(product_id AS VARCHAR), ',' ORDER BY product_id) AS rejected FROM bad WHERE rn <= 8 GROUP BY ALL""")
def rejected_sample(t):
    keys = ["category", "need_ngfw", "need_ports", "need_storage"]
    bad = requirements(t).select(*keys).distinct().join(catalog(t), "category").where(~mt.all_pass(FIELDS))
    few = sh.top_k(bad, keys, ["product_id"], 8)
    return few.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list("product_id")), lambda x: x.cast("string")), ",").alias("rejected"))


@BOOK.query(f"""WITH {CATALOG} SELECT product_id, CAST(n AS BIGINT) AS need, has_storage >= n OR has_storage >= 0.93 * n AS passes FROM cat, range(1, 9) r(n)""")
def storage_tolerance_pass(t):
    rows = catalog(t).select("product_id", "has_storage", F.explode(F.sequence(F.lit(1), F.lit(8))).alias("need")).withColumn("need_storage", F.col("need").cast("double"))
    return rows.select("product_id", F.col("need").cast("bigint").alias("need"), FIELDS[2].passes().alias("passes"))


@BOOK.query("""SELECT c_custkey, unnest(CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN ['Brand#1', 'Brand#2'] ELSE ['Brand#1'] END) AS vendor FROM customer""")
def vendor_fanout(t):
    return t.customer.select("c_custkey", F.explode(F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), F.array(F.lit("Brand#1"), F.lit("Brand#2"))).otherwise(F.array(F.lit("Brand#1")))).alias("vendor"))


@BOOK.query("SELECT p_brand AS vendor, p_type AS category, CAST(max(p_size) AS BIGINT) AS max_ngfw FROM part GROUP BY ALL")
def vendor_max_spec(t):
    return t.part.groupBy(F.col("p_brand").alias("vendor"), F.col("p_type").alias("category")).agg(F.max("p_size").cast("bigint").alias("max_ngfw"))


@BOOK.query(f"""WITH {REQS}, top AS (SELECT p_type category, CAST(max(p_size) AS DOUBLE) - 10 AS cap FROM part GROUP BY 1)
SELECT l_orderkey, l_linenumber, least(need_ngfw, cap) AS users, need_ngfw > cap AS capped FROM req JOIN top USING (category)""")
def solution_scale_cap(t):
    top = t.part.groupBy(F.col("p_type").alias("category")).agg((F.max("p_size").cast("double") - 10).alias("cap"))
    return requirements(t).join(top, "category").select("l_orderkey", "l_linenumber", F.least("need_ngfw", "cap").alias("users"), (F.col("need_ngfw") > F.col("cap")).alias("capped"))


#: Which interfaces serve a required one.
COMPATIBLE = [("1g_rj45", "1g_rj45"), ("1g_rj45", "1_10g_rj45"), ("10g_rj45", "10g_rj45"), ("10g_rj45", "1_10g_rj45"), ("1_10g_rj45", "1_10g_rj45"), ("1_10g_rj45", "10g_rj45"), ("10g_sfp_plus", "10g_sfp_plus"), ("10g_sfp_plus", "25g_sfp28"), ("25g_sfp28", "25g_sfp28"), ("25g_sfp28", "50g_sfp56"), ("40g_qsfp_plus", "40g_qsfp_plus"), ("40g_qsfp_plus", "100g_qsfp28"), ("100g_qsfp28", "100g_qsfp28"), ("100g_qsfp28", "200g_qsfp56"), ("100g_qsfp28", "400g_qsfp_dd"), ("200g_qsfp56", "200g_qsfp56"), ("200g_qsfp56", "400g_qsfp_dd")]
PORTS = [("1g_rj45", 8), ("10g_sfp_plus", 5), ("25g_sfp28", 3), ("100g_qsfp28", 2)]


def ports_of(t):
    """product_id, iface, n in long form."""
    kinds = F.array(*(F.struct(F.lit(k).alias("iface"), (F.col("p_partkey") % m).alias("n")) for k, m in PORTS))
    return t.part.select(F.col("p_partkey").alias("product_id"), F.explode(kinds).alias("x")).select("product_id", "x.iface", "x.n")


@BOOK.query(f"""WITH compat(required, iface) AS (VALUES {', '.join(f"('{a}','{b}')" for a, b in COMPATIBLE)}),
ports AS ({' UNION ALL '.join(f"SELECT p_partkey product_id, '{k}' iface, p_partkey % {m} n FROM part" for k, m in PORTS)})
SELECT product_id, required, CAST(CASE WHEN sum(n) = 0 THEN max(product_id) % 4 ELSE sum(n) END AS BIGINT) AS available FROM ports JOIN compat USING (iface) GROUP BY product_id, required""")
def compatible_interface_sum(t):
    compat = t.spark.createDataFrame(COMPATIBLE, "required string, iface string")
    joined = ports_of(t).join(F.broadcast(compat), "iface").groupBy("product_id", "required").agg(F.sum("n").alias("s"))
    return joined.select("product_id", "required", F.coalesce(F.nullif("s", F.lit(0)), F.col("product_id") % 4).alias("available"))


@BOOK.query("""SELECT p_partkey AS product_id, CAST(CASE WHEN p_partkey % 3 = 0 THEN 12 WHEN p_size <= 8 THEN 8 WHEN p_size <= 24 THEN 24 ELSE 48 END AS BIGINT) AS ports FROM part""")
def port_option_pick(t):
    options = F.array(F.lit(8), F.lit(24), F.lit(48))
    fixed = F.when(F.col("p_partkey") % 3 == 0, 12)
    return t.part.select(F.col("p_partkey").alias("product_id"), F.coalesce(fixed, F.array_min(F.filter(options, lambda o: o >= F.col("p_size"))), F.array_max(options)).cast("bigint").alias("ports"))


@BOOK.query("""SELECT p_partkey AS product_id, round(CASE WHEN p_partkey % 4 = 0 THEN p_retailprice WHEN p_partkey % 4 = 1 THEN p_size / 1000.0 WHEN p_partkey % 4 = 2 THEN p_retailprice / 1024 END, 6) AS value FROM part""")
def spec_alias_fallback(t):
    k = F.col("p_partkey") % 4
    direct, mbps, gb = F.when(k == 0, F.col("p_retailprice")), F.when(k == 1, F.col("p_size") / 1000), F.when(k == 2, F.col("p_retailprice") / 1024)
    return t.part.select(F.col("p_partkey").alias("product_id"), F.round(F.coalesce(direct, mbps, gb), 6).alias("value"))


@BOOK.query("""SELECT vendor, model, product_id FROM (SELECT lower(p_brand) vendor, lower(p_type) model, p_partkey product_id, row_number() OVER (PARTITION BY lower(p_brand), lower(p_type) ORDER BY p_size, p_partkey) rn FROM part) WHERE rn = 1""")
def catalog_first_wins_dedup(t):
    rows = t.part.select(F.lower("p_brand").alias("vendor"), F.lower("p_type").alias("model"), F.col("p_partkey").alias("product_id"), "p_size")
    return sh.first_wins(rows, ["vendor", "model"], ["p_size", "product_id"]).drop("p_size")


@BOOK.query("""WITH cur(vendor, category) AS (VALUES ('Brand#1', 'CURATED'), ('Brand#2', 'CURATED')), c AS (SELECT DISTINCT p_brand vendor, p_type category FROM part)
SELECT * FROM c UNION ALL SELECT * FROM cur WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.vendor = cur.vendor AND c.category = cur.category)""")
def curated_anti_union(t):
    have = t.part.select(F.col("p_brand").alias("vendor"), F.col("p_type").alias("category")).distinct()
    curated = t.spark.createDataFrame([("Brand#1", "CURATED"), ("Brand#2", "CURATED")], "vendor string, category string")
    return have.unionByName(curated.join(have, ["vendor", "category"], "left_anti"))


@BOOK.query("""SELECT p_brand AS vendor, p_type AS category, arg_min(p_name, p_partkey) AS model, count(*) AS n, string_agg(DISTINCT CAST(p_size AS VARCHAR), ',' ORDER BY CAST(p_size AS VARCHAR)) AS sizes, arg_max(p_name, struct_pack(a := p_retailprice, b := p_partkey)) AS best FROM part GROUP BY ALL""")
def duplicate_merge(t):
    return t.part.groupBy(F.col("p_brand").alias("vendor"), F.col("p_type").alias("category")).agg(F.min_by("p_name", "p_partkey").alias("model"), F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_set(F.col("p_size").cast("string"))), ",").alias("sizes"), F.max_by("p_name", F.struct("p_retailprice", "p_partkey")).alias("best"))


@BOOK.query("""WITH links AS (SELECT s_suppkey, s_name, 'Brand#' || (s_suppkey % 25 + 1) brand FROM supplier),
j AS (SELECT p_partkey, s_name, row_number() OVER (PARTITION BY p_partkey ORDER BY CASE WHEN s_suppkey % 2 = p_partkey % 2 THEN 0 ELSE 1 END, s_suppkey) rn FROM part LEFT JOIN links ON p_brand = brand)
SELECT p_partkey AS product_id, coalesce(s_name, 'none') AS link FROM j WHERE rn = 1""")
def link_hydration(t):
    links = t.supplier.select("s_suppkey", "s_name", F.concat(F.lit("Brand#"), (F.col("s_suppkey") % 25 + 1).cast("string")).alias("p_brand"), (F.col("s_suppkey") % 2).alias("odd"))
    best = links.groupBy("p_brand").agg(*(F.min_by("s_name", F.struct((F.col("odd") != k).alias("miss"), "s_suppkey")).alias(f"l{k}") for k in (0, 1)))
    return t.part.join(best, "p_brand", "left").select(F.col("p_partkey").alias("product_id"), F.coalesce(F.when(F.col("p_partkey") % 2 == 0, F.col("l0")).otherwise(F.col("l1")), F.lit("none")).alias("link"))


@BOOK.query("""SELECT p_partkey AS product_id, CAST(coalesce(nullif(regexp_extract(p_name, '(\\d+)', 1), ''), '0') AS DOUBLE) AS scale FROM part""")
def product_scale_score(t):
    return t.part.select(F.col("p_partkey").alias("product_id"), F.coalesce(tx.largest_number(F.col("p_name")), F.lit(0.0)).alias("scale"))


@BOOK.query("""WITH d AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey % 3 = 0 THEN 'matched' WHEN l_suppkey % 3 = 1 THEN 'no_safe_match' END status, l_extendedprice / 100000 gap, l_tax * 10 local_gap FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN status = 'matched' AND gap <= local_gap THEN 'provider' ELSE 'local' END AS chosen, coalesce(status, 'none') AS status FROM d""")
def llm_decision_policy(t):
    """A provider's decision stands only if it fits no worse than the local choice."""
    status = F.when(F.col("l_suppkey") % 3 == 0, "matched").when(F.col("l_suppkey") % 3 == 1, "no_safe_match")
    rows = t.lineitem.select("l_orderkey", "l_linenumber", status.alias("s"), (F.col("l_extendedprice") / 100000).alias("gap"), (F.col("l_tax") * 10).alias("own"))
    return rows.select("l_orderkey", "l_linenumber", F.when((F.col("s") == "matched") & (F.col("gap") <= F.col("own")), "provider").otherwise("local").alias("chosen"), F.coalesce("s", F.lit("none")).alias("status"))


@BOOK.query("""SELECT l_orderkey, max(l_quantity) AS quantity, CAST(max(l_linenumber) AS BIGINT) AS ports, bool_or(l_returnflag = 'R') AS returned, string_agg(DISTINCT l_linestatus, ',' ORDER BY l_linestatus) AS modes,
 max(CASE WHEN l_linenumber % 2 = 0 THEN l_tax END) AS even_max, max(CASE WHEN l_linenumber % 2 = 1 THEN l_tax END) AS odd_max FROM lineitem GROUP BY 1""")
def metadata_merge_max(t):
    even = F.when(F.col("l_linenumber") % 2 == 0, F.col("l_tax"))
    odd = F.when(F.col("l_linenumber") % 2 == 1, F.col("l_tax"))
    return t.lineitem.groupBy("l_orderkey").agg(F.max("l_quantity").alias("quantity"), F.max("l_linenumber").cast("bigint").alias("ports"), F.bool_or(F.col("l_returnflag") == "R").alias("returned"), F.array_join(F.sort_array(F.collect_set("l_linestatus")), ",").alias("modes"), F.max(even).alias("even_max"), F.max(odd).alias("odd_max"))


HA = ["active-active", "active-passive", "clustering", "vrrp"]


@BOOK.query("""WITH r AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN ['active-active'] WHEN 1 THEN ['active-passive', 'clustering'] WHEN 2 THEN ['vrrp'] ELSE [] END need,
 CASE o_custkey % 3 WHEN 0 THEN ['active-active', 'active-passive', 'clustering'] WHEN 1 THEN ['vrrp'] ELSE [] END have, o_custkey % 2 = 0 supported FROM orders)
SELECT o_orderkey, CASE WHEN len(need) = 0 THEN true WHEN len(have) > 0 THEN list_has_all(have, need) ELSE supported AND list_has_all(['active-passive', 'active-active', 'clustering'], need) END AS passes FROM r""")
def ha_mode_superset(t):
    arr = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    k, m = F.col("o_orderkey") % 4, F.col("o_custkey") % 3
    need = F.when(k == 0, arr(HA[0])).when(k == 1, arr(HA[1], HA[2])).when(k == 2, arr(HA[3])).otherwise(arr())
    have = F.when(m == 0, arr(*HA[:3])).when(m == 1, arr(HA[3])).otherwise(arr())
    holds = lambda a, b: F.size(F.array_except(b, a)) == 0
    passes = F.when(F.size(need) == 0, True).when(F.size(have) > 0, holds(have, need)).otherwise((F.col("o_custkey") % 2 == 0) & holds(arr(*HA[:3]), need))
    return t.orders.select("o_orderkey", passes.alias("passes"))


@BOOK.query("""WITH m AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END top, CASE WHEN o_custkey % 3 = 0 THEN o_custkey * 1000.0 END mbps, o_custkey * 1.0 nested FROM orders)
SELECT o_orderkey, round(coalesce(top, mbps / 1000, nested), 6) AS gbps, CASE WHEN top IS NOT NULL THEN 'top' WHEN mbps IS NOT NULL THEN 'detected' ELSE 'nested' END AS origin FROM m""")
def metadata_precedence(t):
    top = F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice"))
    mbps = F.when(F.col("o_custkey") % 3 == 0, F.col("o_custkey") * 1000.0)
    return t.orders.select("o_orderkey", F.round(F.coalesce(top, mbps / 1000, F.col("o_custkey").cast("double")), 6).alias("gbps"), F.when(top.isNotNull(), "top").when(mbps.isNotNull(), "detected").otherwise("nested").alias("origin"))


@BOOK.query("""SELECT p_partkey AS product_id, left(p_type, 5) || CASE WHEN n > 0 THEN '_' || n ELSE '' END AS title FROM (SELECT *, row_number() OVER (PARTITION BY lower(left(p_type, 5)) ORDER BY p_partkey) - 1 n FROM part)""")
def sheet_title_uniquify(t):
    base = F.left(F.regexp_replace("p_type", r"[\\/?*\[\]:]", ""), F.lit(5))
    n = F.row_number().over(Window.partitionBy(F.lower(base)).orderBy("p_partkey")) - 1
    rows = t.part.select("p_partkey", base.alias("base"), n.alias("n"))
    return rows.select(F.col("p_partkey").alias("product_id"), F.concat("base", F.when(F.col("n") > 0, F.concat(F.lit("_"), F.col("n").cast("string"))).otherwise("")).alias("title"))
