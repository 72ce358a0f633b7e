"""Queries of the row side: nested sheets, requirement text, blocks, folds, counters."""

from __future__ import annotations

from pyspark.sql import functions as F
from ..functions import requirements as rq
from ..functions import rules as R
from ..functions import text as tx
from ..operators import blocks as bl
from ..operators import shape as sh
from ..sources import sheets as ss
from .book import Book

BOOK = Book()
#: a requirement text made from each line item, alike in both engines
SPEC = "sp AS (SELECT l_orderkey, l_linenumber, 'ngfw throughput ' || CAST(l_quantity AS INT) || CASE l_linenumber % 3 WHEN 0 THEN ' tbps' WHEN 1 THEN ' gbps' ELSE ' mbps' END || ' | ' || l_linenumber || ' x 10g sfp | concurrent sessions ' || (l_partkey % 50) || CASE l_partkey % 3 WHEN 0 THEN ' million' WHEN 1 THEN 'k' ELSE '' END || ' | ups 2 x 20 kva and ' || (l_suppkey % 90 + 1) || ' kva' AS req FROM lineitem)"


def specs(t):
    s = lambda c: F.col(c).cast("string")
    k, p = F.col("l_linenumber") % 3, F.col("l_partkey") % 3
    req = F.concat(F.lit("ngfw throughput "), F.col("l_quantity").cast("int").cast("string"), F.when(k == 0, " tbps").when(k == 1, " gbps").otherwise(" mbps"), F.lit(" | "), s("l_linenumber"), F.lit(" x 10g sfp | concurrent sessions "), (F.col("l_partkey") % 50).cast("string"), F.when(p == 0, " million").when(p == 1, "k").otherwise(""), F.lit(" | ups 2 x 20 kva and "), (F.col("l_suppkey") % 90 + 1).cast("string"), F.lit(" kva"))
    return t.lineitem.select("l_orderkey", "l_linenumber", req.alias("req"))


KEY = ["l_orderkey", "l_linenumber"]


@BOOK.query(f"WITH {SPEC} SELECT l_orderkey, l_linenumber, round(CAST(regexp_extract(req, '(\\d+) ([tgm])bps', 1) AS DOUBLE) * CASE regexp_extract(req, '(\\d+) ([tgm])bps', 2) WHEN 't' THEN 1000 WHEN 'm' THEN 0.001 ELSE 1 END, 6) AS gbps FROM sp")
def unit_to_gbps(t):
    return specs(t).select(*KEY, F.round(F.array_max(F.map_values(rq.throughputs(rq.prepared(F.col("req")), F.lit("")))), 6).alias("gbps"))


@BOOK.query(f"WITH {SPEC} SELECT l_orderkey, l_linenumber, CAST(CAST(regexp_extract(req, 'sessions (\\d+)( million|k)?', 1) AS DOUBLE) * CASE trim(regexp_extract(req, 'sessions (\\d+)( million|k)?', 2)) WHEN 'million' THEN 1000000 WHEN 'k' THEN 1000 ELSE 1 END AS BIGINT) AS sessions FROM sp")
def count_suffix_parse(t):
    return specs(t).select(*KEY, rq.count(rq.prepared(F.col("req")), R.COUNT_LABELS["concurrent_sessions"]).alias("sessions"))


@BOOK.query(f"WITH {SPEC} SELECT l_orderkey, l_linenumber, CAST(regexp_extract(req, 'and (\\d+) kva', 1) AS DOUBLE) AS kva FROM sp")
def capacity_extract(t):
    return specs(t).select(*KEY, rq.capacity(rq.prepared(F.col("req")), "kva").alias("kva"))


@BOOK.query(f"WITH {SPEC} SELECT l_orderkey, l_linenumber, CAST(regexp_extract(req, '(\\d+) x 10g sfp', 1) AS BIGINT) AS ports FROM sp")
def interface_extract(t):
    return specs(t).select(*KEY, rq.interfaces(rq.prepared(F.col("req")))["10g_sfp_plus"].alias("ports"))


@BOOK.query("""SELECT p_partkey, CAST(CASE p_partkey % 4 WHEN 0 THEN p_size WHEN 1 THEN p_size * 1000000 WHEN 2 THEN p_size + 7 ELSE p_size * 1000 END AS DOUBLE) AS value FROM part""")
def catalog_number_parse(t):
    n, k = F.col("p_size").cast("string"), F.col("p_partkey") % 4
    raw = F.when(k == 0, n).when(k == 1, F.concat(n, F.lit(" Million"))).when(k == 2, F.concat(n, F.lit(" to "), (F.col("p_size") + 7).cast("string"))).otherwise(F.concat(n, F.lit(",000")))
    return t.part.select("p_partkey", tx.number(raw).alias("value"))


@BOOK.query("""WITH s AS (SELECT p_partkey, unnest(['1.2.' || p_size || ' need ' || p_type, '1.3 want ' || p_brand]) AS sec, unnest([0, 1]) AS sec_no FROM part) SELECT p_partkey, CAST(sec_no AS BIGINT) AS sec_no, sec FROM s""")
def numbered_section_split(t):
    raw = F.concat(F.lit("intro 1.2."), F.col("p_size").cast("string"), F.lit(" need "), "p_type", F.lit(" 1.3 want "), "p_brand")
    return t.part.select("p_partkey", F.posexplode(tx.numbered_sections(raw)).alias("sec_no", "sec")).withColumn("sec_no", F.col("sec_no").cast("bigint"))


@BOOK.query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_type || ' | ' || p_brand || ' | ' || p_name ELSE p_type || ' | ' || p_name END AS q FROM part")
def contained_part_dedup(t):
    parts = F.when(F.col("p_partkey") % 2 == 0, F.array("p_type", F.lower("p_type"), "p_brand", "p_name")).otherwise(F.array("p_type", F.upper("p_type"), "p_name", F.lower("p_name")))
    return t.part.select("p_partkey", F.array_join(tx.distinct_parts(parts), " | ").alias("q"))


@BOOK.query("""SELECT o_orderkey, 'Orders | o_orderstatus,o_orderpriority | ' || c_name || ' | ' || o_orderstatus || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE ' | ' || o_orderpriority END AS ctx FROM orders JOIN customer ON o_custkey = c_custkey""")
def row_text_concat(t):
    rows = t.orders.join(t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey")
    cells = F.array("c_name", "o_orderstatus", F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.col("o_orderpriority")), F.lit("done"))
    headers = F.array(F.lit("name"), F.lit("o_orderstatus"), F.lit("o_orderpriority"), F.lit("Reference"))
    row = ss.row_text(headers, cells, skip=["Reference"])
    return rows.select("o_orderkey", ss.contextual(F.lit("Orders"), F.array(F.lit("o_orderstatus"), F.lit("o_orderpriority")), row).alias("ctx"))


@BOOK.query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.k') IS NOT NULL AS has_k FROM events""")
def json_props_extract(t):
    v = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")
    return t.events.select("event_id", v.alias("k"), v.isNotNull().alias("has_k"))


@BOOK.query("""SELECT user_id, event_id, CAST(sum(turn) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS island FROM
 (SELECT user_id, event_id, CAST(CASE WHEN lag(event_type) OVER w IS DISTINCT FROM event_type OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS BIGINT) turn FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))""")
def block_islands(t):
    return sh.islands(t.events.select("user_id", "event_id", "event_type"), ["user_id"], ["event_id"], "event_type").select("user_id", "event_id", "island")


@BOOK.query("""SELECT l_orderkey, l_linenumber, coalesce(max(CASE WHEN l_linestatus = 'F' OR l_quantity > 30 THEN CAST(l_linenumber AS BIGINT) END) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber), -1) AS anchor FROM lineitem""")
def block_cover(t):
    anchor = F.when((F.col("l_linestatus") == "F") | (F.col("l_quantity") > 30), F.col("l_linenumber").cast("bigint"))
    return sh.covered_by(t.lineitem.select("l_orderkey", "l_linenumber", "l_linestatus", "l_quantity"), ["l_orderkey"], ["l_linenumber", F.desc_nulls_last(anchor)], anchor).select("l_orderkey", "l_linenumber", F.coalesce("anchor", F.lit(-1)).alias("anchor"))


@BOOK.query("SELECT conv_id, left(string_agg(text, ' | ' ORDER BY turn), 1000) AS ctx FROM conversations WHERE trim(text) <> '' GROUP BY conv_id")
def group_context(t):
    """Texts of a group in order, the joined text cut at 1,000 characters."""
    rows = bl.parts_of(t.conversations.where(F.trim("text") != "").withColumnRenamed("turn", "row_no"), ["conv_id"], "g")
    return rows.select("conv_id", F.left(F.array_join(F.transform("g", lambda s: s["text"]), " | "), F.lit(1000)).alias("ctx"))


@BOOK.query("""SELECT a.conv_id, a.turn, string_agg(CASE WHEN b.turn = a.turn THEN 'PRIMARY' ELSE 'SPEC_ROW_' || (b.turn + 1) END || ': ' || b.text, ' | ' ORDER BY b.turn) AS ctx FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.text <> '' GROUP BY ALL""")
def block_context(t):
    """Each row with the whole text of its group, uncut, itself marked."""
    rows = t.conversations.select("conv_id", "turn", F.col("turn").alias("row_no"), "text")
    return rows.join(bl.parts_of(rows, ["conv_id"], "g"), "conv_id").select("conv_id", "turn", bl.marked(F.col("g"), F.col("row_no")).alias("ctx"))


@BOOK.query("SELECT conv_id, arg_min(turn, struct_pack(a := CASE WHEN role = 'assistant' AND length(text) > 300 THEN 0 ELSE 1 END, b := turn)) AS anchor_turn FROM conversations WHERE trim(text) <> '' GROUP BY conv_id")
def anchor_pick(t):
    miss = F.when((F.col("role") == "assistant") & (F.length("text") > 300), 0).otherwise(1)
    return t.conversations.where(F.trim("text") != "").groupBy("conv_id").agg(F.min_by("turn", F.struct(miss.alias("m"), "turn")).alias("anchor_turn"))


@BOOK.query("""WITH f AS (SELECT l_orderkey, l_shipmode, min(l_linenumber) n FROM (SELECT l_orderkey, l_linenumber, l_returnflag || l_linestatus l_shipmode FROM lineitem) GROUP BY ALL)
SELECT l_orderkey, string_agg(l_shipmode, ',' ORDER BY n, l_shipmode) AS refs FROM f GROUP BY 1""")
def row_fold_distinct(t):
    ref = F.concat("l_returnflag", "l_linestatus")
    first = t.lineitem.groupBy("l_orderkey", ref.alias("ref")).agg(F.min("l_linenumber").alias("n"))
    return first.groupBy("l_orderkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "ref"))), lambda s: s["ref"]), ",").alias("refs"))


@BOOK.query("SELECT user_id, CASE WHEN bool_and(event_type <> 'error' AND value >= 0) THEN 'Matched' ELSE 'Review' END AS status FROM events GROUP BY 1")
def status_rollup(t):
    return t.events.groupBy("user_id").agg(F.when(F.bool_and((F.col("event_type") != "error") & (F.col("value") >= 0)), "Matched").otherwise("Review").alias("status"))


@BOOK.query("SELECT event_type, count(*) AS n, CAST(count(*) FILTER (WHERE value > 50) AS BIGINT) AS high, CAST(count(DISTINCT user_id) AS BIGINT) AS users FROM events GROUP BY ROLLUP (event_type)")
def run_stats(t):
    return t.events.rollup("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 50).alias("high"), F.countDistinct("user_id").alias("users"))


@BOOK.query("""WITH d AS (SELECT role, length(text) // 100 AS bin, min(conv_id * 1000 + turn) AS first_key, count(*) AS hits FROM conversations GROUP BY ALL) SELECT c.conv_id, c.turn, d.first_key, d.hits FROM conversations c JOIN d ON c.role = d.role AND length(c.text) // 100 = d.bin""")
def query_memo_distinct(t):
    rows = t.conversations.select("conv_id", "turn", "role", F.floor(F.length("text") / 100).alias("bin"))
    memo = rows.groupBy("role", "bin").agg(F.min(F.col("conv_id") * 1000 + F.col("turn")).alias("first_key"), F.count(F.lit(1)).alias("hits"))
    return rows.join(memo, ["role", "bin"]).select("conv_id", "turn", "first_key", "hits")


@BOOK.query("""SELECT o_custkey AS doc_id, CAST(no AS BIGINT) AS row_no, CASE WHEN x.s = 'F' THEN 'section' ELSE 'data' END AS row_type, x.s || ',' || x.p AS cells FROM
 (SELECT o_custkey, unnest(g) x, generate_subscripts(g, 1) - 1 no FROM (SELECT o_custkey, list(struct_pack(k := o_orderkey, s := o_orderstatus, p := o_orderpriority) ORDER BY o_orderkey) g FROM orders GROUP BY 1))""")
def sheet_rows_flatten(t):
    """Orders packed into the nested sheet document and flattened again by the JSON source."""
    row = F.to_json(F.struct(F.when(F.col("o_orderstatus") == "F", "section").otherwise("data").alias("row_type"), F.array("o_orderstatus", "o_orderpriority").alias("data")))
    legacy = F.to_json(F.array("o_orderstatus", "o_orderpriority"))
    raw = F.when((F.col("o_orderkey") % 2 == 0) & (F.col("o_orderstatus") != "F"), legacy).otherwise(row)
    docs = t.orders.groupBy(F.col("o_custkey").alias("doc_id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", raw.alias("r")))), lambda s: s["r"]), ",").alias("rows"))
    docs = docs.select("doc_id", F.concat(F.lit('{"sheets":[{"title":"T","headers":["status","priority"],"rows":['), "rows", F.lit("]}]}")).alias("json"))
    return ss.flatten_rows(docs).select("doc_id", "row_no", "row_type", F.array_join("cells", ",").alias("cells"))


@BOOK.query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN CAST(event_id % 7 AS BIGINT) WHEN event_id % 3 = 1 THEN CAST(event_id % 11 AS BIGINT) ELSE -1 END AS n FROM events""")
def llm_reply_salvage(t):
    """Fenced, prose-wrapped and truncated replies; what cannot be read is null."""
    e = F.col("event_id")
    fenced = F.concat(F.lit('Sure!\n```json\n{"n": '), (e % 7).cast("string"), F.lit("}\n```"))
    prose = F.concat(F.lit('Here: {"n": '), (e % 11).cast("string"), F.lit("} as asked."))
    raw = F.when(e % 3 == 0, fenced).when(e % 3 == 1, prose).otherwise(F.lit('{"n": '))
    return t.events.select("event_id", F.coalesce(F.try_variant_get(ss.salvaged(raw), "$.n", "bigint"), F.lit(-1)).alias("n"))
