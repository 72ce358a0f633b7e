"""References for requirement sheets: rows in, rows with references, reasons and details out.

One pass over flat sheet rows (``sources.sheets.flatten_rows``): product blocks and gates choose the
rows that ask for a product, numbered sections split them, constraints are parsed, and each (row,
section, vendor) takes its closest safe product from the catalog by a join on vendor.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import constraints as cs
from ..functions import rules as R
from ..functions import text as tx
from ..sources.staged import staged
from . import blocks as bl
from . import fit, gates

SHEET, ROW = bl.SHEET, [*bl.SHEET, "row_no"]


@dataclass(frozen=True)
class Provider:
    """What differs between providers of references."""

    name: str = "fortinet"
    vendors: tuple[str, ...] = ("Fortinet",)
    top_k: int = 8
    may_override: bool = False  # a decision of another judge may replace the closest fit
    table_rows: int = 80  # rows of a one-product table that its text shows

    def asked(self) -> Column:
        if self.name == "juniper":
            return cs.words(["Juniper"])
        return fit.vendors_for(F.col("device_type"), self.vendors)

    def parsed(self, df: DataFrame, text: str, meta: str) -> DataFrame:
        return (cs.parse_juniper if self.name == "juniper" else cs.parse_constraints)(df, text, meta)


def chunk(product: Column) -> Column:
    """A product as text, ``key: value`` joined by bars; nested values as JSON, empty ones left out."""
    top = F.map_filter(F.try_variant_get(product, "$", cs.TEXTS), lambda _, v: ~F.coalesce(v, F.lit("")).isin("", "{}", "[]"))
    return F.array_join(F.transform(F.map_entries(top), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), " | ")


def build_query(text: Column, meta: str | None = None) -> Column:
    """The row's text and what its metadata says, without parts that an earlier part holds."""
    clean = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    parts = [text]
    if meta:
        bare = lambda v: F.when(v.rlike(r"^(-?\d+(\.\d+)?([eE]\d+)?|true|false|[\[{].*)$"), v).otherwise(F.concat(F.lit('"'), v, F.lit('"')))
        listed = lambda m: F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(F.lit('"'), e["key"], F.lit('": '), bare(e["value"]))), ", ")
        json = lambda n: F.when(F.size(F.col(f"{meta}.{n}")) > 0, F.concat(F.lit("{"), listed(F.col(f"{meta}.{n}")), F.lit("}")))
        top = F.col(f"{meta}.top")
        parts += [F.try_element_at(top, F.lit(k)) for k in ("device_type", "device_category", "category", "source_text")]
        parts += [json("detected"), json("nested"), json("interfaces")]
    own = F.filter(F.array(*map(clean, parts)), lambda p: p != "")
    return F.array_join(tx.distinct_parts(own), " | ")


def enriched_metadata(df: DataFrame, meta: str, text: str) -> DataFrame:
    """Column meta with what found (constraints of the text) adds: a missing category, missing numbers,
    larger interface counts, flags and modes."""
    top, f = F.col(f"{meta}.top"), F.col("found")
    own = F.transform_values(f["numbers"], lambda _, v: v.cast("string"))
    lacking = F.map_filter(own, lambda k, _: cs.filled(F.try_element_at(F.col(f"{meta}.detected"), k)).isNull())
    detected = F.map_concat(F.map_filter(F.col(f"{meta}.detected"), lambda k, _: ~cs.has(lacking, k)), lacking)
    flags = F.map_from_arrays(f["flags"], F.transform(f["flags"], lambda _: F.lit("true")))
    kept = F.map_filter(top, lambda k, _: ~F.array_contains(f["flags"], k))
    counts = lambda m: F.transform_values(m, lambda _, v: tx.number(v).cast("bigint"))
    ports = F.transform_values(cs.most(counts(F.col(f"{meta}.interfaces")), f["interfaces"]), lambda _, v: v.cast("string"))
    named = F.coalesce(*(cs.category(cs.filled(F.try_element_at(top, F.lit(k)))) for k in ("device_type", "category", "device_category")))
    df = df.withColumns({"_top": F.map_concat(kept, flags), "_detected": detected, "_ports": ports, "_named": named})
    df = df.withColumn("_top", cs.put(F.col("_top"), "device_category", F.when(F.col("_named").isNull(), f["device_type"])))
    df = df.withColumn("_top", cs.put(F.col("_top"), "ha_modes", F.when(F.size(f["ha_modes"]) > 0, F.to_json(f["ha_modes"]))))
    df = df.withColumn("_top", cs.put(F.col("_top"), "source_text", F.left(F.col(text), F.lit(1000))))
    return df.withColumn(meta, F.struct(F.col("_top").alias("top"), F.col("_detected").alias("detected"), F.col(f"{meta}.nested").alias("nested"), F.col("_ports").alias("interfaces"))).drop("_top", "_detected", "_ports", "_named")


def pending(rows: DataFrame, provider: Provider) -> DataFrame:
    """ROW, segment, query, SPEC, notes, scale_users of each section of each row that asks for a product.
    rows: doc_id, sheet_no, title, headers, row_no, row_type, cells, metadata (VARIANT)."""
    own = rows.where(~gates.skipped_sheet(F.col("title"))).select(*ROW, "title", "headers", "row_type", "cells", cs.metadata(F.col("metadata")).alias("meta"))
    own = bl.with_blocks(own.withColumn("text", bl.row_text(F.col("headers"), F.col("cells"))))
    own = own.withColumn("context", bl.context(F.col("title"), F.col("headers"), F.col("text")))
    own = staged(cs.effective(own, "meta", "context"))
    has_blocks = F.col("first_start").isNotNull()
    anchor = F.coalesce(F.col("row_no") == F.col("anchor_row"), F.lit(False))
    own = own.withColumn("_stands", gates.standalone(F.col("context"))).withColumn("_speaks", gates.reference_anchor("meta"))
    own = own.withColumn("_wanted", gates.flag("meta", "requires_reference", True) | (F.col("_speaks") & gates.matchable("meta")))
    signal = gates.concrete_signal(F.col("title"), F.col("headers"), F.col("context"), cs.hard("found."))
    data = (F.col("row_type") != "section") & (F.size(F.filter("cells", lambda c: c != "")) > 0)
    own = own.withColumn("_first", F.min(F.when(data, F.col("row_no"))).over(Window.partitionBy(*SHEET)))
    single = gates.single_firewall_sheet(F.col("title"), F.col("headers"), F.col("context"))
    primary = gates.flag("meta", "product_group_primary_row", True) | gates.flag("meta", "group_primary_row", True)
    other = single & ~F.coalesce(F.col("row_no") == F.col("_first"), F.lit(False)) & ~primary & ~F.col("_stands")
    free = (F.col("row_type") != "section") & ~(has_blocks & (F.col("row_no") < F.col("first_start"))) & ~F.col("in_block")
    free = free & (has_blocks | ~gates.admin_sheet(F.col("title"))) & signal & ~other & (F.col("_stands") | F.col("_speaks"))
    free = free & gates.should_reference(F.col("context"), F.col("_wanted"), provider.name)
    own = own.withColumns({"_anchor": anchor, "_single": single, "_group": gates.group_of("meta")})
    own = staged(own)
    asks = enriched_metadata(own.where(F.coalesce(anchor | free, F.lit(False))), "meta", "context")
    texts = [
        (bl.parts_of(own.where("in_block"), [*SHEET, "start_row"], "_block"), [*SHEET, "start_row"]),
        (bl.parts_of(own.where(F.col("_group") != ""), [*SHEET, "_group"], "_siblings"), [*SHEET, "_group"]),
        (bl.parts_of(own.where("row_type <> 'section' AND text <> ''").withColumn("_no", F.row_number().over(Window.partitionBy(*SHEET).orderBy("row_no"))).where(F.col("_no") <= provider.table_rows), SHEET, "_table"), SHEET),
    ]
    for parts, on in texts:
        asks = asks.join(parts, on, "left")
    part = lambda c: bl.marked(F.col(c), F.col("row_no"))
    some = F.when(F.trim("title") != "", F.col("title"))
    base = F.when(F.col("_anchor"), F.concat_ws(" | ", some, F.concat(F.lit("Full inferred product requirement block: "), F.coalesce(part("_block"), F.lit(""))))).otherwise(F.col("context"))
    asks = asks.withColumn("_base", base)
    more = F.when(~F.col("_stands") & (F.size("_siblings") > 1), F.concat(F.col("_base"), F.lit(" | Full product requirement block: "), part("_siblings")))
    asks = asks.withColumn("_base", F.coalesce(more, "_base"))
    whole = ~F.col("_anchor") & ~F.col("_stands") & F.col("_single") & (F.size("_table") > 1)
    asks = asks.withColumn("_base", F.when(whole, F.concat(F.col("_base"), F.lit(" | Full single-product firewall requirement table: "), part("_table"))).otherwise(F.col("_base")))
    return sections(staged(asks.select(*ROW, "title", "meta", F.col("_base").alias("context"))), provider)


def sections(asks: DataFrame, provider: Provider) -> DataFrame:
    """One row for each numbered section that states a product (the whole text, where there are fewer than
    two sections or none does); a section's metadata is empty, as it speaks of the whole row."""
    clean = F.trim(F.regexp_replace("context", r"\s+", " "))
    cut = tx.numbered_sections(clean)
    parts = F.filter(F.transform(cut, lambda p: F.regexp_replace(p, r"^[ |]+|[ |]+$", "")), lambda p: p != "")
    split = asks.withColumn("_parts", F.when(F.size(cut) >= 2, parts))
    split = split.select(*ROW, F.posexplode("_parts").alias("segment", "segment_text"))
    read = cs.normalized(cs.found_in(split, "segment_text", "_found").withColumn("_meta", cs.no_metadata()), "_meta", F.col("segment_text"), "_found")
    kept = staged(read.drop("_meta", "_found")).where(cs.hard() | gates.segment_intent(F.col("segment_text"))).select(*ROW, "segment", "segment_text")
    listed = kept.groupBy(*ROW).agg(F.transform(F.sort_array(F.collect_list(F.struct("segment", "segment_text"))), lambda s: s["segment_text"]).alias("_segments"))
    asks = asks.join(listed, ROW, "left").withColumn("_segments", F.coalesce("_segments", F.array("context")))
    asks = asks.withColumn("meta", F.when(F.size("_segments") > 1, cs.no_metadata()).otherwise(F.col("meta")))
    asks = asks.select(*ROW, "title", "meta", F.posexplode("_segments").alias("segment", "_text"))
    asks = staged(asks.withColumn("query", build_query(F.col("_text"), "meta")))
    return staged(provider.parsed(asks, "query", "meta").drop("meta", "_text")).where(gates.product_intent(F.col("query")))


def url_penalty(url: Column) -> Column:
    u = F.lower(F.coalesce(url, F.lit("")))
    good = u.contains("data-sheets") & ~u.contains("infographic") & ~u.contains("product_matrix")
    return F.when(good, 0.0).when(u.endswith(".pdf"), 0.5).otherwise(1.0)


def model_keys(model: Column) -> Column:
    """A model's name and the name without vendors' words and signs."""
    text = F.lower(F.trim(F.regexp_replace(F.coalesce(model, F.lit("")), r"\s+", " ")))
    plain = F.regexp_replace(text, r"\b(fortinet|juniper|fortigate|fortiswitch)\b|\(tm\)|\(r\)|tm|registered", " ")
    plain = F.trim(F.regexp_replace(plain, "[^a-z0-9]+", " "))
    return F.filter(F.array_distinct(F.array(text, plain)), lambda k: k != "")


def tokens(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), F.lit(1)))


def retrieval_score(provider: str = "fortinet") -> Column:
    """The additive score of a pair: overlap of tokens, words of the query in the product's text, category,
    mention of the model, and boosts of the domain. Columns: _q (lower query), _terms, _chunk (lower), _tokens,
    _keys, device_type, category, model."""
    q, c, cat = F.col("_q"), F.col("_chunk"), F.coalesce(F.col("category"), F.lit(""))
    m = F.lower(F.coalesce(F.col("model"), F.lit("")))
    both = F.size(F.array_intersect("_terms", "_tokens"))
    semantic = F.when((F.size("_terms") > 0) & (F.size("_tokens") > 0), both / F.sqrt(F.size("_terms") * F.size("_tokens"))).otherwise(0.0)
    held = F.size(F.filter("_terms", lambda t: F.contains(c, t)))
    serves = F.array_contains(fit.serving(F.col("device_type")), cat)
    kin = F.array_contains(fit.serving(F.col("device_type"), provider), cat)
    base = semantic + F.least(held / 28.0, F.lit(0.30)) + F.when(serves, 0.35).when(kin, 0.12).otherwise(0.0)

    def mention(k: Column) -> Column:
        parts = F.filter(F.split(k, " "), lambda t: F.length(t) > 1)
        return F.when(F.contains(q, k), 0.85).when((F.size(parts) >= 2) & (F.size(F.array_except(parts, F.col("_terms"))) == 0), 0.45)

    base = base + F.coalesce(F.get(F.array_compact(F.transform("_keys", mention)), F.lit(0)), F.lit(0.0))
    on = lambda cond, x: F.when(F.coalesce(cond, F.lit(False)), x).otherwise(0.0)
    some = lambda *terms: tx.any_of(q, terms)
    switch = cat.isin("SWITCH", "DATACENTER_SWITCH", "ACCESS_SWITCH")
    wall = some("firewall", "vpn", "ipsec", "ngfw") & (cat == "NGFW")
    logs = some("fortilogger", "hardware logging", "log reporting", "logging appliance", "firewall logging", "log backup")
    logger = m.contains("fortilogger") | (cat == "LOGGING")
    base = base + on(wall, 0.35) + on(wall & m.contains("fortigate"), 0.25) + on(some("switch", "sfp", "qsfp", "ethernet", "port") & switch, 0.25)
    base = base + on(some("manager", "centralized", "fortimanager") & m.contains("fortimanager"), 0.45)
    base = base + on(logs & logger, 0.75) - on(logs & ~logger & m.contains("fortianalyzer"), 0.35)
    base = base + on(some("siem", "soc", "eps") & (m.contains("fortisiem") | (cat == "SIEM_SOC")), 0.45)
    return base + on(some("redundant") & tx.any_of(c, ["redundant", "dual power", "dual psu"]), 0.15)


def series_boost() -> Column:
    """What one vendor's series add to the score of the candidates that were retrieved."""
    q, m = F.col("_q"), F.lower(F.coalesce(F.col("model"), F.lit("")))
    some = lambda *terms: tx.any_of(q, terms)
    on = lambda cond, x: F.when(F.coalesce(cond, F.lit(False)), x).otherwise(0.0)
    kin = F.array_contains(fit.serving(F.col("device_type"), "juniper"), F.coalesce(F.col("category"), F.lit("")))
    return (
        on(kin, 0.2)
        + on(some("srx", "firewall", "ngfw") & m.startswith("srx"), 0.4)
        + on(some("qfx", "leaf", "spine", "tor", "data center switch") & m.startswith("qfx"), 0.45)
        + on(some("ex", "access switch", "campus switch") & m.startswith("ex"), 0.35)
        + on(some("mx", "ptx", "acx", "router") & m.rlike("^(mx|ptx|acx)"), 0.35)
        + on(some("mist", "wireless", "access point", "wi-fi", "wifi") & m.startswith("ap"), 0.45)
        + on(some("wi-fi 7", "wifi 7", "802.11be") & (m == "ap47"), 0.8)
        + on(some("wi-fi 6e", "wifi 6e", "6 ghz") & (m == "ap45"), 0.6)
    )


def vendor_most(products: DataFrame, name: str = "ssl_vpn_users") -> DataFrame:
    """_vendor, _most: the largest value of a specification by category, of each vendor."""
    own = products.select(F.lower("vendor").alias("_vendor"), "category", F.try_element_at("p_numbers", F.lit(name)).alias("v")).where("v IS NOT NULL")
    best = own.groupBy("_vendor", "category").agg(F.max("v").alias("v"))
    return best.groupBy("_vendor").agg(F.map_from_entries(F.collect_list(F.struct("category", "v"))).alias("_most"))


def chosen(asks: DataFrame, products: DataFrame, key: list[str], provider: Provider, decisions: DataFrame | None = None) -> DataFrame:
    """key, vendor_no, vendor_asked, constraints, and the product that fits closest among those that pass
    (null where none does), its checks, status, reasoning and the candidates that were retrieved.
    products: from ``fit.with_specs`` with product and ord; asks: key, query, SPEC, notes, scale_users.
    decisions: row_id, vendor, selected_model, match_status, confidence, reasoning of another judge."""
    goods = products.withColumns({"_vendor": F.lower("vendor"), "_chunk": F.lower(chunk(F.col("product"))), "_keys": model_keys(F.col("model"))}).withColumn("_tokens", tokens(F.col("_chunk")))
    goods = staged(goods.drop("product"))
    each = asks.select("*", F.posexplode(provider.asked()).alias("vendor_no", "vendor_asked")).withColumn("_vendor", F.lower("vendor_asked"))
    each = each.join(vendor_most(goods), "_vendor", "left")
    cap = F.array_max(F.transform(fit.serving(F.col("device_type"), provider.name), lambda c: F.try_element_at(F.col("_most"), c)))
    each = cs.capped_scale(each.withColumn("_cap", cap), "query", "_cap").drop("_cap", "_most")
    each = staged(each).withColumns({"_q": F.lower("query"), "_terms": F.filter(tokens(F.col("query")), lambda t: F.length(t) > 2)})
    by = [*key, "vendor_no"]
    pairs = each.join(goods, "_vendor").withColumn("_score", retrieval_score(provider.name))
    pairs = pairs.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("_score"), "ord")))
    if provider.name == "juniper":
        pairs = pairs.withColumn("_score", F.when(F.col("_rank") <= provider.top_k, F.col("_score") + series_boost()).otherwise(F.col("_score")))
    shown = pairs.where(F.col("_rank") <= provider.top_k).groupBy(*by).agg(F.slice(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("_score")).alias("s"), "_rank", F.struct("vendor", "model", "category", F.round("_score", 4).alias("score"), F.col("p_datasheet").alias("datasheet_url")).alias("x")))), lambda t: t["x"]), 1, provider.top_k).alias("top_candidates"))
    kin = F.array_contains(fit.serving(F.col("device_type"), provider.name), F.col("category")) | F.col("device_type").isNull()
    pairs = pairs.where(kin).withColumn("checks", fit.checks())
    logger = (F.col("device_type") == "LOGGING") & F.lower("model").contains("fortilogger") if provider.name != "juniper" else F.lit(False)
    safe = pairs.where(F.coalesce(logger, F.lit(False)) | (F.size(fit.named(False)) == 0))
    overlap = F.size(F.array_intersect("_terms", "_tokens")) / F.greatest(F.lit(1.0), F.sqrt(F.greatest(F.lit(1), F.size("_terms")) * F.greatest(F.lit(1), F.size("_tokens"))))
    safe = fit.scored(safe.withColumn("_score", F.when(F.col("_rank") <= provider.top_k, F.col("_score")).otherwise(overlap)))
    users = F.coalesce(F.try_element_at(F.col("p_numbers"), F.lit("ssl_vpn_users")), F.lit(0.0))
    need = F.coalesce(F.try_element_at(F.col("numbers"), F.lit("ssl_vpn_users")), F.nullif(users, F.lit(0.0)), F.lit(1.0))
    gap = F.abs(users - need) / F.greatest(need, F.lit(1.0))
    scale, air = F.col("scale_users").isNotNull(), F.col("device_type") == "WIRELESS_AP" if provider.name == "juniper" else F.lit(False)
    penalty, worst, mean = (F.round(c, 9) for c in fit.ORDER)
    bad_url, score = url_penalty(F.col("p_datasheet")), -F.col("_score")
    plain, other = [penalty, worst, mean, F.col("p_scale"), bad_url, score], [gap, penalty, worst, F.col("p_scale"), bad_url, score]
    aerial = [penalty, worst, mean, score, F.col("p_scale"), F.lit(0.0)]
    keys = [F.when(F.coalesce(air, F.lit(False)), a).when(scale, o).otherwise(p).cast("double").alias(f"k{n}") for n, (a, o, p) in enumerate(zip(aerial, other, plain))]
    safe = safe.withColumn("_order", F.struct(*keys, "ord"))
    keep = ["vendor", "model", "category", "p_url", "p_datasheet", "checks", "_score", "_order"]
    safe = staged(safe.select(*by, "_vendor", *keep))
    best = safe.groupBy(*by).agg(F.min_by(F.struct(*keep), "_order").alias("_won"))
    out = each.drop("_q", "_terms").join(best, by, "left").join(shown, by, "left")
    return decided(out, safe, key, provider, decisions)


def decided(out: DataFrame, safe: DataFrame, key: list[str], provider: Provider, decisions: DataFrame | None) -> DataFrame:
    """The closest fit, unless another judge chose a safe product that fits no worse and may override; the
    judge's reasons stay only where the judge chose the product that is taken."""
    by = [*key, "vendor_no"]
    if decisions is None:
        return out.withColumns({"_said": F.lit(None).cast("string"), "_status": F.lit(None).cast("string"), "_sure": F.lit(None).cast("double")})
    said = decisions.select("row_id", F.lower("vendor").alias("_vendor"), F.lower(F.trim("selected_model")).alias("_wish"), F.col("match_status").alias("_status"), F.col("confidence").cast("double").alias("_sure"), F.col("reasoning").alias("_said"))
    said = said.where((F.coalesce("_wish", F.lit("")) != "") & (F.lower(F.coalesce("_status", F.lit(""))) != "no_safe_match"))
    out = out.withColumn("row_id", row_id()).join(said, ["row_id", "_vendor"], "left").drop("row_id")
    wished = safe.join(out.select(*by, "_wish").where("_wish IS NOT NULL"), by)
    hit = F.when(F.lower("model") == F.col("_wish"), 0).when(F.contains(F.lower("model"), F.col("_wish")), 1)
    wished = wished.withColumn("_hit", hit).where("_hit IS NOT NULL")
    wished = wished.groupBy(*by).agg(F.min_by(F.struct(*[c for c in safe.columns if c not in (*by, "_vendor")]), F.struct("_hit", "_order")).alias("_other"))
    out = out.join(wished, by, "left")
    replace = F.lit(provider.may_override) & F.coalesce(F.col("_other._order") <= F.col("_won._order"), F.lit(False))
    out = out.withColumn("_won", F.when(replace, F.col("_other")).otherwise(F.col("_won")))
    agrees = F.coalesce(F.contains(F.lower("_won.model"), F.col("_wish")), F.lit(False))
    mine = lambda c: F.when(agrees, F.col(c)).alias(c)
    return out.withColumns({c: mine(c) for c in ("_said", "_status", "_sure")}).drop("_wish", "_other")


def row_id() -> Column:
    title = F.when(F.coalesce(F.col("title"), F.lit("")) != "", F.col("title")).otherwise("Sheet")
    return F.concat(title, F.lit(":"), (F.col("row_no") + 1).cast("string"), F.lit(":segment-"), (F.col("segment") + 1).cast("string"))


def plain_number(c: Column) -> Column:
    """As text, whole numbers without a point."""
    return F.when(c == F.floor(c), c.cast("bigint").cast("string")).otherwise(F.round(c, 6).cast("string"))


def rendered(df: DataFrame, provider: Provider) -> DataFrame:
    """df (from ``chosen``) with reference, reasoning and details (a JSON text) of each vendor."""
    won = F.col("_won")
    none = won.isNull()
    shown = F.filter(won["checks"], lambda c: c["ok"] & c["need"].isNotNull())
    said = F.transform(F.slice(shown, 1, 6), lambda c: F.concat(c["field"], F.lit(": required "), plain_number(c["need"]), F.lit(", candidate "), plain_number(c["have"])))
    family = (F.col("device_type") == "LOGGING") & F.lower(won["model"]).contains("fortilogger") & F.exists(won["checks"], lambda c: ~c["ok"])
    why = F.when(F.coalesce(family, F.lit(False)), "the requirement is for dedicated logging hardware, whose capacity the catalog does not state in full").otherwise("it passes every stated constraint and fits closest among the catalog's safe products")
    note = F.when(F.size("notes") > 0, F.concat(F.lit(" Notes: "), F.array_join("notes", "; "), F.lit("."))).otherwise("")
    checked = F.when(F.size(said) > 0, F.concat(F.lit(" Key checks: "), F.array_join(said, "; "), F.lit("."))).otherwise("")
    own = F.concat("vendor_asked", F.lit(": selected "), won["model"], F.lit(" because "), why, F.lit("."), note, checked)
    confidence = F.coalesce("_sure", F.round(F.greatest(F.lit(0.5), F.least(F.lit(0.98), won["_score"])), 2))
    status = F.when(none, "no_safe_match").otherwise(F.coalesce("_status", F.when(F.coalesce(family, F.lit(False)), "family_match").otherwise("rag_retrieval_match")))
    ref = F.when(none, "").otherwise(fit.reference(won["vendor"], won["model"], won["p_url"]))
    reason = F.when(none, F.concat("vendor_asked", F.lit(": no catalog item met all hard constraints without being under-spec."))).otherwise(F.coalesce("_said", own))
    spec = F.struct(*cs.SPEC, "notes", "scale_users")
    passed = lambda ok: F.transform(F.filter(won["checks"], lambda c: c["ok"] == F.lit(ok)), lambda c: c["field"])
    df = df.withColumns({"reference": ref, "reasoning": reason, "match_status": status, "confidence": F.when(~none, confidence)})
    details = F.struct(
        F.lit(provider.name).alias("provider"), F.col("vendor_asked").alias("vendor"), "match_status", "confidence", "query", spec.alias("constraints"),
        won["model"].alias("selected_model"), won["category"].alias("selected_category"), won["p_url"].alias("selected_url"),
        passed(True).alias("matched_requirements"), passed(False).alias("missing_requirements"), won["checks"].alias("checks"), "top_candidates",
    )
    return df.withColumn("details", F.to_json(details))


def folded(df: DataFrame, provider: Provider) -> DataFrame:
    """ROW, reference (distinct, joined by bars), reasoning, details of all vendors and sections of a row."""
    items = F.sort_array(F.collect_list(F.struct("segment", "vendor_no", "reference", "reasoning", "details")))
    rows = df.groupBy(*ROW).agg(items.alias("i"))
    refs = F.array_distinct(F.filter(F.transform("i", lambda x: x["reference"]), lambda r: r != ""))
    details = F.concat(F.lit(f'{{"provider":"{provider.name}","segments":['), F.array_join(F.transform("i", lambda x: x["details"]), ","), F.lit("]}"))
    return rows.select(*ROW, F.array_join(refs, " | ").alias("reference"), F.array_join(F.transform("i", lambda x: x["reasoning"]), "\n\n").alias("reasoning"), details.alias("details"))


def written(rows: DataFrame, found: DataFrame, skipped: Column) -> DataFrame:
    """rows with the output columns at the end of headers (once) and of cells, which are cut or filled to the
    headers' length; sheets that are skipped stay as they are."""
    heads = F.coalesce("headers", F.array().cast("array<string>"))
    wide = F.when(skipped, heads).otherwise(F.concat(heads, F.array_except(cs.words(R.OUTPUT_COLUMNS), heads)))
    out = rows.join(found, ROW, "left").withColumn("_wide", wide)
    value = lambda h: F.when(h == R.OUTPUT_COLUMNS[0], F.coalesce("reference", F.lit(""))).when(h == R.OUTPUT_COLUMNS[1], F.coalesce("reasoning", F.lit(""))).otherwise(F.coalesce("details", F.lit("")))
    cells = F.transform("_wide", lambda h, i: F.when(h.isin(*R.OUTPUT_COLUMNS), value(h)).otherwise(F.coalesce(F.get("cells", i), F.lit(""))))
    return out.withColumns({"cells": F.when(skipped, F.col("cells")).otherwise(cells), "headers": F.col("_wide"), "reference": F.coalesce("reference", F.lit(""))}).drop("_wide")


def inject_references(rows: DataFrame, products: DataFrame, provider: Provider = Provider(), decisions: DataFrame | None = None) -> DataFrame:
    """rows with the output columns filled, and reference, reasoning, details, asked (whether the row asked for a
    product). rows: doc_id, sheet_no, title, headers, row_no, row_type, cells, metadata (VARIANT), row_no from 0
    without gaps; products: vendor, model, category, product (VARIANT), ord (unique). A null cell counts as empty."""
    rows = rows.withColumn("cells", F.transform(F.coalesce("cells", F.array().cast("array<string>")), lambda c: F.coalesce(c, F.lit(""))))
    asks = pending(rows, provider)
    found = folded(rendered(chosen(asks, fit.with_specs(products), [*ROW, "segment"], provider, decisions), provider), provider)
    return written(rows, found.withColumn("asked", F.lit(True)), gates.skipped_sheet(F.col("title"))).withColumn("asked", F.coalesce("asked", F.lit(False)))


def stats(injected: DataFrame) -> DataFrame:
    """One row of counters."""
    return injected.agg(
        F.count_if(~gates.skipped_sheet(F.col("title"))).alias("rows_seen"),
        F.count_if(~F.col("asked") & (F.col("row_type") == "section") & ~gates.skipped_sheet(F.col("title"))).alias("sections_skipped"),
        F.count_if(F.col("asked")).alias("groups_seen"),
        F.count_if(F.col("asked") & (F.col("reference") != "")).alias("matched_rows"),
        F.count_if(F.col("asked") & (F.col("reference") == "")).alias("unmatched_rows"),
    )
