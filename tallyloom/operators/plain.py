"""References by rules alone: rows are gathered into requirement groups, each group's merged constraints
meet the catalog of every vendor, and the reference stands in all rows of the group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constraints as cs
from ..functions import rules as R
from ..functions import text as tx
from ..sources.staged import staged
from . import fit, gates
from . import shape as sh

SHEET, ROW = ["doc_id", "sheet_no"], ["doc_id", "sheet_no", "row_no"]
SKIP = ["References", "Admin_Guide_Reference_Tag"]
#: Columns that a sheet gets, in this order.
OUTPUT = ["References", "Hardware_Reference_Reasoning", "Admin_Guide_Reference", "Admin_Guide_Reference_Reasoning", "Admin_Guide_Reference_Tag", "Reference_Match_Details"]
#: Categories that ask for a product without anything measured.
UNMEASURED = [
    "CENTRALIZED_MANAGEMENT", "SIEM_SOC", "NDR", "ENDPOINT_SECURITY", "IDENTITY_ACCESS", "PAM", "SDN_AUTOMATION", "SANDBOX", "EMAIL_SECURITY", "NAC", "DECEPTION", "SOAR", "SASE",
    "SECURE_WEB_GATEWAY", "DDOS_MITIGATION", "DIGITAL_RISK_PROTECTION", "NETWORK_PERFORMANCE_MONITORING", "AI_NETWORK_OPERATIONS", "CLOUD_SECURITY", "WAN_EXTENDER", "VOIP_SECURITY",
    "VIDEO_SECURITY",
]
GROUP_TITLES = ["firewall", "fortigate", "appliance", "switch", "router", "controller"]


def widened(headers: Column) -> Column:
    """Headers with the output columns: each once, the guide's reasons right behind its references."""
    h = F.coalesce(headers, F.array().cast("array<string>"))
    for name in OUTPUT:
        there = F.array_contains(h, name)
        if name == "Admin_Guide_Reference_Reasoning":
            h = F.when(there, h).otherwise(F.array_insert(h, (F.array_position(h, "Admin_Guide_Reference") + 1).cast("int"), F.lit(name)))
        else:
            h = F.when(there, h).otherwise(F.array_append(h, F.lit(name)))
    return h


def mentions(rows: DataFrame, products: DataFrame, text: str, key: list[str]) -> DataFrame:
    """key, direct: references of the models that a text names, a blank in a name standing for any blanks and hyphens, between
    characters that are neither letters nor digits. Texts and models meet on the model's first token: a token of the
    text that begins with it, as the rest may follow without a blank."""
    name = F.trim(F.col("model"))
    first = F.lower(F.regexp_extract(name, r"([A-Za-z0-9]+)", 1))
    escaped = F.regexp_replace(name, r"([^A-Za-z0-9\s])", r"\\$1")
    pattern = F.concat(F.lit("(?i)(?<![A-Za-z0-9])"), F.regexp_replace(escaped, r"\s", r"[\\s-]*"), F.lit("(?![A-Za-z0-9])"))
    label = F.concat(F.when(F.coalesce(F.trim("vendor"), F.lit("")) != "", F.concat(F.trim("vendor"), F.lit(": "))).otherwise(""), name)
    url = F.coalesce("url", F.lit(""))
    names = products.where(F.coalesce(name, F.lit("")) != "").select("ord", first.alias("_token"), pattern.alias("_pattern"), F.when(url != "", F.concat(label, F.lit(" — "), url)).otherwise(label).alias("_label"))
    sizes = F.array_distinct(F.transform(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1)), lambda t: t))
    starts = F.array_distinct(F.flatten(F.transform(sizes, lambda t: F.transform(F.sequence(F.lit(1), F.length(t)), lambda n: F.left(t, n)))))
    asked = rows.where(F.length(text) > 0).select(*key, F.col(text).alias("_text"), F.explode(starts).alias("_token"))
    hits = asked.join(names, "_token").where(F.expr("_text RLIKE _pattern"))
    rolled = hits.groupBy(*key).agg(F.sort_array(F.collect_set(F.struct("ord", "_label"))).alias("_m"))
    return rolled.select(*key, F.array_distinct(F.transform("_m", lambda m: m["_label"])).alias("direct"))


def group_key(title: Column, headers: Column, cells: Column) -> Column:
    """The key that rows of one product in a sheet share, or null: a numbered row with something measured, in a sheet about
    hardware; named after the sheet's title, else its first header."""
    first = F.trim(F.coalesce(F.get(cells, F.lit(0)), F.lit("")))
    about = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.array_join(F.slice(headers, 1, 4), " ")))
    label = F.coalesce(cs.filled(title), cs.filled(F.get(headers, F.lit(0))), "device_type")
    key = F.regexp_replace(F.regexp_replace(F.lower(label), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    named = F.coalesce(cs.filled(F.left(key, F.lit(80))), F.lit("hardware"))
    numbered = (first == "") | first.rlike(r"^\d+[\).\s-]*$")
    return F.when(F.col("device_type").isNotNull() & cs.measured() & numbered & tx.any_of(about, GROUP_TITLES), named)


def merged(rows: DataFrame, by: list[str]) -> DataFrame:
    """by and the constraints of each group: the first category, the largest numbers and interface counts, all flags and
    modes and features in order of their first row, and the texts joined by bars, 1,000 characters at most."""
    order = F.col("row_no")
    union = lambda c: F.array_distinct(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct(order.alias("o"), F.col(c).alias("x")))), lambda s: s["x"])))
    out = rows.groupBy(*by).agg(
        F.min_by("device_type", F.when(F.col("device_type").isNotNull(), order)).alias("device_type"),
        F.array_distinct(F.flatten(F.collect_list("flags"))).alias("flags"), union("ha_modes").alias("ha_modes"), union("features").alias("features"),
        F.left(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row_no", "text"))), lambda s: s["text"]), " | "), F.lit(1000)).alias("source_text"),
        F.bool_or("asks").alias("asks"), F.min(F.when(F.col("primary"), order)).alias("_flagged"), F.min(order).alias("_first"), F.count(F.lit(1)).alias("n_rows"),
        F.array_distinct(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("row_no", "direct"))), lambda s: F.coalesce(s["direct"], F.array().cast("array<string>"))))).alias("direct"),
    )
    for name, kind in (("numbers", "double"), ("interfaces", "bigint")):
        most = rows.select(*by, F.explode(name).alias("k", "v")).groupBy(*by, "k").agg(F.max("v").alias("v"))
        maps = most.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias(name))
        out = out.join(maps, by, "left").withColumn(name, F.coalesce(name, cs.empty(f"map<string,{kind}>")))
    return out.withColumn("primary_row", F.coalesce("_flagged", "_first")).drop("_flagged", "_first")


def admin_tag(features: Column, category: Column) -> Column:
    """The tag that asks the guide for a row's features, as JSON; empty without any."""
    query = F.array_join(features, " ")
    body = F.struct(F.lit(True).alias("reference_needed"), query.alias("lookup_query"), features.alias("fortinet_feature_candidates"), features.alias("fortinet_domains"), category.alias("device_category"), F.lit("medium").alias("priority"))
    return F.when(F.size(features) > 0, F.to_json(body)).otherwise("")


def inject_hardware_references(rows: DataFrame, products: DataFrame) -> DataFrame:
    """rows with the six output columns, reference, tag and group_id (null for rows that ask for nothing). rows: doc_id,
    sheet_no, title, headers, row_no, row_type, cells, metadata (VARIANT); products: vendor, model, category, url,
    product, ord. Sheets about qualification stay as they are."""
    title = F.col("title")
    skip = tx.any_of(gates.low(title), gates.PLAIN_SKIPPED)
    rows = rows.withColumn("cells", F.transform(F.coalesce("cells", F.array().cast("array<string>")), lambda c: F.coalesce(c, F.lit(""))))
    header = lambda i: F.coalesce(F.trim(F.get("headers", i)), F.lit(""))
    text = F.array_join(F.array_compact(F.transform("cells", lambda c, i: F.when((c != "") & ~header(i).isin(*SKIP), c))), " | ")
    heads = F.array_join(F.slice(F.coalesce("headers", F.array().cast("array<string>")), 1, 4), " | ")
    some = lambda c: F.when(F.trim(c) != "", c)
    own = rows.where(~skip & (F.col("row_type") != "section")).withColumns({"text": text, "meta": cs.metadata(F.col("metadata"))})
    own = own.withColumn("context", F.concat_ws(" | ", some(title), some(heads), F.col("text"))).drop("metadata")
    own = staged(cs.effective(own, "meta", "context"))
    told = gates.flag("meta", "requires_reference", True)
    silent = F.size("meta.top") == 0
    port = tx.plain(F.col("context")).rlike(R.FLAGS["ha_port"])
    own = own.withColumn("flags", F.when(port, F.col("flags")).otherwise(F.array_remove("flags", "ha_port")))
    listed = F.from_json(cs.filled(F.try_element_at(F.col("meta.top"), F.lit("fortinet_feature_candidates"))), "array<string>")
    own = own.withColumn("features", F.filter(F.transform(F.coalesce(listed, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != ""))
    own = staged(own.where("NOT found.excluded").join(mentions(own, products, "text", ROW), ROW, "left"))
    named = F.col("direct").isNotNull()
    wanted = told | gates.catalog_wanted(F.col("context")) | named
    whole = F.col("device_type").isNotNull() & (cs.hard() | F.col("device_type").isin(*UNMEASURED))
    asks = wanted | F.when(silent | ~cs.has(F.col("meta.top"), F.lit("requires_reference")), whole).otherwise(False)
    eligible = F.coalesce(F.col("device_type").isNotNull() & (named | gates.hardware_wanted(F.col("text"))) & asks, F.lit(False))
    own = own.withColumns({"_ok": eligible, "asks": F.coalesce(wanted, F.lit(False)), "_key": group_key(title, F.col("headers"), F.col("cells")), "primary": silent | gates.flag("meta", "group_primary_row", True)})
    sections = rows.where(~skip & (F.col("row_type") == "section")).select(*ROW, F.lit(None).cast("string").alias("_key"))
    line = sh.islands(staged(own).where("_ok").select(*ROW, "_key").unionByName(sections), SHEET, ["row_no"], "_key")
    explicit = cs.filled(F.try_element_at(F.col("meta.top"), F.lit("requirement_group_id")))
    auto = F.when(F.col("_key").isNotNull(), F.concat(F.lit("AUTO_"), F.col("island").cast("string"), F.lit("_"), F.col("_key")))
    members = own.where("_ok").drop("_key").join(line, ROW).withColumn("group_id", F.coalesce(explicit, auto, F.concat(F.lit("ROW_"), (F.col("row_no") + 1).cast("string"))))
    members = staged(members.select(*ROW, "group_id", "text", "features", "direct", "asks", "primary", *cs.SPEC))
    by = [*SHEET, "group_id"]
    groups = staged(merged(members, by))
    goods = fit.with_specs(products)
    others = [r[0] for r in products.select("vendor").where("vendor <> ''").distinct().orderBy("vendor").limit(1000).collect()] or R.NETWORK_VENDORS
    got = fit.matched(groups, goods, by, fit.vendors_for(F.col("device_type"), others), F.concat_ws(" ", "source_text", F.array_join("features", " ")))
    ref = F.when(F.col("model").isNotNull(), fit.reference(F.col("vendor"), F.col("model"), F.col("p_url"), " — "))
    why = F.when(F.col("model").isNull(), F.concat("vendor_asked", F.lit(": no catalog item met all hard constraints without being under-spec."))).otherwise(F.format_string("%s: selected %s, the closest weighted fit among %s valid catalog candidates. Top valid candidates: %s.", "vendor_asked", "model", F.col("valid").cast("string"), F.array_join(F.slice("top", 1, 3), "; ")))
    detail = F.to_json(F.struct("vendor_asked", "model", "category", "matched", "valid", "top", "rejected", "confidence"))
    rolled = got.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("vendor_no", ref.alias("r"), why.alias("w"), detail.alias("d")))).alias("_v"))
    part = lambda f: F.transform("_v", lambda v: v[f])
    matchable = F.col("device_type").isNotNull() & (F.col("asks") | cs.hard() | F.col("device_type").isin(*UNMEASURED))
    found = F.array_join(F.array_compact(part("r")), " | ")
    review = F.concat(F.lit("[Review Required] No compliant catalog match found for "), "device_type", F.lit("."))
    groups = groups.join(rolled, by, "left").withColumn("_found", F.coalesce(found, F.lit("")))
    reference = F.when(matchable, F.when(F.col("_found") != "", F.col("_found")).otherwise(review)).otherwise(F.array_join("direct", " | "))
    direct = F.when(~matchable & (F.size("direct") > 0), "Used the model that the requirement names, as nothing measurable was stated.")
    groups = groups.select(*by, "primary_row", reference.alias("reference"), F.coalesce(direct, F.array_join(part("w"), "\n\n"), F.lit("")).alias("_why"), F.coalesce(F.concat(F.lit("["), F.array_join(part("d"), ","), F.lit("]")), F.lit("")).alias("_details"))
    cells = members.select(*ROW, "group_id").join(groups, by)
    main = F.col("row_no") == F.col("primary_row")
    cells = cells.select(*ROW, "group_id", "reference", F.when(main, F.col("_why")).otherwise("").alias("reasoning"), F.when(main, F.col("_details")).otherwise("").alias("details"))
    tags = own.select(*ROW, admin_tag(F.col("features"), F.col("device_type")).alias("tag"))
    out = rows.join(cells, ROW, "left").join(tags, ROW, "left").withColumns({c: F.coalesce(c, F.lit("")) for c in ("reference", "reasoning", "details", "tag")})
    values = dict(zip(OUTPUT, ("reference", "reasoning", None, None, "tag", "details")))
    out = out.withColumn("_wide", F.when(skip, F.col("headers")).otherwise(widened(F.col("headers"))))
    value = lambda h: F.coalesce(*(F.when(h == n, F.col(c) if c else F.lit("")) for n, c in values.items()))
    filled = F.transform("_wide", lambda h, i: F.coalesce(value(h), F.get("cells", i), F.lit("")))
    return out.withColumns({"cells": F.when(skip, F.col("cells")).otherwise(filled), "headers": F.col("_wide")}).drop("_wide")
