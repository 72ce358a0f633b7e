"""References for power, cooling and racks: catalogs are hydrated and merged, requirements read by ordered
rules, and candidates that say nothing about a field pass it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import constraints as cs
from ..functions import rules as R
from ..functions import text as tx
from ..sources.staged import staged
from . import blocks as bl
from . import fit, gates, inject

SHEET, ROW = bl.SHEET, [*bl.SHEET, "row_no"]
#: Words of a category, the first that fits wins.
CATEGORIES = [
    ("UPS", ["ups", "uninterruptible", "battery", "runtime", "online", "double conversion"]), ("ENERGY_STORAGE", ["battery", "energy storage", "bess", "lithium"]),
    ("DC_POWER", ["dc power", "rectifier", "netsure", "48v"]), ("POWER_DISTRIBUTION", ["pdu", "power distribution", "busway", "rpp", "panelboard"]),
    ("TRANSFER_SWITCH", ["transfer switch", "static transfer", "sts", " ats", "ats-", "dc-ats"]), ("SWITCHGEAR", ["switchgear", "switchboard"]), ("BUSWAY", ["busway", "busduct"]),
    ("COOLING", ["cooling", "thermal", "in-row", "inrow", "room cooling", "chiller", "heat rejection", "crac", "crv"]), ("COOLING_CONTROL", ["controller", "thermal control", "monitoring"]),
    ("RACK", ["rack", "cabinet", "enclosure", "42u", "45u", "48u", "containment", "cable manager", "cable management", "blank panel"]), ("ENCLOSURE", ["outdoor enclosure", "enclosure", "cabinet"]),
    ("INTEGRATED_RACK_SOLUTION", ["integrated", "micro data center", "smartaisle", "smartrow", "smartcabinet"]), ("MONITORING", ["monitoring", "sensor", "environmental", "gateway", "rdu"]),
    ("SERIAL_CONSOLE", ["serial console", "console", "gateway"]), ("KVM", ["kvm", "lcd tray", "console", "switch"]), ("SOFTWARE", ["software", "platform", "management"]),
]
CANONICAL = [
    ("ENERGY_STORAGE", ["energy storage", "bess", "battery energy"]), ("POWER_DISTRIBUTION", ["power distribution", "rack pdu", "pdu"]), ("COOLING", ["thermal management", "cooling", "in-row", "in row"]),
    ("MONITORING", ["monitoring", "management"]), ("RACK", ["rack", "enclosure"]), ("INTEGRATED_RACK_SOLUTION", ["containment", "integrated data center", "smartaisle"]), ("UPS", ["ups", "uninterruptible"]),
]
#: Overrides of the category by patterns, in order; a later one counts over an earlier one.
OVERRIDES = [
    ("RACK", r"\b(cable manager|cable management|blank panel|brush strip|mounting plastic blank|rack accessory)\b"), ("TRANSFER_SWITCH", r"\b(dc-ats|ats-|ats\b|static transfer|transfer switch)\b"),
    ("POWER_DISTRIBUTION", r"\b(rpdu|rack pdu|pdu\b|power distribution)\b"),
    ("POWER_DISTRIBUTION", r"\b(modular power distribution|rack based modular power distribution|ups output|hot plug mcb|bms,\s*modbus|touch screen)\b"),
    ("INTEGRATED_RACK_SOLUTION", r"\b(containment|hot\s*/\s*cold aisle|hot aisle|cold aisle|aisle containment)\b"),
]
STORAGE, MODULE = r"\b(lithium[- ]ion battery|battery rack|battery module|battery cabinet)\b", r"\b(power module|battery circuit|ground short)\b"
SENSOR = r"\b(temperature.*sensor|humidity.*sensor|water sensor|environmental sensor)\b"
REDUNDANT = r"\b(n\+1|redundan|dual power|active/passive|active-passive|ha\b|high availability)"
FIELDS = {
    "power_capacity_kva": r"(\d+(?:\.\d+)?)\s*kva\b", "power_capacity_kw": r"(\d+(?:\.\d+)?)\s*kw\b", "cooling_capacity_kw": r"(\d+(?:\.\d+)?)\s*kw\b", "rack_units": r"\b(\d+)\s*u\b",
    "static_load_kg": r"([\d,]+)\s*kg\b", "outlet_count": r"(\d+)\s*(?:outlet|socket|receptacle)",
}
REDUNDANCY_WORDS = ["redundan", "dual power", "n+1", "ha", "high availability", "hot_swappable"]
BAD_URL = ["code-of-conduct", "code_of_conduct", "ethics", "compliance", "foss-information", "obsolete"]
SCOPE = {
    "SPLIT_AC": "split AC / non-Vertiv packaged air-conditioning scope", "VIDEO_WALL": "video wall / display scope", "CCTV": "CCTV scope", "FIRE_SYSTEM": "fire detection or fire suppression scope",
    "ACCESS_CONTROL": "access control scope",
}


def canonical(c: Column) -> Column:
    """The category that a catalog's words stand for, else the words in capitals."""
    low = F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")))
    plain = F.upper(F.regexp_replace(F.regexp_replace(low, "[^a-z0-9]+", "_"), "^_+|_+$", ""))
    return F.when(low != "", F.coalesce(tx.first_category(low, CANONICAL), plain))


def first_number(c: Column) -> Column:
    """The first number of a text, commas between thousands left out; the max, else the min, of an object."""
    v = F.try_parse_json(c)
    inner = F.coalesce(F.try_variant_get(v, "$.max", "string"), F.try_variant_get(v, "$.min", "string"))
    raw = F.when(c.startswith("{"), inner).otherwise(c)
    return F.replace(F.regexp_extract(raw, r"(\d+(?:,\d{3})*(?:\.\d+)?)", 1), F.lit(","), F.lit("")).try_cast("double")


def datasheet(url: Column) -> Column:
    """A public datasheet's address, or null."""
    low = F.lower(F.trim(F.coalesce(url, F.lit(""))))
    good = low.rlike("^https?://") & ~low.contains("partners.vertiv.com/english/directory") & ~tx.any_of(low, BAD_URL) & low.contains(".pdf")
    return F.when(good, F.trim(url))


def product_page(url: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(url, F.lit(""))))
    return F.when(low.rlike("^https?://") & ~low.contains("partners.vertiv.com/english/directory"), F.trim(url))


def model_key(model: Column) -> Column:
    """A model's name without the vendor's and signs."""
    low = F.lower(F.trim(F.regexp_replace(F.coalesce(model, F.lit("")), r"\s+", " ")))
    plain = F.trim(F.regexp_replace(F.regexp_replace(low, r"\bvertiv\b|\(tm\)|\(r\)|tm|registered", " "), "[^a-z0-9]+", " "))
    return F.coalesce(cs.filled(plain), low)


def url_quality(url: Column, model: Column) -> Column:
    low = F.lower(F.coalesce(url, F.lit("")))
    words = F.array_distinct(F.filter(F.split(model_key(model), " "), lambda t: F.length(t) > 2))
    on = lambda terms, x: F.when(tx.any_of(low, terms), x).otherwise(0)
    return on(["/products/", "/shared/"], 2) + on(["datasheet", "data-sheet", "-ds-"], 4) + on(["brochure", "-br-"], 3) - on(["obsolete"], 4) + F.size(F.filter(words, lambda t: F.contains(low, t)))


def normalized(products: DataFrame) -> DataFrame:
    """ord, vendor, model, category, datasheet_url, product_url, specs (map of text) of a catalog scan: names from product_name,
    the vendor by default, and the summary of the technical specifications where the product itself says nothing."""
    top = F.coalesce(F.try_variant_get("product", "$", cs.TEXTS), cs.empty(cs.TEXTS))
    summary = F.coalesce(F.try_variant_get("product", "$.technical_specifications.normalized_summary", cs.TEXTS), cs.empty(cs.TEXTS))
    get = lambda n: cs.filled(F.try_variant_get("product", f"$.{n}", "string"))
    specs = F.map_concat(top, F.map_filter(summary, lambda k, _: ~cs.has(top, k)))
    return products.select("ord", F.coalesce("vendor", F.lit("Vertiv")).alias("vendor"), "model", canonical(F.col("category")).alias("category"), get("datasheet_url").alias("datasheet_url"), get("product_url").alias("product_url"), specs.alias("specs"))


def kin(a: Column, b: Column) -> Column:
    return F.array_contains(fit.serving(a, "vertiv"), b)


def token_links(left: DataFrame, right: DataFrame, rule) -> DataFrame:
    """left rows (ord, category, _tokens) with the best right row (r_ord, r_category, r_tokens, r_bonus): they share tokens, and rule
    scores the pair (null: no match); the first of equals. Rows without a match are left out."""
    a = left.select("ord", "category", "_tokens", F.explode("_tokens").alias("_t"))
    b = right.select("r_ord", "r_category", "r_tokens", "r_bonus", F.explode("r_tokens").alias("_t"))
    pairs = a.join(b, "_t").groupBy("ord", "r_ord").agg(*(F.first(c).alias(c) for c in ("category", "_tokens", "r_category", "r_tokens", "r_bonus")), F.count(F.lit(1)).alias("_n"))
    pairs = pairs.withColumn("_s", rule).where("_s IS NOT NULL")
    return pairs.groupBy("ord").agg(F.min_by("r_ord", F.struct((-F.col("_s")).alias("s"), "r_ord")).alias("r_ord"))


def keyed(df: DataFrame) -> DataFrame:
    return df.withColumn("_tokens", F.array_distinct(F.split(model_key(F.col("model")), " ")))


def hydrated_specs(products: DataFrame, extracted: DataFrame) -> DataFrame:
    """products whose specs lack technical_specifications, with those of the extracted product (ord, model, category, specs) that
    shares most tokens of the name: two at least (or all, if it has one), three more where one name holds the other."""
    n, size = F.col("_n"), lambda c: F.size(c)
    whole = (n == size("r_tokens")) | (n == size("_tokens"))
    fits = F.col("category").isNull() | F.col("r_category").isNull() | kin(F.col("category"), F.col("r_category"))
    score = F.when(fits & (size("_tokens") >= 2) & (n >= F.least(F.lit(2), size("r_tokens"))) & (whole | (n >= 2)), n + F.when(whole, 3).otherwise(0))
    right = keyed(extracted).select(F.col("ord").alias("r_ord"), F.col("category").alias("r_category"), F.col("_tokens").alias("r_tokens"), F.lit(0).alias("r_bonus"), F.col("specs").alias("r_specs"))
    found = token_links(keyed(products), right, score).join(right.select("r_ord", "r_specs"), "r_ord").drop("r_ord")
    out = products.join(found, "ord", "left")
    bare = ~cs.has(F.col("specs"), F.lit("technical_specifications")) & F.col("r_specs").isNotNull()
    more = F.map_filter("r_specs", lambda k, _: ~cs.has(F.col("specs"), k))
    return out.withColumn("specs", F.when(bare, F.map_concat(F.col("specs"), more)).otherwise(F.col("specs"))).drop("r_specs")


def hydrated_links(products: DataFrame, links: DataFrame) -> DataFrame:
    """products with public addresses: their own, else those of the link (ord, model, category, datasheet_url, product_url) with the
    same name (one with a datasheet first), else of one of the same category whose name holds all their tokens."""
    own = products.withColumns({"_own": datasheet(F.col("datasheet_url")), "_key": model_key(F.col("model"))})
    good = links.withColumns({"_d": datasheet(F.col("datasheet_url")), "_p": product_page(F.col("product_url")), "_key": model_key(F.col("model"))}).where("_d IS NOT NULL OR _p IS NOT NULL")
    exact = good.groupBy("_key").agg(F.min_by(F.struct("_d", "_p"), F.struct(F.col("_d").isNull().alias("x"), "ord")).alias("_e"))
    n = F.col("_n")
    score = F.when((F.size("_tokens") >= 2) & (n == F.size("_tokens")) & (F.col("category").isNull() | (F.col("category") == F.col("r_category"))), n + F.col("r_bonus"))
    right = keyed(good).select(F.col("ord").alias("r_ord"), F.col("category").alias("r_category"), F.col("_tokens").alias("r_tokens"), F.when(F.col("_d").isNotNull(), 5).otherwise(0).alias("r_bonus"), F.struct("_d", "_p").alias("_l"))
    near = token_links(keyed(own.where("_own IS NULL")), right, score).join(right.select("r_ord", "_l"), "r_ord").drop("r_ord")
    out = own.join(exact, "_key", "left").join(near, "ord", "left").withColumn("_x", F.coalesce("_e", "_l"))
    page = F.when(F.col("_own").isNotNull(), F.coalesce(product_page(F.col("product_url")), F.lit(""))).otherwise(F.coalesce("_x._p", "product_url"))
    return out.withColumns({"datasheet_url": F.coalesce("_own", "_x._d", "datasheet_url"), "product_url": page}).drop("_own", "_key", "_e", "_l", "_x")


def merged(products: DataFrame) -> DataFrame:
    """One product for each name and category, in the order of the first: the first of each specification, the datasheet of the
    highest quality, the first public page."""
    by = [model_key(F.col("model")).alias("_key"), F.coalesce("category", F.lit("")).alias("_cat")]
    sheet = datasheet(F.col("datasheet_url"))
    specs = products.select(*by, "ord", F.explode("specs").alias("k", "v")).where("v IS NOT NULL AND v NOT IN ('', '{}', '[]')")
    specs = specs.groupBy("_key", "_cat", "k").agg(F.min_by("v", "ord").alias("v")).groupBy("_key", "_cat").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("specs"))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("ord"))).alias(c)
    best = F.max_by(sheet, F.when(sheet.isNotNull(), F.struct(url_quality(sheet, F.col("model")).alias("q"), (-F.col("ord")).alias("o"))))
    page = F.min_by(product_page(F.col("product_url")), F.when(product_page(F.col("product_url")).isNotNull(), F.col("ord")))
    rows = products.groupBy(*by).agg(F.min("ord").alias("ord"), first("vendor"), first("model"), first("category"), best.alias("datasheet_url"), page.alias("product_url"))
    return rows.join(specs, ["_key", "_cat"], "left").withColumn("specs", F.coalesce("specs", cs.empty(cs.TEXTS))).drop("_key", "_cat")


def load_catalog(scan: DataFrame, extracted: DataFrame | None = None) -> DataFrame:
    """A catalog ready for matching, with p_fields (map of numbers) and chunk (lower text): normalised, hydrated with extracted
    specifications and public links, of this vendor only, duplicates merged. scan, extracted: catalog scans with ord."""
    rows = normalized(scan)
    links = rows
    if extracted is not None:
        more = normalized(extracted)
        rows = hydrated_specs(rows, more).unionByName(more)
    rows = merged(staged(hydrated_links(rows, links)).where(F.lower("vendor").isin("vertiv", "")))
    numbers = cs.entries(cs.words(FIELDS), lambda f: first_number(F.try_element_at(F.col("specs"), f)))
    chunk = F.lower(F.array_join(F.transform(F.map_entries("specs"), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), " | "))
    return staged(rows.withColumns({"p_fields": numbers, "chunk": chunk, "sub": F.lower(F.coalesce(F.try_element_at("specs", F.lit("subheading")), F.lit("")))}))


def parse(df: DataFrame, text: str, meta: str | None = None) -> DataFrame:
    """df with category, unsupported, fields (map), accessory and redundancy that a text asks for."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    named = F.coalesce(*(cs.filled(F.try_element_at(F.col(f"{meta}.top"), F.lit(k))) for k in ("device_type", "device_category", "category"))) if meta else F.lit(None).cast("string")
    base = tx.first_category(F.concat(F.lower(F.coalesce(named, F.lit(""))), F.lit(" "), low), CATEGORIES)
    found = base
    for name, pattern in OVERRIDES:
        found = F.when(low.rlike(pattern), name).otherwise(found)
    found = F.when(low.rlike(STORAGE), "ENERGY_STORAGE").when(low.rlike(MODULE), "UPS").otherwise(found)
    found = F.when(low.contains("monitoring server"), "MONITORING").otherwise(found)
    found = F.when(low.rlike(SENSOR), "COOLING_CONTROL").otherwise(found)
    value = lambda f: F.replace(F.regexp_extract(low, FIELDS[f], 1), F.lit(","), F.lit("")).try_cast("double")
    accessory = low.rlike(OVERRIDES[0][1])
    cool = F.coalesce(base == "COOLING", F.lit(False))
    kept = {f: value(f) for f in FIELDS}
    kept["rack_units"] = F.when(~accessory, kept["rack_units"])
    kept["cooling_capacity_kw"] = F.when(cool, kept["cooling_capacity_kw"])
    df = df.withColumns({"category": found, "unsupported": gates.unsupported(F.col(text)), "accessory": accessory, "redundancy": low.rlike(REDUNDANT)})
    kw = F.when(~cool & ~F.coalesce(F.col("category") == "ENERGY_STORAGE", F.lit(False)), kept["power_capacity_kw"])
    kept["power_capacity_kw"] = kw
    pairs = F.array(*(F.struct(F.lit(f).alias("key"), v.alias("value")) for f, v in kept.items()))
    return df.withColumn("fields", F.map_from_entries(F.filter(pairs, lambda e: e["value"].isNotNull())))


def score() -> Column:
    """The additive score of a pair of a requirement (_q, _terms, category as need, accessory) and a product."""
    q, c, need = F.col("_q"), F.col("chunk"), F.col("need")
    m = F.lower(F.coalesce(F.col("model"), F.lit("")))
    on = lambda cond, x: F.when(F.coalesce(cond, F.lit(False)), x).otherwise(0.0)
    some = lambda col, *terms: tx.any_of(col, terms)
    long = F.filter("_terms", lambda t: F.length(t) > 2)
    both = F.size(F.array_intersect(long, F.col("_tokens")))
    semantic = F.when((F.size(long) > 0) & (F.size("_tokens") > 0), both / F.sqrt(F.size(long) * F.size("_tokens"))).otherwise(0.0)
    key = model_key(F.col("model"))
    parts = F.filter(F.split(key, " "), lambda t: F.length(t) > 2)
    mention = F.when(F.contains(q, m) | F.contains(q, key), 0.75).when((F.size(parts) >= 2) & (F.size(F.array_except(parts, F.col("_terms"))) == 0), 0.45).otherwise(0.0)
    out = semantic + F.least(F.size(F.filter(long, lambda t: F.contains(c, t))) / 25.0, F.lit(0.25)) + mention
    out = out + F.when(F.col("category") == need, 0.3).when(F.coalesce(kin(need, F.col("category")), F.lit(False)), 0.15).otherwise(0.0)
    cool, ups, bank, dist, watch, sense = (need == k for k in ("COOLING", "UPS", "ENERGY_STORAGE", "POWER_DISTRIBUTION", "MONITORING", "COOLING_CONTROL"))
    row = some(F.col("sub"), "in-row", "in row")
    out = out + on(cool & q.rlike(r"\bin[- ]?row\b") & row, 0.25) + on(cool & q.rlike(r"\b300\s*mm\b") & (m.contains("crv") | some(m, "in-row", "in row") | some(F.col("sub"), "crv") | row), 0.5)
    aisle = (need == "INTEGRATED_RACK_SOLUTION") & c.contains("smartaisle")
    out = out + on(aisle, 0.6) + on(aisle & c.contains("smartaisle 2"), 0.2)
    out = out + on(ups & q.rlike(r"\b(power module|battery circuit|ground short|lithium-ion battery rack)\b") & m.contains("apm"), 0.6)
    out = out + on(ups & q.rlike(r"\b120\s*kw\b|\b(?:25|30)\s*kw\s+to\s+150\s*kw\b|hot swappable.*modular") & m.contains("apm2"), 0.7)
    cell = bank & q.rlike(r"\b(lithium|battery rack|battery module)\b")
    out = out + on(cell & m.contains("hpl p1"), 2.0) + on(cell & some(m, "lithium-ion battery cabinet", "lithium ion battery cabinet"), 0.6) + on(cell & some(m, "energycore", "battery"), 0.5)
    panel = dist & q.rlike(r"\b(modular power distribution|ups output|system capacity|hot plug mcb|touch screen|bms|modbus)\b")
    out = out + on(panel & m.contains("spm"), 1.2) - on(panel & some(m, "rack pdu", "rpdu", "geist", "powergo"), 0.6)
    out = out + on(watch & q.contains("monitoring server") & m.contains("rdu501"), 0.8) + on(sense & q.contains("water sensor") & some(m, "water sensing", "water sensor"), 0.8)
    out = out + on(sense & some(q, "temperature", "humidity") & some(m, "temperature", "humidity"), 0.5)
    part = F.col("accessory") & (F.col("category") == "RACK")
    return out + on(part, 0.25) + on(part & some(c, "cable management", "cable manager", "blank panel", "accessories"), 0.25)


def safe() -> Column:
    """A product that is of a kin category, is not below a field that it states, and is redundant where that is asked for."""
    low = F.forall(F.map_entries("fields"), lambda e: F.coalesce(F.try_element_at(F.col("p_fields"), e["key"]) >= e["value"], F.lit(True)))
    near = F.col("need").isNull() | F.coalesce(kin(F.col("need"), F.col("category")), F.lit(False))
    return F.col("unsupported").isNull() & near & low & (~F.col("redundancy") | tx.any_of(F.col("chunk"), REDUNDANCY_WORDS))


def tightness() -> Column:
    """The mean of how far a product goes beyond each field, 1 at least; 999 where it states none of them."""
    over = F.transform(F.filter(F.map_entries("fields"), lambda e: (e["value"] > 0) & F.try_element_at(F.col("p_fields"), e["key"]).isNotNull()), lambda e: F.greatest(F.element_at(F.col("p_fields"), e["key"]) / e["value"], F.lit(1.0)))
    return F.when(F.size(over) > 0, F.aggregate(over, F.lit(0.0), lambda t, x: t + x) / F.size(over)).otherwise(999.0)


def chosen(asks: DataFrame, catalog: DataFrame, key: list[str], top_k: int = 8) -> DataFrame:
    """key, and the product that is taken (null for none) for each requirement (key, query, category, unsupported, fields, accessory,
    redundancy): of the top_k retrieved (among those that share a word with the query) the safe ones (all, if none is safe), of these those with a datasheet (all, if none has
    one), of these the tightest. match_status, reference, reasoning, score say how."""
    asks = staged(asks.withColumnRenamed("category", "need")).withColumns({"_q": F.lower("query"), "_terms": inject.tokens(F.col("query"))})
    goods = catalog.withColumn("_tokens", inject.tokens(F.col("chunk")))
    pairs = asks.where("unsupported IS NULL").select("*", F.explode("_terms").alias("_t")).join(goods.select("*", F.explode("_tokens").alias("_t")), "_t").drop("_t").dropDuplicates([*key, "ord"])
    pairs = pairs.withColumn("score", score())
    pairs = pairs.withColumn("_rn", F.row_number().over(Window.partitionBy(*key, "model", "product_url").orderBy("ord"))).where("_rn = 1")
    pairs = staged(pairs.withColumn("_rank", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("score"), "ord"))).where(F.col("_rank") <= top_k).drop("_one", "_rn", "_tokens", "_terms"))
    pairs = pairs.withColumns({"_safe": safe(), "_sheet": datasheet(F.col("datasheet_url")).isNotNull(), "_tight": F.round(tightness(), 9)})
    w = Window.partitionBy(*key)
    pairs = pairs.withColumn("_in", F.col("_safe") | ~F.max("_safe").over(w)).where("_in")
    pairs = pairs.withColumn("_in", F.col("_sheet") | ~F.max("_sheet").over(w)).where("_in")
    best = pairs.groupBy(*key).agg(F.min_by(F.struct("model", F.col("category").alias("c"), "datasheet_url", "product_url", "score"), F.struct("_tight", (-F.col("score")).alias("s"), "_rank")).alias("won"))
    out = asks.drop("_q", "_terms").join(best, key, "left")
    scope = F.create_map(*(F.lit(x) for kv in SCOPE.items() for x in kv))
    none = F.concat(F.lit("Vertiv: no reference added because "), F.when(F.col("unsupported").isNotNull(), F.concat(F.lit("the requirement is "), F.try_element_at(scope, F.col("unsupported")))).otherwise("no relevant catalog candidates were retrieved"), F.lit("."))
    sheet = datasheet(F.col("won.datasheet_url"))
    ref = F.when(F.col("won").isNull(), "").otherwise(fit.reference(F.lit("Vertiv"), F.col("won.model"), F.coalesce(sheet, F.lit(""))))
    return out.withColumns({
        "reference": ref, "match_status": F.when(F.col("won").isNull(), "out_of_scope_or_no_safe_match").otherwise("rag_retrieval_match"),
        "reasoning": F.when(F.col("won").isNull(), none).otherwise(F.concat(F.lit("Vertiv: selected "), F.col("won.model"), F.lit(" from the top retrieved catalog evidence; it is not below any number that the catalog states."))),
        "confidence": F.round(F.least(F.greatest(F.col("won.score"), F.lit(0.0)), F.lit(1.0)), 2),
    })


def inject_power_references(rows: DataFrame, catalog: DataFrame, top_k: int = 8) -> DataFrame:
    """rows with the output columns and reference; rows as for ``inject.inject_references``, catalog from ``load_catalog``. Where
    no anchor row of a sheet finds a product, rows that the metadata calls continuations are tried as well."""
    rows = rows.withColumn("cells", F.transform(F.coalesce("cells", F.array().cast("array<string>")), lambda c: F.coalesce(c, F.lit(""))))
    own = rows.where(~gates.skipped_sheet(F.col("title")) & (F.col("row_type") != "section")).withColumn("meta", cs.metadata(F.col("metadata"))).drop("metadata")
    heads = F.coalesce("headers", F.array().cast("array<string>"))
    text = F.array_join(F.array_compact(F.transform("cells", lambda c, i: F.when((c != "") & ~F.coalesce(F.get(heads, i), F.lit("")).isin(*R.OUTPUT_COLUMNS), c))), " | ")
    own = own.withColumn("text", text).withColumn("context", bl.context(F.col("title"), heads, F.col("text")))
    own = own.withColumns({"_anchor": gates.reference_anchor("meta"), "_wanted": gates.power_reference(F.col("context"), gates.flag("meta", "requires_reference", True)), "_group": gates.group_of("meta")})
    own = staged(own)
    siblings = bl.parts_of(own.where("_group <> ''"), [*SHEET, "_group"], "_siblings")
    asks = own.join(siblings, [*SHEET, "_group"], "left")
    block = F.concat(F.col("context"), F.lit(" | Full product requirement block: "), bl.marked(F.col("_siblings"), F.col("row_no")))
    asks = asks.withColumn("_base", F.when(F.col("_anchor") & (F.size("_siblings") > 1), block).otherwise(F.col("context")))
    asks = staged(asks.withColumn("query", inject.build_query(F.col("_base"), "meta")).select(*ROW, "query", "meta", "_anchor", "_wanted"))
    asks = parse(asks, "query", "meta").where("(_anchor AND (_wanted OR unsupported IS NOT NULL)) OR (NOT _anchor AND _wanted)").drop("meta", "_wanted")
    got = staged(chosen(asks, catalog, ROW, top_k))
    hit = F.max(F.when(F.col("_anchor"), F.col("won").isNotNull()).otherwise(False)).over(Window.partitionBy(*SHEET))
    got = got.withColumn("_hit", hit).where("_anchor OR (NOT _hit AND won IS NOT NULL)")
    details = F.to_json(F.struct(F.lit("vertiv").alias("provider"), "match_status", "confidence", "query", F.struct(F.col("need").alias("category"), "fields", "unsupported", "redundancy").alias("constraints"), "won"))
    return inject.written(rows, got.select(*ROW, "reference", "reasoning", details.alias("details")), gates.skipped_sheet(F.col("title")))
