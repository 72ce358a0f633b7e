"""Constraints against products: hard filter over all kinds of fields, fit scores, closest fit.

Products carry their specifications as maps (``with_specs``), requirements theirs as the columns of
``functions.constraints``. A pair's checks are one array of structs, built and folded inside the
row: no pair is exploded by field.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import constraints as cs
from ..functions import rules as R
from ..functions import text as tx
from ..sources.staged import staged

CHECK = "array<struct<field:string,need:double,have:double,ok:boolean,weight:double,near:boolean>>"


def value(raw: Column) -> Column:
    """A specification: a number, a text, or an object whose max, value, required or min counts, in this order."""
    inner = lambda v: F.coalesce(*(cs.filled(F.try_variant_get(v, f"$.{n}", "string")) for n in ("max", "value", "required", "min")))
    return tx.bound(raw, lambda x: tx.number(cs.filled(F.when(x.startswith("{"), tx.bound(F.try_parse_json(x), inner)).otherwise(x))))


def with_specs(products: DataFrame, product: str = "product") -> DataFrame:
    """A table of products with p_numbers, p_interfaces, p_modes, p_flags, p_ports, p_options, p_speed and p_scale
    of the VARIANT column product; model names the product."""
    df = products.withColumn("_top", F.coalesce(F.try_variant_get(product, "$", cs.TEXTS), cs.empty(cs.TEXTS)))
    top = F.col("_top")
    get = lambda name: cs.filled(F.try_element_at(top, F.lit(name) if isinstance(name, str) else name))
    own = cs.entries(cs.words([f for f in R.NUMERIC_FIELDS if f not in ("ports", "storage_tb", "throughput_gbps")]), lambda f: value(get(f)))
    df = df.withColumn("p_numbers", own)
    for field, names in R.SPEC_ALIASES.items():
        if field not in ("max_ports", "throughput_gbps"):
            alias = F.coalesce(*map(get, names))
            df = df.withColumn("p_numbers", F.when(get(field).isNull(), cs.put(F.col("p_numbers"), field, value(alias))).otherwise(F.col("p_numbers")))
    plain = F.coalesce(value(get("throughput_gbps")), F.when(get("throughput_gbps").isNull(), tx.number(F.coalesce(*map(get, R.SPEC_ALIASES["throughput_gbps"])))))
    speed = F.when(get("throughput_mbps").isNotNull(), tx.number(get("throughput_mbps")) / 1000).otherwise(plain)
    df = df.withColumn("p_numbers", cs.put(F.col("p_numbers"), "throughput_gbps", speed))
    disk = F.coalesce(tx.number(get("storage_tb")), tx.number(get("storage_gb")) / 1024, tx.number(get("local_storage_gb")) / 1024)
    df = df.withColumn("p_numbers", cs.put(F.col("p_numbers"), "storage_tb", disk))
    ports = F.coalesce(F.try_variant_get(product, "$.interfaces", cs.TEXTS), cs.empty(cs.TEXTS))
    some = lambda name: F.when(~get(name).isin("0", "0.0"), get(name))
    listed = F.from_json(F.coalesce(get("main_port_options"), F.lit("[]")), "array<string>")
    fast = F.transform(F.regexp_extract_all(F.coalesce(get("main_port_speed"), F.lit("")), F.lit(r"(?i)(\d+(?:\.\d+)?)\s*G(?:bps)?"), F.lit(1)), lambda x: x.cast("double"))
    flags = [F.when(F.lower(get(f)) == "true", F.lit(f)) for f in R.BOOLEAN_FIELDS]
    names = F.transform(F.regexp_extract_all(F.coalesce(F.col("model"), F.lit("")), F.lit(r"(\d+)"), F.lit(1)), lambda x: x.cast("double"))
    scales = F.aggregate(cs.words(R.SCALE_FIELDS), F.lit(0.0), lambda t, f: t + F.coalesce(F.log(F.greatest(F.lit(1.0), tx.number(get(f)))), F.lit(0.0)))
    df = df.withColumns({
        "p_interfaces": F.transform_values(ports, lambda _, x: F.coalesce(tx.number(x).cast("bigint"), F.lit(0).cast("bigint"))),
        "p_modes": cs.modes(get("ha_modes")),
        "p_flags": F.array_compact(F.array(*flags)),
        "p_ports": tx.number(F.coalesce(some("ports"), some("max_ports"))),
        "p_options": F.array_sort(F.array_compact(F.transform(F.coalesce(listed, F.array().cast("array<string>")), lambda x: F.floor(tx.number(x)).cast("double")))),
        "p_speed": F.array_max(fast),
        "p_scale": F.coalesce(F.array_max(names), scales),
        "p_url": F.coalesce(get("datasheet_url"), get("product_url"), F.lit("")),
        "p_datasheet": F.coalesce(get("datasheet_url"), F.lit("")),
    }).drop("_top")
    return staged(df)


def port_count(need: Column) -> Column:
    """Ports of a product: stated, else the least option that is enough (the largest, if none is), else all
    interfaces; null if it says nothing."""
    enough = F.array_min(F.filter("p_options", lambda o: o >= need))
    every = F.when(F.size("p_interfaces") > 0, F.aggregate(F.map_values("p_interfaces"), F.lit(0).cast("bigint"), lambda t, x: t + x).cast("double"))
    chosen = F.when(F.size("p_options") > 0, F.coalesce(enough, F.array_max("p_options"))).otherwise(every)
    return F.coalesce(F.floor("p_ports").cast("double"), chosen)


def available(field: Column, need: Column) -> Column:
    own = F.try_element_at(F.col("p_numbers"), field)
    return F.when(field == "ports", port_count(need)).when(field == "max_ports", F.coalesce(own, port_count(need))).otherwise(own)


def interface_count(name: Column, need: Column) -> Column:
    """Interfaces that serve the required one; without any, the ports if they are fast enough."""
    serving = F.create_map(*(x for k, v in R.INTERFACE_COMPATIBILITY.items() for x in (F.lit(k), cs.words(v))))
    names = F.coalesce(F.try_element_at(serving, name), F.array(name))
    total = F.aggregate(names, F.lit(0).cast("bigint"), lambda t, x: t + F.coalesce(F.try_element_at(F.col("p_interfaces"), x), F.lit(0)))
    wide, plain = (F.regexp_extract(name, r"^(\d+)(?:_(\d+))?g", k).try_cast("double") for k in (2, 1))
    fast = F.col("p_speed") >= F.coalesce(wide, plain)
    return F.when(total > 0, total.cast("double")).when(fast, F.coalesce(port_count(need), F.lit(0.0))).otherwise(0.0)


def storage_passes(field: Column, need: Column, have: Column) -> Column:
    """A whole number of TB is met by 93 percent of it: disks are sold by decimal units."""
    return (field == "storage_tb") & (need > 0) & ((have >= need) | ((F.abs(need - F.round(need)) < 0.01) & (have >= need * 0.93)))


def checks(prefix: str = "") -> Column:
    """CHECK of each constraint, in fixed order: numbers, interfaces, flags, modes. need and have are null for flags and modes."""
    numbers, ports, flags, wanted = (F.col(f"{prefix}{n}") for n in ("numbers", "interfaces", "flags", "ha_modes"))
    weights = F.create_map(*(x for k, v in R.FIT_WEIGHTS.items() for x in (F.lit(k), F.lit(v))))
    row = lambda f, n, h, ok, w, near: F.struct(f.alias("field"), n.alias("need"), h.alias("have"), F.coalesce(ok, F.lit(False)).alias("ok"), w.alias("weight"), near.alias("near"))

    def numeric(f: Column) -> Column:
        need = F.element_at(numbers, f)
        have = available(f, need)
        near = F.coalesce(storage_passes(f, need, have), F.lit(False))
        return row(f, need, have, (have >= need) | near, F.coalesce(F.try_element_at(weights, f), F.lit(1.0)), near)

    def port(name: Column) -> Column:
        need = F.element_at(ports, name).cast("double")
        have = interface_count(name, need)
        return row(F.concat(F.lit("interfaces."), name), need, have, have >= need, F.lit(R.FIT_WEIGHTS["interfaces"]), F.lit(False))

    none, no = F.lit(None).cast("double"), F.lit(False)
    supported = F.array_contains("p_flags", "ha_supported") | F.array_contains("p_flags", "ha_port") | (F.size("p_modes") > 0)
    flag = lambda f: row(f, none, none, F.array_contains(F.col("p_flags"), f) | ((f == "ha_supported") & supported), F.lit(1.0), no)
    generic = supported & (F.size(F.array_except(wanted, cs.words(R.GENERIC_HA_MODES))) == 0)
    kept = F.when(F.size("p_modes") > 0, F.size(F.array_except(wanted, F.col("p_modes"))) == 0).otherwise(generic)
    mode = F.when(F.size(wanted) > 0, F.array(row(F.lit("ha_modes"), none, none, kept, F.lit(1.0), no))).otherwise(F.array().cast(CHECK))
    listed = lambda names, f: F.transform(names, f).cast(CHECK)
    asked = F.array_intersect(cs.words(R.NUMERIC_FIELDS), F.map_keys(numbers))
    return F.concat(listed(asked, numeric), listed(F.map_keys(ports), port), listed(flags, flag), mode)


def named(ok: bool) -> Column:
    """Fields of column checks that pass, or do not."""
    return F.transform(F.filter("checks", lambda c: c["ok"] == F.lit(ok)), lambda c: c["field"])


def scored(df: DataFrame, context: Column | None = None) -> DataFrame:
    """df with the fit of column checks: closeness, weighted_closeness, coverage, affinity (a token of the
    model stands in context), penalties, max_overprovision, total and fit_quality."""
    fits = F.filter("checks", lambda c: (c["need"] > 0) & (c["have"] > 0))
    fold = lambda f: F.aggregate("_fits", F.lit(0.0), lambda t, c: t + f(c))
    factor = lambda c: F.greatest(F.lit(1.0), c["have"] / c["need"])
    df = df.withColumn("_fits", fits).withColumn("_n", F.size("_fits").cast("double"))
    weight = fold(lambda c: c["weight"])
    mean = lambda total, n, other: F.when(n > 0, total / n).otherwise(other)
    n = F.col("_n")
    df = df.withColumns({
        "closeness": mean(fold(lambda c: c["need"] / c["have"]), n, F.lit(0.75)),
        "_weight": weight,
        "overprovision_penalty": mean(fold(lambda c: F.log(factor(c))), n, F.lit(0.0)),
        "max_overprovision": F.coalesce(F.array_max(F.transform("_fits", factor)), F.lit(1.0)),
        "weighted_worst_overprovision": F.greatest(F.lit(0.0), F.coalesce(F.array_max(F.transform("_fits", lambda c: F.log(factor(c)) * c["weight"])), F.lit(0.0))),
        "coverage": F.least(F.lit(1.0), F.size(named(True)) / F.greatest(F.lit(1), F.size("checks"))),
    })
    df = df.withColumns({
        "weighted_closeness": mean(fold(lambda c: c["need"] / c["have"] * c["weight"]), F.col("_weight"), F.col("closeness")),
        "weighted_overprovision_penalty": mean(fold(lambda c: F.log(factor(c)) * c["weight"]), F.col("_weight"), F.col("overprovision_penalty")),
    })
    tokens = F.filter(F.regexp_extract_all(F.lower("model"), F.lit("([a-z0-9]+)"), F.lit(1)), lambda t: F.length(t) > 2)
    said = F.lit(False) if context is None else F.exists(tokens, lambda t: F.contains(F.lower(context), t))
    df = df.withColumn("affinity", F.when(said, 1.0).otherwise(0.0))
    df = df.withColumn("total", 0.68 * F.col("weighted_closeness") + 0.16 * F.col("coverage") + 0.06 * F.col("affinity") + 0.10)
    return df.withColumn("fit_quality", 0.84 * F.col("weighted_closeness") + 0.16 * F.col("coverage")).drop("_fits", "_n", "_weight")


def serving(required: Column, provider: str | None = None) -> Column:
    """Categories that may serve the required one."""
    known = F.create_map(*(x for k, v in R.SERVING.items() for x in (F.lit(k), cs.words(v))))
    out = F.coalesce(F.try_element_at(known, required), F.array(required))
    for group in R.SERVING_GROUPS.get(provider or "", []):
        out = F.when(required.isin(*group), F.array_union(out, cs.words(group))).otherwise(out)
    return out


def vendors_for(required: Column, others: Sequence[str]) -> Column:
    """Both network vendors for network hardware, else the others."""
    return F.when(required.isin(*R.TWO_VENDORS), cs.words(R.NETWORK_VENDORS)).otherwise(cs.words(others))


def paired(requirements: DataFrame, products: DataFrame, vendors: Column, provider: str | None = None) -> DataFrame:
    """Each requirement with each product of its vendors whose category may serve it: an equi-join on
    vendor and category. vendor_asked keeps the vendor's name as asked."""
    asked = requirements.withColumn("vendor_asked", F.explode(vendors)).withColumn("_serves", F.explode(serving(F.col("device_type"), provider)))
    asked = asked.withColumn("_vendor", F.lower("vendor_asked"))
    named_ = products.withColumns({"_vendor": F.lower("vendor"), "_serves": F.col("category")})
    return asked.join(named_, ["_vendor", "_serves"]).drop("_vendor", "_serves")


#: What decides a product's checks and scores.
FITTING = ["vendor", "category", "p_numbers", "p_interfaces", "p_modes", "p_flags", "p_ports", "p_options", "p_speed"]


def classes(products: DataFrame, place: str, by_model: bool) -> DataFrame:
    """A row for each set of products that no requirement can tell apart: FITTING, model (of one of them), n, first (the
    TOP first by scale and place) and oldest (the REJECTED first by place). by_model: the model's name counts too."""
    parts = [F.array_sort(F.map_entries(c)) if c in ("p_numbers", "p_interfaces") else F.col(c) for c in FITTING]
    key = F.to_json(F.struct(*(p.alias(f"k{i}") for i, p in enumerate([*parts, *([F.col("model")] if by_model else [])]))))
    own = products.select(*FITTING, "model", "p_url", "p_scale", F.col(place).alias("place"), key.alias("_class"))
    least = lambda n, *order: own.withColumn("_rn", F.row_number().over(Window.partitionBy("_class").orderBy(*order))).where(F.col("_rn") <= n).groupBy("_class")
    first = least(TOP, "p_scale", "place").agg(F.sort_array(F.collect_list(F.struct("p_scale", "place", "model", "p_url"))).alias("first"), *(F.first(c).alias(c) for c in [*FITTING, "model"]))
    oldest = least(REJECTED, "place").agg(F.sort_array(F.collect_list(F.struct("place", "model"))).alias("oldest"))
    return first.join(oldest, "_class").join(own.groupBy("_class").agg(F.count(F.lit(1)).alias("n")), "_class").drop("_class")


ORDER = ["weighted_overprovision_penalty", "weighted_worst_overprovision", "overprovision_penalty"]
REJECTED, TOP, FIELDS = 8, 5, 8


def matched(requirements: DataFrame, products: DataFrame, key: Sequence[str], vendors: Column, context: Column | None = None, place: str = "ord", provider: str | None = None) -> DataFrame:
    """key, vendor_no, vendor_asked and the closest product that passes every check (null fields where none does),
    with confidence, valid (number of those that pass), top (models of the first TOP), rejected (a sample of
    REJECTED, by place, with up to FIELDS failing fields). products come from ``with_specs`` and have a unique place.
    Requirements without a category or without anything to check have no row."""
    asks = staged(requirements).where(F.col("device_type").isNotNull() & cs.hard())
    by = [*key, "vendor_asked"]
    pairs = paired(asks, staged(classes(products, place, context is not None)), vendors, provider).withColumn("checks", checks()).withColumn("_ok", F.forall("checks", lambda c: c["ok"]))
    good = scored(pairs.where("_ok"), context).withColumns({"_less": -F.col("coverage"), "_far": -F.col("affinity"), "_m": F.struct(named(True).alias("m"))})
    kept = ["category", "total", *ORDER, "weighted_closeness", "coverage", "_m"]
    good = good.select(*by, "vendor", *kept, "_less", "_far", "n", "first", F.col("first")[0]["p_scale"].alias("p_scale"), F.col("first")[0]["place"].alias("place"))
    order = [*ORDER, "_less", "_far", "p_scale", "place"]
    ranked = lambda df, n, order: df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= n)
    # the first products stand in the first classes, by each class's own first
    few = ranked(good.drop("n"), TOP, order).drop("rank", "p_scale", "place").select("*", F.inline("first")).drop("first")
    few = ranked(few, TOP, order)
    first = lambda c: F.max(F.when(F.col("rank") == 1, F.col(c)))
    won = few.groupBy(*by).agg(
        *(first(c).alias(c) for c in ("vendor", "model", "category", "p_url", "total", *ORDER, "weighted_closeness", "coverage", "p_scale")),
        F.max(F.when(F.col("rank") == 1, F.col("_m"))).alias("_m"),
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "model"))), lambda x: x["model"]).alias("top"),
    )
    won = won.join(pairs.where("_ok").groupBy(*by).agg(F.sum("n").alias("valid")), by)
    bad = pairs.where("not _ok").select(*by, "oldest", F.col("oldest")[0]["place"].alias("place"), F.slice(named(False), 1, FIELDS).alias("_missing"))
    bad = ranked(bad, REJECTED, ["place"]).drop("rank", "place").select("*", F.inline("oldest")).drop("oldest")
    bad = ranked(bad, REJECTED, ["place"]).withColumnRenamed("rank", "_rn")
    bad = bad.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("_rn", "model", F.col("_missing").alias("missing")))), lambda x: F.struct(x["model"].alias("model"), x["missing"].alias("missing"))).alias("rejected"))
    confidence = F.round(F.greatest(F.lit(0.5), F.least(F.lit(0.99), F.col("total"))), 2)
    out = asks.select(*key, F.posexplode(vendors).alias("vendor_no", "vendor_asked")).join(won, by, "left").join(bad, by, "left")
    return out.withColumns({"confidence": confidence, "matched": F.col("_m.m"), "valid": F.coalesce("valid", F.lit(0))}).drop("_m")


def reference(vendor: Column, model: Column, url: Column, dash: str = " - ") -> Column:
    """``Vendor: Model - url``, without the dash where there is no url; null without a model."""
    name = F.concat(vendor, F.lit(": "), model)
    return F.when(F.coalesce(url, F.lit("")) != "", F.concat(name, F.lit(dash), url)).otherwise(name)


def match_text(df: DataFrame, key: str, text: str, products: DataFrame, vendors: Sequence[str] | None = None) -> DataFrame:
    """key, reference and details of each text: what it asks for, and the closest product of each vendor
    (all of the catalog's for hardware beyond the network), joined by bars. A text that is out of scope, names no
    category or states nothing to check has an empty reference."""
    read = df.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    read = cs.normalized(cs.found_in(read, "_text", "_found").withColumn("_meta", cs.no_metadata()), "_meta", F.col("_text"), "_found")
    read = staged(read.drop("_meta", "_found"))
    others = list(vendors) if vendors else [r[0] for r in products.select("vendor").where("vendor <> ''").distinct().orderBy("vendor").limit(1000).collect()] or R.NETWORK_VENDORS
    asked = cs.words(others) if vendors else vendors_for(F.col("device_type"), others)
    got = matched(read, products, ["_key", "_text"], asked, F.col("_text"))
    ref = F.when(F.col("model").isNotNull(), reference(F.col("vendor"), F.col("model"), F.col("p_url"), " — "))
    lines = F.transform(F.sort_array(F.collect_list(F.struct("vendor_no", ref.alias("r")))), lambda x: x["r"])
    rows = got.groupBy("_key").agg(F.array_join(F.array_compact(lines), " | ").alias("reference"), F.sort_array(F.collect_list(F.struct("vendor_asked", "model", "confidence", "valid"))).alias("matches"))
    return read.select("_key", *cs.SPEC).join(rows, "_key", "left").withColumn("reference", F.coalesce("reference", F.lit(""))).withColumnRenamed("_key", key)
