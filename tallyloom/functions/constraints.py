"""Requirement text and metadata to constraints.

Metadata is held as four maps of text (top, detected, nested, interfaces), as the JSON of a row
gives them; constraints are the columns device_type, numbers (field to value), interfaces (name to
count), flags, ha_modes, notes and scale_users. Each step is one bound expression over the columns of the
step before: what it names often is computed once a row, and no method grows too large to be compiled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.staged import spread
from . import requirements as rq
from . import rules as R
from . import text as tx

TEXTS, NUMBERS, COUNTS = "map<string,string>", "map<string,double>", "map<string,bigint>"
META = f"struct<top:{TEXTS},detected:{TEXTS},nested:{TEXTS},interfaces:{TEXTS}>"
SPEC = ["device_type", "numbers", "interfaces", "flags", "ha_modes"]


def empty(kind: str) -> Column:
    return F.from_json(F.lit("{}"), kind)


def words(items) -> Column:
    return F.array(*map(F.lit, items)).cast("array<string>")


def has(m: Column, key: Column) -> Column:
    return F.array_contains(F.map_keys(m), key)


def put(m: Column, key, value: Column) -> Column:
    """m with the key set, where the value is not null."""
    key = F.lit(key) if isinstance(key, str) else key
    return tx.bound(value, lambda v: F.when(v.isNull(), m).otherwise(F.map_concat(F.map_filter(m, lambda k, _: k != key), F.create_map(key, v))))


def then(c: Column, *steps) -> Column:
    """c, and each step of what the step before gives."""
    for step in steps:
        c = tx.bound(c, step)
    return c


def without(m: Column, keys) -> Column:
    return F.map_filter(m, lambda k, _: ~k.isin(*keys))


def filled(c: Column) -> Column:
    """Text that says something, or null."""
    return tx.bound(F.trim(c), lambda x: F.nullif(x, F.lit("")))


def most(a: Column, b: Column) -> Column:
    """Both maps of counts, the larger where they share a key."""
    return F.map_zip_with(a, b, lambda _, x, y: F.greatest(x, y))


def entries(names: Column, value) -> Column:
    """Map of each name to value(name), where that is not null; names are distinct."""
    pairs = F.transform(names, lambda n: F.struct(n.alias("key"), value(n).alias("value")))
    return F.map_from_entries(F.filter(pairs, lambda e: e["value"].isNotNull()))


def category(c: Column) -> Column:
    """The category that a name stands for; names without one stand for themselves in upper case."""
    known = sorted(set(R.CATEGORY_ALIASES.values()))
    aliases = F.create_map(*(F.lit(x) for kv in R.CATEGORY_ALIASES.items() for x in kv))
    found = lambda x: F.element_at(aliases, F.regexp_replace(F.lower(x), "[ -]", "_"))
    named = lambda x: F.when(x.isin(*known), x).otherwise(F.coalesce(found(x), F.upper(x)))
    return tx.bound(c, lambda c: F.when(filled(c).isNotNull() & (c != "unknown"), tx.bound(F.trim(c), named)))


def modes(raw: Column) -> Column:
    """The modes that a list, or a text of parts between , ; / and |, names."""
    none = F.array().cast("array<string>")
    parts = lambda x: F.when(x.startswith("["), F.from_json(x, "array<string>")).otherwise(F.split(x, "[,;/|]+"))
    found = lambda x: F.transform(F.coalesce(parts(x), none), lambda p: tx.bound(tx.plain(p), rq.ha_modes))
    return tx.bound(raw, lambda x: F.when(x.isNull(), none).otherwise(F.array_distinct(F.flatten(found(x)))))


def metadata(v: Column) -> Column:
    """META of a VARIANT object (null: without anything)."""
    part = lambda v, path: F.coalesce(F.try_variant_get(v, path, TEXTS), empty(TEXTS))
    own = lambda v: F.coalesce(F.try_variant_get(v, "$.interfaces", TEXTS), F.try_variant_get(v, "$.requirements.interfaces", TEXTS), empty(TEXTS))
    return tx.bound(v, lambda v: F.struct(part(v, "$").alias("top"), part(v, "$.detected_specs").alias("detected"), part(v, "$.requirements").alias("nested"), own(v).alias("interfaces")))


def no_metadata() -> Column:
    return F.struct(*(empty(TEXTS).alias(n) for n in ("top", "detected", "nested", "interfaces")))


def found_in(df: DataFrame, text: str, out: str = "found") -> DataFrame:
    """df with out: the constraints that the text itself states."""
    own = df.withColumn("_own", F.struct(*map(F.col, df.columns)))
    read = rq.read_requirements(own.select("_own", F.col(f"_own.`{text}`").alias("_text")), "_text")
    flags = F.array_compact(F.array(*(F.when(F.col(f), F.lit(f)) for f in R.BOOLEAN_FIELDS)))
    numbers = F.map_concat(F.coalesce("throughputs", empty(NUMBERS)), F.coalesce("counts", empty(NUMBERS)))
    spec = F.struct(F.col("device_type"), numbers.alias("numbers"), F.coalesce("interfaces", empty(COUNTS)).alias("interfaces"), flags.alias("flags"), F.coalesce("ha_modes", F.array().cast("array<string>")).alias("ha_modes"), "excluded")
    # bound: a struct's fields would be taken apart and each computed again by every step that names one
    return read.select(*(F.col(f"_own.`{c}`").alias(c) for c in df.columns), rq.bound(F.lit(0), lambda _: spec).alias(out))


def measured(df_or_prefix: str = "", found: Column | None = None) -> Column:
    """Whether there is a number other than 0, an interface or a mode, in the columns or in struct found."""
    c = lambda n: F.col(f"{df_or_prefix}{n}") if found is None else found[n]
    return F.exists(F.map_values(c("numbers")), lambda x: x != 0) | (F.size(c("interfaces")) > 0) | (F.size(c("ha_modes")) > 0)


def hard(prefix: str = "", found: Column | None = None) -> Column:
    """Whether there is anything that a product can fail."""
    return measured(prefix, found) | (F.size(F.col(f"{prefix}flags") if found is None else found["flags"]) > 0)


def normalized(df: DataFrame, meta: str, source: Column, found: str | None = None, fills: bool = False) -> DataFrame:
    """df with SPEC from column meta (META), and from found: its numbers stand where top has none (or,
    with fills, where detected has none), its interfaces raise counts, its flags and modes are added."""
    given = F.struct(F.col(meta).alias("meta"), *([F.col(found).alias("found")] if found else []))
    df = df.withColumn("_spec", tx.bound(given, lambda g: _spec(g["meta"], g["found"] if found else None, fills)))
    return promoted(df.withColumns({n: F.col(f"_spec.{n}") for n in SPEC}).drop("_spec"), source)


def _spec(meta: Column, found: Column | None, fills: bool) -> Column:
    """Struct of SPEC; found is None for none."""
    top, detected, nested = (meta[n] for n in ("top", "detected", "nested"))
    none = F.lit(None).cast("string")
    own = empty(NUMBERS) if found is None else found["numbers"]
    text = lambda m, k: F.try_element_at(m, k)

    def value(p: Column) -> Column:
        stands = lambda x: ranged(p["key"], p[x])
        below = F.when(p["has_d"], stands("d")).otherwise(stands("n"))
        if found is not None and fills:
            return F.when(p["has_t"], stands("t")).otherwise(F.coalesce(ranged(p["key"], filled(p["d"])), p["own"], stands("n")))
        plain = F.when(p["has_t"], stands("t")).otherwise(below)
        if found is None:
            return plain
        truthy = ~F.coalesce(F.lower(p["t"]), F.lit("")).isin("", "0", "0.0", "false", "{}", "[]")
        return F.when(truthy, stands("t")).when(p["own"].isNotNull(), p["own"]).otherwise(plain)

    def ranged(k: Column, raw: Column) -> Column:
        least = lambda v: F.coalesce(*(F.try_variant_get(v, f"$.{n}", "string") for n in ("min", "required", "value", "max")))
        return tx.bound(raw, lambda x: F.when(k.isin(*R.RANGE_FIELDS) & x.startswith("{"), tx.number(tx.bound(F.try_parse_json(x), least))).otherwise(tx.number(x)))

    first = lambda maps, names: F.coalesce(*(F.when(has(m, F.lit(n)), F.coalesce(text(m, F.lit(n)), F.lit(""))) for m in maps for n in names), none)
    told = lambda k: F.struct(k.alias("key"), has(top, k).alias("has_t"), text(top, k).alias("t"), has(detected, k).alias("has_d"), text(detected, k).alias("d"), text(nested, k).alias("n"), text(own, k).alias("own"))
    keys = lambda m: F.coalesce(F.map_keys(m), words([]))
    there = F.array_intersect(words(R.NUMERIC_FIELDS), F.concat(*map(keys, (top, detected, nested, own))))
    some_of = F.filter(F.transform(there, told), lambda p: F.coalesce(p["t"], p["d"], p["n"]).isNotNull() | p["own"].isNotNull())
    pairs = F.transform(some_of, lambda p: F.struct(p["key"].alias("key"), value(p).alias("value")))
    missing = lambda n, k, names, by: F.when(~has(n, F.lit(k)), tx.number(first([top, detected, nested], names)) / by)
    numbers = then(
        F.map_from_entries(F.filter(pairs, lambda e: e["value"].isNotNull())),
        lambda n: put(n, "switching_capacity_gbps", tx.number(text(detected, F.lit("switching_capacity_tbps"))) * 1000),
        lambda n: put(n, "throughput_gbps", missing(n, "throughput_gbps", ["throughput_mbps"], 1000)),
        lambda n: put(n, "storage_tb", missing(n, "storage_tb", ["storage_gb", "local_storage_gb"], 1024)),
        lambda n: put(n, "connections_per_second", tx.number(first([detected, nested], ["cps"]))),
    )
    stated = F.map_filter(F.transform_values(meta["interfaces"], lambda _, x: tx.number(x).cast("bigint")), lambda _, x: x.isNotNull())
    fields = F.array_intersect(words(R.INTERFACE_FIELDS), F.concat(keys(top), keys(detected)))
    listed = entries(fields, lambda k: tx.number(F.when(has(top, k), text(top, k)).otherwise(text(detected, k))).cast("bigint"))
    names = F.create_map(*(F.lit(x) for kv in R.INTERFACE_FIELDS.items() for x in kv))
    ports = stated if found is None else most(stated, found["interfaces"])
    interfaces = most(ports, F.transform_keys(listed, lambda k, _: F.element_at(names, k)))
    true = lambda m, f: F.lower(F.coalesce(text(m, F.lit(f)), F.lit(""))) == "true"
    flagged = [F.when(true(top, f) | true(detected, f) | true(nested, f) | (F.lit(False) if found is None else F.array_contains(found["flags"], f)), F.lit(f)) for f in R.BOOLEAN_FIELDS]
    said = lambda m: tx.bound(modes(tx.bound(filled(text(m, F.lit("ha_modes"))), lambda x: F.nullif(x, F.lit("[]")))), lambda c: F.when(F.size(c) > 0, c))
    mine = [] if found is None else [F.when(F.size(found["ha_modes"]) > 0, found["ha_modes"])]
    order = [*mine, said(top), said(detected), said(nested)] if fills else [said(top), *mine, said(detected), said(nested)]
    chosen = F.coalesce(*order, F.array().cast("array<string>"))
    kind = category(F.coalesce(*(filled(text(top, F.lit(k))) for k in ("device_type", "category", "device_category"))))
    if found is not None:
        certain = F.lit(False) if fills else found["device_type"].isNotNull() & hard(found=found)
        kind = F.when(certain, found["device_type"]).otherwise(F.coalesce(kind, found["device_type"]))

    def whole(ha: Column) -> Column:
        flags = tx.bound(F.array_compact(F.array(*flagged)), lambda x: F.when(F.size(ha) > 0, F.array_union(x, words(["ha_supported"]))).otherwise(x))
        return F.struct(kind.alias("device_type"), numbers.alias("numbers"), interfaces.alias("interfaces"), flags.alias("flags"), ha.alias("ha_modes"))

    return tx.bound(chosen, whole)


def promoted(df: DataFrame, source: Column) -> DataFrame:
    """A firewall's plain throughput becomes the one that its text is about."""

    def field(low: Column, n: Column) -> Column:
        out = None
        for terms, name in R.PROMOTED:
            fits = tx.any_of(low, terms) & ~has(n, F.lit(name))
            out = F.when(fits, name) if out is None else out.when(fits, name)
        return F.coalesce(out.when(~has(n, F.lit("ngfw_throughput_gbps")) & ~has(n, F.lit("firewall_throughput_gbps")), "ngfw_throughput_gbps"), F.lit(""))

    def moved(g: Column) -> Column:
        n = g["n"]
        plain = F.coalesce(F.try_element_at(n, F.lit("throughput_gbps")), F.lit(0.0))
        rest = without(n, ["throughput_gbps"])
        put_to = tx.bound(tx.bound(F.lower(F.left(g["s"], F.lit(1000))), lambda low: field(low, n)), lambda to: F.when(to == "", rest).otherwise(F.map_concat(rest, F.create_map(to, plain))))
        return F.when((plain != 0) & (g["kind"] == "NGFW"), put_to).otherwise(n)

    given = F.struct(F.col("numbers").alias("n"), F.col("device_type").alias("kind"), F.coalesce(source, F.lit("")).alias("s"))
    return df.withColumn("numbers", tx.bound(given, moved))


def labelled_throughputs(df: DataFrame, text: str) -> DataFrame:
    """A throughput behind its label counts before any other reading."""

    def one(low: Column, pattern: str) -> Column:
        whole = rf"(?:{pattern})[^\d]{{0,80}}(\d+(?:\.\d+)?)\s*(tbps|gbps|mbps)\b"
        return tx.bound(F.regexp_extract(low, whole, 2), lambda u: F.when(u != "", F.regexp_extract(low, whole, 1).try_cast("double") * F.when(u == "tbps", 1000.0).when(u == "mbps", 0.001).otherwise(1.0)))

    def over(n: Column, low: Column) -> Column:
        found = F.filter(F.array(*(F.struct(F.lit(f).alias("key"), one(low, p).alias("value")) for f, p in R.LABELLED.items())), lambda e: e["value"].isNotNull())
        return tx.bound(found, lambda es: F.map_concat(F.map_filter(n, lambda k, _: ~F.exists(es, lambda e: e["key"] == k)), F.map_from_entries(es)))

    def told(n: Column, low: Column) -> Column:
        first = tx.any_of(F.left(low, F.lit(1200)), ["next generation firewall throughput", "ngfw throughput"]) & has(n, F.lit("ngfw_throughput_gbps"))
        return F.when(first, without(n, ["firewall_throughput_gbps"])).otherwise(n)

    def read(g: Column) -> Column:
        return F.when(g["low"].contains("throughput"), then(g["n"], lambda n: over(n, g["low"]), lambda n: told(n, g["low"]))).otherwise(g["n"])

    given = F.struct(F.col("numbers").alias("n"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("low"))
    return df.withColumn("numbers", tx.bound(given, read))


def counted_interfaces(df: DataFrame, found: str) -> DataFrame:
    """The text's interface count replaces one that was multiplied by the speed, is a thousand times too
    large, or too small; the first two are noted."""
    speed = F.create_map(*(F.lit(x) for kv in R.INTERFACE_SPEED.items() for x in kv))

    def kept(name: Column, now: Column, said: Column) -> Column:
        times = now == said * F.try_element_at(speed, name)
        huge = (now > said) & (now >= F.greatest(said * 1000, F.lit(1000)))
        return F.when(now.isNull() | F.coalesce(times, F.lit(False)) | huge | (now < said), F.coalesce(said, now)).otherwise(now)

    df = df.withColumn("_now", F.col("interfaces")).withColumn("interfaces", F.map_zip_with("interfaces", F.col(f"{found}.interfaces"), kept))
    less = F.map_filter("_now", lambda k, v: v > F.element_at(F.col("interfaces"), k))
    note = F.when(F.size(less) > 0, F.concat(F.lit("interfaces corrected from the text: "), F.array_join(F.array_sort(F.map_keys(less)), ", ")))
    return df.withColumn("notes", F.array_compact(F.array_append("notes", note))).drop("_now")


def vpn_users(df: DataFrame, text: str) -> DataFrame:
    """The most VPN users that the text states; scale_users where they are those of a solution."""
    numbers = lambda low, p: F.transform(F.regexp_extract_all(low, F.lit(p), F.lit(1)), lambda x: F.replace(x, F.lit(","), F.lit("")).cast("double"))
    both = lambda plain, scaled: F.struct(F.array_max(F.concat(plain, scaled)).alias("users"), F.array_max(scaled).alias("scaled"))
    read = lambda low: F.when(low.contains("vpn") & low.contains("user"), tx.bound(F.concat(*(numbers(low, p) for p in R.SCALED_USERS)), lambda s: both(numbers(low, R.VPN_USERS), s)))
    df = df.withColumn("_read", tx.bound(F.lower(F.coalesce(F.col(text), F.lit(""))), read))
    df = df.withColumns({"_users": F.col("_read.users"), "_scaled": F.col("_read.scaled")}).drop("_read")
    there = F.col("_users").isNotNull()
    df = df.withColumn("numbers", F.when(there, put(without(F.col("numbers"), ["max_local_remote_users"]), "ssl_vpn_users", F.col("_users"))).otherwise(F.col("numbers")))
    df = df.withColumn("device_type", F.when(there, "NGFW").otherwise(F.col("device_type")))
    return df.withColumn("scale_users", F.when(F.col("_scaled") >= F.col("_users"), F.col("_scaled"))).drop("_users", "_scaled")


def sanitized(df: DataFrame) -> DataFrame:
    """A firewall is not asked for what controllers and services do."""
    gone = F.array_sort(F.array_intersect(F.map_keys("numbers"), words(R.CONTROLLER_FIELDS)))
    wall = (F.col("device_type") == "NGFW") & (F.size(gone) > 0)
    note = F.when(wall, F.concat(F.lit("fields of controllers and services ignored: "), F.array_join(gone, ", ")))
    df = df.withColumn("notes", F.array_compact(F.array_append("notes", note)))
    return df.withColumn("numbers", F.when(F.col("device_type") == "NGFW", without(F.col("numbers"), R.CONTROLLER_FIELDS)).otherwise(F.col("numbers")))


def parse_constraints(df: DataFrame, text: str, meta: str | None = None) -> DataFrame:
    """df with SPEC, notes and scale_users: the text's own statements over the metadata, then labels,
    interface counts and users of the text, in this order. Columns of these names are replaced; a null
    text counts as empty, null metadata says nothing."""
    df = df.drop(*SPEC, "notes", "scale_users")
    if meta is None:
        meta, df = "_meta", df.withColumn("_meta", no_metadata())
    df = normalized(found_in(df, text, "_found"), meta, F.col(text), "_found").withColumn("notes", F.array().cast("array<string>"))
    logs = F.exists(words(R.LOG_FIELDS), lambda f: F.coalesce(F.try_element_at(F.col("numbers"), f), F.lit(0.0)) != 0)
    df = df.withColumn("device_type", F.when(logs, "LOGGING").otherwise(F.col("device_type")))
    df = vpn_users(counted_interfaces(labelled_throughputs(df, text), "_found"), text)
    return sanitized(df).drop("_found", "_meta")


def parse_distinct(df: DataFrame, text: str, meta: str) -> DataFrame:
    """parse_constraints with column meta of JSON text, reading each distinct text with its metadata once: reading
    costs far more than dealing the rows by what they say."""
    said = spread(df.select(F.col(text).alias("_said"), F.col(meta).alias("_json")).distinct())
    read = parse_constraints(said.withColumn("_made", metadata(F.parse_json("_json"))), "_said", "_made").select("_said", "_json", *SPEC, "notes", "scale_users")
    rows = df.drop(*SPEC, "notes", "scale_users")
    return rows.join(read, rows[text].eqNullSafe(read["_said"]) & rows[meta].eqNullSafe(read["_json"])).drop("_said", "_json")


#: Further categories of one vendor by words of the text, in order.
JUNIPER_CATEGORIES = [
    ("WIRELESS_AP", ["wireless access point", "access point", "wi-fi", "wifi", "mist ap", "ap45", "ap47"]),
    ("SDWAN_ROUTER", ["session smart router", "sd-wan router", "ssr", "wan edge"]),
    ("SDN_AUTOMATION", ["apstra", "data center director", "intent-based networking"]),
    ("CENTRALIZED_MANAGEMENT", ["mist cloud", "wired assurance", "wireless assurance", "security director"]),
]


def parse_juniper(df: DataFrame, text: str, meta: str | None = None) -> DataFrame:
    """parse_constraints with further categories; an access point's uplink is a port, no throughput."""
    df = parse_constraints(df, text, meta)
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    df = df.withColumn("device_type", F.coalesce(tx.first_category(low, JUNIPER_CATEGORIES), "device_type"))
    speed = F.regexp_extract(low, r"(\d+(?:\.\d+)?)\s*g(?:be|bps)?\s+(?:uplink|port|interface)", 1).try_cast("double")
    df = df.withColumn("_speed", F.when(F.col("device_type") == "WIRELESS_AP", speed))
    port = F.when(F.col("_speed") >= 10, "10g_rj45").when(F.col("_speed") >= 1, "1g_rj45")
    df = df.withColumn("interfaces", F.when(port.isNotNull(), most(F.col("interfaces"), F.create_map(F.coalesce(port, F.lit("")), F.lit(1).cast("bigint")))).otherwise(F.col("interfaces")))
    same = F.try_element_at(F.col("numbers"), F.lit("throughput_gbps")) == F.col("_speed")
    return df.withColumn("numbers", F.when(same, without(F.col("numbers"), ["throughput_gbps"])).otherwise(F.col("numbers"))).drop("_speed")


def effective(df: DataFrame, meta: str, text: str) -> DataFrame:
    """df with SPEC of the metadata whose gaps the text fills, and found."""
    return normalized(found_in(df, text, "found"), meta, F.col(text), "found", fills=True)


def capped_scale(df: DataFrame, text: str, most_users: str) -> DataFrame:
    """Where a text of a solution asks for more VPN users than the vendor's largest product serves
    (column most_users), each appliance is asked for that many; scale_users keeps the wish."""
    low, users = F.lower(F.col(text)), F.try_element_at(F.col("numbers"), F.lit("ssl_vpn_users"))
    over = low.contains("ssl") & low.contains("vpn") & low.rlike(R.SOLUTION_SCALE) & (users > F.col(most_users))
    df = df.withColumn("_over", F.coalesce(over, F.lit(False)))
    note = F.when(F.col("_over"), F.concat(F.lit("VPN users of the solution capped for one appliance: "), users.cast("bigint").cast("string"), F.lit(" to "), F.col(most_users).cast("bigint").cast("string")))
    df = df.withColumns({"notes": F.array_compact(F.array_append("notes", note)), "scale_users": F.when(F.col("_over"), users).otherwise(F.col("scale_users"))})
    return df.withColumn("numbers", F.when(F.col("_over"), put(F.col("numbers"), "ssl_vpn_users", F.col(most_users))).otherwise(F.col("numbers"))).drop("_over")
