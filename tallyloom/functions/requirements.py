"""Requirement text to constraints: scope, category, throughputs, counts, capacities,
interfaces, flags. Columns in, columns out, all inside Catalyst."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import rules as R
from . import text as tx

SPEED = r"(\d+(?:\.\d+)?)\s*(tbps|gbps|mbps|tbit/s|gbit/s|mbit/s|g\b|t\b)"
COUNT = r"(\d[\d,]*(?:\.\d+)?)\s*(k|m|million|thousand)?"
BETWEEN = r"(?:\s|\||:|=|-|>|of|at least|minimum|min)*?"


def prepared(c: Column) -> Column:
    """Lower case with plain signs and single blanks, and a blank at either end."""
    plain = F.translate(F.replace(F.lower(F.coalesce(c, F.lit(""))), F.lit("≥"), F.lit(">=")), "—–", "--")
    return F.concat(F.lit(" "), F.regexp_replace(plain, r"\s+", " "), F.lit(" "))


def category(t: Column) -> Column:
    """The first category, equipment around the network first, with a keyword in the text."""
    order = [*R.ARCHITECTURE, *(c for c in R.CATEGORY_KEYWORDS if c not in R.ARCHITECTURE)]
    return tx.first_category(t, [(c, R.CATEGORY_KEYWORDS[c]) for c in order])


def excluded(t: Column) -> Column:
    return tx.any_of(t, R.EXCLUDED)


def _scaled(n: Column, unit: Column) -> Column:
    factor = F.when(unit.isin("m", "million"), 1e6).when(unit.isin("k", "thousand"), 1e3).otherwise(1.0)
    return (F.replace(n, F.lit(","), F.lit("")).cast("double") * factor).cast("bigint")


def _largest(t: Column, pattern: str, label: str) -> Column:
    n, u = (F.regexp_extract_all(t, F.lit(pattern), F.lit(k)) for k in (1, 2))
    return F.when(t.contains(label), F.array_max(F.zip_with(n, u, _scaled)))


def count(t: Column, labels: list[str]) -> Column:
    """The largest number behind one of the labels, else the largest before one."""
    behind = [_largest(t, re.escape(x) + BETWEEN + COUNT, x) for x in labels]
    ahead = [_largest(t, COUNT + r"\s+" + re.escape(x), x) for x in labels]
    most = lambda xs: F.array_max(F.array(*xs))
    # a label that holds another is there only where the other is
    least = [x for x in labels if not any(y != x and y in x for y in labels)]
    return F.when(tx.any_of(t, least), F.coalesce(most(behind), most(ahead)))


def log_volume(t: Column, unit: str) -> Column:
    """Numbers before the unit where the text speaks of logs or reports."""
    n = F.transform(F.regexp_extract_all(t, F.lit(r"(\d[\d,]*(?:\.\d+)?)\s*" + unit + r"\b"), F.lit(1)), lambda x: _scaled(x, F.lit("")))
    return F.when(tx.any_of(t, ["log", "report", "analytic"]) & t.rlike(r"\b(?:logs?|logging|reports?|reporting|analytics?)\b"), F.array_max(n))


def storage_tb(t: Column) -> Column:
    """The first size before a storage word and the first behind one, the larger, in TB."""

    def size(pattern: str) -> Column:
        n, u = (F.regexp_extract(t, pattern, k) for k in (1, 2))
        return F.nullif(n, F.lit("")).cast("double") / F.when(u == "gb", 1024.0).otherwise(1.0)

    word = "(?:storage|ssd|disk|hdd)"
    some = tx.any_of(t, ["storage", "ssd", "disk", "hdd"])
    return F.when(some, F.greatest(size(rf"(?:{word}\s*(?:of|:)?\s*)?(\d+(?:\.\d+)?)\s*(tb|gb)\s*{word}"), size(word + r".{0,80}?(\d+(?:\.\d+)?)\s*(tb|gb)\b")))


def capacity(t: Column, unit: str) -> Column:
    """The largest number before the unit, unless ``n x`` stands before it."""
    pattern = rf"(\d+\s*[x×]\s*)?(\d+(?:\.\d+)?)\s*{unit}\b"
    pre, n = (F.regexp_extract_all(t, F.lit(pattern), F.lit(k)) for k in (1, 2))
    found = F.array_max(F.zip_with(pre, n, lambda p, x: F.when(p == "", x.cast("double"))))
    return F.when(t.contains(unit), found) if re.escape(unit) == unit else found


def interfaces(t: Column) -> Column:
    """Map of interface to count, of those that the text asks for; null for none."""

    def numbers(pattern: str | None) -> Column:
        if pattern is None:
            return F.array().cast("array<bigint>")
        return F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(1)), lambda x: x.cast("bigint"))

    add = lambda xs: F.aggregate(xs, F.lit(0).cast("bigint"), lambda a, x: a + x)
    entries = []
    for name, (ahead, behind, trailing) in R.INTERFACES.items():
        total = F.greatest(add(numbers(ahead)) + add(numbers(behind)), F.coalesce(F.array_max(numbers(trailing)), F.lit(0)))
        total = F.when(tx.any_of(t, R.INTERFACE_SIGNS[name]), total).otherwise(F.lit(0).cast("bigint"))
        entries.append(F.struct(F.lit(name).alias("key"), total.alias("value")))
    return _map(F.array(*entries), lambda e: e["value"] > 0)


def ha_modes(t: Column) -> Column:
    found = F.array_compact(F.array(*(F.when(t.rlike(p), F.lit(m)) for m, p in R.HA_MODES)))
    return F.when(tx.any_of(t, R.HA_SIGNS), found).otherwise(F.array().cast("array<string>"))


bound = tx.bound


def flag(t: Column, name: str) -> Column:
    """Whether the prepared text sets the flag; a null text does not."""
    return bound(t, lambda x: F.coalesce(tx.any_of(x, R.FLAG_SIGNS[name]) & x.rlike(R.FLAGS[name]), F.lit(False)))


def _map(entries: Column, keep) -> Column:
    """Map of the (key, value) entries to keep; null for none."""
    return bound(F.filter(entries, keep), lambda e: F.when(F.size(e) > 0, F.map_from_entries(e)))


def _speeds(t: Column) -> Column:
    """b, n, u, a of each speed: the text before it, its number, its unit, the text behind."""
    pieces = F.split(F.regexp_replace(t, SPEED, "\u0001$1\u0002$2\u0003"), "\u0001")
    plain = lambda x: F.translate(x, "\u0001\u0002\u0003", "")

    def one(ps: Column, i: Column) -> Column:
        parts = F.split(F.get(ps, i), "[\u0002\u0003]")
        behind = F.concat(F.get(parts, F.lit(2)), plain(F.array_join(F.slice(ps, i + 2, F.size(ps)), "")))
        return F.struct(plain(F.array_join(F.slice(ps, F.lit(1), i), "")).alias("b"), F.get(parts, F.lit(0)).alias("n"), F.get(parts, F.lit(1)).alias("u"), behind.alias("a"))

    return bound(pieces, lambda ps: F.transform(F.slice(F.sequence(F.lit(0), F.size(ps) - 1), F.lit(2), F.size(ps)), lambda i: one(ps, i)))


def _clauses(s: Column) -> Column:
    """What names a speed's field: its clause between commas, the two cells between bars that
    end with it, and the 80 characters around it."""
    speed = F.concat(s["n"], s["u"])
    near = F.when(s["a"].rlike("[,;|]"), F.regexp_extract(s["a"], r"^[^,;|]*", 0)).otherwise(F.left(s["a"], F.lit(60)))
    cell = F.when(s["a"].contains("|"), F.regexp_extract(s["a"], r"^[^|]*", 0)).otherwise(F.left(s["a"], F.lit(60)))
    return F.struct(
        F.concat(F.regexp_extract(s["b"], r"[^,;|]*$", 0), speed, near).alias("local"),
        F.when(s["b"].contains("|"), F.concat(F.regexp_extract(s["b"], r"[^|]*\|[^|]*$", 0), speed, cell)).alias("barred"),
        F.concat(F.right(s["b"], F.lit(80)), speed, F.left(s["a"], F.lit(80))).alias("window"),
        (s["n"].try_cast("double") * F.when(s["u"].startswith("t"), 1000.0).when(s["u"].startswith("m"), 0.001).otherwise(1.0)).alias("v"),
    )


def throughputs(t: Column, cat: Column) -> Column:
    """Map of throughput field to its largest value in Gbps; ``n x 10 g`` is an interface and
    no throughput."""
    cat = F.coalesce(cat, F.lit(""))
    wall = cat.isin("NGFW", "")
    own = F.filter(_speeds(t), lambda s: ~F.right(s["b"], F.lit(12)).rlike(r"\d+\s*[x×]\s*$"))
    signals = F.transform(F.transform(own, _clauses), lambda s: F.struct(F.coalesce(s["barred"], s["local"]).alias("signal"), s["local"].alias("local"), s["window"].alias("window"), s["v"].alias("v")))
    decided = F.transform(signals, lambda s: F.struct(F.when(tx.any_of(s["signal"], R.THROUGHPUT_SIGNALS), s["signal"]).otherwise(F.concat(s["local"], F.lit(" "), s["window"])).alias("c"), s["window"].alias("w"), s["v"].alias("v")))

    def field(s: Column) -> Column:
        return (
            F.when(wall & s["c"].contains("ssl vpn"), "ssl_vpn_gbps")
            .when(wall & s["c"].contains("ipsec"), "ipsec_vpn_throughput_gbps")
            .when(wall & tx.any_of(s["c"], ["ssl", "tls", "inspection", "decrypt"]), "ssl_tls_inspection_gbps")
            .when(s["c"].rlike(r"\bips\b|intrusion prevention"), "ips_throughput_gbps")
            .when(s["c"].contains("threat protection"), "threat_protection_gbps")
            .when(tx.any_of(s["w"], ["switching", "backplane", "fabric"]) | cat.isin("SWITCH", "DATACENTER_SWITCH", "ACCESS_SWITCH"), "switching_capacity_gbps")
            .when(cat == "NGFW", "ngfw_throughput_gbps")
            .otherwise("throughput_gbps")
        )

    named = F.transform(decided, lambda s: F.struct(field(s).alias("f"), s["v"].alias("v")))
    names = F.array(*map(F.lit, R.THROUGHPUT_FIELDS))
    most = lambda xs, f: F.array_max(F.transform(F.filter(xs, lambda s: s["f"] == f), lambda s: s["v"]))
    entries = bound(named, lambda xs: F.transform(names, lambda f: F.struct(f.alias("key"), most(xs, f).alias("value"))))
    return _map(entries, lambda e: e["value"].isNotNull())


def counts(t: Column, cat: Column) -> Column:
    """Map of counted field, storage and capacity to its value."""
    found = {f: count(t, labels).cast("double") for f, labels in R.COUNT_LABELS.items()}
    found["logs_per_day_gb"] = F.greatest(found["logs_per_day_gb"], log_volume(t, r"gb\s*(?:per\s+day|/day|pd)").cast("double"))
    found["performance_eps"] = F.greatest(found["performance_eps"], log_volume(t, "eps").cast("double"))
    found["storage_tb"] = storage_tb(t)
    own: dict[str, Column | None] = {}
    for c, fields in R.CATEGORY_COUNTS.items():
        for f, labels in fields.items():
            own[f] = F.when(cat == c, count(t, labels).cast("double"))
    for c, fields in R.CATEGORY_CAPACITY.items():
        for f, unit in fields.items():
            here = F.when(cat == c, capacity(t, unit))
            own[f] = F.coalesce(own[f], here) if f in own else here
    entries = F.array(*(F.struct(F.lit(f).alias("key"), v.alias("value")) for f, v in {**found, **own}.items()))
    return _map(entries, lambda e: e["value"].isNotNull())


def read_requirements(df: DataFrame, text: str = "text") -> DataFrame:
    """df with excluded, device_type, throughputs, counts, interfaces, ha_modes and a column
    for each flag. An excluded text has nulls and false flags; a null text counts as empty."""
    df = df.withColumn("_t", prepared(F.col(text))).withColumn("excluded", bound(F.col("_t"), excluded))
    df = df.withColumn("_t", F.when(~F.col("excluded"), F.col("_t"))).withColumn("device_type", bound(F.col("_t"), category))
    t = F.col("_t")
    found = {"throughputs": throughputs(t, F.col("device_type")), "counts": counts(t, F.col("device_type")), "interfaces": interfaces(t), "ha_modes": bound(t, ha_modes)}
    return df.withColumns(found | {f: flag(t, f) for f in R.FLAGS}).drop("_t")
