"""Which rows and sheets ask for a reference: predicates over text, metadata and constraints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import constraints as cs
from ..functions import rules as R
from ..functions import text as tx


def low(c: Column) -> Column:
    return F.lower(F.coalesce(c, F.lit("")))


def any_match(c: Column, patterns) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | c.rlike(p)
    return out


def skipped_sheet(title: Column) -> Column:
    return tx.any_of(low(title), R.SKIPPED_SHEETS)


def admin_sheet(title: Column) -> Column:
    return tx.any_of(low(title), R.ADMIN_SHEETS)


def product_intent(query: Column) -> Column:
    """Something to check, or a text that is no narrative and names a product, or logging and management
    hardware (columns SPEC)."""
    q = low(query)
    family = F.col("device_type").isin("LOGGING", "CENTRALIZED_MANAGEMENT") & tx.any_of(q, R.HARDWARE_WORDS)
    return cs.hard() | F.coalesce(~q.rlike(R.NARRATIVE_WORDS) & (any_match(q, R.EXPLICIT_PRODUCT) | family), F.lit(False))


def concrete_signal(title: Column, headers: Column, text: Column, narrative_measured: Column) -> Column:
    """As product_intent, for a row in its sheet. narrative_measured: the whole context states something to check."""
    context = low(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.array_join(F.slice(headers, 1, 6), " "), F.coalesce(text, F.lit(""))))
    family = F.col("device_type").isin("LOGGING", "CENTRALIZED_MANAGEMENT") & tx.any_of(context, R.HARDWARE_WORDS)
    veto = tx.any_of(context, R.NARRATIVE) & ~narrative_measured
    return cs.hard() | F.coalesce(~veto & (any_match(context, R.EXPLICIT_PRODUCT + R.EXPLICIT_ROW) | family), F.lit(False))


def standalone(text: Column) -> Column:
    """A row that states a product and its size by itself."""
    return cs.hard() & F.col("device_type").isNotNull() & low(text).rlike(R.PRODUCT_SIGNAL) & low(text).rlike(R.SIZING_SIGNAL)


def flag(meta: str, name: str, value: bool) -> Column:
    """Whether the metadata says so explicitly."""
    return F.coalesce(F.lower(F.try_element_at(F.col(f"{meta}.top"), F.lit(name))) == str(value).lower(), F.lit(False))


def group_of(meta: str) -> Column:
    """The product's or requirement's group that the metadata names, or an empty text."""
    top = F.col(f"{meta}.top")
    return F.coalesce(*(cs.filled(F.try_element_at(top, F.lit(n))) for n in ("product_group_id", "requirement_group_id")), F.lit(""))


def reference_anchor(meta: str) -> Column:
    """No flag of the metadata says that another row speaks for this one."""
    denied = flag(meta, "product_group_primary_row", False) | flag(meta, "group_primary_row", False) | flag(meta, "is_product_spec_continuation", True)
    return ~(denied | (flag(meta, "requires_reference", False) & (group_of(meta) != "")))


def matchable(meta: str) -> Column:
    """A category, and a demand for a reference or something measurable; flags alone do not suffice."""
    return F.col("device_type").isNotNull() & (flag(meta, "requires_reference", True) | cs.measured())


def should_reference(text: Column, wanted: Column, provider: str = "fortinet") -> Column:
    if provider == "juniper":
        return wanted | tx.any_of(low(text), R.JUNIPER_WORDS)
    return wanted | F.coalesce(F.col("device_type").isin(*R.REFERENCED), F.lit(False)) | tx.any_of(low(text), R.REFERENCED_WORDS)


def segment_intent(text: Column) -> Column:
    return F.col("device_type").isNotNull() | (low(text).rlike(R.SEGMENT_PRODUCT) & low(text).rlike(R.SEGMENT_DEMAND))


def single_firewall_sheet(title: Column, headers: Column, text: Column) -> Column:
    context = low(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.array_join(F.slice(headers, 1, 6), " "), F.coalesce(text, F.lit(""))))
    return tx.any_of(context, R.SINGLE_FIREWALL)


def anchor_text(c: Column) -> Column:
    """A row that opens a product's block."""
    t = low(c)
    named = t.contains("perimeter firewall") | any_match(t, R.ANCHORS)
    return ~tx.any_of(t, R.NO_ANCHOR) & (t.rlike(R.LOGGING_ANCHOR) | (~t.contains("virtual router") & named))


def section_only(c: Column) -> Column:
    """An anchor that is a heading: no size, no word of a specification."""
    t = F.trim(low(c))
    return (t != "") & ~t.rlike(R.SIZED) & ~tx.any_of(t, R.SPEC_WORDS) & anchor_text(t)


def capacity_row(c: Column) -> Column:
    """A firewall row that holds its whole specification."""
    t = low(c)
    return t.contains("firewall") & t.rlike(R.CAPACITY_ROW[0]) & t.rlike(R.CAPACITY_ROW[1])


#: Fixed values of the plain matcher's gates.
PROCUREMENT = [
    "supply", "provide", "proposed", "procure", "recommended solution", "appliance", "hardware", "equipment", "bom", "boq", "total remote sites", "aggregation firewalls", "remote site equipment",
]
STANDALONE_PROCUREMENT = [
    "equipment hardware", "appliance", "hardware capacity", "firewall capacity", "total remote sites", "aggregation firewalls", "remote site equipment", "bidder should provide", "supply",
    "proposed solution",
]
SERVICES = ["support", "warranty", "nbd", "principal", "rma", "sla", "training", "delivery"]
HARDWARE_SIZES = ["throughput", "interfaces", "sessions", "ports", "gbps", "mbps", "capacity"]
PLAIN_SKIPPED = R.SKIPPED_SHEETS + ["mandatory criteria", "bidder qualification"]


def bullet_fragment(text: Column) -> Column:
    return text.rlike(r"(?i)^\s*[a-z]\)")


def service_only(text: Column) -> Column:
    return tx.any_of(low(text), SERVICES) & ~tx.any_of(low(text), HARDWARE_SIZES)


def catalog_wanted(text: Column) -> Column:
    """A category with something measurable, or with words of procurement."""
    return F.col("device_type").isNotNull() & (cs.measured() | tx.any_of(low(text), PROCUREMENT))


def hardware_wanted(text: Column) -> Column:
    """catalog_wanted, but no fragment of a list without a context of its own, and no mere service."""
    fragment = bullet_fragment(text) & ~tx.any_of(low(text), STANDALONE_PROCUREMENT)
    return F.col("device_type").isNotNull() & ~fragment & (cs.measured() | (~service_only(text) & catalog_wanted(text)))


#: Fixed values of the power and cooling provider.
UNSUPPORTED = [
    ("SPLIT_AC", r"\b(split\s*a/?c|split\s+ac|split\s+type\s+ac|split\s+air\s*condition(?:er|ing)?|a/?c\s+unit|air\s*condition(?:er|ing)?\s+unit|ton\s+split|t3\s+compressor|compressor\s+and\s+vendor|ashrae\s+requirement)\b"),
    ("VIDEO_WALL", r"\b(video\s*wall|display\s*wall|lcd\s*wall|noc\s+screen|screen\s+for\s+the\s+network\s+operations\s+room)\b"),
    ("CCTV", r"\b(ip\s*camera|dome\s*camera|bullet\s*camera|nvr|network\s+video\s+recorder|cctv)\b"),
    ("FIRE_SYSTEM", r"\b(fire\s+alarm|fire\s+detection|fire\s+suppression|smoke\s+detector|gas\s+cylinder|fk-5-1-12|clean\s+agent)\b"),
    ("ACCESS_CONTROL", r"\b(access\s+control|biometric|fingerprint|rfid|face\s+recognition|exit\s+button|magnetic\s+lock)\b"),
]
SERVICE_TERMS = ["startup", "commissioning", "installation", "testing & commissioning", "testing and commissioning", "complete job", "civil work"]
NON_CATALOG_TERMS = [
    "ip camera", "dome camera", "bullet/dome camera", "nvr", "recorder", "hdd", "vesda", "fire detection", "fire alarm", "fire suppression", "gas cylinder", "smoke detector", "smoke sensor",
    "speaker", "public address", "biometric", "fingerprint", "rfid", "ic card", "access control", "exit button", "electro-magnetic lock", "magnetic lock", "panic bar", "smoke seal",
    "single leaf door", "double leaf door", "door closer", "exit lights", "exit light", "cable tray", "cable ladder", "cable trunking", "perforated cable", "solid trunking",
    "distribution board", "o/g db", "db-ups", "ups o/g db", "subassembly", "communication cable", "seismic anchors", "function module", "door sensor", "microwave and infrared sensor",
    "split ac", "split a/c", "split type ac", "split air conditioner", "split air conditioning", "a/c unit", "ac unit", "air conditioning unit", "air conditioner unit", "ton split",
    "t3 compressor", "compressor and vendor", "video wall", "display wall", "lcd wall", "noc screen", "screen for the network operations room",
]
POWER_TERMS = [
    "ups", "battery", "pdu", "rack", "enclosure", "containment", "cooling", "thermal", "chiller", "power distribution", "monitoring", "sensor", "kvm", "console", "busway", "switchgear",
    "cabinet", "42u", "48u", "kva", "kw", "inrow", "in-row", "crv", "apm", "rdu", "sts", "static transfer", "transfer switch", "ats", "rpdu", "cable manager", "cable management",
    "blank panel", "brush strip", "rack accessory",
]


def unsupported(text: Column) -> Column:
    """The first kind of equipment that the provider does not make, or null."""
    out = None
    for name, pattern in UNSUPPORTED:
        hit = low(text).rlike(pattern)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def power_reference(text: Column, wanted: Column) -> Column:
    foreign = tx.any_of(low(text), SERVICE_TERMS + NON_CATALOG_TERMS)
    return ~foreign & (wanted | tx.any_of(low(text), POWER_TERMS))


#: Fixed values of the guide's gate.
GUIDE_EXCLUDED = [
    "price", "cost", "payment", "warranty", "delivery", "bidder", "boq", "tax", "commercial", "legal", "eligibility", "authorization", "training", "rack", "ups", "cooling", "cctv", "civil",
    "electrical",
]
GUIDE_TERMS = [
    "firewall", "policy", "vpn", "ssl vpn", "ipsec", "sd-wan", "routing", "bgp", "ospf", "ha", "high availability", "nat", "authentication", "radius", "ldap", "saml", "logging", "syslog",
    "ips", "antivirus", "web filter", "application control", "ztna", "certificate", "vdom", "interface", "zone", "dns", "dhcp",
]


def guide_reference(text: Column) -> Column:
    """A text of 12 characters or more with a technical and no commercial term."""
    t = low(text)
    return (F.length(F.trim(t)) >= 12) & ~tx.any_of(t, GUIDE_EXCLUDED) & tx.any_of(t, GUIDE_TERMS)
