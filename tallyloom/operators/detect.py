"""The technical section of a document, found on its pages (doc, page_no from 1, text).

Page predicates are columns; start, end and annex range are aggregates and windows by document, so
documents are never gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from . import shape as sh

#: Fixed values, in their order: headers that open the section, and those that close it.
START_HEADERS = [
    r"\bTSR[-–\s]*\d*\b", r"TECHNICAL\s+SPECIFICATION\s+REQUIREMENTS?", r"TECHNICAL\s+SCRUTINY\s+PROFORMA", r"\bTSP\b",
    r"SECTION\s+V\b", r"SECTION\s+5\b", r"SCHEDULE\s+OF\s+REQUIREMENTS?", r"TECHNICAL\s+SPECIFICATIONS?\s*$", r"TECHNICAL\s+REQUIREMENTS?\s*$", r"TECHNICAL\s+CONDITIONS?\s*/\s*SPECIFICATIONS?",
    r"DP[-–\s]*2.*PART[-–\s]*III", r"PART[-–\s]*III.*TECHNICAL",
    r"ANNEX[-\s]*A\s*\d*\s*[:\-]?\s*BILL\s+OF\s+QUANTIT", r"ANNEX[-\s]*A\s*:\s*BOQ", r"ANNEX(?:URE)?\s*[-–]?\s*A\s*$", r"ANNEX(?:URE)?\s*[-–]?\s*1\s*$",
    r"BILL\s+OF\s+QUANTITIES?\s*$", r"\bBOQ\b\s*$", r"SCOPE\s+OF\s+(?:WORK|SUPPLY|SERVICES?)\s*$",
]
END_HEADERS = [
    r"SECTION\s+VI\b", r"SECTION\s+6\b", r"STANDARD\s+FORMS?\s*$", r"BID\s+FORMS?\s*$", r"PROPOSAL\s+FORMS?\s*$", r"GENERAL\s+CONDITIONS?\s+OF\s+(?:THE\s+)?CONTRACT",
    r"SPECIAL\s+CONDITIONS?\s+OF\s+(?:THE\s+)?CONTRACT", r"LETTER\s+OF\s+BID", r"FINANCIAL\s+PROPOSAL\s+FORM\s*$", r"SERVICE\s+LEVEL\s+AGREEMENT\s*$",
    r"ANNEX[-–\s]*[:\-]?\s*C\b", r"ANNEX[-–\s]*[:\-]?\s*D\b", r"ANNEX[-–\s]*[:\-]?\s*E\b", r"ANNEX[-–\s]*[:\-]?\s*F\b", r"ANNEX[-–\s]*[:\-]?\s*G\b",
    r"CONTRACT\s+AGREEMENT\s*$", r"NON[-–\s]DISCLOSURE\s+AGREEMENT", r"PERFORMANCE\s+GUARANTEE\s*$", r"BANK\s+GUARANTEE", r"EVALUATION\s+CRITERIA\s*$", r"RFP\s+FORMS?\s*$",
    r"RFP[-–\s]*0?1\s*$", r"FORM\s+['\"]?A[-–]?\d+", r"SECTION\s+VII\b", r"SECTION\s+VIII\b", r"UNDERTAKING\s*$", r"DP[-–\s]*(?:PART[-–\s]*)?II\b.*(?:LEGAL|ADMIN)",
    r"LEGAL\s*/\s*ADMINISTRATIVE", r"TERMS\s+AND\s+CONDITIONS\s+GOVERNING", r"SUPPLEMENT\s+TO\s+INDENT", r"FORM\s+DP[-–]?3\b", r"FORM\s+DP[-–]?2\s*,?\s*PART[-–\s]*II\b",
]
KEYWORDS = [
    "SPECIFICATION", "COMPLIANCE", "MAKE", "MODEL", "QTY", "QUANTITY", "PROCESSOR", "MEMORY", "STORAGE", "BANDWIDTH", "THROUGHPUT", "FIREWALL", "SWITCH", "ROUTER", "SERVER", "UPS", "RACK",
    "PDU", "RAM", "SSD", "HDD", "GHZ", "MBPS", "GBPS", "KVA", "WATT", "HARDWARE", "SOFTWARE", "COOLING", "NETWORK", "SECURITY", "FORTIGATE", "CISCO", "DELL", "HP", "JUNIPER", "IEC", "NFPA",
    "TIA", "ANSI", "IEEE", "CONTAINMENT", "DATA CENTER", "HVAC", "CCTV", "FIBER", "SSL", "VPN", "PDC", "SDC", "BOQ", "TSR", "REDUNDAN", "CONCURRENT", "SCALAB", "LICENSE", "FIRMWARE", "IPS",
    "UTM", "IPSEC", "ANTIVIRUS", "INSPECTION", "PROTOCOL", "FORTIANALYZER", "FORTIMANAGER", "ANNEX-A", "ANNEX-B", "BILL OF QUANTITY", "COMPUTING NODE", "SAN", "NVME", "FLASH", "RACK MOUNT",
    "XEON", "GPU",
]
PROCEDURAL = [
    "TABLE OF CONTENTS", "INDEX OF CLAUSE", "LIST OF CLAUSE", "INSTRUCTION TO BIDDER", "INVITATION TO BID", "INVITATION FOR BID", "GRIEVANCE", "BID VALIDITY", "BID SECURITY", "PAYMENT SCHEDULE",
    "TERMS AND CONDITIONS", "GENERAL CONDITIONS", "SPECIAL CONDITIONS",
]
ANNEX_A, ANNEX_B, ANNEX_C = r"(?i)Annex[-\s]+A\s*[:\-=]\s*Bill\s+of\s+Quant", r"(?i)^Annex[-\s]*B\d+\s*$", r"(?i)ANNEX[-\s]*[:\-]?\s*C\b"
LOW, STREAK = 15, 6


def weight(pattern: str) -> int:
    """What a header of this pattern counts for."""
    if any(k in pattern for k in ("TSR", "SCRUTINY", "TSP")):
        return 1000
    if "SCHEDULE" in pattern or "SECTION" in pattern:
        return 600
    if "TECHNICAL" in pattern:
        return 500
    if "DP" in pattern or "PART" in pattern:
        return 450
    if "ANNEX" in pattern:
        return 700 if "BILL" in pattern else 300
    return 200


def lines(text: Column) -> Column:
    """Lines without outer white space, those that are not empty."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.filter(parts, lambda x: x != "")


def coverage(line: Column, pattern: str) -> Column:
    """The share of a line of at most 130 characters that the pattern covers."""
    share = F.length(F.regexp_extract(F.upper(line), pattern, 0)) / F.greatest(F.length(line), F.lit(1))
    return F.when(F.length(line) <= 130, share).otherwise(0.0)


def first_header(ls: Column, patterns: list[str]) -> Column:
    """(pattern, line, place of the line from 0) of the first pattern, in order, that covers 30 % of a line; null for none."""

    def of(n: int, pattern: str) -> Column:
        hit = F.get(F.filter(ls, lambda x: coverage(x, pattern) >= 0.3), F.lit(0))
        return F.when(hit.isNotNull(), F.struct(F.lit(n).alias("pattern"), hit.alias("line")))

    return F.coalesce(*(of(n, p) for n, p in enumerate(patterns)))


def toc_page(ls: Column, page_no: Column) -> Column:
    """More than two dot leaders, or, on one of the first 15 pages, more than six lines that end in a page number."""
    text = F.array_join(ls, " ")
    ends = F.size(F.filter(ls, lambda x: x.rlike(r"\s+\d{1,3}\s*$")))
    return (tx.count_of(text, "....") > 2) | (tx.count_of(text, ". . . .") > 2) | ((page_no <= 15) & (ends > 6))


def page_facts(pages: DataFrame) -> DataFrame:
    """doc, page_no, n_lines, toc, density, procedural, start (pattern, line), stop (pattern, line, place), annex_a,
    annex_b, annex_c of each page, from one pass over its text."""
    df = pages.select("doc", "page_no", "text", lines(F.col("text")).alias("_l")).withColumn("_u", F.upper(F.array_join("_l", " ")))
    top = lambda n: F.slice("_l", 1, n)
    df = df.withColumns({
        "n_lines": F.size("_l"),
        "toc": toc_page(F.col("_l"), F.col("page_no")),
        "density": tx.density(F.col("_u"), KEYWORDS),
        "procedural": tx.any_of(F.col("_u"), PROCEDURAL),
        "start": first_header(top(8), START_HEADERS),
        "stop": first_header(top(10), END_HEADERS),
        "annex_a": F.coalesce(F.col("text").rlike(ANNEX_A), F.lit(False)),
        "annex_b": F.exists(top(4), lambda x: x.rlike(ANNEX_B)),
        "annex_c": F.exists(top(4), lambda x: x.rlike(ANNEX_C)),
    })
    df = df.withColumn("stop_place", (F.array_position("_l", F.col("stop.line")) - 1) / F.greatest(F.col("n_lines"), F.lit(1)))
    return df.drop("text", "_l", "_u")


def start_candidates(facts: DataFrame) -> DataFrame:
    """doc, page_no, pattern, line, density, score, n_pages of the pages that may open the section."""
    sizes = facts.groupBy("doc").agg(F.max("page_no").alias("n_pages"))
    rows = facts.where("n_lines > 0 AND NOT toc AND start IS NOT NULL").join(sizes, "doc")
    pos = (F.col("page_no") - 1) / F.col("n_pages")
    label = F.get(F.array(*(F.lit(weight(p)) for p in START_HEADERS)), F.col("start.pattern"))
    score = label + F.col("density") * 8 - F.when(F.col("procedural"), 800).otherwise(0) + F.when(pos < 0.08, -500).when((pos > 0.10) & (pos < 0.85), 100).otherwise(0)
    return rows.select("doc", "page_no", F.col("start.pattern").alias("pattern"), F.col("start.line").alias("line"), "density", score.alias("score"), "n_pages")


def start_pages(facts: DataFrame) -> DataFrame:
    """doc, n_pages, start_page, title: the candidate of the highest score, the earliest of equals; page 1 without any."""
    best = start_candidates(facts).groupBy("doc").agg(F.min_by(F.struct("page_no", "line"), F.struct((-F.col("score")).alias("s"), "page_no")).alias("b"))
    sizes = facts.groupBy("doc").agg(F.max("page_no").alias("n_pages"))
    return sizes.join(best, "doc", "left").select("doc", "n_pages", F.coalesce("b.page_no", F.lit(1)).alias("start_page"), F.coalesce("b.line", F.lit("Fallback")).alias("title"))


def end_pages(facts: DataFrame, starts: DataFrame) -> DataFrame:
    """starts with end_page: the first page behind the start with a closing header (the page before it, if the header
    stands in the upper 55 %), or the first of STREAK pages in a row of low density (blank ones don't count), whichever
    shows first; else the last page."""
    rows = facts.where("n_lines > 0").join(starts.select("doc", "start_page"), "doc").where("page_no > start_page")
    rows = sh.islands(rows.withColumn("_low", F.col("density") < LOW), ["doc"], ["page_no"], "_low")
    rows = rows.withColumn("_no", F.row_number().over(Window.partitionBy("doc", "island").orderBy("page_no")))
    header = F.when(F.col("stop").isNotNull(), F.struct("page_no", F.when(F.col("stop_place") < 0.55, F.col("page_no") - 1).otherwise(F.col("page_no")).alias("e")))
    streak = F.when(F.col("_low") & (F.col("_no") == STREAK), F.struct("page_no", (F.col("page_no") - 5).alias("e")))
    found = rows.groupBy("doc").agg(F.min(header).alias("h"), F.min(streak).alias("s"))
    end = F.when(F.col("h").isNotNull() & (F.col("s").isNull() | (F.col("h.page_no") <= F.col("s.page_no"))), F.col("h.e")).otherwise(F.col("s.e"))
    return starts.join(found, "doc", "left").withColumn("end_page", F.coalesce(end, "n_pages")).drop("h", "s")


def annex_ranges(facts: DataFrame) -> DataFrame:
    """doc, start_page, end_page, sheets: from the first page of annex A (or of annex B) to the last of annex B (to the page
    before annex C), where that is five pages and three sheets at least. Pages of B behind a gap that is far
    larger than the others are copies and do not count."""
    rows = facts.where("n_lines > 0")
    a = rows.groupBy("doc").agg(F.min(F.when(F.col("annex_a"), F.col("page_no"))).alias("_a"))
    rows = rows.join(a, "doc").where(~F.coalesce(F.col("page_no") == F.col("_a"), F.lit(False)))
    b = rows.where("annex_b").select("doc", "page_no")
    first = b.groupBy("doc").agg(F.min("page_no").alias("_b"))
    c = rows.where("annex_c").join(first, "doc").where("page_no >= _b").groupBy("doc").agg(F.min("page_no").alias("_c"))
    cut = sh.gap_cut(b, ["doc"], "page_no")
    kept = b.join(cut, "doc", "left").where(F.col("cut_page").isNull() | (F.col("page_no") <= F.col("cut_page")))
    out = kept.groupBy("doc").agg(F.min("page_no").alias("_b"), F.max("page_no").alias("_last"), F.count(F.lit(1)).alias("sheets")).join(a, "doc").join(c, "doc", "left")
    out = out.withColumns({"start_page": F.coalesce("_a", "_b"), "end_page": F.when(F.col("_c") > F.col("_last"), F.col("_c") - 1).otherwise(F.col("_last"))})
    return out.where("end_page - start_page + 1 >= 5 AND sheets >= 3").select("doc", "start_page", "end_page", "sheets")


def detect_sections(facts: DataFrame) -> DataFrame:
    """doc, start_page, end_page, title: the annexes, where there are any, else the section between headers."""
    plain = end_pages(facts, start_pages(facts))
    annex = annex_ranges(facts).select("doc", F.col("start_page").alias("_s"), F.col("end_page").alias("_e"), F.concat(F.lit("Annex-A + Annex-B ("), F.col("sheets").cast("string"), F.lit(" sheets)")).alias("_t"))
    both = plain.join(annex, "doc", "left")
    start = F.greatest(F.lit(1), F.least(F.coalesce("_s", "start_page"), "n_pages"))
    both = both.select("doc", "n_pages", start.alias("start_page"), F.coalesce("_e", "end_page").alias("_end"), F.coalesce("_t", "title").alias("title"))
    return both.select("doc", "start_page", F.greatest("start_page", F.least("_end", "n_pages")).alias("end_page"), "title")


def pages_between(pages: DataFrame, ranges: DataFrame) -> DataFrame:
    """The pages of each document from start_page to end_page, both included; past the end there are none."""
    return pages.join(ranges.select("doc", "start_page", "end_page"), "doc").where("page_no BETWEEN start_page AND end_page").drop("start_page", "end_page")


def checked_range(start, end, total: int) -> tuple[int, int] | None:
    """A page range as a user gives it: both or none, whole numbers, 1 <= start <= end <= total."""
    if start in (None, "") and end in (None, ""):
        return None
    if start in (None, "") or end in (None, ""):
        raise ValueError("both start and end page are needed")
    try:
        a, z = int(start), int(end)
    except (TypeError, ValueError) as e:
        raise ValueError("pages must be whole numbers") from e
    if a < 1 or z < a or z > total:
        raise ValueError(f"pages must lie between 1 and {total}, in order")
    return a, z
