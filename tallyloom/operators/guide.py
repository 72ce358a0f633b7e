"""Citations of a guide: outlines to an index, rows to their best entries, citations as text.

The index is the small side (a guide's outline): queries meet it in a join on shared tokens or, with an
encoder, on the nearest vectors; whole texts are scored by an Arrow function in both cases.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import constraints as cs
from ..functions import text as tx
from ..sources.staged import staged
from . import gates
from . import retrieve as rt
from . import shape as sh

#: Domains of sections, of texts, and what two domains also mean.
DOMAINS = [
    ("VPN", ["vpn", "ipsec", "ssl vpn", "remote access"]), ("Firewall Policy", ["firewall", "policy", "nat", "security policy"]), ("High Availability", ["ha", "high availability", "cluster"]),
    ("Routing", ["routing", "ospf", "bgp", "static route"]), ("Authentication", ["authentication", "ldap", "radius", "saml", "user"]), ("Logging", ["log", "logging", "fortianalyzer", "syslog"]),
    ("SD-WAN", ["sd-wan", "sdwan"]), ("Security Profiles", ["ips", "antivirus", "web filter", "application control"]),
]
TEXT_DOMAINS = [
    ("VPN", ["vpn", "ipsec", "ssl vpn"]), ("Firewall Policy", ["firewall", "policy", "nat"]), ("Routing", ["routing", "bgp", "ospf"]), ("High Availability", ["ha", "high availability", "cluster"]),
    ("Authentication", ["authentication", "ldap", "radius", "saml"]), ("Logging", ["log", "syslog", "fortianalyzer"]), ("Security Profiles", ["ips", "antivirus", "web filter", "application control"]),
    ("SD-WAN", ["sd-wan", "sdwan"]),
]
ALSO = [
    (["network security", "next generation firewall"], ["networking", "routing", "firewall policy", "ips", "antivirus", "web filter"]),
    (["remote access"], ["ipsec vpn", "agentless vpn", "ssl vpn"]),
]
AUTO, PREFILTER = 0.60, 15
TEXTS = "array<string>"


# Outlines


def resolved_page(dest_page: Column, item_page: Column, n_pages: Column) -> Column:
    """The destination's page (from 0) plus one, else the entry's own page, else 1; not past the end."""
    return F.when(dest_page >= 0, F.least(dest_page + 1, n_pages)).when(item_page > 0, F.least(item_page, n_pages)).otherwise(F.lit(1))


def page_anchor(page: Column) -> Column:
    return F.when(F.coalesce(page, F.lit(0)) > 0, F.concat(F.lit("#page="), page.cast("string"))).otherwise("")


def page_uri(uri: Column, page: Column) -> Column:
    """The file's address at a page: an address with a page stays, another's fragment is replaced."""
    base = F.concat(F.substring_index(uri, "#", 1), page_anchor(page))
    return F.when(F.coalesce(uri, F.lit("")) == "", "").when(F.contains(uri, F.lit("#page=")), uri).when(F.coalesce(page, F.lit(0)) > 0, base).otherwise(uri)


def domains(c: Column, rules=DOMAINS) -> Column:
    """Domains of which the text holds a phrase (with a blank or a hyphen) or has a word."""
    own, low = tx.tokens(c), F.lower(c)
    named = [F.when(_held(low, own, ws), F.lit(n)) for n, ws in rules]
    found = F.array_compact(F.array(*named))
    return F.when(F.size(found) == 0, F.array(F.lit("General"))).otherwise(found)


def _held(low: Column, own: Column, ws) -> Column:
    phrases, single = [w for w in ws if " " in w or "-" in w], [w for w in ws if " " not in w and "-" not in w]
    return tx.any_of(low, phrases) | (F.arrays_overlap(own, cs.words(single)) if single else F.lit(False))


def first_destinations(names: DataFrame) -> DataFrame:
    """doc, page, named_destination: the first name, in order of names, that leads to each page (from 1). names:
    doc, name, dest_page (from 0, null where it cannot be resolved)."""
    rows = names.where("dest_page >= 0 AND name <> ''").select("doc", "name", (F.col("dest_page") + 1).alias("page"))
    return rows.groupBy("doc", "page").agg(F.min("name").alias("named_destination"))


def internal_links(links: DataFrame) -> DataFrame:
    """Links to pages and links to addresses (doc, source_page and target_page from 0, uri, no): id, source_page,
    target_page, uri, anchor with pages from 1; a link with neither goes."""
    inner = F.col("target_page") >= 0
    rows = links.where(F.coalesce(inner, F.lit(False)) | (F.coalesce("uri", F.lit("")) != ""))
    page = F.when(inner, F.col("target_page") + 1)
    ident = F.concat(F.lit("link_"), (F.col("source_page") + 1).cast("string"), F.lit("_"), F.col("no").cast("string"))
    return rows.select("doc", ident.alias("id"), (F.col("source_page") + 1).alias("source_page"), page.alias("target_page"), F.when(~F.coalesce(inner, F.lit(False)), F.col("uri")).alias("uri"), page_anchor(page).alias("anchor"))


def flat_index(toc: DataFrame, names: DataFrame | None = None, deepest: int = 16) -> DataFrame:
    """An index row for each outline entry: id, title, page, page_end, level, section_path, parents, anchor, pdf_uri,
    named_destination, embedding_text, keywords, domains. toc: doc, idx, level (1 to deepest), title, page, dest_page,
    n_pages, uri. An entry deeper than deepest is an error."""
    rows = toc.withColumns({"level": F.when(F.col("level") <= deepest, F.col("level")).otherwise(F.raise_error(F.lit(f"an outline deeper than {deepest} levels"))), "title": F.trim("title"), "_page": resolved_page(F.col("dest_page"), F.col("page"), F.col("n_pages"))})
    rows = sh.parent_path(rows, ["doc"], "idx", "level", "title", deepest, "section_path")
    rows = sh.section_end(rows.withColumn("_raw", F.coalesce(F.nullif("page", F.lit(0)), "_page")), ["doc"], "idx", "level", "_raw", deepest, "page_end")
    named = F.lit("").alias("named_destination")
    if names is not None:
        first = first_destinations(names).withColumnRenamed("page", "_page")
        rows, named = rows.join(first, ["doc", "_page"], "left"), F.coalesce("named_destination", F.lit("")).alias("named_destination")
    text = F.concat("section_path", F.lit(" | "), "title", F.lit(" | page "), F.col("_page").cast("string"))
    return rows.select(
        "doc", F.concat(F.lit("toc_"), F.col("idx").cast("string")).alias("id"), "idx", "title", F.col("_page").alias("page"), F.greatest("page_end", "_page").alias("page_end"), "level", "section_path",
        page_anchor(F.col("_page")).alias("anchor"), page_uri(F.col("uri"), F.col("_page")).alias("pdf_uri"), named, text.alias("embedding_text"), tx.tokens(F.col("section_path")).alias("keywords"), domains(F.col("section_path")).alias("domains"),
    )


def index_entries(raw: DataFrame) -> DataFrame:
    """Entries of an index as JSON (doc, idx, entry VARIANT) with what they lack filled in: page, anchor, pdf_uri, and the text
    that stands for them (the first that there is of five fields)."""
    get = lambda n: cs.filled(F.try_variant_get("entry", f"$.{n}", "string"))
    page = F.coalesce(get("pdf_page"), get("page")).try_cast("int")
    listed = lambda n: F.coalesce(F.try_variant_get("entry", f"$.{n}", TEXTS), F.array().cast(TEXTS))
    return raw.select(
        "doc", "idx", F.coalesce(get("title"), F.lit("")).alias("title"), page.alias("page"), F.coalesce(get("pdf_anchor"), get("anchor"), page_anchor(page)).alias("anchor"),
        page_uri(F.coalesce(get("pdf_uri"), F.lit("")), page).alias("pdf_uri"), F.coalesce(get("url"), F.lit("")).alias("url"),
        F.coalesce(*(get(n) for n in ("embedding_text", "contextual_title", "section_path", "path", "title")), F.lit("")).alias("embedding_text"),
        F.coalesce(*(get(n) for n in ("contextual_title", "section_path", "title")), F.lit("")).alias("section_path"), listed("keywords").alias("keywords"), listed("domains").alias("domains"),
    )


def index_is_linked(raw: DataFrame, sample: int = 25) -> DataFrame:
    """One row, linked: of the first entries any has an address, or all have a page, an anchor and a file's address that agree."""
    get = lambda n: cs.filled(F.try_variant_get("entry", f"$.{n}", "string"))
    anchor = F.concat(F.lit("#page="), get("page"))
    agrees = F.coalesce((get("anchor") == anchor) & F.endswith(get("pdf_uri"), anchor), F.lit(False))
    return raw.orderBy("idx").limit(sample).agg((F.coalesce(F.bool_or(get("url").isNotNull()), F.lit(False)) | F.coalesce(F.bool_and(agrees), F.lit(False))).alias("linked"))


# Rows


def tag_of(cell: Column) -> Column:
    """VARIANT of a cell's tag: the cell as JSON, else its first flat object; null unless it says that a reference is needed."""
    raw = F.trim(F.coalesce(cell, F.lit("")))
    whole = F.try_parse_json(raw)
    tag = F.when(whole.isNotNull(), whole).otherwise(F.try_parse_json(cs.filled(F.regexp_extract(raw, r"(\{[^{}]+\})", 1))))
    needed = F.coalesce(F.try_variant_get(tag, "$.reference_needed", "string"), F.lit(""))
    return F.when(~F.lower(needed).isin("", "false", "0", "null"), tag)


def with_tags(rows: DataFrame, text: str, tag: str | None = None) -> DataFrame:
    """rows with lookups (the features to look up), tag_domains and origin (tag, text, or null where nothing is asked for)."""
    own = tag_of(F.col(tag)) if tag else F.lit(None).cast("variant")
    rows = rows.withColumn("_tag", own)
    listed = lambda n: F.filter(F.coalesce(F.try_variant_get("_tag", f"$.{n}", TEXTS), F.array().cast(TEXTS)), lambda x: F.coalesce(F.trim(x), F.lit("")) != "")
    query = cs.filled(F.try_variant_get("_tag", "$.lookup_query", "string"))
    short = F.left(F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\s+", " ")), F.lit(180))
    low = F.lower(short)
    spoken = F.array_compact(F.array(*(F.when(tx.any_of(low, ws), F.lit(n)) for n, ws in TEXT_DOMAINS)))
    tagged, asks = F.col("_tag").isNotNull(), gates.guide_reference(F.col(text))
    features = F.when(F.size(listed("fortinet_feature_candidates")) > 0, listed("fortinet_feature_candidates")).otherwise(F.array_compact(F.array(query)))
    none = F.array().cast(TEXTS)
    return rows.withColumns({
        "lookups": F.when(tagged, features).when(asks, F.array(short)).otherwise(none),
        "tag_domains": F.when(tagged, listed("fortinet_domains")).when(asks, spoken).otherwise(none),
        "origin": F.when(tagged, "tag").when(asks, "text"),
    }).drop("_tag")


def domain_boost(asked: Column, held: Column) -> Column:
    """The share of an entry's domains that are asked for; 0.2 where none is, 0 where either has none."""
    low = F.transform(asked, lambda d: F.lower(d))
    for names, more in ALSO:
        low = F.when(F.arrays_overlap(low, cs.words(names)), F.array_union(low, cs.words(more))).otherwise(low)
    own = F.array_distinct(F.transform(held, lambda d: F.lower(d)))
    both = F.size(F.array_intersect(low, own))
    return F.when((F.size(asked) == 0) | (F.size(held) == 0), 0.0).when(both == 0, 0.2).otherwise(both / F.size(own))


def fuzzy() -> Column:
    """token-sort ratio of two columns of text, as an Arrow function."""

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        order = lambda t: " ".join(sorted((t or "").lower().split()))
        pairs = ((order(x), order(y)) for x, y in zip(a, b))
        return pd.Series([2 * rt.common_length(x, y) / (len(x) + len(y)) if x or y else 1.0 for x, y in pairs])

    return ratio


def composite(semantic: Column | None) -> Column:
    """The weighted mean of columns fuzzy, keyword and domain (and semantic, where an encoder gave it)."""
    parts = {"fuzzy": F.col("fuzzy"), "keyword": F.col("keyword"), "domain": F.col("domain")}
    return rt.composite(parts if semantic is None else {"semantic": semantic, **parts})


def best_entries(queries: DataFrame, index: DataFrame, encode: Callable[[DataFrame, str], DataFrame] | None = None, prefilter: int = PREFILTER) -> DataFrame:
    """The best entry of each distinct query (q, query, tag_domains, doc): score, method, confidence, status and the parts of
    the score. encode(df, text column) adds an array column vector; without it all entries of the guide that share a
    token with the query are scored, or all of them where none does."""
    asked = queries.withColumn("_tokens", tx.tokens(F.col("query")))
    entries = index.select("doc", "idx", "title", "page", "section_path", "pdf_uri", "url", "keywords", "domains", "embedding_text")
    if encode is None:
        pairs = asked.join(entries, "doc").withColumn("semantic", F.lit(None).cast("double"))
    else:
        a = encode(asked, "query").withColumnRenamed("vector", "_a")
        b = encode(entries, "embedding_text").withColumnRenamed("vector", "_b")
        dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u * v), F.lit(0.0), lambda t, z: t + z)
        cos = dot(F.col("_a"), F.col("_b")) / F.nullif(F.sqrt(dot(F.col("_a"), F.col("_a")) * dot(F.col("_b"), F.col("_b"))), F.lit(0.0))
        pairs = a.join(b, "doc").withColumn("_cos", F.coalesce(cos, F.lit(0.0)))
        pairs = sh.top_k(pairs, ["q"], [F.desc("_cos"), "idx"], prefilter, "_rank").drop("_rank", "_a", "_b")
        pairs = pairs.withColumn("semantic", F.greatest(F.lit(0.0), (F.col("_cos") + 1) / 2))
    held = F.size(F.array_intersect("_tokens", "keywords"))
    own = tx.tokens(F.col("title"))
    pairs = pairs.withColumns({"fuzzy": fuzzy()("query", "section_path"), "keyword": F.when((F.size("_tokens") > 0) & (F.size("keywords") > 0), held / F.size("keywords")).otherwise(0.0), "domain": domain_boost(F.col("tag_domains"), F.col("domains"))})
    sure = (F.size(own) > 0) & (F.size(F.array_except(own, F.col("_tokens"))) == 0)
    pairs = pairs.withColumn("fuzzy", F.when(sure, F.greatest("fuzzy", F.lit(0.85))).otherwise(F.col("fuzzy")))
    pairs = pairs.withColumn("score", composite(F.col("semantic") if encode else None))
    best = pairs.groupBy("q").agg(F.min_by(F.struct(*(c for c in pairs.columns if c not in ("q", "_tokens", "_cos"))), F.struct((-F.col("score")).alias("s"), "idx")).alias("b")).select("q", "b.*")
    wide, close = F.coalesce(F.col("semantic") > 0.3, F.lit(False)), F.col("fuzzy") > 0.3
    method = F.when(wide & close, "hybrid_semantic_fuzzy").when(wide, "semantic_only").when(close, "fuzzy_only").otherwise("keyword_only")
    return best.withColumns({"method": method, "confidence": rt.band(F.col("score")), "status": F.when(F.col("score") >= AUTO, "Matched").otherwise("Manual Review Required"), "score": F.round("score", 4)})


def citation() -> Column:
    named = F.concat(F.lit("FortiOS Admin Guide - "), "title")
    return F.when(F.coalesce("title", F.lit("")) == "", "").when(F.col("page").isNotNull(), F.concat(named, F.lit(" (Page "), F.col("page").cast("string"), F.lit(")"))).otherwise(named)


def enrich(rows: DataFrame, index: DataFrame, key: list[str], text: str, tag: str | None = None, encode: Callable[[DataFrame, str], DataFrame] | None = None) -> DataFrame:
    """rows with reference, reasoning and status of the guide's sections that each asks for: one for each feature of its
    tag, an entry once; status is null (and the texts are empty) where nothing is asked for, Manual Review Required where any
    match is unsure. rows: doc (the guide's), key, text, tag; equal lookups are scored once."""
    asked = staged(with_tags(rows, text, tag))
    each = asked.where("origin IS NOT NULL").select("doc", *key, "tag_domains", F.posexplode("lookups").alias("no", "lookup"), F.col(text).alias("_text"))
    alone = F.concat("lookup", F.lit(" "), F.left(F.coalesce("_text", F.lit("")), F.lit(200)))
    each = staged(each.withColumn("query", alone).withColumn("q", F.xxhash64("doc", "query", "tag_domains")))
    best = best_entries(each.groupBy("q").agg(F.first("doc").alias("doc"), F.first("query").alias("query"), F.first("tag_domains").alias("tag_domains")), index, encode)
    best = staged(best.drop("doc", "query", "tag_domains"))
    found = each.join(best, "q", "left")
    same = F.coalesce(cs.filled(F.col("url")), cs.filled(F.col("pdf_uri")), "title")
    first = F.row_number().over(Window.partitionBy(*key, same).orderBy("no"))
    found = found.withColumn("_rn", first).where("_rn = 1")
    said = F.when(F.col("status") == "Matched", citation()).otherwise(F.concat(F.lit("[Review Required] "), F.coalesce(cs.filled(citation()), F.lit("No match found"))))
    uri = F.coalesce(cs.filled(F.col("url")), cs.filled(F.col("pdf_uri")))
    said = F.when(uri.isNotNull(), F.concat(said, F.lit("\n"), uri)).otherwise(said)
    why = F.format_string("Selected '%s' using %s scoring. Status: %s; confidence: %s; score: %s. Section path: %s.", F.coalesce("title", F.lit("No matched section")), F.coalesce("method", F.lit("no")), F.coalesce("status", F.lit("Manual Review Required")), F.coalesce("confidence", F.lit("Low")), F.coalesce("score", F.lit(0.0)).cast("string"), F.coalesce("section_path", F.lit("")))
    rolled = found.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("no", said.alias("c"), why.alias("w")))).alias("_i"), F.bool_and(F.coalesce(F.col("status") == "Matched", F.lit(False))).alias("_all"))
    joined = lambda f: F.coalesce(F.array_join(F.transform("_i", lambda x: x[f]), "\n\n"), F.lit(""))
    out = asked.join(rolled, key, "left")
    status = F.when(F.col("_all"), "Matched").when(F.col("origin").isNotNull(), "Manual Review Required")
    return out.withColumns({"reference": joined("c"), "reasoning": joined("w"), "status": status}).drop("_i", "_all", "lookups", "tag_domains")


def written(status: Column, value: Column, error: Column) -> Column:
    """A cell: empty where nothing is asked for, the error where a row failed, else the value."""
    return F.when(error.isNotNull(), F.concat(F.lit("[ERROR] "), error)).when(status.isNull(), "").otherwise(value)
