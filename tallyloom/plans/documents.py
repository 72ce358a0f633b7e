"""Queries of the document side: pages, lines, sections, cost, outlines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import requirements as rq
from ..functions import rules as R
from ..functions import text as tx
from ..operators import detect as dt
from ..operators import shape as sh
from .book import Book

BOOK = Book()
#: Lines that open the pages of our volumes; documents themselves are invented prose.
TOPS = [
    "SECTION V", "x", "Technical Requirements", "Annex-B1", "Annex-B2", "SCOPE OF WORK", "Table of Contents\nFirewall .... 3\nSwitch .... 4\nRouter .... 5", "BID FORMS", "y", "Annex-A : Bill of Quantity",
    "Annex-B7", "ANNEX-C", "SCHEDULE OF REQUIREMENTS for the network", "z", "Invitation to Bid\nSECTION 5", "TSR-7", "Annex-B9", "q", "EVALUATION CRITERIA", "a 1\na 2\na 3\na 4\na 5\na 6\na 7\nSECTION 5",
    "FORM A-1 of the bidder who shall sign and stamp every page of it", "w", "v",
]
FILLER = "Firewall and switch, throughput in Gbps; IPsec VPN. "
#: documents as volumes of 50 pages; a volume's number shifts which page opens with which line
PAGES = "pg AS (SELECT doc_id // 50 AS doc, doc_id % 50 + 1 AS page_no, doc_id, text AS prose, [" + ", ".join("'" + x.replace("\n", "' || chr(10) || '") + "'" for x in TOPS) + f"][(doc_id * 7 + doc_id // 50) % {len(TOPS)} + 1] || chr(10) || repeat('{FILLER}', CAST(doc_id % 4 AS BIGINT)) || chr(10) || text AS text FROM documents)"


def pages(t):
    tops = F.array(*map(F.lit, TOPS))
    top = F.get(tops, ((F.col("doc_id") * 7 + F.floor(F.col("doc_id") / 50)) % len(TOPS)).cast("int"))
    text = F.concat(top, F.lit("\n"), F.expr(f"repeat('{FILLER}', cast(doc_id % 4 as int))"), F.lit("\n"), F.col("text"))
    return t.documents.select(F.floor(F.col("doc_id") / 50).cast("bigint").alias("doc"), (F.col("doc_id") % 50 + 1).alias("page_no"), "doc_id", F.col("text").alias("prose"), text.alias("text"))


def sql_density(c: str) -> str:
    return " + ".join(f"least((length({c}) - length(replace({c}, '{k}', ''))) // {len(k)}, 6)" for k in dt.KEYWORDS)


def quoted(p: str) -> str:
    return p.replace("'", "''")


#: Facts of each page, in SQL: lines without outer white space, first headers, density.
FACTS = PAGES + f""",
ls AS (SELECT doc, page_no, doc_id, text, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS l FROM pg),
up AS (SELECT *, upper(replace(array_to_string(l, ' '), 'ß', 'ss')) AS u, array_to_string(l, ' ') AS j FROM ls),
sp(o, pat, w) AS (VALUES {', '.join(f"({n}, '{quoted(p)}', {dt.weight(p)})" for n, p in enumerate(dt.START_HEADERS))}),
ep(o, pat) AS (VALUES {', '.join(f"({n}, '{quoted(p)}')" for n, p in enumerate(dt.END_HEADERS))}),
t8 AS (SELECT doc, page_no, unnest(list_slice(l, 1, 8)) AS line, generate_subscripts(list_slice(l, 1, 8), 1) AS no FROM ls),
t10 AS (SELECT doc, page_no, len(l) AS n, unnest(list_slice(l, 1, 10)) AS line, generate_subscripts(list_slice(l, 1, 10), 1) AS no FROM ls),
sh AS (SELECT doc, page_no, arg_min(struct_pack(o := o, w := w, line := line), struct_pack(a := o, b := no)) AS s FROM t8, sp WHERE length(line) <= 130 AND length(regexp_extract(upper(line), pat)) / greatest(length(line), 1) >= 0.3 GROUP BY ALL),
eh AS (SELECT doc, page_no, arg_min(struct_pack(o := o, place := (no - 1) / n), struct_pack(a := o, b := no)) AS e FROM t10, ep WHERE length(line) <= 130 AND length(regexp_extract(upper(line), pat)) / greatest(length(line), 1) >= 0.3 GROUP BY ALL),
fa AS (SELECT doc, page_no, doc_id, len(l) AS n_lines, (length(j) - length(replace(j, '....', ''))) // 4 > 2 OR (length(j) - length(replace(j, '. . . .', ''))) // 7 > 2 OR (page_no <= 15 AND len(list_filter(l, lambda x: regexp_matches(x, '\\s+\\d{{1,3}}\\s*$'))) > 6) AS toc,
  CAST({sql_density('u')} AS BIGINT) AS density, {' OR '.join(f"contains(u, '{k}')" for k in dt.PROCEDURAL)} AS procedural, s, e, regexp_matches(text, '{quoted(dt.ANNEX_A)}') AS a,
  len(list_filter(list_slice(l, 1, 4), lambda x: regexp_matches(x, '{quoted(dt.ANNEX_B)}'))) > 0 AS b, len(list_filter(list_slice(l, 1, 4), lambda x: regexp_matches(x, '{quoted(dt.ANNEX_C)}'))) > 0 AS c
  FROM up LEFT JOIN sh USING (doc, page_no) LEFT JOIN eh USING (doc, page_no)),
sz AS (SELECT doc, max(page_no) AS n_pages FROM fa GROUP BY 1),
cand AS (SELECT doc, page_no, s.o AS pattern, s.line AS line, density, CAST(s.w + density * 8 - CASE WHEN procedural THEN 800 ELSE 0 END + CASE WHEN (page_no - 1) / n_pages < 0.08 THEN -500 WHEN (page_no - 1) / n_pages > 0.10 AND (page_no - 1) / n_pages < 0.85 THEN 100 ELSE 0 END AS BIGINT) AS score FROM fa JOIN sz USING (doc) WHERE NOT toc AND s IS NOT NULL),
st AS (SELECT doc, n_pages, coalesce(arg_min(page_no, struct_pack(x := -score, y := page_no)), 1) AS start_page, coalesce(arg_min(line, struct_pack(x := -score, y := page_no)), 'Fallback') AS title FROM sz LEFT JOIN cand USING (doc) GROUP BY doc, n_pages),
af AS (SELECT fa.*, start_page, density < 15 AS low FROM fa JOIN st USING (doc) WHERE page_no > start_page),
rn AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY page_no) - row_number() OVER (PARTITION BY doc, low ORDER BY page_no) AS g FROM af),
rk AS (SELECT *, row_number() OVER (PARTITION BY doc, low, g ORDER BY page_no) AS k FROM rn),
ev AS (SELECT doc, page_no, 0 AS kind, CASE WHEN e.place < 0.55 THEN page_no - 1 ELSE page_no END AS v FROM rk WHERE e IS NOT NULL UNION ALL SELECT doc, page_no, 1, page_no - 5 FROM rk WHERE low AND k = 6),
en AS (SELECT doc, n_pages, start_page, title, coalesce(arg_min(v, struct_pack(x := page_no, y := kind)), n_pages) AS end_page FROM st LEFT JOIN ev USING (doc) GROUP BY doc, n_pages, start_page, title),
aa AS (SELECT doc, min(page_no) FILTER (WHERE a) AS a FROM fa GROUP BY 1),
bb AS (SELECT fa.doc, page_no, row_number() OVER (PARTITION BY fa.doc ORDER BY page_no) AS no, lead(page_no) OVER (PARTITION BY fa.doc ORDER BY page_no) - page_no AS gap FROM fa JOIN aa USING (doc) WHERE fa.b AND page_no IS DISTINCT FROM aa.a),
bg AS (SELECT doc, count(*) AS n, list_sort(list(gap) FILTER (WHERE gap IS NOT NULL)) AS x, min(page_no) AS first FROM bb GROUP BY 1),
hf AS (SELECT doc, list_sort(list(gap)) AS h FROM bb JOIN bg USING (doc) WHERE no <= n // 2 + 1 AND gap IS NOT NULL AND no <= (n - 1) // 2 + 1 GROUP BY 1),
ct AS (SELECT bb.doc, min(page_no) AS cut FROM bb JOIN bg USING (doc) JOIN hf USING (doc) WHERE n >= 4 AND gap > greatest(8 * h[len(h) // 2 + 1], 30) GROUP BY 1),
cc AS (SELECT fa.doc, min(page_no) AS c FROM fa JOIN bg USING (doc) JOIN aa USING (doc) WHERE fa.c AND page_no >= first AND page_no IS DISTINCT FROM aa.a GROUP BY 1),
an AS (SELECT bb.doc, coalesce(any_value(aa.a), min(page_no)) AS start_page, CASE WHEN any_value(cc.c) > max(page_no) THEN any_value(cc.c) - 1 ELSE max(page_no) END AS end_page, count(*) AS sheets FROM bb JOIN aa USING (doc) LEFT JOIN ct USING (doc) LEFT JOIN cc USING (doc) WHERE cut IS NULL OR page_no <= cut GROUP BY bb.doc),
ar AS (SELECT * FROM an WHERE end_page - start_page + 1 >= 5 AND sheets >= 3)"""


def facts(t):
    return dt.page_facts(pages(t))


@BOOK.query(f"WITH {FACTS} SELECT doc, page_no, density FROM fa")
def keyword_density(t):
    return facts(t).select("doc", "page_no", "density")


@BOOK.query(f"WITH {FACTS} SELECT doc, page_no, procedural FROM fa")
def procedural_flag(t):
    return facts(t).select("doc", "page_no", "procedural")


SQL_CATEGORIES = [(c, R.CATEGORY_KEYWORDS[c]) for c in [*R.ARCHITECTURE, *(c for c in R.CATEGORY_KEYWORDS if c not in R.ARCHITECTURE)]]


@BOOK.query(f"WITH {PAGES} SELECT doc, page_no, coalesce(CASE " + " ".join("WHEN " + " OR ".join(f"contains(l, '{w}')" for w in ws) + f" THEN '{n}'" for n, ws in SQL_CATEGORIES) + " END, 'NONE') AS category FROM (SELECT doc, page_no, ' ' || regexp_replace(lower(text), '\\s+', ' ', 'g') || ' ' AS l FROM pg)")
def category_detect(t):
    text = F.concat(F.lit(" "), tx.plain(F.col("text")), F.lit(" "))
    return pages(t).select("doc", "page_no", F.coalesce(rq.category(text), F.lit("NONE")).alias("category"))


@BOOK.query(f"WITH {FACTS} SELECT doc, page_no, CAST(n_lines AS BIGINT) AS n_lines, toc AS is_toc FROM fa")
def toc_page_flag(t):
    return facts(t).select("doc", "page_no", F.col("n_lines").cast("bigint").alias("n_lines"), F.col("toc").alias("is_toc"))


@BOOK.query(f"WITH {FACTS} SELECT doc, page_no, CAST(s.o AS BIGINT) AS opens, CAST(e.o AS BIGINT) AS closes, round(e.place, 6) AS place FROM fa WHERE s IS NOT NULL OR e IS NOT NULL")
def header_coverage(t):
    hit = facts(t).where("start IS NOT NULL OR stop IS NOT NULL")
    return hit.select("doc", "page_no", F.col("start.pattern").cast("bigint").alias("opens"), F.col("stop.pattern").cast("bigint").alias("closes"), F.when(F.col("stop").isNotNull(), F.round("stop_place", 6)).alias("place"))


@BOOK.query(f"WITH {FACTS} SELECT doc, page_no, score, line FROM cand")
def start_candidates(t):
    return dt.start_candidates(facts(t)).select("doc", "page_no", F.col("score").cast("bigint").alias("score"), "line")


@BOOK.query(f"WITH {FACTS} SELECT doc, start_page, title FROM st")
def pick_start_page(t):
    return dt.start_pages(facts(t)).select("doc", F.col("start_page").cast("bigint").alias("start_page"), "title")


@BOOK.query(f"WITH {FACTS} SELECT doc, min(page_no) - 5 AS streak_start FROM rk WHERE low AND k = 6 GROUP BY doc")
def low_density_streak(t):
    own = facts(t)
    rows = own.join(dt.start_pages(own).select("doc", "start_page"), "doc").where("page_no > start_page")
    return sh.low_streak(rows, ["doc"], "page_no", F.col("density") < dt.LOW, dt.STREAK)


@BOOK.query(f"WITH {FACTS} SELECT doc, end_page FROM en")
def find_end_page(t):
    own = facts(t)
    return dt.end_pages(own, dt.start_pages(own)).select("doc", F.col("end_page").cast("bigint").alias("end_page"))


@BOOK.query(f"WITH {FACTS} SELECT doc, start_page, end_page, sheets FROM ar")
def annex_sweep(t):
    return dt.annex_ranges(facts(t)).select("doc", *(F.col(c).cast("bigint").alias(c) for c in ("start_page", "end_page", "sheets")))


@BOOK.query(f"WITH {FACTS}, de AS (SELECT en.doc, en.n_pages, greatest(1, least(coalesce(ar.start_page, en.start_page), n_pages)) AS start_page, coalesce(ar.end_page, en.end_page) AS z, CASE WHEN ar.doc IS NULL THEN title ELSE 'Annex-A + Annex-B (' || sheets || ' sheets)' END AS title FROM en LEFT JOIN ar USING (doc)) SELECT doc, start_page, greatest(start_page, least(z, n_pages)) AS end_page, title FROM de")
def detect_requirements(t):
    """The whole detector: annexes first, else headers, scores and the end."""
    return dt.detect_sections(facts(t)).select("doc", *(F.col(c).cast("bigint").alias(c) for c in ("start_page", "end_page")), "title")


@BOOK.query(f"WITH {FACTS} SELECT doc, page_no, length(text) AS n FROM en JOIN pg USING (doc) WHERE page_no BETWEEN start_page AND end_page")
def section_pages(t):
    own = facts(t)
    return dt.pages_between(pages(t), dt.end_pages(own, dt.start_pages(own))).select("doc", "page_no", F.length("text").cast("bigint").alias("n"))


@BOOK.query("""WITH p AS (SELECT DISTINCT user_id, event_id // 7 AS page FROM events), g AS (SELECT *, row_number() OVER w no, lead(page) OVER w - page gap FROM p WINDOW w AS (PARTITION BY user_id ORDER BY page)),
a AS (SELECT user_id, count(*) n, list(struct_pack(no := no, page := page, gap := gap) ORDER BY no) FILTER (WHERE gap IS NOT NULL) gs FROM g GROUP BY 1),
b AS (SELECT *, list_sort(list_transform(list_filter(gs, lambda s: s.no <= n // 2 + 1), lambda s: s.gap)) half FROM a),
c AS (SELECT *, greatest(2 * half[len(half) // 2 + 1], 30) bar FROM b)
SELECT user_id, CASE WHEN n >= 4 THEN list_min(list_transform(list_filter(gs, lambda s: s.gap > bar), lambda s: s.page)) END AS cut_page FROM c""")
def corrigendum_gap_cut(t):
    rows = t.events.select("user_id", F.floor(F.col("event_id") / 7).cast("bigint").alias("page")).distinct()
    return sh.gap_cut(rows, ["user_id"], "page", factor=2)


@BOOK.query(f"WITH {PAGES} SELECT doc, (page_no - 1) // 10 AS chunk_no, count(*) AS n_pages, min(page_no) AS first_page, max(page_no) AS last_page FROM pg GROUP BY ALL")
def page_chunking(t):
    return pages(t).groupBy("doc", F.floor((F.col("page_no") - 1) / 10).cast("bigint").alias("chunk_no")).agg(F.count(F.lit(1)).alias("n_pages"), F.min("page_no").alias("first_page"), F.max("page_no").alias("last_page"))


#: Dollars for a million tokens in and out.
PRICES = [
    ("gemini-3-flash-preview", 0.50, 3.00), ("gemini-3.5-flash", 1.50, 9.00), ("gemini-3.1-pro-preview", 2.00, 12.00), ("gemini-3.1-flash-lite", 0.25, 1.50), ("gemini-2.5-pro", 1.25, 10.00),
    ("gemini-2.5-flash", 0.30, 2.50), ("gemini-2.5-flash-lite", 0.10, 0.40), ("gemini-2.5-flash-lite-preview-09-2025", 0.10, 0.40),
]


def price_of(model: str | None) -> tuple[str, float, float]:
    """The prices of a model (the first without a name); an unknown model is an error."""
    wanted = (model or PRICES[0][0]).strip()
    for row in PRICES:
        if row[0] == wanted:
            return row
    raise ValueError(f"unknown model {wanted!r}; known: " + ", ".join(m for m, *_ in PRICES))


def estimated_cost(volumes, prices):
    """volumes (doc, p pages, c characters) with tokens and dollars of each model of prices."""
    rows = F.array(*(F.struct(F.lit(m).alias("model"), F.lit(a).alias("pi"), F.lit(b).alias("po")) for m, a, b in prices))
    ti = F.floor((F.col("c") + 4500 * F.greatest(F.lit(1), F.ceil(F.col("p") / 10))) / F.lit(3.8)).cast("bigint")
    out = volumes.select("doc", ti.alias("tokens_in"), F.explode(rows).alias("x")).withColumn("tokens_out", F.floor(F.col("tokens_in") * F.lit(0.3)).cast("bigint"))
    return out.select("doc", "x.model", "tokens_in", "tokens_out", F.round(F.col("tokens_in") / 1e6 * F.col("x.pi") + F.col("tokens_out") / 1e6 * F.col("x.po"), 6).alias("usd"))


@BOOK.query(f"""WITH {PAGES}, a AS (SELECT doc, count(*) p, sum(length(text)) c FROM pg GROUP BY 1), b AS (SELECT doc, floor((c + 4500 * greatest(1, ceil(p / 10.0))) / 3.8) ti FROM a),
pr(model, pi, po) AS (VALUES {', '.join(f"('{m}', {a}::DOUBLE, {b}::DOUBLE)" for m, a, b in PRICES)})
SELECT doc, model, CAST(ti AS BIGINT) AS tokens_in, CAST(floor(ti * 0.3::DOUBLE) AS BIGINT) AS tokens_out, round(ti / 1e6 * pi + floor(ti * 0.3::DOUBLE) / 1e6 * po, 6) AS usd FROM b, pr""")
def cost_estimate(t):
    return estimated_cost(pages(t).groupBy("doc").agg(F.count(F.lit(1)).alias("p"), F.sum(F.length("text")).alias("c")), PRICES)


@BOOK.query("SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) FILTER (WHERE text <> '') AS full_text FROM conversations GROUP BY conv_id")
def page_text_concat(t):
    parts = F.sort_array(F.collect_list(F.when(F.col("text") != "", F.struct("turn", "text"))))
    return t.conversations.groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda s: s["text"]), "\n").alias("full_text"))


@BOOK.query("SELECT doc_id, CAST(greatest(15, least(list_max(list_transform(string_split(text, chr(10)), lambda x: length(x))) + 2, 65)) AS BIGINT) AS width FROM documents")
def column_width_stats(t):
    return t.documents.select("doc_id", F.greatest(F.lit(15), F.least(F.array_max(F.transform(F.split("text", "\n"), lambda x: F.length(x))) + 2, F.lit(65))).cast("bigint").alias("width"))


@BOOK.query(r"SELECT doc_id, regexp_replace(text, '(\S)\s+([a-zA-Z0-9][.)])\s+', '\1' || chr(10) || '\2 ', 'g') AS text FROM documents")
def inline_bullet_split(t):
    return t.documents.select("doc_id", tx.inline_bullets(F.col("text")).alias("text"))


OUTLINE = "tc AS (SELECT user_id, event_id AS idx, event_id % 3 + 1 AS lvl, 'h' || event_id AS title, event_id // 5 + 1 AS page FROM events)"


def outline(t):
    e = F.col("event_id")
    return t.events.select("user_id", e.alias("idx"), (e % 3 + 1).alias("lvl"), F.concat(F.lit("h"), e.cast("string")).alias("title"), (F.floor(e / 5) + 1).cast("bigint").alias("page"))


@BOOK.query(f"""WITH {OUTLINE}, par AS (SELECT a.user_id, a.idx, a.title, b.idx bi, b.title bt FROM tc a LEFT JOIN tc b ON a.user_id = b.user_id AND b.idx < a.idx AND b.lvl < a.lvl
 AND NOT EXISTS (SELECT 1 FROM tc c WHERE c.user_id = a.user_id AND c.idx > b.idx AND c.idx < a.idx AND c.lvl <= b.lvl))
SELECT idx, coalesce(string_agg(bt, ' > ' ORDER BY bi) || ' > ', '') || title AS path FROM par GROUP BY user_id, idx, title""")
def bookmark_parent_path(t):
    return sh.parent_path(outline(t), ["user_id"], "idx", "lvl", "title", 3).select("idx", "path")


@BOOK.query(f"""WITH {OUTLINE}, nx AS (SELECT a.*, (SELECT arg_min(b.page, b.idx) FROM tc b WHERE b.user_id = a.user_id AND b.idx > a.idx AND b.lvl <= a.lvl) np,
 (SELECT max(c.page) FROM tc c WHERE c.user_id = a.user_id AND c.idx >= a.idx) mp FROM tc a) SELECT idx, CASE WHEN np IS NOT NULL THEN greatest(page, np - 1) ELSE mp END AS page_end FROM nx""")
def bookmark_page_end(t):
    return sh.section_end(outline(t), ["user_id"], "idx", "lvl", "page", 3).select("idx", "page_end")


@BOOK.query("SELECT page_id % 50 AS page, arg_min(url, page_id) AS dest FROM pages GROUP BY 1")
def named_dest_first(t):
    return t.pages.groupBy((F.col("page_id") % 50).alias("page")).agg(F.min_by("url", "page_id").alias("dest"))


@BOOK.query("SELECT page_id, regexp_extract(html, 'https?://[^\\s|\"''<>]+', 0) AS first_url FROM pages")
def first_url(t):
    return t.pages.select("page_id", tx.first_url(F.col("html")).alias("first_url"))
