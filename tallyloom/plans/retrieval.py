"""Queries of the retrieval side: TF-IDF, cosine, overlap, fuzzy and hybrid scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import retrieve as rt
from ..operators import shape as sh
from .book import Book

BOOK = Book()
SQL_TOKENS = "list_distinct(regexp_extract_all(lower({0}), '[a-z0-9]+(?:[-''][a-z0-9]+)*'))"


@BOOK.query(f"SELECT doc_id, CAST(len(x) AS BIGINT) AS n_tokens, array_to_string(list_slice(list_sort(x), 1, 5), ',') AS head FROM (SELECT doc_id, {SQL_TOKENS.format('text')} x FROM documents)")
def token_set(t):
    rows = t.documents.select("doc_id", tx.tokens(F.col("text")).alias("x"))
    return rows.select("doc_id", F.size("x").cast("bigint").alias("n_tokens"), F.array_join(F.slice("x", 1, 5), ",").alias("head"))





TERMS = "regexp_extract_all(lower({0}), '[a-z0-9]{{2,}}')"


@BOOK.query(f"""WITH dt AS (SELECT item_id AS d, unnest({TERMS.format('text')}) term FROM benchmark), qt AS (SELECT conv_id * 1000 + turn AS q, unnest({TERMS.format('text')}) term FROM conversations),
n AS (SELECT count(*) n FROM benchmark), df AS (SELECT term, count(DISTINCT d) df FROM dt GROUP BY 1), idf AS (SELECT term, ln((1 + n) / (1 + df)) + 1 w FROM df, n),
dw AS (SELECT d, term, count(*) * max(w) w FROM dt JOIN idf USING (term) GROUP BY d, term), dn AS (SELECT d, sqrt(sum(w * w)) l FROM dw GROUP BY d),
qw AS (SELECT q, term, count(*) * max(w) w FROM qt JOIN idf USING (term) GROUP BY q, term), qn AS (SELECT q, sqrt(sum(w * w)) l FROM qw GROUP BY q),
sc AS (SELECT q, d, round(sum(qw.w * dw.w) / max(qn.l) / max(dn.l), 6) score FROM qw JOIN dw USING (term) JOIN qn USING (q) JOIN dn USING (d) GROUP BY q, d)
SELECT q, d, score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, d) rn FROM sc) WHERE rn <= 3""")
def tfidf_topk(t):
    docs = t.benchmark.select(F.col("item_id").alias("d"), "text")
    asked = t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("q"), "text")
    scored = rt.tfidf_scores(asked, docs, "q", "d").withColumn("score", F.round("score", 6))
    return sh.top_k(scored, ["q"], [F.desc("score"), "d"], 3).select("q", "d", "score")


@BOOK.query(f"""WITH b AS (SELECT item_id, {SQL_TOKENS.format('text')} x FROM benchmark), p AS (SELECT a.item_id q, b.item_id d, len(list_intersect(a.x, b.x)) / sqrt(len(a.x) * len(b.x)) s FROM b a JOIN b ON a.item_id <> b.item_id)
SELECT q, d, round(s, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(s, 6) DESC, d) rn FROM p WHERE s > 0) WHERE rn <= 5""")
def token_overlap_topk(t):
    rows = t.benchmark.select(F.col("item_id").alias("k"), tx.tokens(F.col("text")).alias("x"))
    scored = rt.overlap_scores(rows, rows, "cosine").where("q <> d").withColumn("score", F.round("score", 6))
    return sh.top_k(scored, ["q"], [F.desc("score"), "d"], 5).select("q", "d", "score")


@BOOK.query(f"""WITH b AS (SELECT item_id, {SQL_TOKENS.format('text')} x FROM benchmark)
SELECT a.item_id AS q, c.item_id AS d, round(len(list_intersect(a.x, c.x)) / len(c.x), 6) AS score FROM b a JOIN b c ON a.item_id <> c.item_id WHERE len(list_intersect(a.x, c.x)) > 0""")
def keyword_overlap(t):
    rows = t.benchmark.select(F.col("item_id").alias("k"), tx.tokens(F.col("text")).alias("x"))
    return rt.overlap_scores(rows, rows, "share").where("q <> d").select("q", "d", F.round("score", 6).alias("score"))


@BOOK.query("""WITH q AS (SELECT * FROM embeddings WHERE vec_id % 100 = 0), p AS (SELECT q.vec_id q, e.vec_id d, round(list_sum(list_transform(list_zip(q.embedding, e.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)), 5) cos FROM q JOIN embeddings e ON q.vec_id <> e.vec_id)
SELECT q, d, cos, round(greatest(0, (cos + 1) / 2), 6) AS semantic FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY cos DESC, d) rn FROM p) WHERE rn <= 15""")
def cosine_topk(t):
    """The stated query set, ids divisible by 100, against all vectors, in blocks."""
    rows = t.embeddings.select("vec_id", "embedding")
    top = rt.cosine_top(rows.where("vec_id % 100 = 0"), rows, "vec_id", "embedding", 15, digits=5)
    return top.select("q", "d", "cos", F.round(F.greatest(F.lit(0.0), (F.col("cos") + 1) / 2), 6).alias("semantic"))


@BOOK.query()
def fuzzy_token_sort(t):
    """The token-sort ratio of the whole texts of each two items that share a token."""
    rows = t.benchmark.select(F.col("item_id").alias("k"), "text", tx.tokens(F.col("text")).alias("x"))
    pairs = rt.overlap_scores(rows, rows, "share").where("q <> d").select("q", "d")
    return rt.token_sort_ratios(pairs, rows.select("k", "text")).select("q", "d", F.round("ratio", 6).alias("ratio"))


@BOOK.query(f"""WITH b AS (SELECT item_id, item_id % 3 dom, {SQL_TOKENS.format('text')} x FROM benchmark),
p AS (SELECT a.item_id q, c.item_id d, len(list_intersect(a.x, c.x)) / sqrt(len(a.x) * len(c.x)) fuz, len(list_intersect(a.x, c.x)) / len(c.x) kw, CASE WHEN a.dom = c.dom THEN 1.0 ELSE 0.2 END::DOUBLE dom FROM b a JOIN b c ON a.item_id <> c.item_id),
s AS (SELECT *, round((0.25 * fuz + 0.15 * kw + 0.05 * dom) / 0.45, 6) score FROM p WHERE kw > 0), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, d) rn FROM s)
SELECT q, d, score, CASE WHEN score >= 0.8 THEN 'High' WHEN score >= 0.55 THEN 'Medium' ELSE 'Low' END AS band, score >= 0.6 AS matched FROM r WHERE rn = 1""")
def hybrid_score_best(t):
    """The composite without an encoder: the semantic weight goes, the rest is renormalised."""
    rows = t.benchmark.select(F.col("item_id").alias("k"), tx.tokens(F.col("text")).alias("x"))
    both = rt.overlap_scores(rows, rows, "cosine", "share").where("q <> d")
    dom = F.when(F.col("q") % 3 == F.col("d") % 3, 1.0).otherwise(0.2)
    scored = both.withColumn("score", F.round(rt.composite({"fuzzy": F.col("score"), "keyword": F.col("share"), "domain": dom}), 6))
    best = sh.first_wins(scored, ["q"], [F.desc("score"), "d"])
    return best.select("q", "d", "score", rt.band(F.col("score")).alias("band"), (F.col("score") >= 0.6).alias("matched"))
