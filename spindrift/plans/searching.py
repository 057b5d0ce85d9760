"""Queries: benchmark passages against documents, embeddings, token neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import retrieval
from ..sources.shared import Steps
from ..sources.tables import table
from .registry import query, rounded

STOP = "[" + ", ".join(f"'{w}'" for w in retrieval.STOP_WORDS) + "]"
MARKS = retrieval.MARKS.replace("'", "''")
TERMS = "list_filter(list_transform(list_filter(regexp_split_to_array(lower({t}), '[ \\t\\n\\r]+'), lambda w: w <> ''), lambda w: regexp_replace(w, '^[" + MARKS + "]+|[" + MARKS + "]+$', '', 'g')), lambda w: NOT list_contains(" + STOP + ", w))"
INDEX_SQL = f"""
idx AS (SELECT doc, term, count(*) AS tf FROM (SELECT doc_id AS doc, unnest({TERMS.format(t='text')}) AS term FROM documents) GROUP BY doc, term),
qt AS (SELECT query, term, count(*) AS qf FROM (SELECT item_id AS query, unnest({TERMS.format(t='text')}) AS term FROM benchmark) GROUP BY query, term),
df AS (SELECT term, count(*) AS df FROM idx GROUP BY term), n AS (SELECT count(*) AS n FROM documents)"""
BM25_SQL = f"""{INDEX_SQL},
len AS (SELECT doc, sum(tf) AS dl FROM idx GROUP BY doc),
st AS (SELECT n, sum(dl) / n AS avgdl FROM len, n GROUP BY n),
scores AS (SELECT query, idx.doc, sum(qf * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
  FROM qt JOIN df USING (term) JOIN idx USING (term) JOIN len ON len.doc = idx.doc, st GROUP BY query, idx.doc)"""
TFIDF_SQL = f"""{INDEX_SQL},
w AS (SELECT term, ln((n + 1) / (df + 1)) + 1 AS idf FROM df, n),
d AS (SELECT doc, term, (1 + ln(tf)) * idf AS w FROM idx JOIN w USING (term)), q AS (SELECT query, term, (1 + ln(qf)) * idf AS v FROM qt JOIN w USING (term)),
dn AS (SELECT doc, sqrt(sum(w * w)) AS dn FROM d GROUP BY doc), qn AS (SELECT query, sqrt(sum(v * v)) AS qn FROM q GROUP BY query),
scores AS (SELECT query, doc, any_value(dot) / any_value(dn) / any_value(qn) AS score FROM (SELECT query, doc, sum(v * w) AS dot FROM q JOIN d USING (term) GROUP BY query, doc) JOIN dn USING (doc) JOIN qn USING (query) GROUP BY query, doc)"""
#: The right document of a passage of three words or more: the least that holds the whole passage.
GOLD_SQL = """
gold AS (SELECT item_id AS query, min(doc_id) AS gold FROM benchmark b JOIN documents d ON contains(d.text, b.text) WHERE len(list_filter(regexp_split_to_array(b.text, '[^\\p{L}]+'), lambda w: w <> '')) >= 3 GROUP BY item_id),
own AS (SELECT g.query, g.gold, s.score AS own FROM gold g LEFT JOIN scores s ON s.query = g.query AND s.doc = g.gold),
rk AS (SELECT o.query, o.gold, any_value(own) AS own, count(*) FILTER (score > own + 1e-12) AS better, count(*) FILTER (score >= own - 1e-12 AND score <= own + 1e-12) AS eq FROM own o LEFT JOIN scores s ON s.query = o.query GROUP BY o.query, o.gold),
res AS (SELECT query, gold, CASE WHEN own IS NULL THEN n + 1.0 ELSE better + (eq + 1) / 2.0 END AS rank, own, better FROM rk, n)
"""
RANKS_SELECT = "SELECT query, gold, round(rank, 6) AS rank, round(CASE WHEN own IS NULL THEN 0 ELSE 1 / rank END, 6) AS reciprocal, own IS NOT NULL AND better = 0 AS among_first FROM res"
SUMMARY_SELECT = "SELECT count(*) AS n, round(avg(CASE WHEN own IS NULL THEN 0 ELSE 1 / rank END), 6) AS mrr, round(avg((own IS NOT NULL AND better = 0)::INT), 6) AS first_share, round(avg(rank), 6) AS mean_rank FROM res"


def _parts(spark: SparkSession, sf_dir: str, whole: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Index, terms of the passages and number of documents; terms that no passage has are in the index only if it must be ``whole``."""
    docs, queries = table(spark, sf_dir, "documents"), retrieval.query_terms(table(spark, sf_dir, "benchmark"), "item_id", "text")
    queries = Steps(spark, "passages").keep(queries, "terms")
    return retrieval.postings(docs, "doc_id", "text", None if whole else queries), queries, docs.agg(F.count("*").alias("n"))


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query, doc): the least document that holds the whole passage; none for passages of fewer than three words.

    All words but a passage's first and last are whole words of a document that holds it, so
    passages and documents meet on the rarest of them, and then the text decides.
    """
    docs, bench = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    words = bench.select(F.col("item_id").alias("query"), F.col("text").alias("passage"), F.filter(F.split("text", r"[^\p{L}]+"), lambda w: w != "").alias("inner"))
    words = words.where(F.size("inner") >= 3).withColumn("inner", F.array_distinct(F.slice("inner", 2, F.size("inner") - 2)))
    steps = Steps(spark, "gold")
    each = steps.keep(words.select("query", "passage", F.explode("inner").alias("word")), "words")
    places = docs.select(F.col("doc_id").alias("doc"), F.explode(F.array_distinct(F.split("text", r"[^\p{L}]+"))).alias("word"))
    places = steps.keep(places.join(each.select("word").distinct(), "word", "left_semi"), "places")
    each = each.join(places.groupBy("word").agg(F.count("*").alias("df")), "word")
    rarest = each.groupBy("query").agg(F.min_by(F.struct("word", "passage"), F.struct("df", "word")).alias("at"))
    rarest = steps.keep(rarest.select("query", "at.passage", "at.word"), "rarest")
    met = steps.keep(rarest.join(places, "word").select("query", "passage", "doc"), "met")
    text = docs.select(F.col("doc_id").alias("doc"), "text")
    return met.join(text, "doc").where(F.contains("text", "passage")).groupBy("query").agg(F.min("doc").alias("doc"))


@query("rt1_bm25", f"WITH {BM25_SQL} SELECT query, doc, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 6) DESC, doc) AS r FROM scores) WHERE r <= 10")
def rt1_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every passage."""
    scores = rounded(retrieval.bm25(*_parts(spark, sf_dir)))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "doc")
    return scores.withColumn("r", F.row_number().over(best)).where("r <= 10").drop("r")


@query("rt2_tf_idf", f"WITH {TFIDF_SQL} SELECT query, doc, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 6) DESC, doc) AS r FROM scores) WHERE r <= 10")
def rt2_tf_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = rounded(retrieval.tf_idf_cosine(*_parts(spark, sf_dir, whole=True)))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "doc")
    return scores.withColumn("r", F.row_number().over(best)).where("r <= 10").drop("r")


@query("wn5_gold_ranks", f"WITH {BM25_SQL}, {GOLD_SQL} {RANKS_SELECT}")
def wn5_gold_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, queries, n = _parts(spark, sf_dir)
    return rounded(retrieval.gold_ranks(retrieval.bm25(index, queries, n), gold(spark, sf_dir), n))


@query("rt4_bm25_summary", f"WITH {BM25_SQL}, {GOLD_SQL} {SUMMARY_SELECT}")
def rt4_bm25_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, queries, n = _parts(spark, sf_dir)
    return rounded(retrieval.summary(retrieval.gold_ranks(retrieval.bm25(index, queries, n), gold(spark, sf_dir), n)))


@query("rt4_tf_idf_summary", f"WITH {TFIDF_SQL}, {GOLD_SQL} {SUMMARY_SELECT}")
def rt4_tf_idf_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, queries, n = _parts(spark, sf_dir, whole=True)
    return rounded(retrieval.summary(retrieval.gold_ranks(retrieval.tf_idf_cosine(index, queries, n), gold(spark, sf_dir), n)))


@query("jn9_pair_similarity", """WITH e AS (SELECT label, vec_id, embedding::DOUBLE[] AS v FROM embeddings),
p AS (SELECT a.label, list_cosine_similarity(a.v, b.v) AS s FROM e a JOIN e b ON a.label = b.label AND a.vec_id < b.vec_id)
SELECT label, count(*) AS n_pairs, round(avg(s), 6) AS mean FROM p GROUP BY label""")
def jn9_pair_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean similarity of the pairs of each label."""
    return rounded(retrieval.mean_pair_similarity(table(spark, sf_dir, "embeddings"), "label", "embedding"))


@query("rt3_embedding_cosine", """WITH c AS (SELECT label, min(vec_id) AS q FROM embeddings GROUP BY label), q AS (SELECT c.label, c.q, e.embedding::DOUBLE[] AS v FROM c JOIN embeddings e ON e.vec_id = c.q),
s AS (SELECT q.q AS query, e.vec_id AS doc, round(list_cosine_similarity(q.v, e.embedding::DOUBLE[]), 6) AS score FROM q, embeddings e WHERE e.vec_id <> q.q)
SELECT query, doc, score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS r FROM s) WHERE r <= 10""")
def rt3_embedding_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of the first vector of each label (a stated query set against all rows)."""
    e = table(spark, sf_dir, "embeddings").select("label", "vec_id", "embedding")
    first = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("v"), F.min("vec_id").alias("query"))
    scored = e.crossJoin(first.select("query", "v")).where("vec_id <> query").select("query", F.col("vec_id").alias("doc"), F.round(retrieval.cosine(F.col("v"), F.col("embedding")), 6).alias("score"))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "doc")
    return scored.withColumn("r", F.row_number().over(best)).where("r <= 10").drop("r")


@query("jn8_token_neighbours", """WITH t AS (SELECT DISTINCT p_brand, p_name || ' ' || p_type AS name FROM part), k AS (SELECT *, list_distinct(string_split(lower(name), ' ')) AS tokens FROM t),
p AS (SELECT a.p_brand, a.name, b.name AS other, len(list_intersect(a.tokens, b.tokens))::DOUBLE / len(list_distinct(list_concat(a.tokens, b.tokens))) AS similarity FROM k a JOIN k b ON a.p_brand = b.p_brand AND a.name <> b.name),
r AS (SELECT *, row_number() OVER (PARTITION BY p_brand, name ORDER BY similarity DESC, other) AS place FROM p WHERE similarity > 0)
SELECT p_brand, name, other, round(similarity, 6) AS similarity, place FROM r WHERE place <= 6""")
def jn8_token_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "part").select("p_brand", F.concat_ws(" ", "p_name", "p_type").alias("name")).distinct()
    return rounded(retrieval.nearest_by_tokens(t.withColumn("tokens", F.split(F.lower("name"), " ")), "p_brand", "name", "tokens"))
