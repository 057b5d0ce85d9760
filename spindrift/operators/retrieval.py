"""Lexical and vector retrieval: postings, BM25, TF-IDF cosine, ranks of the right document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import Steps

# Words that carry no meaning for retrieval, and marks that are taken off the ends of words.
STOP_WORDS = ("a", "an", "the", "to", "of", "for", "in", "on", "at", "by", "and", "or", "is", "are", "be", "with", "from", "as", "it", "its", "that", "this", "not", "no", "up", "out")
MARKS = ".,;:!?'\"()"


def terms(text: Column) -> Column:
    """Lower-cased words without marks at their ends, stop words left out; a word of marks only is the empty term."""
    words = F.filter(F.split(F.lower(text), r"[ \t\n\r]+"), lambda w: w != "")
    bare = F.transform(words, lambda w: F.btrim(w, F.lit(MARKS)))
    return F.filter(bare, lambda w: ~w.isin(*STOP_WORDS))


def postings(docs: DataFrame, doc: str, text: str, wanted: DataFrame | None = None) -> DataFrame:
    """(doc, term, tf). With ``wanted`` only its terms have rows of their own; a document's other terms are one row of a null term with their number."""
    rows = docs.select(F.col(doc).alias("doc"), F.col(text).alias("text"))
    if wanted is None:
        # Texts are smaller than their terms, and rows dealt out by document are counted where they are.
        return rows.repartition("doc").select("doc", F.explode(terms(F.col("text"))).alias("term")).groupBy("doc", "term").agg(F.count("*").alias("tf"))
    known = wanted.select("term", F.lit(True).alias("_known")).distinct()
    each = rows.select("doc", F.explode(terms(F.col("text"))).alias("term")).join(known, "term", "left")
    return each.groupBy("doc", F.when(F.col("_known"), F.col("term")).alias("term")).agg(F.count("*").alias("tf"))


def query_terms(queries: DataFrame, query: str, text: str) -> DataFrame:
    """(query, term, qf): repeated terms count again."""
    return queries.select(F.col(query).alias("query"), F.explode(terms(F.col(text))).alias("term")).groupBy("query", "term").agg(F.count("*").alias("qf"))


def bm25(index: DataFrame, queries: DataFrame, n_docs: DataFrame, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query, doc, score) of documents that share a term; an equi-join on the term.

    ``n_docs`` is one row (n) with the number of documents, empty ones included. Rows of ``index`` without a term count
    for the lengths only. The index goes through one shuffle by document; pairs of query and document go through none if the
    queries' terms are few enough to be sent to all tasks.
    """
    steps = Steps(index.sparkSession, "bm25")
    index = steps.keep(index, "index")
    n_terms = index.agg(F.sum("tf").alias("all"))
    stats = n_terms.crossJoin(F.broadcast(n_docs)).select("n", (F.col("all") / F.col("n")).alias("avgdl"))  # one row
    df = index.where("term is not null").groupBy("term").agg(F.count("*").alias("df"))
    idf = F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    # As a table its size is known, so that Spark can tell whether to broadcast it.
    weights = steps.keep(queries.join(df, "term").crossJoin(F.broadcast(stats)).select("query", "term", (F.col("qf") * idf).alias("weight"), "avgdl"), "weights")
    hits = index.join(weights.select("term", F.lit(True).alias("_asked")).distinct(), "term", "left")
    hit = F.collect_list(F.when(F.col("_asked"), F.struct("term", "tf"))).alias("hits")  # a document's own terms that are asked for
    per_doc = hits.groupBy("doc").agg(F.sum("tf").alias("dl"), hit).select("doc", "dl", F.explode("hits").alias("hit")).select("doc", "dl", "hit.*")
    part = F.col("weight") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return per_doc.join(weights, "term").groupBy("query", "doc").agg(F.sum(part).alias("score"))


def tf_idf_cosine(index: DataFrame, queries: DataFrame, n_docs: DataFrame) -> DataFrame:
    """(query, doc, score): cosine of weights (1 + ln tf) (ln((n + 1) / (df + 1)) + 1); unknown query terms weigh 0.

    The norms take every term, so ``index`` must be whole; it goes through one shuffle by document, as in ``bm25``.
    """
    steps = Steps(index.sparkSession, "tf-idf")
    index = steps.keep(index, "index")
    asked = queries.select("term", F.lit(True).alias("asked")).distinct()
    idf = index.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n_docs)).select("term", (F.ln((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))
    idf = steps.keep(idf.join(asked, "term", "left"), "idf")
    weight = lambda tf: (1 + F.ln(F.col(tf))) * F.col("idf")
    q = queries.join(idf.where("asked"), "term").select("query", "term", weight("qf").alias("v"))
    q_norm = q.groupBy("query").agg(F.sqrt(F.sum(F.col("v") ** 2)).alias("v_norm"))
    q = steps.keep(q.join(q_norm, "query"), "weights")
    d = index.join(idf, "term").select("doc", "term", "asked", weight("tf").alias("w"))
    hit = F.collect_list(F.when(F.col("asked"), F.struct("term", "w"))).alias("hits")  # a document's own terms that are asked for
    per_doc = d.groupBy("doc").agg(F.sqrt(F.sum(F.col("w") ** 2)).alias("w_norm"), hit).select("doc", "w_norm", F.explode("hits").alias("hit")).select("doc", "w_norm", "hit.*")
    dots = per_doc.join(q, "term").groupBy("query", "doc").agg(F.sum(F.col("v") * F.col("w")).alias("dot"), F.first("w_norm").alias("w_norm"), F.first("v_norm").alias("v_norm"))
    return dots.select("query", "doc", F.try_divide("dot", F.col("w_norm") * F.col("v_norm")).alias("score"))


def cosine(a: Column, b: Column) -> Column:
    """0 for a zero vector or vectors of different lengths."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda s, t: s.cast("double") * t.cast("double")), F.lit(0.0), lambda s, t: s + t)
    return F.when(F.size(a) != F.size(b), F.lit(0.0)).otherwise(F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0)))


def mean_pair_similarity(items: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, n_pairs, mean): mean cosine of all pairs of a key, from the sum of the unit vectors; no pair is made."""
    v = F.col(vector).cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    unit = items.select(key, F.transform(v, lambda x: F.try_divide(x, norm)).alias("u"))
    sums = unit.select(key, F.posexplode("u").alias("i", "x")).groupBy(key, "i").agg(F.sum("x").alias("s"), F.sum(F.col("x") ** 2).alias("q"), F.count("*").alias("n"))
    per_key = sums.groupBy(key).agg(F.sum(F.col("s") ** 2 - F.col("q")).alias("both"), F.max("n").alias("n"))
    pairs = F.col("n") * (F.col("n") - 1)
    return per_key.where("n > 1").select(key, (pairs / 2).cast("long").alias("n_pairs"), (F.col("both") / pairs).alias("mean"))


def gold_ranks(scores: DataFrame, gold: DataFrame, n_docs: DataFrame) -> DataFrame:
    """For each (query, gold doc): the rank of the gold document, ties averaged; without a score it follows all others.

    Ranks are counts of better and equal scores, found by a join on the query, so no window over a query's documents is sorted.
    """
    steps = Steps(scores.sparkSession, "gold-ranks")
    g = steps.keep(gold.select("query", F.col("doc").alias("gold")), "gold")
    scores = steps.keep(scores.join(g.select("query").distinct(), "query", "left_semi"), "scores")
    own = g.join(scores.select("query", F.col("doc").alias("gold"), F.col("score").alias("own")), ["query", "gold"], "left")
    own = steps.keep(own, "own")
    near = F.col("own") - 1e-12
    counted = own.where("own is not null").join(scores, "query").groupBy("query", "gold").agg(F.count_if(F.col("score") > F.col("own") + 1e-12).alias("better"), F.count_if((F.col("score") >= near) & (F.col("score") <= F.col("own") + 1e-12)).alias("equal"))
    ranked = own.join(counted, ["query", "gold"], "left").crossJoin(F.broadcast(n_docs))
    rank = F.when(F.col("own").isNull(), F.col("n") + 1.0).otherwise(F.col("better") + (F.col("equal") + 1) / 2.0)
    found = F.col("own").isNotNull()
    return ranked.select("query", "gold", rank.alias("rank"), F.when(found, 1 / rank).otherwise(F.lit(0.0)).alias("reciprocal"), (found & (F.col("better") == 0)).alias("among_first"))


def summary(ranks: DataFrame) -> DataFrame:
    return ranks.agg(F.count("*").alias("n"), F.avg("reciprocal").alias("mrr"), F.avg(F.col("among_first").cast("double")).alias("first_share"), F.avg("rank").alias("mean_rank"))


def nearest_by_tokens(items: DataFrame, key: str, name: str, tokens: str, k: int = 6) -> DataFrame:
    """(key, name, other, similarity, place): the k most alike items of the same key by token Jaccard, ties by name.

    Items meet on a shared token, not in a cross join; items that share none have similarity 0 and are not listed.
    """
    t = items.select(key, F.col(name).alias("name"), F.array_distinct(tokens).alias("tokens"))
    e = t.select(key, "name", F.size("tokens").alias("size"), F.explode("tokens").alias("token"))
    other = e.select(key, F.col("name").alias("other"), F.col("size").alias("other_size"), "token")
    both = e.join(other, [key, "token"]).where("name <> other").groupBy(key, "name", "other").agg(F.count("*").alias("shared"), F.max("size").alias("size"), F.max("other_size").alias("other_size"))
    sim = both.withColumn("similarity", F.col("shared") / (F.col("size") + F.col("other_size") - F.col("shared")))
    place = F.row_number().over(Window.partitionBy(key, "name").orderBy(F.desc("similarity"), "other"))
    return sim.withColumn("place", place).where(F.col("place") <= k).select(key, "name", "other", "similarity", "place")
