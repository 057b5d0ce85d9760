"""Queries: names, descriptions, catalogs and judges' answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import text as T
from ..operators.ranks import tercile
from ..sources.tables import table
from .registry import query, rounded


@query("jn6_near_names", """WITH n AS (SELECT DISTINCT p_brand, p_name || ' ' || p_type AS name FROM part),
p AS (SELECT a.p_brand, a.name AS a, b.name AS b, 1 - levenshtein(a.name, b.name)::DOUBLE / greatest(length(a.name), length(b.name)) AS s FROM n a JOIN n b ON a.p_brand = b.p_brand AND a.name < b.name)
SELECT p_brand, a, b, round(s, 6) AS similarity FROM p WHERE s >= 0.8""")
def jn6_near_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_brand", F.concat_ws(" ", "p_name", "p_type").alias("name"))
    return rounded(T.near_names(p, "p_brand", "name"))


@query("jn7_near_misses", """WITH x AS (SELECT DISTINCT p_brand, split_part(p_name, ' ', 1) AS prop FROM part), y AS (SELECT DISTINCT p_brand, split_part(p_name, ' ', 2) AS word FROM part UNION SELECT DISTINCT p_brand, lower(p_type) FROM part),
d AS (SELECT x.p_brand, prop, word, levenshtein(prop, word) AS distance FROM x JOIN y ON x.p_brand = y.p_brand AND substr(prop, 1, 1) = substr(word, 1, 1))
SELECT p_brand, prop, word, distance::INT AS distance FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, prop ORDER BY distance, word) AS r FROM d WHERE distance > 0 AND distance <= 4) WHERE r = 1""")
def jn7_near_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    words = F.split("p_name", " ")
    y = p.select("p_brand", F.get(words, F.lit(1)).alias("word")).unionByName(p.select("p_brand", F.lower("p_type").alias("word")))
    return T.near_misses(p.select("p_brand", F.get(words, F.lit(0)).alias("prop")), y, "p_brand", most=4, prefix=1)


@query("fn2_identifiers", """SELECT DISTINCT c_name, lower(regexp_replace(c_name, '([a-z0-9])([A-Z])', '\\1_\\2', 'g')) AS snake,
  translate(lower(regexp_replace(c_name, '([a-z0-9])([A-Z])', '\\1_\\2', 'g')), '_-', '') AS squeezed, split_part(lower(c_name), '#', 1) AS leading FROM customer""")
def fn2_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_name")
    return table(spark, sf_dir, "customer").select("c_name", T.snake(c).alias("snake"), T.squeezed(c).alias("squeezed"), T.leading_token(c).alias("leading")).distinct()


@query("fn5_mentions", """SELECT page_id, list_sort(list_distinct(list_transform(list_concat(regexp_extract_all(html, '`([A-Za-z_][A-Za-z0-9_]*)`', 1), regexp_extract_all(html, '\\b([a-z][a-z0-9]*(?:_[a-z0-9]+)+)\\b', 1)), lambda w: lower(w)))) AS mentions FROM pages""")
def fn5_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.mentioned(F.col("html")).alias("mentions"))


@query("fn18_families", """WITH f AS (SELECT DISTINCT p_brand, p_name, split_part(p_name, ' ', 1) AS family FROM part WHERE length(split_part(p_name, ' ', 1)) >= 3)
SELECT p_brand, family, list_sort(list(p_name)) AS members FROM f GROUP BY p_brand, family HAVING count(*) >= 2""")
def fn18_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.families(table(spark, sf_dir, "part"), "p_brand", "p_name")


#: A document is a tool: its name the source and the first word, its description the first line.
DENSITY_SQL = """d AS (SELECT source, split_part(text, ' ', 1) AS name, split_part(text, chr(10), 1) AS description, length(text) % 5 AS n_params, length(text) % 5 // 2 AS n_described FROM documents),
tk AS (SELECT *, list_filter(list_distinct(regexp_split_to_array(lower(regexp_replace(description, '([a-z0-9])([A-Z])', '\\1_\\2', 'g')), '[^a-z0-9]+')), lambda w: length(w) > 1) AS a,
  list_filter(list_distinct(regexp_split_to_array(lower(regexp_replace(name, '([a-z0-9])([A-Z])', '\\1_\\2', 'g')), '[^a-z0-9]+')), lambda w: length(w) > 1) AS b FROM d),
g AS (SELECT source, count(*) AS n_tools, avg(length(description)) AS mean_length, avg((trim(description) <> '')::INT) AS described_share,
  avg((trim(description) <> '' AND len(list_filter(a, lambda w: NOT list_contains(b, w))) = 0)::INT) AS echo_share, coalesce(sum(n_described)::DOUBLE / nullif(sum(n_params), 0), 1.0) AS param_coverage FROM tk GROUP BY source),
m AS (SELECT *, 0.30 * least(1.0, mean_length / 200.0) + 0.25 * described_share + 0.25 * (1 - echo_share) + 0.20 * param_coverage AS composite FROM g)"""


def density(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    n = F.length("text") % 5
    tools = d.select("source", F.split("text", " ", 2)[0].alias("name"), F.split("text", "\n", 2)[0].alias("description"), n.alias("n_params"), F.floor(n / 2).alias("n_described"))
    return T.doc_density(tools, "source")


@query("ag29_doc_density", f"WITH {DENSITY_SQL} SELECT source, n_tools, round(mean_length, 6) AS mean_length, round(described_share, 6) AS described_share, round(echo_share, 6) AS echo_share, round(param_coverage, 6) AS param_coverage, round(composite, 6) AS composite FROM m")
def ag29_doc_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(density(spark, sf_dir))


@query("wn8_density_tiers", f"WITH {DENSITY_SQL}, c AS (SELECT quantile_cont(composite, 0.33) AS a, quantile_cont(composite, 0.67) AS b FROM m) SELECT source, CASE WHEN composite >= b THEN 'high' WHEN composite >= a THEN 'mid' ELSE 'low' END AS tier FROM m, c")
def wn8_density_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tercile(density(spark, sf_dir), "composite").select("source", "tier")


@query("fn11_unmentioned_required", """WITH t AS (SELECT doc_id, text, unnest(['the', 'source', lang, left(source, 3)]) AS param FROM documents) SELECT DISTINCT doc_id, param FROM t WHERE NOT contains(lower(text), lower(param))""")
def fn11_unmentioned_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").withColumn("required", F.array(F.lit("the"), F.lit("source"), F.col("lang"), F.substring("source", 1, 3)))
    return T.unmentioned_required(d, "required", "text").select("doc_id", "param").distinct()


@query("jn4_undeclared_required", """WITH p AS (SELECT p_brand, list_distinct(list(p_name)) AS props, list_distinct(list(split_part(p_name, ' ', 1) || ' bolt')) AS required FROM part GROUP BY p_brand)
SELECT p_brand, list_sort(list_filter(required, lambda r: NOT list_contains(props, r))) AS undeclared FROM p""")
def jn4_undeclared_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.concat(F.split("p_name", " ")[0], F.lit(" bolt"))
    p = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.collect_set("p_name").alias("props"), F.collect_set(first).alias("required"))
    return p.select("p_brand", T.undeclared_required(F.col("required"), F.col("props")).alias("undeclared"))


#: Answers of a judge, made from the texts of conversations.
ANSWERS_SQL = """a AS (SELECT conv_id, turn, CASE (length(text) + turn) % 5 WHEN 0 THEN 'Verdict: YES, score ' || length(text) % 11 WHEN 1 THEN 'no. ' || left(text, 20) WHEN 2 THEN '**Yes** 7.5' WHEN 3 THEN 'verdict - no (score: ' || length(text) % 7 || ')' ELSE left(text, 30) END AS answer FROM conversations),
v AS (SELECT *, coalesce(nullif(upper(regexp_extract(answer, '(?i)verdict[^A-Za-z]{0,5}(yes|no)', 1)), ''), nullif(upper(regexp_extract(answer, '(?i)^[^A-Za-z]*(yes|no)(?:[^A-Za-z]|$)', 1)), '')) AS vote,
  coalesce(TRY_CAST(regexp_extract(answer, '(?i)score[^0-9]{0,5}([0-9]+(?:\\.[0-9]+)?)', 1) AS DOUBLE), TRY_CAST(regexp_extract_all(answer, '([0-9]+(?:\\.[0-9]+)?)', 1)[-1] AS DOUBLE)) AS grade FROM a)"""


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text")
    k = (n + F.col("turn")) % 5
    answer = (
        F.when(k == 0, F.concat(F.lit("Verdict: YES, score "), (n % 11).cast("string")))
        .when(k == 1, F.concat(F.lit("no. "), F.substring("text", 1, 20)))
        .when(k == 2, F.lit("**Yes** 7.5"))
        .when(k == 3, F.concat(F.lit("verdict - no (score: "), (n % 7).cast("string"), F.lit(")")))
        .otherwise(F.substring("text", 1, 30))
    )
    a = table(spark, sf_dir, "conversations").select("conv_id", "turn", answer.alias("answer"))
    return a.withColumns({"vote": T.vote(F.col("answer")), "grade": T.last_number(F.col("answer"))})


@query("fn23_votes", f"WITH {ANSWERS_SQL} SELECT conv_id, turn, vote, round(grade, 6) AS grade FROM v")
def fn23_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(answers(spark, sf_dir).drop("answer"))


@query("ag30_majority", f"""WITH {ANSWERS_SQL}, c AS (SELECT conv_id, count(vote) AS parsed, count(*) FILTER (vote = 'YES') AS yes, avg(CASE WHEN grade IS NOT NULL THEN least(10.0, greatest(0.0, grade)) END) AS grade FROM v GROUP BY conv_id)
SELECT conv_id, CASE WHEN parsed = 0 THEN 'UNDETERMINED' WHEN yes >= 2 THEN 'YES' ELSE 'NO' END AS verdict, round(grade, 6) AS mean_grade, CASE WHEN grade IS NULL THEN 'UNDETERMINED' WHEN grade >= 5 THEN 'YES' ELSE 'NO' END AS graded FROM c""")
def ag30_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    grade = F.least(F.lit(10.0), F.greatest(F.lit(0.0), F.col("grade")))
    c = answers(spark, sf_dir).groupBy("conv_id").agg(F.count("vote").alias("parsed"), F.count_if(F.col("vote") == "YES").alias("yes"), F.avg(F.when(F.col("grade").isNotNull(), grade)).alias("mean_grade"))
    graded = F.when(F.col("mean_grade").isNull(), "UNDETERMINED").when(F.col("mean_grade") >= 5, "YES").otherwise("NO")
    return rounded(c.select("conv_id", T.majority(F.col("yes"), F.col("parsed")).alias("verdict"), "mean_grade", graded.alias("graded")))


@query("ag32_confusion", """SELECT lang, count(*) FILTER (p AND a) AS tp, count(*) FILTER (p AND NOT a) AS fp, count(*) FILTER (NOT p AND a) AS fn, count(*) FILTER (NOT p AND NOT a) AS tn, count(*) FILTER (p IS NULL) AS undetermined,
  round(count(*) FILTER (p AND a)::DOUBLE / nullif(count(*) FILTER (p), 0), 6) AS precision, round(count(*) FILTER (p AND a)::DOUBLE / nullif(count(*) FILTER (a), 0), 6) AS recall
FROM (SELECT lang, toxic = 1 AS p, quality = 0 AS a FROM labels JOIN documents USING (doc_id)) GROUP BY lang""")
def ag32_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return rounded(T.confusion(l.select("lang", (F.col("toxic") == 1).alias("p"), (F.col("quality") == 0).alias("a")), "p", "a", "lang"))


@query("fn25_durations", """WITH d AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN (o_custkey % 3) || 'h' || (o_custkey % 50) || 'm' WHEN 1 THEN (o_custkey % 90) || '.5s' WHEN 2 THEN (o_custkey % 900) || 'ms' ELSE 'soon' END AS t, o_custkey AS c FROM orders)
SELECT o_orderkey, round(CASE WHEN s = 0 THEN 60.0 ELSE s END, 6) AS seconds FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN (c % 3) * 3600.0 + (c % 50) * 60.0 WHEN 1 THEN (c % 90) + 0.5 WHEN 2 THEN (c % 900) / 1000.0 ELSE 0 END AS s FROM d)""")
def fn25_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k = F.col("o_custkey"), F.col("o_orderkey") % 4
    s = lambda n: (c % n).cast("string")
    t = F.when(k == 0, F.concat(s(3), F.lit("h"), s(50), F.lit("m"))).when(k == 1, F.concat(s(90), F.lit(".5s"))).when(k == 2, F.concat(s(900), F.lit("ms"))).otherwise("soon")
    return rounded(table(spark, sf_dir, "orders").select("o_orderkey", T.seconds(t).alias("seconds")))


@query("prj10_three_outcomes", """WITH t AS (SELECT conv_id, turn, nullif(regexp_extract(trim(text), '^([^ \\t\\n\\r]+)', 1), '') AS first FROM conversations), s AS (SELECT *, lower(rtrim(first, '.,;:!?')) AS word FROM t)
SELECT conv_id, turn, CASE WHEN word IN ('the', 'is', 'le', 'la', 'der') THEN CASE WHEN word = 'the' THEN 'correct' ELSE 'wrong' END ELSE 'abstain' END AS outcome FROM s""")
def prj10_three_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first word of an answer, without marks at its end: right, another valid one, or abstaining."""
    word = F.lower(F.rtrim(F.regexp_extract(F.trim("text"), "^([^ \\t\\n\\r]+)", 1), F.lit(".,;:!?")))
    outcome = F.when(word == "the", "correct").when(word.isin("is", "le", "la", "der"), "wrong").otherwise("abstain")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", outcome.alias("outcome"))


@query("fn34_seed", """SELECT p_partkey, list_reduce(list_prepend(42::BIGINT, list_transform(range(1, length(p_name) + 1), lambda i: ord(substr(p_name, i::INT, 1))::BIGINT)), lambda a, c: (a * 131 + c) & 4294967295) AS seed FROM part""")
def fn34_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seed from a name: the polynomial with base 131 modulo 2^32."""
    chars = F.transform(F.sequence(F.lit(1), F.length("p_name")), lambda i: F.ascii(F.substring(F.col("p_name"), i, F.lit(1))).cast("long"))
    seed = F.aggregate(chars, F.lit(42).cast("long"), lambda a, c: (a * 131 + c).bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))
    return table(spark, sf_dir, "part").select("p_partkey", seed.alias("seed"))


@query("fn32_digests", "SELECT doc_id, left(sha256(text), 12) AS digest FROM documents")
def fn32_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.substring(F.sha2(F.col("text").cast("binary"), 256), 1, 12).alias("digest"))


@query("src10_catalog_dedup", """WITH c AS (SELECT p_brand, p_size % 3 AS tier, list_sort(list(DISTINCT p_type)) AS names FROM part GROUP BY p_brand, p_size % 3),
r AS (SELECT *, row_number() OVER (PARTITION BY tier, names ORDER BY p_brand) AS k FROM c WHERE len(names) >= 4) SELECT p_brand, tier, names FROM r WHERE k = 1""")
def src10_catalog_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogs of four tools or more; of those with the same names in a tier, the first."""
    c = table(spark, sf_dir, "part").groupBy("p_brand", (F.col("p_size") % 3).alias("tier")).agg(F.array_sort(F.collect_set("p_type")).alias("names")).where(F.size("names") >= 4)
    first = Window.partitionBy("tier", "names").orderBy("p_brand")
    return c.withColumn("k", F.row_number().over(first)).where("k = 1").drop("k")
