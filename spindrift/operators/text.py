"""Identifiers, descriptions and catalogs: tokens, near names, documentation density, consistency findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Endings by which a word counts as a shortening of another.
SHORT_ENDINGS = ("id", "key", "code", "no", "num", "ref", "type", "cs", "ds", "ms")


def snake(name: Column) -> Column:
    """Camel case cut into words, lower case."""
    return F.lower(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1_$2"))


def squeezed(name: Column) -> Column:
    """An identifier without its word borders."""
    return F.translate(snake(name), "_-", "")


def name_tokens(name: Column) -> Column:
    return F.filter(F.split(snake(name), "[^a-z0-9]+"), lambda w: w != "")


def token_set(text: Column, stop: tuple[str, ...] = ()) -> Column:
    """Distinct alphanumeric words of two letters or more, without stop words."""
    words = F.array_distinct(name_tokens(text))
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*stop) if stop else F.length(w) > 1)


# What is an identifier in a text.
TICKED, JOINED = r"`([a-zA-Z_][a-zA-Z0-9_]*)`", r"\b([a-z][a-z0-9]*(?:_[a-z0-9]+)+)\b"


def mentioned(text: Column) -> Column:
    """Identifiers named in a text: in backticks, or lower-case words joined by underscores; lower case, sorted."""
    found = F.concat(F.regexp_extract_all(text, F.lit(TICKED), 1), F.regexp_extract_all(text, F.lit(JOINED), 1))
    return F.array_sort(F.array_distinct(F.transform(found, lambda w: F.lower(w))))


def either_prefix(a: Column, b: Column) -> Column:
    return F.startswith(a, b) | F.startswith(b, a)


def shortened(param: Column, word: Column) -> Column:
    """Whether ``param`` is ``word`` with a common ending; both squeezed."""
    return F.startswith(param, word) & F.substr(param, F.length(word) + 1).isin(*SHORT_ENDINGS)


def leading_token(name: Column) -> Column:
    return F.get(name_tokens(name), F.lit(0))


def families(names: DataFrame, key: str, name: str) -> DataFrame:
    """(key, family, members): names that share a first word of three letters or more, two at least."""
    g = names.select(key, F.col(name).alias("_n"), leading_token(F.col(name)).alias("family")).where(F.length("family") >= 3)
    return g.groupBy(key, "family").agg(F.array_sort(F.collect_set("_n")).alias("members")).where(F.size("members") >= 2)


def near_names(names: DataFrame, key: str, name: str, least: float = 0.8) -> DataFrame:
    """(key, a, b, similarity): different names of a catalog with edit similarity of ``least`` or more.

    The pairs of a catalog are compared, catalogs being small; the length bound comes before the edit distance.
    """
    n = names.select(key, F.col(name).alias("a")).distinct().withColumn("_la", F.length("a"))
    m = n.select(key, F.col("a").alias("b"), F.col("_la").alias("_lb"))
    longest = F.greatest("_la", "_lb")
    p = n.join(m, key).where((F.col("a") < F.col("b")) & (F.least("_la", "_lb") >= least * longest))
    sim = 1 - F.levenshtein("a", "b") / longest
    return p.withColumn("similarity", sim).where(F.col("similarity") >= least).select(key, "a", "b", "similarity")


def near_misses(props: DataFrame, words: DataFrame, key: str, most: int = 2, prefix: int = 2) -> DataFrame:
    """(key, prop, word, distance): for each property the nearest word of the description, at most ``most`` edits away, but not equal.

    Both sides meet on the catalog key and the shared prefix.
    """
    p = props.select(key, F.col("prop")).distinct().withColumn("_p", F.substring("prop", 1, prefix))
    w = words.select(key, F.col("word")).distinct().withColumn("_p", F.substring("word", 1, prefix))
    d = p.join(w, [key, "_p"]).withColumn("distance", F.levenshtein("prop", "word")).where((F.col("distance") > 0) & (F.col("distance") <= most))
    best = Window.partitionBy(key, "prop").orderBy("distance", "word")
    return d.withColumn("_r", F.row_number().over(best)).where("_r = 1").select(key, "prop", "word", "distance")


def doc_density(tools: DataFrame, key: str) -> DataFrame:
    """For each catalog: tools, mean description length, shares with a description, echoing the name, parameters described; a composite.

    ``tools`` holds (name, description, n_params, n_described). Without any parameter the coverage is 1.
    """
    text = F.coalesce("description", F.lit(""))
    told = F.trim(text) != ""
    echo = told & (F.size(F.array_except(token_set(text), token_set(F.col("name")))) == 0)
    g = tools.groupBy(key).agg(
        F.count("*").alias("n_tools"),
        F.avg(F.length(text)).alias("mean_length"),
        F.avg(told.cast("double")).alias("described_share"),
        F.avg(echo.cast("double")).alias("echo_share"),
        F.coalesce(F.try_divide(F.sum("n_described"), F.sum("n_params")), F.lit(1.0)).alias("param_coverage"),
    )
    length = F.least(F.lit(1.0), F.col("mean_length") / 200.0)
    return g.withColumn("composite", 0.30 * length + 0.25 * F.col("described_share") + 0.25 * (1 - F.col("echo_share")) + 0.20 * F.col("param_coverage"))


def unmentioned_required(tools: DataFrame, required: str, description: str) -> DataFrame:
    """Required parameters whose name the description does not hold, in any case."""
    r = tools.withColumn("param", F.explode(required))
    return r.where(~F.contains(F.lower(F.coalesce(description, F.lit(""))), F.lower("param")))


def undeclared_required(required: Column, props: Column) -> Column:
    """Required names that the schema does not declare."""
    return F.array_sort(F.array_except(required, props))


def ghost_mentions(text: Column, known: Column) -> Column:
    """Identifiers that a description names but nothing declares."""
    return F.array_except(mentioned(text), F.transform(known, lambda w: F.lower(w)))


def number_in(text: Column, most: float) -> Column:
    """The first number of a text, at most ``most``; null without one."""
    return F.least(F.regexp_extract(text, "([0-9]+(?:\\.[0-9]+)?)", 1).try_cast("double"), F.lit(most))


def last_number(text: Column) -> Column:
    """The number after 'score', else the last one."""
    labelled = F.regexp_extract(text, "(?i)score[^0-9]{0,5}([0-9]+(?:\\.[0-9]+)?)", 1).try_cast("double")
    every = F.regexp_extract_all(text, F.lit("([0-9]+(?:\\.[0-9]+)?)"), 1)
    return F.coalesce(labelled, F.try_element_at(every, F.lit(-1)).try_cast("double"))


def vote(text: Column) -> Column:
    """YES or NO after 'verdict', else the bare word at the beginning, else null."""
    labelled = F.upper(F.regexp_extract(text, "(?i)verdict[^A-Za-z]{0,5}(yes|no)", 1))
    bare = F.upper(F.regexp_extract(text, "(?i)^[^A-Za-z]*(yes|no)(?:[^A-Za-z]|$)", 1))
    return F.coalesce(F.nullif(labelled, F.lit("")), F.nullif(bare, F.lit("")))


def majority(yes: Column, parsed: Column) -> Column:
    """Two votes of yes decide; nothing parsed is UNDETERMINED."""
    return F.when(parsed == 0, "UNDETERMINED").when(yes >= 2, "YES").otherwise("NO")


def seconds(duration: Column) -> Column:
    """'1h2m3s4ms' in seconds; 60 where nothing is said."""
    parts = F.regexp_extract_all(duration, F.lit("([0-9]+(?:\\.[0-9]+)?(?:ms|h|m|s))"), 1)
    unit = lambda p: F.regexp_extract(p, "(ms|h|m|s)$", 1)
    factor = lambda u: F.when(u == "h", 3600.0).when(u == "m", 60.0).when(u == "s", 1.0).otherwise(0.001)
    total = F.aggregate(parts, F.lit(0.0), lambda s, p: s + F.regexp_extract(p, "^([0-9.]+)", 1).cast("double") * factor(unit(p)))
    return F.when(F.coalesce(total, F.lit(0.0)) == 0, F.lit(60.0)).otherwise(total)


def confusion(df: DataFrame, predicted: str, actual: str, *keys: str) -> DataFrame:
    """tp, fp, fn, tn, precision, recall (null where undefined); rows without a prediction are counted apart."""
    p, a = F.col(predicted), F.col(actual)
    c = df.groupBy(*keys).agg(F.count_if(p & a).alias("tp"), F.count_if(p & ~a).alias("fp"), F.count_if(~p & a).alias("fn"), F.count_if(~p & ~a).alias("tn"), F.count_if(p.isNull()).alias("undetermined"))
    return c.withColumns({"precision": F.try_divide("tp", F.col("tp") + F.col("fp")), "recall": F.try_divide("tp", F.col("tp") + F.col("fn"))})
