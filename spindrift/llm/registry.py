"""The queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"))


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repeats import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source at equal weight, one epoch; length and hash are taken of the text that the shuffle delivers."""
    from .mixing import mix_sources

    text = F.coalesce("text", F.lit(""))
    mixed = mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "copy", "shuffle_key", F.char_length(text).cast("long").alias("n_chars"), F.md5(text.cast("binary")).alias("text_md5"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import warc_digest

    return warc_digest(table(spark, sf_dir, "pages"))


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import media_digest

    return media_digest(table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op7_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neighbours import nearest

    return nearest(table(spark, sf_dir, "embeddings"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every document, by its hash."""
    from .lines import dedup_lines

    out = dedup_lines(table(spark, sf_dir, "documents"))
    text = F.coalesce(F.col("text"), F.lit(""))
    return out.select("doc_id", "n_lines", "n_removed", F.char_length(text).alias("n_kept_chars"), F.sha2(text.cast("binary"), 256).alias("kept_sha256"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import token_file_digest

    return token_file_digest(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .collocations import collocations

    return collocations(table(spark, sf_dir, "documents"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ranked import search

    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact import exact_duplicates

    return exact_duplicates(table(spark, sf_dir, "documents"))


def _oracles() -> dict[str, str]:
    from .collocations import COLLOCATIONS_SQL
    from .exact import EXACT_SQL
    from .mixing import MIX_SQL
    from .ranked import SEARCH_SQL
    from .warc import WARC_SQL

    return {"op3_mixing": MIX_SQL, "op4_warc": WARC_SQL, "op11_collocations": COLLOCATIONS_SQL, "op12_ranked_search": SEARCH_SQL, "op13_exact_dedup": EXACT_SQL}


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_best_fit_packing, op2_suffix_array_dedup, op3_mixing, op4_warc, op5_media_columns, op6_simhash, op7_nn_descent, op8_line_dedup, op9_token_files, op10_toxicity,
        op11_collocations, op12_ranked_search, op13_exact_dedup,
    )
}
ORACLE_SQL: dict[str, str] = _oracles()
