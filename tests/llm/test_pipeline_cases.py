"""Every stage of the pipeline on odd rows: nulls, empty texts, repeated rows, an empty table, columns whose names clash."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spindrift.llm import similar

CLASHING = "node long, fp long, band string, `group` int, kept boolean, copy int, shuffle_key string, grade double, line string, row binary, n int, least int, component int, _id int, start int"


@pytest.fixture(scope="module")
def docs(spark):
    words = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join(words[k % 7 : k % 7 + 30]) + f"\nline {k % 3} of some length here", "en", ["a", "b", None][k % 3], 10) for k in range(40)]
    rows += [(100, None, None, None, None), (101, "", "de", "a", 0), (102, " \n\t\n", "de", "a", 4), (None, "no id at all, but some words", "en", "b", 28), (7, "another text under an id that is there already", "en", "a", 46), (3, rows[3][1], "en", "a", 10), (3, rows[3][1], "en", "a", 10)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c in CLASHING.split(", "):
        name, kind = c.rsplit(" ", 1)
        d = d.withColumn(name.strip("`"), F.lit(None).cast(kind))
    return d


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("labels")
    spark.createDataFrame([(k, 1, 0) for k in range(5)] + [(100, 0, 0), (None, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at)


def test_stages_on_odd_rows(spark, docs, sf_dir, tmp_path):
    counts = [docs.count()]
    d = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, d, sf_dir).write.parquet(str(tmp_path / str(k)))
        d = spark.read.parquet(str(tmp_path / str(k)))
        counts.append(d.count())
        if k < len(corpus_pipeline.STAGES) - 1:
            assert d.columns == docs.columns, name
        if name == "line dedup":
            assert d.where("doc_id is null").count() == 1
    assert counts[1] == counts[0]  # no toxic label: nothing goes
    assert 0 < counts[3] < counts[2]
    assert counts[-1] > 0


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stages_on_an_empty_table(spark, docs, sf_dir, k):
    name, stage = corpus_pipeline.STAGES[k]
    out = stage(spark, docs.where("false"), sf_dir)
    assert out.count() == 0, name
    if k < len(corpus_pipeline.STAGES) - 1:
        assert out.columns == docs.columns


def test_near_dedup_keeps_unlike_texts_of_one_template(spark):
    """Jaccard 0.6: many candidates, no link."""
    template = [f"t{k}" for k in range(150)]
    rows = [(k, " ".join(template + [f"d{k}x{j}" for j in range(46)])) for k in range(150)] + [(900, " ".join(template + [f"d0x{j}" for j in range(46)] + ["more"]))]
    kept = {r.doc_id for r in similar.keep_one_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == set(range(150))
