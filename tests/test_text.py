"""Edge cases of names, descriptions, votes, numbers and retrieval."""

import pytest
from pyspark.sql import functions as F

from spindrift.operators import retrieval, text


def one(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize(("name", "snake"), [("getUserId", "get_user_id"), ("URL", "url"), ("a1B", "a1_b"), ("", "")])
def test_snake(spark, name, snake):
    assert one(spark, text.snake(F.lit(name))) == snake


def test_mentions(spark):
    assert one(spark, text.mentioned(F.lit("Pass `Id` and user_name or plain words"))) == ["id", "user_name"]


@pytest.mark.parametrize(("answer", "vote"), [("Verdict: yes", "YES"), ("No, never", "NO"), ("**YES**", "YES"), ("nothing", None), ("", None)])
def test_votes(spark, answer, vote):
    assert one(spark, text.vote(F.lit(answer))) == vote


@pytest.mark.parametrize(("yes", "parsed", "result"), [(2, 3, "YES"), (1, 3, "NO"), (0, 0, "UNDETERMINED")])
def test_majority(spark, yes, parsed, result):
    assert one(spark, text.majority(F.lit(yes), F.lit(parsed))) == result


@pytest.mark.parametrize(("answer", "number"), [("Score: 7 of 10", 7.0), ("3 then 4.5", 4.5), ("none", None)])
def test_numbers(spark, answer, number):
    assert one(spark, text.last_number(F.lit(answer))) == number


@pytest.mark.parametrize(("said", "seconds"), [("1h2m3s", 3723.0), ("250ms", 0.25), ("soon", 60.0), (None, 60.0), ("0s", 60.0)])
def test_durations(spark, said, seconds):
    assert one(spark, text.seconds(F.lit(said).cast("string"))) == pytest.approx(seconds)


def test_density_without_parameters(spark):
    df = spark.createDataFrame([("s", "getUser", "get user", 0, 0), ("s", "x", None, 0, 0)], "s string, name string, description string, n_params int, n_described int")
    r = text.doc_density(df, "s").first()
    assert (r.n_tools, r.described_share, r.echo_share, r.param_coverage) == (2, 0.5, 0.5, 1.0)


def test_near_names(spark):
    df = spark.createDataFrame([("s", "read_file"), ("s", "read_files"), ("s", "write"), ("t", "read_file")], "s string, n string")
    assert [(r.a, r.b, r.similarity) for r in text.near_names(df, "s", "n").collect()] == [("read_file", "read_files", 0.9)]


def test_cosine_of_zero_and_unequal_vectors(spark):
    assert one(spark, retrieval.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0
    assert one(spark, retrieval.cosine(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0)))) == 0


def test_gold_rank_shares_ties_and_goes_last_if_absent(spark):
    scores = spark.createDataFrame([(1, 1, 2.0), (1, 2, 2.0), (1, 3, 1.0)], "query int, doc int, score double")
    gold = spark.createDataFrame([(1, 1), (1, 3), (1, 9)], "query int, doc int")
    n = spark.createDataFrame([(9,)], "n long")
    got = {r.gold: (r.rank, r.reciprocal) for r in retrieval.gold_ranks(scores, gold, n).collect()}
    assert got == {1: (1.5, 1 / 1.5), 3: (3.0, 1 / 3), 9: (10.0, 0.0)}
