import __spark_entry__ as entry


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert {"server", "verdict", "delta", "ci_lo", "ci_hi"} <= set(df.columns)
