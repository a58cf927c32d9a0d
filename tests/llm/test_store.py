from roadweave.llm._store import materialize, release


def test_tables_are_kept_until_released(spark):
    df = materialize(spark.range(5), "numbers")
    assert df.count() == 5
    assert release(spark) >= 1 and release(spark) == 0


def test_discard_deletes_one_table(spark):
    import os

    from roadweave.llm._store import discard

    a, b = materialize(spark.range(3), "a"), materialize(spark.range(4), "b")
    discard(a)
    discard(a)
    discard(spark.range(1))
    assert not os.path.exists(a._stored_at) and b.count() == 4
