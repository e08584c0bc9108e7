from __future__ import annotations

import gc

import pytest

from rentlens.operators import frames


def kept_now(spark) -> int:
    return spark.sparkContext._jsc.getPersistentRDDs().size()


@pytest.fixture
def counted(spark):
    before = kept_now(spark)
    return lambda: kept_now(spark) - before


def test_frames_go_with_the_block_or_with_its_result(spark, counted):
    with frames.owned():
        assert frames.keep(spark.range(10)).count() == 10 and counted() == 1
    assert counted() == 0
    with frames.owned() as owner:
        kept = frames.keep(spark.range(20))
        result = owner.until(kept.where("id > 3"))
    assert result.count() == 16 and counted() == 1
    del result, kept
    gc.collect()
    assert counted() == 0


def test_blocks_nest_and_errors_release(spark, counted):
    with pytest.raises(ZeroDivisionError):
        with frames.owned():
            frames.keep(spark.range(5)).count()
            with frames.owned():
                frames.keep(spark.range(6)).count()
            assert counted() == 1
            1 / 0
    assert counted() == 0


def test_nothing_is_kept_without_an_owner(spark, counted):
    assert frames.keep(spark.range(7)).count() == 7 and counted() == 0


@pytest.mark.parametrize("name", ["G1_join_census", "G8_match_token_overlap", "H7_describe_numeric", "G10_match_fuzzy"])
def test_no_frame_is_left_after_a_query(spark, counted, name):
    import __spark_entry__ as entry

    result = entry.queries()[name](spark, "/root/testdata/sf0.001")
    result.collect()
    del result
    gc.collect()
    assert counted() == 0


def test_listings_are_read_twice_for_the_training_table(spark):
    """Once for the places and the fills, once for the rows themselves."""
    from pyspark.sql import functions as F

    from rentlens.catalog.fixtures import Tables
    from rentlens.plans import listings as jobs

    t = Tables(spark, "/root/testdata/sf0.001")
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted_name(x):
        seen.add(1)
        return x

    rows = t.fx("listings").withColumns(
        {"heatingType_clean": F.col("heatingType"), "periode_0005": F.lit("x"), "regio3": counted_name("regio3")}
    )
    n = t.fx("listings").count()
    with frames.owned():
        ready = jobs.train_from_listings(rows, t.fx("keymap"), t.fx("zensus"))
        assert ready.count() > 0
    assert n <= seen.value <= 2 * n
