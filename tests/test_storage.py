"""Tables that pass, and shuffles that go with their query."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from gleaner.storage import _SHUFFLE_CLEANUP, materialize, passing


def folders(df):
    return {os.path.dirname(f).removeprefix("file:") for f in df.inputFiles()}


def test_tables_of_a_scope_are_dropped_but_for_lasting_ones(spark):
    around = materialize(spark.range(5), "around")
    with passing(spark):
        outer = materialize(spark.range(6), "outer")
        with passing(spark):
            inner = materialize(spark.range(7), "inner")
            result = materialize(inner.join(outer, "id"), "result", lasting=True)
            gone = folders(inner)
        assert not any(os.path.exists(f) for f in gone)
        assert result.count() == 6
        last = materialize(result.filter("id > 1"), "last", lasting=True)
        gone = folders(outer) | folders(result)
    assert not any(os.path.exists(f) for f in gone)
    assert (around.count(), last.count()) == (5, 4)


def test_tables_are_dropped_on_failure(spark):
    with pytest.raises(ZeroDivisionError), passing(spark):
        table = folders(materialize(spark.range(3), "failing"))
        raise ZeroDivisionError
    assert not any(os.path.exists(f) for f in table)


def test_setting_is_put_back_and_frames_can_be_used_again(spark):
    before = spark.conf.get(_SHUFFLE_CLEANUP, None)
    counted = spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count()
    first = materialize(counted, "counted")
    assert spark.conf.get(_SHUFFLE_CLEANUP, None) == before
    again = materialize(counted, "counted")  # its shuffle was dropped and is made anew
    assert sorted(first.collect()) == sorted(again.collect()) == sorted(counted.collect())
    assert len(glob.glob(next(iter(folders(first))) + "/*.parquet")) > 0
