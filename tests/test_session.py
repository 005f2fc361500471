"""Settled tables and their end."""

import os

from sessiongrid.session import Scratch, settle, shared_folder


def tables(spark):
    folder = shared_folder(spark).removeprefix("file://")
    return {name for name in os.listdir(folder) if name.startswith("sessiongrid-")}


def test_scratch_deletes_only_its_own_tables(spark):
    kept = settle(spark.range(5))
    before = tables(spark)
    with Scratch(spark) as scratch:
        one, two = scratch.settle(spark.range(3)), scratch.settle(spark.range(4))
        assert len(tables(spark) - before) == 2 and one.count() + two.count() == 7
        scratch.drop(one)
        assert len(tables(spark) - before) == 1
    assert tables(spark) == before and kept.count() == 5


def test_scratch_deletes_after_an_error(spark):
    before = tables(spark)
    try:
        with Scratch(spark) as scratch:
            scratch.settle(spark.range(3))
            raise KeyError("stop")
    except KeyError:
        pass
    assert tables(spark) == before
