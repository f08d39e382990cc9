"""Written intermediates and the folders they go to."""

import os

import pytest

from graphloom.sources.work import remove, scratch, work_dir, written


def test_scratch_ends_with_its_block(spark):
    before = set(os.listdir(work_dir(spark)))
    with scratch(spark) as outer:
        with scratch(spark) as inner:
            assert written(spark.range(3), "inner").count() == 3 and os.listdir(inner)
        assert not os.path.exists(inner)
        kept = written(spark.range(5), "kept", f"{work_dir(spark)}/kept")
        assert written(kept.where("id > 2"), "outer").count() == 2 and os.listdir(outer)
    assert set(os.listdir(work_dir(spark))) - before == {"kept"} and kept.count() == 5
    remove(spark, f"{work_dir(spark)}/kept")
    remove(spark, f"{work_dir(spark)}/kept")
    assert set(os.listdir(work_dir(spark))) == before


def test_scratch_ends_with_an_error(spark):
    with pytest.raises(ValueError), scratch(spark) as folder:
        written(spark.range(1), "one")
        raise ValueError
    assert not os.path.exists(folder)
    assert os.path.dirname(written(spark.range(1), "one").inputFiles()[0].removeprefix("file://")).startswith(work_dir(spark) + "/one-")
