import os
from types import SimpleNamespace

import pytest

from annalist.session import discard, materialize, scratch, shared_folder


def place(df):
    return df._annalist_path.removeprefix("file:").replace("//", "/")


def test_materialize_and_discard(spark):
    df = materialize(spark.range(5), "five")
    assert df.count() == 5 and df.dtypes == spark.range(5).dtypes
    assert df._annalist_path.startswith(shared_folder(spark)) and os.path.isdir(place(df))
    discard(df, spark.range(1))
    assert not os.path.exists(place(df))
    assert materialize(spark.range(0)).count() == 0


def test_settings_of_the_session_stay(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.range(3).createOrReplaceTempView("three")
    assert materialize(spark.sql("select id % 2 as k, count(*) as n from three group by 1")).count() == 2
    assert spark.conf.get(key, None) == before


def test_scratch_deletes_what_was_written_in_it(spark):
    with scratch() as outer:
        with scratch() as inner:
            gone, kept = materialize(spark.range(2)), inner.keep(materialize(spark.range(3)))
        assert not os.path.exists(place(gone)) and kept.count() == 3
        assert outer.frames == [kept]
    assert not os.path.exists(place(kept))
    after = materialize(spark.range(1))
    assert os.path.isdir(place(after))
    discard(after)


def test_folder_without_setting():
    unset = lambda master, name: SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: d), sparkContext=SimpleNamespace(master=master, applicationId=name))
    own = shared_folder(unset("local[4]", "test-app"))
    assert own == shared_folder(unset("local[4]", "test-app")) and os.path.isdir(own.removeprefix("file://"))
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            shared_folder(unset(master, "other"))
