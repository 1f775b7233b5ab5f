import os

import pytest
from pyspark.sql import functions as F

from strandline.llm import common

TEXTS = [None, "", " \t\n\v\f\r ", "a", " a  b\n", "a b　c   d", "\x00 x", "x" * 10_000]


def test_words_are_split_at_ascii_white_space_only(spark):
    d = spark.createDataFrame(list(enumerate(TEXTS)), "k int, t string").select("k", common.words(F.col("t")).alias("w"), common.count_words(F.col("t")).alias("n"))
    for r in d.collect():
        want = [w.decode() for w in (TEXTS[r.k] or "").encode().split()]
        assert r.w == want and r.n == len(want)


def test_only_ascii_letters_are_lowered(spark):
    assert spark.range(1).select(common.ascii_lower(F.lit("AZaz ÄÉİẞ"))).first()[0] == "azaz ÄÉİẞ"


def test_let_evaluates_once(spark):
    r = spark.range(50).select(common.let(F.rand(), lambda x: x - x).alias("d")).distinct().collect()
    assert [x.d for x in r] == [0.0]


def test_stored_tables_are_swept(spark):
    d = common.stored(spark.range(5), "t")
    assert d.count() == 5
    home = common._own(spark).removeprefix("file:")
    assert os.path.isdir(home)
    common.sweep(spark)
    assert not os.path.isdir(home)


def test_what_passes_goes_and_what_stays_stays(spark):
    with common.passing(spark):
        gone = common.stored(spark.range(3), "gone")
        kept = common.stored(gone, "kept", passes=False)
    assert kept.count() == 3
    assert not os.path.exists(gone.inputFiles()[0].removeprefix("file://"))
    with pytest.raises(ZeroDivisionError), common.passing(spark):
        left = common.stored(spark.range(3), "left")
        1 / 0
    assert left.count() == 3


class _Cluster:
    class sparkContext:  # noqa: N801
        master = "spark://somewhere"

        @staticmethod
        def getConf():
            return {}

        @staticmethod
        def getCheckpointDir():
            return None


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(_Cluster)
