"""Connected components by alternating large-star and small-star contraction.

Every round is two shuffles of the remaining edges and ends in a reliable checkpoint, so no round
depends on the memory of an executor and nothing but one count and one checksum reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    far = both.filter("v > u").join(least, "u")
    return far.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(u, v) links between ids -> (node, root): root is the least id of the component.

    Rows only for nodes other than the roots themselves.  Self links and repeated links do no harm;
    null ends are dropped; no links give no rows.
    """
    spark = edges.sparkSession
    shared_dir(spark)
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"), (F.col("u").isNull() | F.col("v").isNull()).alias("bad"))
    e = e.filter("not bad and u != v").select("u", "v").distinct().checkpoint()
    sign = lambda d: d.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = sign(e)
    if not before[0]:
        return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    for _ in range(most_rounds):
        e = _small_star(_large_star(e)).checkpoint()
        if (now := sign(e)) == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
