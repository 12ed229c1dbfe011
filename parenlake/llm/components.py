"""Connected components of a link table, by alternating large and small stars.

Every step is a join or an aggregation over links; no list of links or nodes
reaches the driver, and each step's links are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parenlake.llm.common import drop_stage, stage


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Hang each node's larger (or not larger) neighbours on its least one."""
    if large:
        around = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        around = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = around.groupBy("a").agg(F.min("b").alias("_m")).select(F.col("a").alias("_a"), F.least("a", "_m").alias("_m"))
    joined = around.join(least, F.col("a") == F.col("_a"))
    if large:
        out = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("_m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("_m").alias("b")).unionByName(least.select(F.col("_a").alias("a"), F.col("_m").alias("b")))
    return out.filter(F.col("a") != F.col("b")).distinct()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """links(a long, b long) -> node, component: the least node it reaches.

    Nodes without a link don't appear. No links give an empty result.
    """
    at = stage(links.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    for _ in range(rounds):
        after = stage(_star(_star(at, True), False), "links")
        drop_stage(at)
        at = after
        mark = at.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if mark == before or not mark["n"]:
            return at.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(at.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        before = mark
    raise RuntimeError("components did not settle")
