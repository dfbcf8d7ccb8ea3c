"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014).

Each round is a partial aggregation and a join; rounds are written to the shared folder, so that lineage stays
short and a lost executor costs one round. No node's neighbours meet in one task's memory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knnspark.llm.common import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, component (the smallest node reachable) for all nodes of edges a, b; loops and repeats do no harm."""
    now = scratch.keep(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        linked = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        then = scratch.keep(linked.unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct())
        scratch.drop(now)
        now, before, mark = then, mark, _mark(then)
        if mark == before:
            break
    heads = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(heads.select("node", F.col("node").alias("component")))


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
