"""Exact nearest-neighbour joins of a query set against a reference table.

q: qid, qv, and whatever else; ref: rid, v, label. Ties go to the smaller rid.
"""

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knnspark.constants import TOP
from knnspark.operators import blocks

#: Queries a block holds; reference rows meet one block after the other.
BLOCK = blocks.QUERIES


def pairs(q: DataFrame, ref: DataFrame) -> DataFrame:
    """Every query with every reference row but itself: the stated query set goes to all rows in blocks of bounded size."""
    blocks = max(1, -(-q.count() // BLOCK))
    if blocks == 1:
        return ref.join(F.broadcast(q), F.col("qid") != F.col("rid"))
    dealt = q.withColumn("_b", F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int"))
    spread = ref.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return spread.join(dealt, "_b").filter("qid <> rid").drop("_b")


def nearest(candidates: DataFrame, k: int = TOP) -> DataFrame:
    """The k nearest of each query; the rank filter is pushed below the exchange."""
    w = Window.partitionBy("qid").orderBy("d", "rid")
    return candidates.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k)


def brute(q: DataFrame, ref: DataFrame, dims: int, k: int = TOP) -> DataFrame:
    """qid, rid, d, label, rn by comparing every pair, as matrix products of blocks of queries."""
    return blocks.each_block(q.select("qid", "qv"), lambda some, _: blocks.nearest(ref, some, k), BLOCK)


def within(q: DataFrame, ref: DataFrame, k: int, first: int) -> DataFrame:
    """qid, rid, d: all rows as near as the k-th nearest or, where there are fewer, the farthest; by the first dimensions, then by all."""

    def one(some: pa.Table, _: None) -> DataFrame:
        return blocks.within(ref, some, blocks.farthest(some, blocks.nearest(ref, some, k)), first)

    return blocks.each_block(q.select("qid", "qv"), one, BLOCK)


def vote(top: DataFrame) -> DataFrame:
    """qid, fraud_count, worst: missing neighbours count as legitimate."""
    return top.groupBy("qid").agg(F.sum("label").cast("long").alias("fraud_count"), F.max("d").alias("worst"))


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact neighbours that were found."""
    there = found.select("qid", "rid").distinct().withColumn("hit", F.lit(1))
    return exact.select("qid", "rid").join(there, ["qid", "rid"], "left").agg(F.count("hit").alias("hits"), F.count(F.lit(1)).alias("total"))


def smallest_first(d: Column, key: Column, base: int) -> Column:
    """One integer that orders by d, then key (below base)."""
    return d * base + key
