"""Scoring of request streams: stateless, by the batch functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knnspark.functions import decision, features
from knnspark.operators import knn
from knnspark.operators.index import Clustered, Partitioned
from knnspark.schema import REQUEST


def score(requests: DataFrame, ref: DataFrame | Clustered | Partitioned, dims: int = 14) -> DataFrame:
    """id, fraud_count, fraud_score, approved for rows of id, request (a JSON string).

    ref: an index, or reference rows, which are compared one and all. A malformed request, and any request without reference rows, counts 0 and is approved. Each row is answered, also where an id
    repeats; equal requests are searched once.
    """
    parsed = requests.select("id", F.from_json("request", REQUEST).alias("request")).select("id", features.vector("request").alias("qv"))
    parsed = parsed.withColumn("qid", F.xxhash64("qv"))
    q = parsed.filter(F.col("qv").isNotNull()).select("qid", "qv").dropDuplicates(["qid"])
    top = knn.brute(q, ref.select("rid", "v", "label"), dims) if isinstance(ref, DataFrame) else ref.search(q, dims)
    votes = knn.vote(top).select("qid", "fraud_count")
    counted = parsed.join(votes, "qid", "left").select("id", F.coalesce("fraud_count", F.lit(0)).cast("long").alias("fraud_count"))
    return counted.withColumns({"fraud_score": decision.score(F.col("fraud_count")), "approved": decision.approved(F.col("fraud_count"))})


def shed(rows: DataFrame, batch: str, order: str, slots: int) -> DataFrame:
    """Marks what exceeds `slots` in each batch; the excess is answered with count 0."""
    place = F.row_number().over(Window.partitionBy(batch).orderBy(order))
    return rows.withColumn("shed", place > slots)


def start(stream: DataFrame, ref: DataFrame | Clustered | Partitioned, sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Starts a query that hands each micro-batch's scores to `sink`; the index (or the reference rows) is ready before it starts."""
    if isinstance(ref, DataFrame):
        ref = ref.persist()
        ref.count()
    else:
        ref = ref.ready()

    def one(batch: DataFrame, number: int) -> None:
        sink(score(batch, ref), number)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
