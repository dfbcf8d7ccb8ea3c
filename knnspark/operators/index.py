"""Indexes as objects: built, saved, loaded, made ready, asked. Both answer `search` with qid, rid, d, label, rn."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knnspark import constants as C
from knnspark.functions import features
from knnspark.operators import ivf, partitioned
from knnspark.sources import io


def synthetic_queries(spark: SparkSession, n: int, dims: int = C.DIMS) -> DataFrame:
    """qid, qv: n vectors over the whole grid, the same each time (bytes of a hash)."""
    draw = lambda i: F.conv(F.substring(F.md5(F.concat(F.col("id").cast("string"), F.lit(f":{i}"))), 1, 8), 16, 10).cast("long")
    return spark.range(n).select(F.col("id").alias("qid"), F.array(*[(draw(i) % (2 * C.SCALE) - C.SCALE).cast("int") for i in range(dims)]).alias("qv"))


class Clustered:
    """Tiered probing of k-means clusters, with the production settings."""

    def __init__(self, members: DataFrame, centroids: DataFrame, stats: DataFrame):
        self.members, self.centroids, self.stats = members, centroids, stats

    @classmethod
    def build(cls, ref: DataFrame, k: int | None = None, dims: int = C.DIMS) -> Clustered:
        """The number of clusters grows with the root of the rows, up to the production one, unless it is given."""
        k = k or max(1, min(C.CLUSTERS, round(C.CLUSTERS * math.sqrt(ref.count() / C.SIZED_FOR))))
        centroids = ivf.train_sampled(ref, k)
        members = ivf.assign(ref.select("rid", "v", "label"), centroids)
        return cls(members, centroids, ivf.statistics(members, dims))

    def save(self, path: str) -> None:
        io.save_index(path, self.members, self.centroids, self.stats, self.centroids.count())

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Clustered:
        return cls(*io.load_index(spark, path))

    def info(self) -> DataFrame:
        return self.members.agg(F.count(F.lit(1)).alias("dataset_count")).join(self.centroids.agg(F.count(F.lit(1)).alias("k")))

    def search(self, q: DataFrame, dims: int = C.DIMS) -> DataFrame:
        return ivf.tiered(q, self.members, self.centroids, dims, C.PROBES, C.WORST, C.ESCALATE)

    def ready(self, warm: int = 100) -> Clustered:
        """Holds the members in memory and asks synthetic queries; only then is it ready."""
        self.members = self.members.persist()
        self.search(synthetic_queries(self.members.sparkSession, warm)).count()
        return self


class Partitioned:
    """Exact search of categorical partitions and their median-split leaves."""

    def __init__(self, members: DataFrame, directory: DataFrame, kept: tuple[DataFrame, ...] = ()):
        """kept: what was persisted to build it."""
        self.members, self.directory, self.kept = members, directory, kept

    @classmethod
    def build(cls, ref: DataFrame, most: int = C.LEAF_ROWS, dims: int = C.DIMS) -> Partitioned:
        rows = ref.select("rid", "v", "label").withColumn("pkey", features.key8(F.col("v"))).persist()
        members = partitioned.leaves(rows, dims, most).persist()
        return cls(members, partitioned.boxes(members, ["pkey", "leaf"], dims), (members, rows))

    def save(self, path: str) -> None:
        """What was held to build it goes; from then on the index is what lies there."""
        io.save_tree(path, self.members, self.directory)
        self.members, self.directory = (df.sparkSession.read.schema(df.schema).parquet(f"{path}/{x}") for df, x in ((self.members, "members"), (self.directory, "directory")))
        for df in self.kept:
            df.unpersist()
        self.kept = ()

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Partitioned:
        return cls(*io.load_tree(spark, path))

    def info(self) -> DataFrame:
        return self.directory.agg(F.sum("n").alias("dataset_count"), F.count(F.lit(1)).alias("k"))

    def search(self, q: DataFrame, dims: int = C.DIMS) -> DataFrame:
        return partitioned.search(q.withColumn("pkey", features.key8(F.col("qv"))), self.members, self.directory, dims, ["pkey", "leaf"])

    def ready(self, warm: int = 100) -> Partitioned:
        self.members = self.members.persist()
        self.search(synthetic_queries(self.members.sparkSession, warm)).count()
        return self
