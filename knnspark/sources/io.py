"""Scans and sinks: labelled vectors as JSON, labelled requests, the saved index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from knnspark import constants as C
from knnspark.functions.quantize import with_sentinel
from knnspark.schema import META, REFERENCE, REQUEST


def label_code(label: Column) -> Column:
    """fraud is 1, legit 0; anything else is an error."""
    return F.when(label == "fraud", 1).when(label == "legit", 0).otherwise(F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce(label, F.lit("null")))).cast("int"))


def reference_json(spark: SparkSession, path: str, dims: int = C.DIMS) -> DataFrame:
    """vector, label rows of a (gzipped) JSON array, on the grid. Vectors of another arity are an error."""
    rows = spark.read.schema(REFERENCE).json(path, multiLine=True)
    checked = F.when(F.size("vector") == dims, F.col("vector")).otherwise(F.raise_error(F.lit(f"a vector must have {dims} numbers")).cast("array<float>"))
    return rows.select(F.transform(checked, with_sentinel).alias("v"), label_code(F.col("label")).alias("label"))


def arity(rows: DataFrame, vector: str, dims: int) -> DataFrame:
    """Rows in and out of arity, counted; quarantine instead of failure."""
    ok = F.size(vector) == dims
    return rows.agg(F.count(F.when(ok, 1)).alias("good"), F.count(F.when(~F.coalesce(ok, F.lit(False)), 1)).alias("bad"))


def labelled_requests(spark: SparkSession, path: str) -> DataFrame:
    """request, expected of a test file {"entries": [...]}."""
    schema = f"entries array<struct<request:struct<{REQUEST.replace(' struct', ':struct').replace('id string', 'id:string')}>,expected_approved:boolean>>"
    return spark.read.schema(schema).json(path, multiLine=True).select(F.explode("entries").alias("e")).select(F.col("e.request").alias("request"), F.col("e.expected_approved").alias("expected"))


def save_index(path: str, assigned: DataFrame, centroids: DataFrame, stats: DataFrame, k: int) -> None:
    """Members lie by cluster, nearest to their centroid first."""
    spark = assigned.sparkSession
    assigned.repartition("cid").sortWithinPartitions("cid", "cd", "rid").write.mode("overwrite").parquet(f"{path}/members")
    centroids.write.mode("overwrite").parquet(f"{path}/centroids")
    stats.write.mode("overwrite").parquet(f"{path}/statistics")
    spark.createDataFrame([("knnspark", 1, C.SCALE, assigned.count(), k)], META).write.mode("overwrite").parquet(f"{path}/meta")


def load_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    meta = spark.read.schema(META).parquet(f"{path}/meta").first()
    if (meta.format, meta.version, meta.quant_scale) != ("knnspark", 1, C.SCALE):
        raise ValueError(f"not an index of this version: {meta}")
    return tuple(spark.read.parquet(f"{path}/{x}") for x in ("members", "centroids", "statistics"))


def save_tree(path: str, members: DataFrame, directory: DataFrame) -> None:
    """The partitioned index: members lie by partition and leaf, the directory holds each leaf's size and box."""
    spark = members.sparkSession
    members.repartition("pkey", "leaf").sortWithinPartitions("pkey", "leaf", "rid").write.mode("overwrite").parquet(f"{path}/members")
    directory.write.mode("overwrite").parquet(f"{path}/directory")
    n, leaves = (spark.read.schema(df.schema).parquet(f"{path}/{x}").count() for df, x in ((members, "members"), (directory, "directory")))  # not made anew to be counted
    spark.createDataFrame([("knnspark-tree", 1, C.SCALE, n, leaves)], META).write.mode("overwrite").parquet(f"{path}/meta")


def load_tree(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    meta = spark.read.schema(META).parquet(f"{path}/meta").first()
    if (meta.format, meta.version, meta.quant_scale) != ("knnspark-tree", 1, C.SCALE):
        raise ValueError(f"not a partitioned index of this version: {meta}")
    return tuple(spark.read.parquet(f"{path}/{x}") for x in ("members", "directory"))


def save_run(path: str, results: DataFrame, manifest: dict[str, str], stats: DataFrame) -> None:
    """A run's artifacts as JSON lines: results, what was run, and samples taken meanwhile."""
    results.write.mode("overwrite").json(f"{path}/results")
    results.sparkSession.createDataFrame([tuple(manifest.values())], ", ".join(f"`{k}` string" for k in manifest)).write.mode("overwrite").json(f"{path}/manifest")
    stats.write.mode("overwrite").json(f"{path}/stats")
