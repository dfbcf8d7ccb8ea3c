"""Confusion, calibration, percentiles."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def count_if(cond: Column) -> Column:
    return F.coalesce(F.sum(F.when(cond, 1).otherwise(0)), F.lit(0)).cast("long")


def confusion(rows: DataFrame, approved: Column, expected: Column) -> DataFrame:
    """Approving what is not to be approved is a false negative (fraud missed)."""
    return rows.agg(
        count_if(approved & expected).alias("tn"), count_if(~approved & ~expected).alias("tp"),
        count_if(~approved & expected).alias("fp"), count_if(approved & ~expected).alias("fn"), F.count(F.lit(1)).alias("n"),
    )


def _wrong(count: str) -> Column:
    return (F.col(count) <= 2) != F.col("expected")


def class_breakdown(records: DataFrame) -> DataFrame:
    """All six classes, also empty ones. records: fast_count, fast_worst, full_count, expected."""
    six = records.sparkSession.range(6).select(F.col("id").alias("class"))
    fixable = _wrong("fast_count") & ~_wrong("full_count")
    by = records.groupBy(F.col("fast_count").alias("class")).agg(F.count(F.lit(1)).alias("n"), count_if(_wrong("fast_count")).alias("fast_wrong"), count_if(_wrong("full_count")).alias("full_wrong"), count_if(fixable).alias("fixable"))
    return six.join(by, "class", "left").select("class", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n", "fast_wrong", "full_wrong", "fixable")])


def thresholds(records: DataFrame) -> DataFrame:
    """By class: one below the smallest fast_worst of a fixable row; 0 for classes that always escalate or have none."""
    six = records.sparkSession.range(6).select(F.col("id").alias("class"))
    fixable = records.filter(_wrong("fast_count") & ~_wrong("full_count")).groupBy(F.col("fast_count").alias("class")).agg((F.min("fast_worst") - 1).alias("t"))
    return six.join(fixable, "class", "left").select("class", F.when(F.col("class").between(2, 4), F.lit(0)).otherwise(F.coalesce("t", F.lit(0))).cast("long").alias("threshold"))


def percentile_rows(values: DataFrame, value: str, percents: list[int]) -> DataFrame:
    """sorted[n * p div 100] for each p (zero-based).

    Approximate quantiles cut the values into buckets; exact counts tell which bucket holds each wanted rank, and only those
    buckets are ranked.
    """
    spark = values.sparkSession
    cuts = sorted(set(values.approxQuantile(value, [i / 64 for i in range(1, 64)], 0.005)))
    bucket = sum((F.when(F.col(value) >= c, 1).otherwise(0) for c in cuts), F.lit(0))
    dealt = values.select(value, bucket.alias("bucket"))
    sizes = {r["bucket"]: r["n"] for r in dealt.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()}
    before, n = {}, 0
    for b in sorted(sizes):
        before[b], n = n, n + sizes[b]
    wanted = [(p, min(n * p // 100, n - 1)) for p in percents] if n else []
    picks = [(p, b := max(x for x in before if before[x] <= i), i - before[b] + 1) for p, i in wanted]
    asked = spark.createDataFrame(picks, "percent int, bucket int, rn int")
    local = dealt.filter(F.col("bucket").isin([b for _, b, _ in picks])).withColumn("rn", F.row_number().over(Window.partitionBy("bucket").orderBy(value)))
    return local.join(F.broadcast(asked), ["bucket", "rn"]).select("percent", F.col(value).alias("value"))
