"""From fraud counts to answers and contest scores."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# The six answers by fraud count (fixed values).
ANSWERS = (
    '{"approved":true,"fraud_score":0}',
    '{"approved":true,"fraud_score":0.2}',
    '{"approved":true,"fraud_score":0.4}',
    '{"approved":false,"fraud_score":0.6}',
    '{"approved":false,"fraud_score":0.8}',
    '{"approved":false,"fraud_score":1}',
)


def score(count: Column) -> Column:
    return count / 5.0


def approved(count: Column) -> Column:
    return count <= 2


def response(count: Column) -> Column:
    return F.element_at(F.array(*[F.lit(a) for a in ANSWERS]), (count + 1).cast("int"))


def latency_score(p99_ms: Column) -> Column:
    return F.when(p99_ms > 2000, -3000.0).otherwise(1000 * F.log10(1000 / F.greatest(p99_ms, F.lit(1.0))))


def detection_score(fp: Column, fn: Column, err: Column, n: Column) -> Column:
    """1000 * log10(1 / max(E / n, 0.001)) - 300 * log10(1 + E) with E = fp + 3 fn + 5 err; -3000 above 15 % failures."""
    e = (fp + 3 * fn + 5 * err).cast("double")
    failures = (fp + fn + err) / F.greatest(n, F.lit(1))
    share = e / F.greatest(n, F.lit(1))
    return F.when(failures > 0.15, -3000.0).otherwise(1000 * F.log10(1 / F.greatest(share, F.lit(0.001))) - 300 * F.log10(1 + e))
