"""Exact integer distances and lower bounds. All are plain expressions, so they stay in generated code."""

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F


def l2sq(a: Column, b: Column, dims: int) -> Column:
    """Unrolled: the form for hot paths."""
    return reduce(add, [(a[i] - b[i]).cast("long") * (a[i] - b[i]).cast("long") for i in range(dims)])


def l2sq_any(a: Column, b: Column) -> Column:
    """For vectors of any equal length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y).cast("long") * (x - y).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)


def box_bound(q: Column, low: Column, high: Column, dims: int) -> Column:
    """No point of the box is nearer to q."""
    out = [F.greatest(F.lit(0), q[i] - high[i], low[i] - q[i]).cast("long") for i in range(dims)]
    return reduce(add, [x * x for x in out])


def radius_bound(centre_sq: Column, radius: Column) -> Column:
    """(distance to the centre - radius) squared, zero inside."""
    gap = F.greatest(F.sqrt(centre_sq.cast("double")) - radius, F.lit(0.0))
    return gap * gap
