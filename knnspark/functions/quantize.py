"""Floats to the integer grid, by way of single precision, half up."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from knnspark.constants import SCALE, SENTINEL


def _grid(x: Column) -> Column:
    return F.floor(x.cast("float") * F.lit(SCALE).cast("float") + F.lit(0.5).cast("float")).cast("int")


def clamp(x: Column) -> Column:
    """[0, 1] to 0..SCALE; what lies outside goes to the nearer end."""
    return F.when(x <= 0, 0).when(x >= 1, SCALE).otherwise(_grid(x))


def with_sentinel(x: Column) -> Column:
    """The same, but -1 (within 1e-6) stays apart as SENTINEL."""
    return F.when(F.abs(x + 1) <= 1e-6, SENTINEL).otherwise(clamp(x))


def signed(vector: Column) -> Column:
    """A vector on the grid without clamping."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE + 0.5).cast("int"))


def positive_int(text: Column, default: int) -> Column:
    """A setting's value: whole numbers from 1 up, else the default."""
    n = F.when(text.rlike("^[+-]?[0-9]+$"), text.try_cast("long"))
    return F.when(n >= 1, n).otherwise(F.lit(default)).cast("long")
