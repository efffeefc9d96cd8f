"""Scalar expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F



def inf() -> Column:
    return F.lit(float("inf"))


def nan() -> Column:
    return F.lit(float("nan"))


def ratio(a: Column, b: Column, otherwise: Column | None = None) -> Column:
    """a/b as double, and ``otherwise`` (null if not given) where b is 0."""
    q = F.try_divide(a.cast("double"), b.cast("double"))
    return q if otherwise is None else F.when(b == 0, otherwise).otherwise(q)


def samples_for_error(variance: Column, truth: Column, eps: float = 0.1) -> Column:
    """Independent draws for relative error eps by Chebyshev; infinite where there is nothing to count."""
    return F.when(truth <= 0, inf()).otherwise(F.try_divide(variance, F.pow(F.lit(eps) * truth, F.lit(2.0))))


def correlation(a: Column | str, b: Column | str) -> Column:
    """Pearson's correlation; 0 where one side does not vary, which the built-in function takes for an error."""
    return F.coalesce(F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)), F.lit(0.0))


def nan_mean(x: Column) -> Column:
    return F.avg(F.nanvl(x, F.lit(None).cast("double")))
