"""Aggregate expressions that score predictions (three families of definitions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: float64 machine epsilon: the smallest denominator of the guarded MAPE.
EPS = 2.220446049250313e-16


def mae(y: str, p: str) -> Column:
    return F.avg(F.abs(F.col(y) - F.col(p)))


def rmse(y: str, p: str) -> Column:
    return F.sqrt(F.avg(_err2(y, p)))


def mape_plain(y: str, p: str) -> Column:
    """Mean |error/actual| in percent; null if any actual is 0."""
    ape = F.abs(F.try_divide(F.col(y) - F.col(p), F.col(y)))
    return F.when(F.sum(F.when(F.col(y) == 0, 1).otherwise(0)) == 0, F.avg(ape) * 100)


def mape_finite(y: str, p: str) -> Column:
    """Rows with actual 0 are left out, unless the prediction is 0 as well (0/0), which
    makes the result undefined (null)."""
    ape = F.abs(F.try_divide(F.col(y) - F.col(p), F.col(y)))
    undefined = F.sum(F.when((F.col(y) == 0) & (F.col(p) == 0), 1).otherwise(0))
    return F.when(undefined == 0, F.avg(ape) * 100)


def mape_guarded(y: str, p: str) -> Column:
    """The denominator is at least machine epsilon."""
    return F.avg(F.abs(F.col(y) - F.col(p)) / F.greatest(F.abs(F.col(y)), F.lit(EPS))) * 100


def r2_or_zero(y: str, p: str) -> Column:
    """1 - SSres/SStot, 0 when the actuals are constant."""
    return F.coalesce(1 - F.try_divide(F.sum(_err2(y, p)), _ss_tot(y)), F.lit(0.0))


def r2_score(y: str, p: str) -> Column:
    """As above; constant actuals give 1 if perfect, else 0; below two rows null."""
    res = F.sum(_err2(y, p))
    constant = F.when(res == 0, 1.0).otherwise(0.0)
    return F.when(F.count(y) >= 2, F.coalesce(1 - F.try_divide(res, _ss_tot(y)), constant))


def r2_corr(y: str, p: str) -> Column:
    """Squared Pearson correlation."""
    return F.pow(F.corr(y, p), 2)


def _err2(y: str, p: str) -> Column:
    return (F.col(y) - F.col(p)) * (F.col(y) - F.col(p))


def _ss_tot(y: str) -> Column:
    return F.var_pop(y) * F.count(y)
