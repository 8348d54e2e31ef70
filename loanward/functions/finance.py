"""Loan arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(value: Column | str | float) -> Column:
    if isinstance(value, Column):
        return value
    return F.col(value) if isinstance(value, str) else F.lit(value)


def clip(value: Column | str, low: float, high: float) -> Column:
    """Limit to [low, high]; null stays null."""
    v = _c(value)
    return F.when(v.isNotNull(), F.least(F.greatest(v, F.lit(low)), F.lit(high)))


def installment(amount: Column | str, annual_rate: Column | str, months: Column | str) -> Column:
    """Level monthly payment that repays ``amount`` over ``months``; straight line at rate 0."""
    p, r, n = _c(amount), _c(annual_rate) / 12, _c(months)
    growth = F.pow(1 + r, n)
    return F.when(r == 0, F.try_divide(p, n)).otherwise(F.try_divide(p * r * growth, growth - 1))


def risk_rate(fico: Column | str, dti: Column | str, base: float = 0.15, per_point: float = 0.0001,
              per_dti: float = 0.10, low: float = 0.06, high: float = 0.25) -> Column:
    """Annual rate priced from score and debt ratio, within [low, high]."""
    return clip(F.lit(base) + (F.lit(750) - _c(fico)) * F.lit(per_point) + _c(dti) * F.lit(per_dti), low, high)


def loan_amount(income: Column | str, share: float = 0.15, low: float = 1000.0, high: float = 50000.0) -> Column:
    return clip(_c(income) * F.lit(share), low, high)


def monthly_interest(balance: Column | str, annual_rate: Column | str) -> Column:
    return _c(balance) * (_c(annual_rate) / 12)


def daily_interest(balance: Column | str, annual_rate: Column | str, days: Column | str | int = 30) -> Column:
    return _c(balance) * (_c(annual_rate) / 365) * _c(days)


def declining_balance(amount: Column | str, month: Column | str, monthly_share: float = 0.03) -> Column:
    """Balance after ``month`` months when a fixed share is repaid each month."""
    return _c(amount) * F.pow(F.lit(1.0 - monthly_share), _c(month))
