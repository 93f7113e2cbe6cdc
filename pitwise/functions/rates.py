"""Rates, prices and stakes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def laplace(wins: Column, n: Column, strength: float = 3.0) -> Column:
    """Win rate smoothed towards one half: half of ``strength`` is added to the wins, all of it to the count."""
    return (F.coalesce(wins, F.lit(0)) + strength / 2) / (F.coalesce(n, F.lit(0)) + strength)


def safe_ratio(num: Column, den: Column) -> Column:
    """num / den where den is positive, else null."""
    return F.when(den > 0, num / den)


def devig(odds: Column, other: Column) -> Column:
    """Probability of the first side when both decimal prices are scaled to sum to one."""
    return (1 / odds) / (1 / odds + 1 / other)


def kelly(p: Column, odds: Column) -> Column:
    """Full Kelly fraction at decimal odds, 0 where there is no edge."""
    b = odds - 1
    return F.when((p > 0) & (p <= 1) & (odds > 1), F.greatest(F.lit(0.0), (b * p - (1 - p)) / b)).otherwise(0.0)


def kelly_of_edge(p: Column, odds: Column, k: float = 1.0) -> Column:
    """``k`` times the raw edge over net odds: full Kelly divided by the odds."""
    return F.greatest(F.lit(0.0), k * (p - 1 / odds) / (odds - 1))


def kelly_scaled_edge(p: Column, odds: Column, k: float = 1.0) -> Column:
    """``k`` times edge times odds over net odds, which equals full Kelly at ``k`` = 1."""
    return F.greatest(F.lit(0.0), k * (p - 1 / odds) * odds / (odds - 1))


def american_to_decimal(text: Column) -> Column:
    """Decimal price of an American one: EVEN and PK are 2.0, zero and bad text are null."""
    word = F.upper(F.trim(text))
    value = F.when(word.rlike(r"^[+-]?[0-9]{1,6}$"), F.regexp_replace(word, r"^\+", "").try_cast("double"))
    return F.when(word.isin("EVEN", "PK"), 2.0).when(value > 0, 1 + value / 100).when(value < 0, 1 + 100 / -value)


def american_implied(value: Column) -> Column:
    """Implied probability of an American price."""
    return F.when(value > 0, 100 / (value + 100)).when(value < 0, -value / (-value + 100))


def clip(p: Column, eps: float = 1e-15) -> Column:
    return F.greatest(F.lit(eps), F.least(F.lit(1 - eps), p))


def logit(p: Column, eps: float = 1e-6) -> Column:
    q = clip(p, eps)
    return F.ln(q / (1 - q))


def probability(value: Column) -> Column:
    """A finite number in [0, 1], else null."""
    number = value.try_cast("double")
    return F.when(~F.isnan(number) & number.between(0, 1), number)


def decimal_odds(value: Column) -> Column:
    """A finite price above 1, else null."""
    number = value.try_cast("double")
    return F.when(~F.isnan(number) & (number > 1) & (number < float("inf")), number)
