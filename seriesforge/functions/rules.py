"""Scalar rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _bands(x: Column, bands: list[tuple[float, float, str]], other: str) -> Column:
    out = F.lit(other)
    for lo, hi, name in reversed(bands):
        out = F.when(x.between(lo, hi), name).otherwise(out)
    return out


def period_category(period: Column) -> Column:
    """Trading-day bands, ends included. Fixed values."""
    return _bands(period, [(3, 7, "weekly"), (20, 31, "monthly"), (60, 95, "quarterly"), (240, 270, "annual"), (480, 1500, "election_cycle")], "other")


def sampled_period_category(period: Column, sampling: str) -> Column:
    """The bands for a series sampled daily, weekly (5 days) or monthly (21 days)."""
    return period_category(period * {"daily": 1, "weekly": 5, "monthly": 21}[sampling])


def wavelet_period_category(period: Column) -> Column:
    return _bands(period, [(3, 7, "weekly"), (20, 31, "monthly"), (60, 95, "quarterly"), (240, 270, "annual")], "other")


def quick_period_category(period: Column) -> Column:
    return _bands(period, [(5, 9, "Weekly"), (18, 31, "Monthly"), (55, 70, "Quarterly")], "Other")


def regime_name(mean_return: Column, volatility: Column) -> Column:
    """Ordered rules: a calm rise, a rough fall, rough, else calm. Fixed values."""
    return F.when((mean_return > 0.001) & (volatility < 0.025), "Bull Market").when((mean_return < -0.001) & (volatility > 0.01), "Bear Market").when(volatility > 0.025, "High Volatility").otherwise("Low Volatility")


def correlation_text(r: Column, p: Column, lag: Column, alpha: float = 0.05) -> Column:
    strength = F.when(F.abs(r) > 0.7, "Strong").when(F.abs(r) > 0.4, "Moderate").otherwise("Weak")
    sign = F.when(r > 0, "positive").otherwise("negative")
    when = F.when(lag == 0, "synchronized").when(lag > 0, F.concat(F.lit("first leads by "), lag.cast("string"), F.lit(" days"))).otherwise(F.concat(F.lit("second leads by "), F.abs(lag).cast("string"), F.lit(" days")))
    return F.when(p > alpha, "No significant correlation").otherwise(F.concat_ws(" ", strength, sign, F.lit("correlation,"), when))


def cycle_confidence(strength: Column, period: Column, n: Column) -> Column:
    """Half strength, three tenths for cycles seen (three are enough), a fifth for a plausible period. Fixed values."""
    plausible = F.when(period < 3, 0.3).when(period > n / 2, 0.5).otherwise(1.0)
    return 0.5 * F.least(strength, F.lit(1.0)) + 0.3 * F.least(n / period / 3, F.lit(1.0)) + 0.2 * plausible


def expected_duration(p_stay: Column) -> Column:
    return F.when(p_stay >= 1, F.lit(float("inf"))).otherwise(1 / F.nullif(1 - p_stay, F.lit(0.0)))


def mid_amount(lo: Column, hi: Column) -> Column:
    return (lo + hi) / 2


def match_similarity(distance: Column) -> Column:
    return 1 / (1 + distance / 2)


def match_confidence(similarity: Column, distance: Column, window: int) -> Column:
    return 0.5 * similarity + 0.3 / (1 + distance) + 0.2 * min(window / 60, 1.0)


def anomaly_score(agreement: Column, match: Column, ratio: Column) -> Column:
    """Votes for what is unusual; 1 at most. Fixed values."""
    parts = [F.when(agreement < 0.5, 0.3), F.when(match < 0.6, 0.3), F.when((ratio > 3) | (ratio < 0.33), 0.4)]
    return F.least(sum((F.coalesce(p.otherwise(0.0), F.lit(0.0)) for p in parts), F.lit(0.0)), F.lit(1.0))


def prediction_type(value: Column, duration: Column, recent: Column, usual: Column) -> Column:
    return F.when(value > 2, "trade_increase").when(value < -2, "trade_decrease").when(duration < 7, "regime_change").when(recent > 1.5 * usual, "cycle_peak").otherwise("anomaly")


def last_name(name: Column) -> Column:
    return F.element_at(F.split(F.trim(name), r"\s+"), -1)


def title(name: Column) -> Column:
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))
