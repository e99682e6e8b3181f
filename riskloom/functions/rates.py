"""Guarded ratios: every rate is 0 when its denominator is 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def percent(part: Column, whole: Column) -> Column:
    """Share in per cent, rounded to two places."""
    return F.when(whole > 0, F.round(part / whole * 100, 2)).otherwise(F.lit(0.0))


def f_score(precision: Column, recall: Column) -> Column:
    return F.when(
        precision + recall > 0, F.lit(2.0) * precision * recall / (precision + recall)
    ).otherwise(F.lit(0.0))


def duration_text(seconds: Column) -> Column:
    """``3h 5m 9s``, ``5m 9s`` or ``9s``: leading zero units are left out."""
    hours = F.floor(seconds / 3600)
    minutes = F.floor(seconds % 3600 / 60)
    secs = F.floor(seconds % 60)
    h = F.concat(hours.cast("string"), F.lit("h"))
    m = F.concat(minutes.cast("string"), F.lit("m"))
    s = F.concat(secs.cast("string"), F.lit("s"))
    return (
        F.when(hours > 0, F.concat_ws(" ", h, m, s))
        .when(minutes > 0, F.concat_ws(" ", m, s))
        .otherwise(s)
    )
