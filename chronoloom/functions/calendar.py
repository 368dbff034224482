"""Periodic calendar features of a timestamp."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.spec import PanelSpec


def calendar_columns(time: Column) -> dict[str, Column]:
    """Day, half-day, week and year cycles as sine/cosine pairs.

    Monday is day 0 of the week and January is month 1 of 12.
    """
    hour = F.hour(time)
    cycles = {
        "h": (2, hour, 24),
        "h2": (4, hour, 24),
        "dow": (2, F.weekday(time), 7),
        "mon": (2, F.month(time), 12),
    }
    out: dict[str, Column] = {}
    for name, (turns, part, period) in cycles.items():
        angle = F.lit(turns * math.pi) * part / F.lit(period)
        out[f"{name}_sin"] = F.sin(angle)
        out[f"{name}_cos"] = F.cos(angle)
    return out


def with_calendar(df: DataFrame, spec: PanelSpec) -> DataFrame:
    return df.withColumns(calendar_columns(F.col(spec.time)))
