"""Bands, JSON payload text, signatures and model labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Upper bounds of the first two PM2.5 bands, and band names.
LOW_MAX = 12.0
MODERATE_MAX = 35.4
BANDS = ("Low", "Moderate", "High")

# Labels a stored setting may hold, and the one used otherwise.
MODEL_LABELS = ("LSTM", "XGBoost")
RETIRED_LABEL = "ARIMA"
DEFAULT_LABEL = "LSTM"


def safety_band(value: Column, unknown_is_high: bool = True) -> Column:
    """Band of a PM2.5 value; a missing value is High unless told otherwise."""
    missing = value.isNull() | F.isnan(value)
    low, moderate, high = (F.lit(b) for b in BANDS)
    return (
        F.when(missing, high if unknown_is_high else F.lit(None).cast("string"))
        .when(value <= LOW_MAX, low)
        .when(value <= MODERATE_MAX, moderate)
        .otherwise(high)
    )


def with_safety_band(df: DataFrame, column: str = "pm2_5_pred") -> DataFrame:
    return df.withColumn("pm25_safety_level", safety_band(F.col(column).cast("double")))


def readable_json(text: Column) -> Column:
    """Valid JSON text unchanged; anything else wrapped as ``{"raw": text}``."""
    return F.when(text.isNull(), F.lit(None).cast("string")).when(
        F.try_parse_json(text).isNotNull(), text
    ).otherwise(F.to_json(F.struct(text.alias("raw"))))


def content_signature(name: Column, content: Column) -> Column:
    """``name:length:hash`` of an upload; equal content gives the same text on every run."""
    return F.concat_ws(":", name, F.octet_length(content).cast("string"), F.md5(content))


def model_label(label: Column) -> Column:
    """A known label unchanged; old, unknown or missing ones become the default."""
    trimmed = F.trim(label)
    return F.when(trimmed.isin(*MODEL_LABELS), trimmed).otherwise(F.lit(DEFAULT_LABEL))


def stored_label(label: Column) -> Column:
    """A label as read back: the retired one and a missing one become the default."""
    trimmed = F.coalesce(F.nullif(F.trim(label), F.lit("")), F.lit(DEFAULT_LABEL))
    return F.when(trimmed == RETIRED_LABEL, F.lit(DEFAULT_LABEL)).otherwise(trimmed)
