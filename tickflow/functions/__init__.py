"""Column -> Column helpers.  All are built-in Spark expressions (no Python UDF)."""

from tickflow.functions.numeric import (
    double_or_zero,
    round_by_quote,
    round_fixed,
    to_double,
)
from tickflow.functions.ordering import time_id_key
from tickflow.functions.timecols import (
    INTERVALS,
    bucket_start,
    calendar_columns,
    iso_text,
    ms_text,
    ms_to_ts,
    ts_to_ms,
)
from tickflow.functions.book import level_field, spread, zip_levels

__all__ = [
    "INTERVALS",
    "bucket_start",
    "calendar_columns",
    "double_or_zero",
    "iso_text",
    "level_field",
    "ms_text",
    "ms_to_ts",
    "round_by_quote",
    "round_fixed",
    "spread",
    "time_id_key",
    "to_double",
    "ts_to_ms",
    "zip_levels",
]
