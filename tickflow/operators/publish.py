"""S6 — publish events as JSON ``value`` (no key), as a batch or streaming DataFrame.

The result has the shape a Kafka sink expects (``value`` column, optional ``key``/``topic``) and
is what the decoders read back.  Encoding runs on the executors (``to_json``), never the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def publish_json(df: DataFrame, fields: dict[str, Column], topic: str | None = None) -> DataFrame:
    """One JSON object per row with the given ``{json_key: column}`` entries, in that order.

    NULL fields are left out of the object (``to_json`` default), as a producer that only sends
    the keys it has.
    """
    payload = F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]))
    cols = [payload.cast("binary").alias("value")]
    if topic is not None:
        cols.append(F.lit(topic).alias("topic"))
    return df.select(*cols)
