"""F1 to F4 with a side output: the messages that a decoder drops, each with its reason.

A message is parsed once, with the column in which ``from_json`` keeps a text that doesn't fit the schema.
What the decoders keep has no reason; together the two are the feed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickflow import schemas as S
from tickflow.functions.numeric import to_double

NO_VALUE, BLANK, MALFORMED = "no value", "blank value", "malformed JSON"
_CORRUPT = "_corrupt"


def _positive(name: str) -> Column:
    return to_double(F.col(name)) > 0


def _filled(name: str) -> Column:
    return F.coalesce(F.size(name), F.lit(0)) > 0


def _rules(feed: str) -> dict[str, Column]:
    """What a row must satisfy, by the name that a reason gives it."""
    if feed == "trades":
        return {"price": _positive("price"), "quantity": _positive("quantity")}
    symbol = {"symbol": F.col("symbol").isNotNull()}
    if feed == "tickers":
        return symbol | {
            "open": _positive("open"),
            "close": _positive("close"),
            "volume": to_double(F.col("volume")) >= 0,
            "high below low": to_double(F.col("high")) >= to_double(F.col("low")),
        }
    return symbol | {"no level": _filled("bids") | _filled("asks")}


_WIRES = {
    "trades": (S.TRADE_WIRE, S.TRADE_USED),
    "tickers": (S.TICKER_WIRE, S.TICKER_USED),
    "orderbook": (S.BOOK_WIRE, S.BOOK_USED),
}


def bad_messages(raw: DataFrame, feed: str, value_col: str = "value") -> DataFrame:
    """``message`` (text) and ``reason`` of every message that the feed's decoder gives no row for: no value, a blank one,
    malformed JSON, or the rules that it breaks."""
    wire, used = _WIRES[feed]
    text = F.col(value_col).cast("string")
    read = T.StructType([*S.wire_struct(wire, used).fields, T.StructField(_CORRUPT, T.StringType())])
    names = T.StructType([*S.internal_struct(wire, used).fields, T.StructField(_CORRUPT, T.StringType())])
    parsed = F.from_json(text, read, {"columnNameOfCorruptRecord": _CORRUPT}).cast(names)
    # inline: filters and rules don't reach below it, so the message is parsed once (see decode)
    one = raw.select(F.inline(F.array(F.struct(text.alias("message"), parsed.alias("parsed")))))
    flat = one.select("message", "parsed.*")
    rules = _rules(feed)
    broken = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]
    reason = F.concat_ws(", ", *broken)
    kind = (
        F.when(reason == "", F.lit(""))
        .when(F.col("message").isNull(), F.lit(NO_VALUE))
        .when(F.col("message").rlike(r"^\s*$"), F.lit(BLANK))
        .when(F.col(_CORRUPT).isNotNull(), F.lit(MALFORMED))
        .otherwise(reason)
    )
    return flat.select("message", kind.alias("reason")).where(F.col("reason") != "")
