"""Order-book level helpers on array columns (higher-order functions, no UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: levels shown per side in a book snapshot.
DEFAULT_DEPTH = 10


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def level_field(levels, index: int) -> Column:
    """``[[price, qty], ...]`` (strings) -> array of doubles taken at ``index`` of each level.

    ``get`` returns NULL for a short level where ``x[i]`` would raise under ANSI, and ``try_cast``
    turns unparsable text into NULL.
    """
    return F.transform(_col(levels), lambda x: F.get(x, index).try_cast("double"))


def zip_levels(prices, quantities, depth: int | None = None) -> Column:
    """Pair prices with quantities as ``array<struct<price, quantity>>``.

    The shorter array wins (Python ``zip`` semantics; ``arrays_zip`` would pad with NULL), then
    the first ``depth`` levels are kept in arrival order.  NULL arrays count as empty.
    """
    p = F.coalesce(_col(prices), F.array().cast("array<double>"))
    q = F.coalesce(_col(quantities), F.array().cast("array<double>"))
    n = F.least(F.size(p), F.size(q))
    if depth is not None:
        n = F.least(n, F.lit(depth))
    return F.zip_with(
        F.slice(p, 1, n),
        F.slice(q, 1, n),
        lambda a, b: F.struct(a.alias("price"), b.alias("quantity")),
    )


def spread(bids, asks) -> Column:
    """Best ask price minus best bid price; 0.0 when either side is empty."""
    b, a = _col(bids), _col(asks)
    both = (F.size(b) > 0) & (F.size(a) > 0)
    return F.when(both, F.get(a, 0)["price"] - F.get(b, 0)["price"]).otherwise(F.lit(0.0))
