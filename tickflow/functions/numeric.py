"""Numeric helpers: text -> double, defaults and the two rounding rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Quote assets whose prices are shown with 8 decimals; all others get 2.
FINE_QUOTES = ("BTC", "ETH")
FINE_SCALE = 8
COARSE_SCALE = 2


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_double(c) -> Column:
    """Text -> double; unparsable text gives NULL instead of an error (ANSI is on by default)."""
    return _col(c).try_cast("double")


def double_or_zero(c) -> Column:
    """Missing or unparsable -> 0.0 (account balances)."""
    return F.coalesce(to_double(c), F.lit(0.0))


def round_fixed(c, scale: int = COARSE_SCALE) -> Column:
    """Round half-up to a fixed number of decimals."""
    return F.round(_col(c), scale)


def round_by_quote(c, symbol) -> Column:
    """8 decimals when the symbol's quote asset is BTC or ETH, else 2."""
    sym = _col(symbol)
    fine = F.lit(False)
    for q in FINE_QUOTES:
        fine = fine | sym.endswith(q)
    return F.when(fine, F.round(_col(c), FINE_SCALE)).otherwise(F.round(_col(c), COARSE_SCALE))
