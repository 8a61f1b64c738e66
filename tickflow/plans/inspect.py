"""Plan inspection for tests and tuning (the text of ``explain``)."""

from __future__ import annotations

import contextlib
import io

from pyspark.sql import DataFrame


def plan_text(df: DataFrame, mode: str = "formatted") -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode=mode)
    return buf.getvalue()


def assert_plan(df: DataFrame, contains=(), absent=(), mode: str = "formatted") -> str:
    text = plan_text(df, mode)
    for s in contains:
        assert s in text, f"expected {s!r} in plan:\n{text}"
    for s in absent:
        assert s not in text, f"unexpected {s!r} in plan:\n{text}"
    return text
