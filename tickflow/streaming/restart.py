"""A stream that is started again on its checkpoint after a failure.

The checkpoint names the batch that was under way, and the sinks make a batch that is run again replace what it had
written, so the tables are those of a run without a failure."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql.streaming import StreamingQuery


def run_with_restarts(
    start: Callable[[int], StreamingQuery], restarts: int = 3, pause: float = 0.0
) -> tuple[StreamingQuery, int]:
    """Runs a query to its end; ``start`` gets the number of the attempt and starts it on one checkpoint.  After
    ``restarts`` failures the last one is raised.  Returns the query that ended and how often it was started again."""
    for attempt in range(restarts + 1):
        query = start(attempt)
        try:
            query.awaitTermination()
            return query, attempt
        except StreamingQueryException:
            if attempt == restarts:
                raise
            time.sleep(pause)
    raise AssertionError("unreachable")
