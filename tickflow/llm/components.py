"""Connected components of a table of links, by label propagation with pointer jumping.

Every round writes its labels to the shared folder: nothing is collected and lineage stays short; the round
before's are removed.  Each
node takes the smallest label among its own and its neighbours'; then every label takes
its own label (the jump), so that a path of n nodes needs about log n rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickflow.llm.common import discard, written


def components(links: DataFrame) -> DataFrame:
    """``links`` has ``a`` and ``b``; the result has every node that occurs, as ``node``, with
    ``label``, the smallest node of its component."""
    both = links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct()
    both = written(both.where("a <> b"), "links")
    labels = written(
        both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
        .select("node", F.least("node", "m").alias("label")),
        "labels",
    )
    last = labels
    while True:
        near = (
            both.join(labels.withColumnRenamed("node", "b"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("label").alias("m"))
        )
        stepped = labels.join(near, "node").select(
            "node", F.col("label").alias("old"), F.least("label", "m").alias("label")
        )
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        new = written(
            stepped.join(jump, "label", "left").select(
                "node", "old", F.least("label", F.coalesce("far", "label")).alias("label")
            ),
            "labels",
        )
        discard(last)
        labels, last = new.select("node", "label"), new
        if new.where("label <> old").isEmpty():
            discard(both)
            return labels
