"""The corpus pipeline: five stages over ``documents``, each on all that the one before it kept.

Every stage is a function (spark, docs, sf_dir) -> DataFrame whose result is written as Parquet and read
again as the next one's ``docs``.  All but the last return the columns of ``documents``.

Defined cases are those of the operators; an empty table passes through every stage.  Rows that share an id, or have
none, are told apart by their texts: what one of them loses, another of a different text keeps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickflow.llm import (
    op3_bpe,
    op5_minhash,
    op6_language,
    op9_templates,
    op10_contamination,
)
from tickflow.llm.common import keep_if, table, written

#: A document is rejected if no language is found in it, or if it is nearer to the largest distance
#: from every language's profile than this.
MIN_SCORE = 0.2


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language is identified."""
    profiles = op6_language.learn(docs)
    return op6_language.identified(docs, profiles, MIN_SCORE)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops recurring lines from the texts; a document of nothing else is left whole for the next stage."""
    dropped = op9_templates.recurring(docs, few_docs=op9_templates.FEW_DOCS)
    cut = op9_templates.drop_lines(docs, dropped, empty=False)
    return cut.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates."""
    gone = op5_minhash.near_duplicates(docs, origins=True).where(~F.col("kept"))
    return keep_if(docs, gone.select("doc_id", "origin"), "left_anti")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that contain no benchmark item."""
    found = op10_contamination.contaminated(docs, table(spark, sf_dir, "benchmark"), origins=True)
    found = written(found.select("doc_id", "origin").distinct(), "contaminated")
    return keep_if(docs, found, "left_anti")


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes every text and decodes it again; counts and digests of both."""
    return op3_bpe.digests(op3_bpe.round_trip(docs))


STAGES = [
    ("language ID", language),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("byte-level BPE encoding and decoding", tokenize),
]

#: Rank-order profiles, templates and BPE are not expressible in SQL; the tests hold run() against
#: a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
