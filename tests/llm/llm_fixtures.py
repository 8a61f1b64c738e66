import os

import pytest

SF = "/root/testdata/sf0.001"
LONG = "lang " * 30_000 + "x" * 5000


@pytest.fixture(scope="session")
def tables(spark, tmp_path_factory):
    """Writes a folder of tables; those not given are empty."""
    schemas = {
        "documents": "doc_id long, text string, lang string, source string, n_chars long",
        "pages": "page_id long, url string, html string",
        "benchmark": "item_id long, text string",
        "conversations": "conv_id long, turn long, role string, text string",
    }

    def make(extra=False, **rows):
        path = str(tmp_path_factory.mktemp("tables"))
        for name, ddl in schemas.items():
            df = spark.createDataFrame(rows.get(name, []), ddl)
            if extra:  # columns named like the operators' own
                from pyspark.sql import functions as F

                for c in ("node", "key", "_id", "rank", "start", "part", "file", "digest", "label"):
                    df = df.withColumn(c, F.lit("clash"))
            df.write.parquet(os.path.join(path, f"{name}.parquet"))
        return path

    return make


@pytest.fixture(scope="session")
def small(spark):
    """The documents of the smallest scale as Python rows."""
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").toLocalIterator()]
