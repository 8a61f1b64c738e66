"""Account tables that a delete changes for good.

Both tables of a version are written into a folder of their own, and then one pointer file makes the
version the current one.  Readers follow the newest pointer, so they see both tables before a delete or both after
it; a failure between the two writes leaves the old version current."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickflow import schemas as S
from tickflow.operators.accounts import bulk_delete, delete_outcome, list_accounts
from tickflow.sources.files import Folder

_TABLES = (("info", S.ACCOUNT_INFO), ("balance", S.ACCOUNT_BALANCE))


class AccountStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self.folder = Folder(spark, root)

    def current(self) -> int | None:
        """The number of the current version."""
        names = [n for n in self.folder.names("current/*") if n.isdigit()]
        return max(map(int, names), default=None)

    def read(self) -> tuple[DataFrame, DataFrame]:
        version = self.current()
        if version is None:
            raise FileNotFoundError(f"no accounts in {self.root}")
        at = self.folder.read(f"current/{version:09d}").strip()
        info, balance = [self.spark.read.schema(s).parquet(f"{self.root}/{at}/{name}") for name, s in _TABLES]
        return info, balance

    def replace(self, info: DataFrame, balance: DataFrame) -> int:
        """Writes both tables as the next version and makes it the current one; of two writers of one version the
        second fails."""
        version = (self.current() or 0) + 1
        begun = sum(n.startswith(f"{version:09d}-") for n in self.folder.names("versions/*"))
        at = f"versions/{version:09d}-{begun}"  # a version that failed half-way keeps its folder to itself
        for df, (name, schema) in zip((info, balance), _TABLES, strict=True):
            columns = [df[f.name].cast(f.dataType).alias(f.name) for f in schema.fields]
            df.select(*columns).write.parquet(f"{self.root}/{at}/{name}")
        self.folder.publish(f"current/{version:09d}", at)
        return version

    def delete(self, requests: DataFrame) -> DataFrame:
        """Deletes the requested accounts (``user_id``) from both tables; the outcome of every request."""
        info, balance = self.read()
        self.replace(*bulk_delete(info, balance, requests))
        return delete_outcome(info, requests)

    def listing(self) -> DataFrame:
        return list_accounts(*self.read())
