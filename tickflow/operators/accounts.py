"""Accounts: listing (J1), lookup (J2), bulk delete (J3) with the D18-D20 rules.

The key-value store's two hashes per account become two DataFrames keyed by ``user_id``
(``info``: user_id, username, role; ``balance``: user_id, usd, btc, reserved_usd, reserved_btc,
all text).  Requests are DataFrames of ids, so a bulk operation is one join, not a loop of calls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickflow.functions.numeric import double_or_zero

ADMIN_ID = "0"
DEFAULT_ROLE = "user"
BALANCE_FIELDS = ("usd", "btc", "reserved_usd", "reserved_btc")


def is_admin(user_id="user_id", role="role"):
    """The admin is id '0' or any account whose role is 'admin'."""
    uid = F.col(user_id) if isinstance(user_id, str) else user_id
    r = F.col(role) if isinstance(role, str) else role
    return (uid == F.lit(ADMIN_ID)) | F.coalesce(r == F.lit("admin"), F.lit(False))


def _account_columns():
    return [
        "user_id",
        "username",
        F.coalesce(F.col("role"), F.lit(DEFAULT_ROLE)).alias("role"),  # D19
        *[double_or_zero(c).alias(c) for c in BALANCE_FIELDS],  # D18
    ]


def list_accounts(info: DataFrame, balance: DataFrame) -> DataFrame:
    """Every account with ``user_id`` >= 1 (the id walk starts at 1, so the admin seeded as
    id 0 is not listed), left-joined to its balance; a missing or unparsable amount reads 0.0."""
    listed = info.where(F.col("user_id").try_cast("long") >= 1)
    return listed.join(balance, "user_id", "left").select(*_account_columns())


def lookup_accounts(info: DataFrame, balance: DataFrame, requests: DataFrame) -> DataFrame:
    """Accounts for the requested ids (column ``user_id``); an id missing from either hash is
    not found and yields no row."""
    ids = requests.select("user_id").where(F.col("user_id").isNotNull()).distinct()
    return ids.join(info, "user_id").join(balance, "user_id").select(*_account_columns())


def delete_outcome(info: DataFrame, requests: DataFrame) -> DataFrame:
    """J3 outcome, one row per requested id: how often it was requested, whether it was deleted,
    how many of its requests failed, and why.

    The admin id is refused, an unknown id fails, a known id is deleted by its first request and
    any repeat fails (as a loop of single deletes would).  Requests are counted with a partial
    aggregate, so one id requested a million times costs a counter, not a hot partition.
    """
    req = requests.groupBy("user_id").agg(F.count(F.lit(1)).alias("requests"))
    known = info.select("user_id").distinct().withColumn("exists", F.lit(True))
    j = req.join(known, "user_id", "left")
    refused = F.col("user_id") == F.lit(ADMIN_ID)
    found = F.coalesce(F.col("exists"), F.lit(False))
    success = ~refused & found
    return j.select(
        "user_id",
        "requests",
        success.alias("success"),
        (F.col("requests") - success.cast("long")).alias("failed"),
        F.when(refused, F.lit("admin_protected"))
        .when(found, F.lit("deleted"))
        .otherwise(F.lit("not_found"))
        .alias("reason"),
    )


def delete_counts(outcome: DataFrame) -> DataFrame:
    """Success / failure counts of a bulk delete."""
    return outcome.agg(
        F.sum(F.col("success").cast("long")).alias("success_count"),
        F.sum("failed").alias("fail_count"),
    )


def bulk_delete(
    info: DataFrame, balance: DataFrame, requests: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Both hashes of every requested id except the admin are removed (left anti join).
    Returns the surviving ``(info, balance)``."""
    gone = requests.select("user_id").where(F.col("user_id") != F.lit(ADMIN_ID)).distinct()
    return (
        info.join(gone, "user_id", "left_anti"),
        balance.join(gone, "user_id", "left_anti"),
    )
