"""Accounts J1-J3 with D18-D20."""

import pytest

from tickflow.operators.accounts import (
    bulk_delete,
    delete_counts,
    delete_outcome,
    is_admin,
    list_accounts,
    lookup_accounts,
)


@pytest.fixture()
def accounts(spark):
    info = spark.createDataFrame(
        [("0", "admin", "admin"), ("1", "ann", None), ("2", "bob", None), ("3", "cy", "user")],
        "user_id string, username string, role string",
    )
    bal = spark.createDataFrame(
        [("0", "1e9", "1000", "0", "0"), ("1", "1000.5", "1.0", "0.0", "0.0"),
         ("3", "x", "2", None, "0.0")],
        "user_id string, usd string, btc string, reserved_usd string, reserved_btc string",
    )
    return info, bal


def test_listing(accounts):
    info, bal = accounts
    got = {r.user_id: r for r in list_accounts(info, bal).collect()}
    assert set(got) == {"1", "2", "3"}  # id walk starts at 1
    assert got["1"].usd == 1000.5 and got["1"].role == "user"
    assert got["2"].usd == 0.0 and got["2"].btc == 0.0  # balance missing
    assert got["3"].usd == 0.0 and got["3"].btc == 2.0 and got["3"].reserved_usd == 0.0


def test_lookup_drops_only_missing_balance(spark, accounts):
    info, bal = accounts
    req = spark.createDataFrame([("1",), ("2",), ("3",), ("9",), ("0",)], "user_id string")
    got = {r.user_id: r for r in lookup_accounts(info, bal, req).collect()}
    assert set(got) == {"0", "1", "3"}
    assert got["0"].role == "admin" and got["3"].usd == 0.0


def test_bulk_delete(spark, accounts):
    info, bal = accounts
    req = spark.createDataFrame([("0",), ("2",), ("9",), ("2",)], "user_id string")
    out = {r.user_id: r for r in delete_outcome(info, req).collect()}
    assert (out["0"].success, out["0"].failed, out["0"].reason) == (False, 1, "admin_protected")
    assert (out["9"].success, out["9"].failed, out["9"].reason) == (False, 1, "not_found")
    # id 2 requested twice: deleted by the first request, the repeat fails
    assert (out["2"].requests, out["2"].success, out["2"].failed) == (2, True, 1)
    c = delete_counts(delete_outcome(info, req)).first()
    assert (c.success_count, c.fail_count) == (1, 3)
    info2, bal2 = bulk_delete(info, bal, req)
    assert {r.user_id for r in info2.collect()} == {"0", "1", "3"}
    assert {r.user_id for r in bal2.collect()} == {"0", "1", "3"}


def test_admin_flag(accounts):
    info, _ = accounts
    got = {r.user_id: r.a for r in info.select("user_id", is_admin().alias("a")).collect()}
    assert got == {"0": True, "1": False, "2": False, "3": False}


# --- the stored delete --------------------------------------------------------------------------
@pytest.fixture()
def store(spark, tmp_path):
    from tickflow.operators.account_store import AccountStore

    info = spark.createDataFrame([("0", "root", "admin"), ("1", "a", None), ("2", "b", None)], "user_id string, username string, role string")
    money = spark.createDataFrame([(i, "1", "2", "0", "0") for i in ("0", "1", "2")], "user_id string, usd string, btc string, reserved_usd string, reserved_btc string")
    s = AccountStore(spark, str(tmp_path / "accounts"))
    s.replace(info, money)
    return s


def _ids(store):
    info, balance = store.read()
    return [sorted(r.user_id for r in t.collect()) for t in (info, balance)]


def test_stored_delete(spark, store):
    req = spark.createDataFrame([("1",), ("0",), ("9",)], "user_id string")
    outcome = {r.user_id: r.reason for r in store.delete(req).collect()}
    assert outcome == {"1": "deleted", "0": "admin_protected", "9": "not_found"}
    assert _ids(store) == [["0", "2"], ["0", "2"]] and store.current() == 2
    assert [r.user_id for r in store.listing().collect()] == ["2"]
    again = type(store)(spark, store.root)  # another reader
    assert _ids(again) == [["0", "2"], ["0", "2"]]


def test_failure_between_the_two_writes(spark, store):
    from pyspark.sql import functions as F

    info, balance = store.read()
    broken = balance.withColumn("usd", F.raise_error(F.lit("planted failure")).cast("string"))
    with pytest.raises(Exception, match="planted failure"):
        store.replace(info.where("user_id <> '1'"), broken)
    assert store.current() == 1 and _ids(store) == [["0", "1", "2"]] * 2
    store.delete(spark.createDataFrame([("2",)], "user_id string"))
    assert _ids(store) == [["0", "1"]] * 2


def test_no_accounts_yet(spark, tmp_path):
    from tickflow.operators.account_store import AccountStore

    with pytest.raises(FileNotFoundError):
        AccountStore(spark, str(tmp_path / "none")).read()
