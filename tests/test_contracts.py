"""Loads that set bad rows aside, types found in text, and the binding's copy of orders."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conftest import SF0001
from tidemark.sources import bindings as B
from tidemark.sources.contracts import infer_contract, split_by_contract

RAW = "invoice_id string, subscription_id string, user_id string, amount string, " \
      "currency string, status string, issued_at string, note string"


def test_rejects_name_row_column_and_reason(spark):
    good = ("1", "s", "u", "12.50", "usd", "paid", "2024-01-05 10:00:00", None)
    df = spark.createDataFrame([
        good, ("2", None, "u", "x", "usd", "paid", "2024-02-30 00:00:00", "n"),
        ("3", "s", None, None, None, None, None, None),
        ("4", "s", "u", "123456789.00", "usd", "paid", "2024-01-05", "n")], RAW)
    ok, bad = split_by_contract(df, "invoices", required=("subscription_id",))
    assert sorted(r.invoice_id for r in ok.collect()) == ["1", "3"]
    assert "note" not in ok.columns
    assert dict(ok.dtypes)["amount"] == "decimal(10,2)"
    got = {(json.loads(r.row)["invoice_id"], r.column_name, r.value, r.reason)
           for r in bad.collect()}
    assert got == {("2", "subscription_id", None, "missing"),
                   ("2", "amount", "x", "not decimal(10,2)"),
                   ("2", "issued_at", "2024-02-30 00:00:00", "not timestamp_ntz"),
                   ("4", "amount", "123456789.00", "not decimal(10,2)")}
    assert all(r.n == 8 for r in bad.select(F.size(F.json_object_keys("row")).alias("n"))
               .collect())
    ok, bad = split_by_contract(df.limit(0), "invoices")
    assert ok.count() == 0 and bad.count() == 0
    with pytest.raises(Exception, match="amount"):
        split_by_contract(df.drop("amount"), "invoices")


def test_inferred_types(spark):
    df = spark.createDataFrame([
        ("1", "1", "1", "1.5", "1e5", "2024-01-05", "2024-01-05 10:00:00", "true", "x", None),
        (None, "2", "30000000000", "20", "-2.25", "2024-02-29", "2024-01-05T10:00:00.5", "FALSE",
         "1", None)],
        "user_id string, i string, l string, m string, d string, day string, t string, "
        "b string, s string, nothing string").withColumn("typed", F.lit(1.5))
    got = {f.name: f.dataType.simpleString() for f in infer_contract(df).fields}
    assert got == {"user_id": "string", "i": "int", "l": "bigint", "m": "decimal(10,2)",
                   "d": "double", "day": "date", "t": "timestamp_ntz", "b": "boolean",
                   "s": "string", "nothing": "string", "typed": "double"}
    assert infer_contract(df.limit(0)).fieldNames() == df.columns
    bad_day = df.withColumn("day", F.lit("2024-02-30"))
    assert infer_contract(bad_day)["day"].dataType == T.StringType()


def test_subscriptions_follow_the_orders(spark, tmp_path):
    orders = spark.read.parquet(f"{SF0001}/orders.parquet")
    target = f"{tmp_path}/orders.parquet"
    orders.write.parquet(target)
    assert B.subscriptions(spark, str(tmp_path)).count() == orders.count()
    spark.catalog.clearCache()
    orders.limit(7).write.mode("append").parquet(target)
    assert B.subscriptions(spark, str(tmp_path)).count() == orders.count() + 7
