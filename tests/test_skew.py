"""A user owning a third of all events: the broadcast path and the
shuffle path (adaptive skew split) give the same rows, and the shuffle path
really splits the hot partition."""

from pyspark.sql import functions as F

from conftest import SF001
from tidemark.operators.engagement import event_rollup
from tidemark.operators.retention import window_flags
from tidemark.sources import bindings as B

SHUFFLE_PATH = {
    "spark.tidemark.broadcastMaxRows": "0",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16KB",
}


def _hot_events(spark):
    ev = B.user_events(spark, SF001)
    # several map tasks, as a large table would have; a third of rows to user 7
    return ev.repartition(16).withColumn(
        "user_id", F.when(F.col("event_id") % 3 == 0, F.lit(7)).otherwise(F.col("user_id")))


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_hot_user_same_result_and_split(spark):
    users = B.users(spark, SF001)
    broadcast_rows = _rows(event_rollup(users, _hot_events(spark)))
    flags_broadcast = _rows(window_flags(users, _hot_events(spark)))
    old = {k: spark.conf.get(k, None) for k in SHUFFLE_PATH}
    try:
        for k, v in SHUFFLE_PATH.items():
            spark.conf.set(k, v)
        df = event_rollup(users, _hot_events(spark))
        shuffle_rows = _rows(df)
        plan = df._jdf.queryExecution().executedPlan().toString()
        flags_shuffle = _rows(window_flags(users, _hot_events(spark)))
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    assert shuffle_rows == broadcast_rows
    assert flags_shuffle == flags_broadcast
    assert "SortMergeJoin(skew=true)" in plan
    hot = [r for r in shuffle_rows if r[0] == 7][0]
    assert hot[7] > 1000          # total_events_week1 of the hot user
