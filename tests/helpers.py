import datetime as dt

from pyspark.sql import types as T

TS = T.TimestampNTZType()


def ts(s: str) -> dt.datetime:
    return dt.datetime.fromisoformat(s)


USERS = T.StructType([T.StructField(n, t) for n, t in [
    ("user_id", T.StringType()), ("email", T.StringType()), ("full_name", T.StringType()),
    ("region", T.StringType()), ("signup_source", T.StringType()), ("signed_up_at", TS),
    ("initial_plan", T.StringType())]])
EVENTS = T.StructType([T.StructField(n, t) for n, t in [
    ("event_id", T.StringType()), ("user_id", T.StringType()), ("event_type", T.StringType()),
    ("event_timestamp", TS), ("event_properties", T.StringType())]])
SUBS = T.StructType([T.StructField(n, t) for n, t in [
    ("subscription_id", T.StringType()), ("user_id", T.StringType()), ("plan", T.StringType()),
    ("mrr", T.DecimalType(10, 2)), ("started_at", TS), ("ended_at", TS),
    ("change_type", T.StringType())]])


def users_df(spark, rows):
    """rows: (user_id, signed_up_at[, region, source])"""
    full = []
    for r in rows:
        uid, signup = r[0], r[1]
        region = r[2] if len(r) > 2 else "US"
        source = r[3] if len(r) > 3 else "organic"
        full.append((uid, f"{uid}@x.io", uid.upper(), region, source, ts(signup), "free"))
    return spark.createDataFrame(full, USERS)


def events_df(spark, rows):
    """rows: (event_id, user_id, type, timestamp)"""
    return spark.createDataFrame([(e, u, t, ts(x), "{}") for e, u, t, x in rows], EVENTS)


def subs_df(spark, rows):
    """rows: (id, user, plan, mrr, started, ended, change_type)"""
    from decimal import Decimal
    return spark.createDataFrame(
        [(i, u, p, Decimal(str(m)) if m is not None else None, ts(s) if s else None,
          ts(e) if e else None, c) for i, u, p, m, s, e, c in rows], SUBS)


def by_key(df, key="user_id"):
    return {r[key]: r.asDict() for r in df.collect()}
