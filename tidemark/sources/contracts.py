"""Table contracts: the column names and types each raw input must have.

Ids are strings in the contracts (the source systems' text keys); operators
never assume a key type, so frames with integer ids work unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

S, TS, D = T.StringType(), T.TimestampNTZType(), T.DateType()
MONEY = T.DecimalType(10, 2)
INT = T.IntegerType()


def _schema(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


CONTRACTS: dict[str, T.StructType] = {
    "users": _schema(("user_id", S), ("email", S), ("full_name", S), ("region", S),
                     ("signup_source", S), ("signed_up_at", TS), ("initial_plan", S)),
    "user_events": _schema(("event_id", S), ("user_id", S), ("event_type", S),
                           ("event_timestamp", TS), ("event_properties", S)),
    "feature_usage": _schema(("usage_id", S), ("user_id", S), ("feature_name", S),
                             ("used_at", TS), ("duration_seconds", INT)),
    "subscriptions": _schema(("subscription_id", S), ("user_id", S), ("plan", S),
                             ("mrr", MONEY), ("started_at", TS), ("ended_at", TS),
                             ("change_type", S)),
    "invoices": _schema(("invoice_id", S), ("subscription_id", S), ("user_id", S),
                        ("amount", MONEY), ("currency", S), ("status", S), ("issued_at", TS)),
    "conversations": _schema(("conversation_id", S), ("user_id", S), ("topic", S),
                             ("status", S), ("created_at", TS), ("resolved_at", TS),
                             ("messages_count", INT), ("first_response_minutes", INT)),
    "retention_flags": _schema(("user_id", S), ("cohort_week", D), ("region", S),
                               ("signup_source", S), ("plan_at_latest", S),
                               ("retention_day", INT), ("is_retained", INT)),
}


def _fits(column, to: T.DataType):
    """The value as ``to``, null if it does not fit."""
    return F.col(column).try_cast(to)


def split_by_contract(df: DataFrame, contract: T.StructType | str,
                      required: tuple[str, ...] = (),
                      keep_key_types: bool = False) -> tuple[DataFrame, DataFrame]:
    """Load what fits and set the rest aside: (accepted, rejected).

    ``accepted`` has the contract's columns and every row all of whose values
    fit their types and whose ``required`` columns are not null.  ``rejected``
    has one row per fault: ``row`` (the raw row as JSON), ``column_name``,
    ``value`` (as text) and ``reason`` (``missing`` or ``not <type>``).  A row
    with two faults is two rejects and no accepted row.  Both are projections of
    one scan; columns the contract does not name are only kept in ``row``.
    A missing column fails analysis, as it does in ``cast_to_contract``."""
    schema = CONTRACTS[contract] if isinstance(contract, str) else contract
    have = {f.name: f.dataType for f in df.schema.fields}
    cast, faults = [], []
    for f in schema.fields:
        raw = F.col(f.name)
        keep = keep_key_types and f.name.endswith("_id") and f.name in have
        value = raw if keep else _fits(f.name, f.dataType)
        cast.append(value.alias(f.name))
        reason = F.when(raw.isNotNull() & value.isNull(),
                        F.lit(f"not {f.dataType.simpleString()}"))
        if f.name in required:
            reason = F.coalesce(reason, F.when(raw.isNull(), F.lit("missing")))
        faults.append(F.struct(F.lit(f.name).alias("column_name"),
                               raw.cast("string").alias("value"), reason.alias("reason")))
    found = F.filter(F.array(*faults), lambda x: x["reason"].isNotNull())
    accepted = df.where(F.size(found) == 0).select(*cast)
    raw_row = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]),
                        {"ignoreNullFields": "false"})
    rejected = (df.select(raw_row.alias("row"), found.alias("f")).where(F.size("f") > 0)
                .select("row", F.explode("f").alias("x")).select("row", "x.*"))
    return accepted, rejected


# Types a text column may turn out to have, the narrowest first.
INFERRED = (T.BooleanType(), INT, T.LongType(), MONEY, T.DoubleType(), D, TS)
_SHAPE = {T.BooleanType(): r"(?i)true|false", INT: r"[+-]?\d+", T.LongType(): r"[+-]?\d+",
          MONEY: r"[+-]?\d{1,8}(\.\d{1,2})?", T.DoubleType(): r"[+-]?\d*\.?\d+(e[+-]?\d+)?",
          D: r"\d{4}-\d\d-\d\d", TS: r"\d{4}-\d\d-\d\d[ T]\d\d:\d\d(:\d\d(\.\d+)?)?"}


def infer_contract(df: DataFrame) -> T.StructType:
    """Types of text columns by their values, over the whole table in one pass:
    the narrowest of boolean, int, bigint, decimal(10,2), double, date and
    timestamp that every value has, else text.  Columns named ``*_id`` and
    columns without any value stay text; columns that are not text keep their
    type."""
    text = [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.StringType) and not f.name.endswith("_id")]
    checks = []
    for n, c in enumerate(text):
        value = F.trim(F.col(f"`{c}`"))
        checks.append(F.count(value).alias(f"n{n}"))
        for k, t in enumerate(INFERRED):
            fits = value.rlike(f"^(?:{_SHAPE[t]})$") & value.try_cast(t).isNotNull()
            checks.append(F.bool_and(fits).alias(f"t{n}_{k}"))
    seen = df.agg(F.lit(1).alias("one"), *checks).first()        # one row
    types = {}
    for n, c in enumerate(text):
        fit = [t for k, t in enumerate(INFERRED) if seen[f"n{n}"] and seen[f"t{n}_{k}"]]
        types[c] = fit[0] if fit else S
    return T.StructType([T.StructField(f.name, types.get(f.name, f.dataType), True)
                         for f in df.schema.fields])


def cast_to_contract(df: DataFrame, contract: T.StructType | str,
                     keep_key_types: bool = False) -> DataFrame:
    """Project ``df`` onto a contract, casting every column to its type.

    Casts run under ANSI semantics, so a value that does not fit (text in a
    number column, a malformed timestamp) fails the job instead of turning
    into NULL.  Missing columns fail analysis.  With ``keep_key_types`` the
    ``*_id`` columns keep their incoming type."""
    schema = CONTRACTS[contract] if isinstance(contract, str) else contract
    have = {f.name: f.dataType for f in df.schema.fields}
    cols = []
    for f in schema.fields:
        if keep_key_types and f.name.endswith("_id") and f.name in have:
            cols.append(F.col(f.name))
        else:
            cols.append(F.col(f.name).cast(f.dataType).alias(f.name))
    return df.select(*cols)
