"""Every registered query against its DuckDB oracle on the smallest tables,
and the published figures of the fixture binding at sf0.01."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import SF0001, SF001
from scripts.check_oracle import TABLES, digest
from tidemark.plans.catalog import ORACLE, QUERIES

KEYS = sorted(QUERIES)            # an optional part brings its own tests


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        p = f"{SF0001}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def test_every_query_has_an_oracle():
    assert set(ORACLE) == set(KEYS)
    assert set(KEYS) <= set(entry.queries())


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, duck, key):
    df = entry.queries()[key](spark, SF0001)
    rows = [tuple(r) for r in df.collect()]
    res = duck.execute(entry.oracle_sql()[key])
    ocols = [d[0] for d in res.description]
    orows = res.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert len(rows) == len(orows)
    assert digest(df.columns, rows)[0] == digest(ocols, orows)[0]


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["region", "total", "board_rate", "invite_rate", "week2_rate",
                          "conversion_rate"]
    assert df.count() == 5


def test_fixture_figures_sf001(spark):
    q = entry.queries()
    stages = {r.max_funnel_stage: r["count"] for r in
              q["funnel_stages"](spark, SF001).groupBy("max_funnel_stage").count().collect()}
    assert stages == {1: 901, 2: 1, 3: 15, 4: 84, 5: 499}
    act = q["activation_score"](spark, SF001)
    assert act.filter("is_activated").count() == 38
    assert act.filter("activation_score = 0").count() == 1350
    assert act.filter("activation_score = 100").count() == 12
    ret = {r.retention_day: r.n for r in q["retention_flags"](spark, SF001)
           .groupBy("retention_day").agg({"is_retained": "sum"})
           .withColumnRenamed("sum(is_retained)", "n").collect()}
    assert [ret[d] for d in (1, 7, 14, 30)] == [150, 125, 90, 0]
    wf = q["mrr_waterfall"](spark, SF001).agg({"new_mrr": "sum", "expansion_mrr": "sum",
                                                "churn_mrr": "sum"}).first()
    assert (wf["sum(new_mrr)"], wf["sum(expansion_mrr)"], wf["sum(churn_mrr)"]) == \
        (15000.0, 91095.0, 57420.0)
    assert q["kpi_current_mrr"](spark, SF001).first().ending_mrr == 48675.0
    delta_end = q["mrr_waterfall_delta"](spark, SF001).orderBy("report_month").collect()[-1]
    assert delta_end.ending_mrr == 15466.0
