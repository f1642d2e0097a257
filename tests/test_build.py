"""Built tables serve the same reports as the registered queries."""

import __spark_entry__ as entry
from conftest import SF0001
from scripts.check_oracle import digest
from tidemark.plans.build import BuildParams, build_models, dashboard
from tidemark.plans.catalog import decimals_to_double
from tidemark.session import scratch_path
from tidemark.sources import bindings as B


def test_build_then_dashboard(spark):
    out = scratch_path(spark, "build_test")
    params = BuildParams(as_of=B.AS_OF, first_month=B.MRR_FIRST_MONTH,
                         last_month=B.MRR_LAST_MONTH)
    models = build_models(spark, B.driver_tables(spark, SF0001), out, params)
    reports = dashboard(models, B.AS_OF)
    q = entry.queries()
    for name, df in reports.items():
        got = decimals_to_double(df)
        want = q[name](spark, SF0001)
        assert sorted(got.columns) == sorted(want.columns), name
        g = [tuple(r) for r in got.collect()]
        w = [tuple(r) for r in want.collect()]
        assert digest(got.columns, g)[0] == digest(want.columns, w)[0], name
    # the data tests over the built tables give the registered suite's result
    from tidemark.plans import suite as SU
    tables = B.driver_tables(spark, SF0001)
    on_tables = {r.test_name: r.violations for r in
                 SU.spark_suite(SU.built_frames(tables, models)).collect()}
    registered = {r.test_name: r.violations for r in q["dq_suite"](spark, SF0001).collect()}
    assert on_tables == registered
    # a second run loads the event fact incrementally (nothing new: unchanged)
    again = build_models(spark, B.driver_tables(spark, SF0001), out, params)
    assert again["fct_user_events"].count() == models["fct_user_events"].count()
