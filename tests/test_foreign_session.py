"""The registered queries run on a session the library did not build (as the
driver's): settings are applied at run time, static ones are left alone."""

import subprocess
import sys
import textwrap

ROOT = __file__.rsplit("/tests/", 1)[0]


def test_entry_and_queries_on_plain_session():
    code = textwrap.dedent(f"""
        import sys
        sys.path.insert(0, {ROOT!r})
        from pyspark.sql import SparkSession
        spark = (SparkSession.builder.master("local[2]")
                 .config("spark.sql.shuffle.partitions", "4")
                 .config("spark.ui.enabled", "false").getOrCreate())
        import __spark_entry__ as entry
        assert entry.entry(spark).count() == 5
        q = entry.queries()
        for k in ("dim_users", "mrr_waterfall", "retention_summary", "kpi_dau_wau_mau"):
            q[k](spark, "/root/testdata/sf0.001").collect()
        assert spark.conf.get("spark.sql.session.timeZone") == "UTC"
        print("OK")
    """)
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True,
                         timeout=600)
    assert out.stdout.strip().endswith("OK"), out.stderr[-2000:]
