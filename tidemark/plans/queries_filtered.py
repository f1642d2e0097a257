"""Registered queries: the reports under a region and source selection, and
under the fallbacks of an empty selection (``reports.Filters``).

The oracle of a filtered report is that of the whole report with the mart it
reads narrowed to the chosen rows.
"""

from __future__ import annotations

from tidemark.plans import queries_core as C
from tidemark.plans import queries_revenue as V
from tidemark.plans import reports as R
from tidemark.plans.catalog import ORACLE, register
from tidemark.sources.bindings import FALLBACK_SOURCE, REGION_NAMES

# Fixed values of the registered runs, in the names of the binding.
CHOSEN = R.Filters(("ASIA", "EUROPE"), ("BUILDING", "MACHINERY"))
EMPTY = R.Filters((), (), known_regions=REGION_NAMES, fallback_source=FALLBACK_SOURCE)

# report -> (mart builder, mart in the oracle, region filter, source filter)
REPORTS = {
    "kpi_total_users": (C.dim_users, "o_dim_users", True, True),
    "kpi_activation_rate": (C.snapshot, "o_snapshot", True, True),
    "weekly_signups": (C.dim_users, "o_dim_users", True, True),
    "activation_by_source": (C.dim_users, "o_dim_users", True, False),
    "funnel_counts": (C.snapshot, "o_snapshot", True, True),
    "funnel_by_region": (C.snapshot, "o_snapshot", False, True),
    "conversion_by_activation": (C.snapshot, "o_snapshot", True, True),
    "retention_by_cohort": (V.flags, "o_retention", True, True),
    "retention_by_region": (V.flags, "o_retention", True, True),
    "retention_by_source": (V.flags, "o_retention", True, True),
    "retention_summary": (V.flags, "o_retention", True, True),
}


def _values(names) -> str:
    return ", ".join(f"'{n}'" for n in names)


def _oracle(report: str, mart: str, f: R.Filters, regions: bool, sources: bool) -> str:
    kept = [f"region IN ({_values(f.region_values())})"] * regions \
        + [f"signup_source IN ({_values(f.source_values())})"] * sources
    return ORACLE[report].replace(
        f"FROM {mart}", f"FROM (SELECT * FROM {mart} WHERE {' AND '.join(kept)}) kept")


def _register(report: str, suffix: str, f: R.Filters) -> None:
    mart, name, regions, sources = REPORTS[report]

    def run(s, d):
        return getattr(R, report)(mart(s, d), f)

    run.__doc__ = f"Report {report}, {suffix}."
    register(f"{report}_{suffix}", _oracle(report, name, f, regions, sources))(run)


for _report in REPORTS:
    _register(_report, "filtered", CHOSEN)
for _report in ("kpi_total_users", "funnel_counts", "retention_summary"):
    _register(_report, "fallback", EMPTY)
