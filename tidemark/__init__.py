"""tidemark: subscription-product analytics as Spark DataFrame operators.

Layout
  sources/    table contracts, readers, fixture bindings, literal relations, sinks
  functions/  column-level helpers (time arithmetic, exact rates, money)
  operators/  staging, funnel, activation, retention, revenue, marts,
              incremental loads, data-quality tests, data jobs
  plans/      the model graph (which operator feeds which) and the reports
  streaming/  Structured Streaming forms of the incremental operators
"""

__version__ = "0.1.0"
