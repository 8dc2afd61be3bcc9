"""paylens — payment-incident analytics as composable Spark DataFrame functions.

Every public function takes DataFrames (plus plain parameters) and returns a
lazy DataFrame; nothing is collected inside the library.  The building
blocks:

* ``paylens.sources``   — fixture adapter (driver tables → silver tables),
  table readers, typed ingest of text records, co-bucketed tables,
  day-partitioned sinks.
* ``paylens.functions`` — column-expression helpers (bucketing, tie-safe
  rounding, exact money and variance arithmetic).
* ``paylens.operators`` — KPI cube, anomaly detection, window restriction,
  drill-downs, impact, root-cause attribution / ranking, top-k numbering,
  evidence text and alert payloads.
* ``paylens.plans``     — composed plans (the day's incident analysis, full
  and incremental gold refresh), the query registry used by
  ``__spark_entry__`` and the DuckDB oracle SQL.
* ``paylens.streaming`` — Structured Streaming KPI cube and continuous gold
  maintenance.
"""

from paylens.config import AS_OF, BUCKET_MINUTES, DIMS, Z_THRESHOLD, AVG_PURCHASE_VALUE  # noqa: F401

__version__ = "0.1.0"
