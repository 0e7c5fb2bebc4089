"""fleetcheck: database-fleet health analytics as Spark DataFrame operators.

Layout:
  functions/  column expressions (pure ``Column -> Column`` helpers)
  operators/  ``DataFrame -> DataFrame`` checks (capacity, config, perf, ...)
  sources/    readers for snapshot tables, logs, OS dumps, report HTML, JDBC
  plans/      fixture queries, DuckDB oracle SQL and the per-DBMS check registries
  streaming/  incremental ingest of logs / events with watermarks
"""

__version__ = "0.1.0"
