"""retailspark — retail demand analytics as set-based Spark DataFrame jobs.

Sub-packages:

* ``functions``  – Column -> Column helpers (weather codes, calendar features,
  rounding, labels, text formats).  Pure built-in expressions, no UDFs.
* ``sources``    – readers for tables and semi-structured payloads, sinks
  (keyed replace, registry upsert, partitioned package files) and the
  stand-in inputs derived from the driver's test tables.
* ``operators``  – DataFrame -> DataFrame operators (daily aggregation,
  features, alerts, reports, ingest, dashboard, sessions, models, scoring).
* ``plans``      – end-to-end jobs composed from operators (daily forecast,
  weekly report, package ingest).
* ``streaming``  – Structured Streaming twins of the ingest operators.
"""

from retailspark.config import Config

__all__ = ["Config"]
