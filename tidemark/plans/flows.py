"""The ingest flow: schema, table, rows, count."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import SparkSession

from tidemark.sources import tables

from .tasks import Outcome, Task, run_flow

#: The rows that the flow loads.
ROWS = [
    ("evt-001", "signup", dt.datetime(2026, 9, 1, 10, 0, 0), '{"plan":"free"}'),
    ("evt-002", "signup", dt.datetime(2026, 9, 1, 10, 5, 0), '{"plan":"pro"}'),
    ("evt-003", "page_view", dt.datetime(2026, 9, 1, 10, 6, 12), '{"path":"/pricing"}'),
]


def ingest(spark: SparkSession, schema: str = "default", table: str = "events", rows=None) -> list[Outcome]:
    """Loads rows and fetches row_count; each run adds the rows again."""
    rows = rows or (lambda s: tables.literal_rows(s, ROWS, tables.EVENTS))
    return run_flow(
        spark,
        [
            Task("create_schema", lambda s, _: tables.create_schema(s, schema)),
            Task("create_table", lambda s, _: tables.create_table(s, schema, table, tables.EVENTS)),
            Task("load_data", lambda s, _: tables.append(rows(s), schema, table)),
            Task("verify_count", lambda s, _: tables.row_count(s.table(tables.quoted(schema, table))), fetch=True),
        ],
    )
