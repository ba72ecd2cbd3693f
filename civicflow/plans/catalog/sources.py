"""Catalogue: sources and sinks (A5, A9, A10 round trips on data Spark derives
from the driver tables)."""

from __future__ import annotations

from pyspark.sql import functions as F

from civicflow import sources
from civicflow.plans.catalog import register
from civicflow.plans.catalog.enrich import _SEGMENTS, _SHARE_COLS, _SHARES_SQL, _shares

# Fixed value: report labels (text in the report -> column name).
_LABELS = {f"Share {s.title()}": f"share_{s.lower()}" for s in _SEGMENTS}


@register("block_report", f"""
SELECT region AS key, {', '.join(f'round_even({c} * 1000.0::DOUBLE, 0) / 1000.0::DOUBLE AS {c}' for c in _SHARE_COLS)}
FROM ({_SHARES_SQL})""")
def block_report(spark, sf):
    """Write the per-region share dimension as a block text report, then parse it back (A5)."""
    path = sources.scratch_path(spark, "block-report")
    sources.write_block_report(_shares(spark, sf), "region", {c: lbl for lbl, c in _LABELS.items()}, path,
                               title="=== SEGMENT SHARES ===\n\nShares per region:\n")
    return sources.read_block_report(spark, path, _LABELS, key="key")


def _request_rows(spark, sf):
    """Events rendered as ticket requests; some optional fields are absent."""
    from civicflow.session import table
    ev = table(spark, sf, "events")
    e = F.col("event_id")
    return ev.select(
        e.alias("ticket_id"),
        F.when(e % 3 == 0, F.lit(None)).otherwise(F.upper("event_type")).alias("Agency"),
        F.when(e % 4 == 0, F.lit(None)).otherwise(F.lit("Residential Building/House")).alias("Location_Type"),
        F.get_json_object("props", "$.k").alias("Incident_Zip"),
        F.when(e % 5 == 0, F.lit(None)).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).alias("created_date"),
    )


@register("json_requests", """
SELECT event_id AS ticket_id, coalesce(CASE WHEN event_id % 3 = 0 THEN NULL ELSE upper(event_type) END, 'DSNY') AS Agency,
       coalesce(CASE WHEN event_id % 4 = 0 THEN NULL ELSE 'Residential Building/House' END, 'Street/Sidewalk') AS Location_Type,
       json_extract_string(props, '$.k') AS Incident_Zip, 'N/A' AS Vehicle_Type, 'Straßenzustand' AS Descriptor,
       coalesce(CASE WHEN event_id % 5 = 0 THEN NULL ELSE date_trunc('second', ts) END, TIMESTAMP '2024-02-01 00:00:00')
         AS created_date,
       CAST(NULL AS VARCHAR) AS Borough
FROM events""")
def json_requests(spark, sf):
    """Write requests as JSON lines and read them back with schema + defaults."""
    path = sources.scratch_path(spark, "requests")
    sources.write_json(_request_rows(spark, sf), path)
    return sources.read_requests_json(spark, path, as_of="2024-02-01 00:00:00").select(*sources.REQUEST_SCHEMA.fieldNames())
