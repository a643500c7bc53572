"""All core queries of the driver contract with their SQL."""

from __future__ import annotations

from . import log_queries, record_sql
from ..operators import log_entries, normalise_times, rejects, schema_drift

_RECORD_QUERIES = {
    "p1_found": log_entries.p1_found,
    "p1_entries": log_entries.p1_entries,
    "p1_templates": log_entries.p1_templates,
    "p2_found": normalise_times.p2_found,
    "p2_times": normalise_times.p2_times,
    "p5_found": rejects.p5_found,
    "p5_loaded": rejects.p5_loaded,
    "p5_rejects": rejects.p5_rejects,
    "p6_found": schema_drift.p6_found,
    "p6_unified": schema_drift.p6_unified,
}


def entry(spark, sf_dir):
    return log_entries.p1_found(spark, sf_dir)


def queries():
    return _RECORD_QUERIES | log_queries.QUERIES


def oracle_sql():
    return log_queries.SQL | record_sql.SQL
