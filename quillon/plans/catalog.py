"""All queries of the engine and the SQL that they are held against."""

from __future__ import annotations

from quillon.plans import base, q_boundary, q_metrics, q_spans, q_tables  # noqa: F401  the modules register their queries


def flagship(spark, sf_dir):
    return q_spans.flagship(spark, sf_dir)


def queries():
    return base.QUERIES


def oracle_sql():
    return base.SQL
