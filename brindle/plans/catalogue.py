"""All named queries."""

from __future__ import annotations

from brindle.plans import corpus, findings, readers, scalars, streams, tables, texts, vectors, written  # noqa: F401  each registers its own
from brindle.plans.base import QUERIES


def queries():
    return {name: q.build for name, q in QUERIES.items()}


def oracle_sql():
    return {name: q.sql for name, q in QUERIES.items() if q.sql}
