"""All named queries."""

from __future__ import annotations

from lexgauge.plans import (  # noqa: F401
    content_queries,
    contract_queries,
    domain_queries,
    ledger_queries,
    quality_queries,
    stream_queries,
)
from lexgauge.plans.registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
