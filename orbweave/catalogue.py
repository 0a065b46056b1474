"""All queries of the series engine on the driver's tables, and their SQL."""

from __future__ import annotations

from orbweave.plans import queries as _plans


def queries() -> dict:
    return dict(_plans.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_plans.ORACLES)
