"""Every query of the library outside the llm subpackage, with its SQL."""

from __future__ import annotations

from procaudit.plans import backfill, evaluation, matching, prediction, relational, scalars  # noqa: F401
from procaudit.plans.registry import ORACLES, QUERIES


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
