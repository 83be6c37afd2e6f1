"""All queries of the library and their oracle SQL."""

from __future__ import annotations

from newsloom.plans import attention, corpus, events, extras, market, models, topics  # noqa: F401  each registers its plans
from newsloom.plans.registry import PLANS, SQL


def queries() -> dict:
    return dict(PLANS)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
