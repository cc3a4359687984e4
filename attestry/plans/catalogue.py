"""Every query of the library by name, with the SQL it is held against."""

from __future__ import annotations

from attestry.plans import comparison, corpus, documents, drafts, lineage, notes, scoring, screening  # noqa: F401  they register their queries
from attestry.plans.registry import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracles() -> dict:
    return dict(ORACLES)
