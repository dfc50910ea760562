"""Named queries over the derived books."""

from __future__ import annotations


def all_queries():
    """(queries, oracles) with every plan module registered."""
    from taxlake.plans import currency, duplicates, files, parties, review, state, summaries, texts, upkeep, vat  # noqa: F401
    from taxlake.plans.catalog import ORACLES, QUERIES

    return dict(QUERIES), dict(ORACLES)
