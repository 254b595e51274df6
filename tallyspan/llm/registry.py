"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import alignment, collocations, decontamination, exact_dedup, licenses, mixing, near_dedup, neighbours, packing, passages, quality, secrets, warc

MODULES = (secrets, licenses, neighbours, warc, quality, mixing, exact_dedup, packing, passages, near_dedup, alignment, decontamination, collocations)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in MODULES for k, s in m.ORACLE_SQL.items()}
