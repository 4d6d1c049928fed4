"""All queries over the given tables, and the SQL that each must agree with."""

from __future__ import annotations

from . import books, calls, comparison, linkage, registers, reports, rules

_PARTS = (linkage, registers, reports, comparison, rules, books, calls)
#: Loops over edges, of many small jobs: they stand last, so that what is bounded in time gets to all others first.
LAST = ("linkage_components", "linkage_stages", "strong_components", "sample_disjoint", "linkage_roundtrip", "linkage_families", "linkage_couples_found", "gedcom_linked")
_ALL = {k: v for part in _PARTS for k, v in part.QUERIES.items()}
QUERIES: dict = {k: v for k, v in _ALL.items() if k not in LAST} | {k: _ALL[k] for k in LAST}
ORACLE: dict[str, str] = {k: v for part in _PARTS for k, v in part.ORACLE.items()}
