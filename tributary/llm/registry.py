"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from . import alignment, bpe, language_id, line_dedup, ngram_join, packing, quality_classifier, quality_rules, repair, resampling, sharding, suffix_dedup, vector_search

MODULES = (packing, quality_rules, bpe, vector_search, suffix_dedup, ngram_join, sharding, quality_classifier, language_id, repair, alignment, line_dedup, resampling)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in MODULES for name, sql in getattr(m, "ORACLE_SQL", {}).items()}
