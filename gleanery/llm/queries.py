"""The registered queries of the training-data operators."""

from __future__ import annotations

from gleanery.llm import (
    queries_chunking,
    queries_decontaminate,
    queries_langid,
    queries_licenses,
    queries_mixing,
    queries_pii,
    queries_quality,
    queries_simhash,
    queries_spans,
    queries_wrappers,
)

_PARTS = (
    queries_chunking,
    queries_decontaminate,
    queries_langid,
    queries_licenses,
    queries_mixing,
    queries_pii,
    queries_quality,
    queries_simhash,
    queries_spans,
    queries_wrappers,
)

QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLES = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
