"""All queries of the engine, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from . import answers, retrieval, routing, store, streams, text

QUERIES = retrieval.QUERIES | store.QUERIES | text.QUERIES | routing.QUERIES | streams.QUERIES | answers.QUERIES
ORACLES = retrieval.ORACLES | store.ORACLES | text.ORACLES | routing.ORACLES | streams.ORACLES | answers.ORACLES
