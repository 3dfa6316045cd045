"""All named queries of the engine."""

from __future__ import annotations

from . import corpus, evidence, extras, ingest, originality, relational, resolve, retrieval, scoring, streams, workflow
from .base import Query

ALL: dict[str, Query] = {}
for _module in (corpus, retrieval, ingest, resolve, scoring, evidence, streams, relational, extras, originality, workflow):
    for _name, _query in _module.catalog.items.items():
        if _name in ALL:
            raise ValueError(f"two queries are named {_name}")
        ALL[_name] = _query
