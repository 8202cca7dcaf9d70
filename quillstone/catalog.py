"""All queries of the library outside the corpus operators."""

from __future__ import annotations

from quillstone.queries import corpus, formulas, inventory, jobs, measures, relational, retrieval, rowwise, storage, training
from quillstone.queries.registry import Query

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "audit_flags"

for _module in (corpus, measures, rowwise, formulas, jobs, inventory, relational, retrieval, training, storage):
    QUERIES |= _module.R.queries
    ORACLES |= _module.R.oracles
