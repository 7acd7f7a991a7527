"""All registered queries of this subpackage."""

from __future__ import annotations

from ledgerlens.llm import captures, decontaminate, filter_audit, hard_negatives, language, near_text, near_vectors, packing, page_text, paragraphs, secrets, shards, url_rules
from ledgerlens.plans.registry import Query

QUERIES: dict[str, Query] = {}
for _module in (captures, decontaminate, filter_audit, hard_negatives, language, near_text, near_vectors, packing, page_text, paragraphs, secrets, shards, url_rules):
    QUERIES |= _module.QUERIES
