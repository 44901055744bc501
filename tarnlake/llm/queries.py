"""One query per operator, each over the whole of its table."""

from __future__ import annotations

from tarnlake.llm import chat_query, decontaminate_query, exact_query, fingerprints_query, near_query, packing_query, quality_query, runs_query, secrets_query, sharding_query, tokens_query, trie_query, urls_query  # noqa: F401
from tarnlake.llm.registry import ORACLES, QUERIES  # noqa: F401
