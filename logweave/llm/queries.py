"""All registered queries of this package, and the corpus pipeline."""

from __future__ import annotations

import corpus_pipeline
from logweave.llm import q_texts, q_tokens, q_vectors  # noqa: F401
from logweave.llm.registry import LLM_ORACLES, LLM_QUERIES, register

register("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)

__all__ = ["LLM_ORACLES", "LLM_QUERIES"]
