"""All registered queries, imported once so the registry is complete."""

from __future__ import annotations

from corpusvox.plans import (  # noqa: F401
    q_batching, q_extra, q_features, q_io, q_manifest, q_misc, q_more, q_prompts, q_scoring, q_segments, q_sentences,
    q_streaming,
    q_text)
from corpusvox.plans.registry import ORACLE, QUERIES

__all__ = ["QUERIES", "ORACLE"]
