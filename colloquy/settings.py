"""Engine settings; each may be overridden by an environment variable of its upper-case name."""

from __future__ import annotations

import math
import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    chunk_target_tokens: int = 320
    chunk_overlap_tokens: int = 60
    chunk_max_tokens: int = 520
    dense_k: int = 24
    lexical_k: int = 24
    final_k: int = 10
    rrf_k: int = 60
    mmr_lambda: float = 0.7
    retriever_floor: int = 2
    neighbour_radius: int = 1
    neighbour_seeds: int = 3
    context_token_budget: int = 6000
    min_dense_similarity: float = 0.05
    min_fused_score: float = 0.008
    max_question_chars: int = 2000
    min_citation_coverage: float = 0.5
    whole_meeting_tokens: int = 12000
    trace_list_limit: int = 50

    @classmethod
    def from_env(cls, env=os.environ) -> Settings:
        """Unset, empty, malformed or non-finite values fall back to the defaults."""
        found = {}
        for f in fields(cls):
            try:
                value = float(env.get(f.name.upper(), ""))
            except ValueError:
                continue
            if math.isfinite(value):
                found[f.name] = type(f.default)(value)
        return cls(**found)
