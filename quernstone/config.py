"""Settings from environment variables; a blank value means the default."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    rag_top_k: int = 5
    rag_score_min: float = 0.48
    vector_size: int = 768
    encoder: str = "fake"
    embed_batch: int = 32
    context_tokens: int = 8192
    answer_tokens: int = 2048

    @classmethod
    def load(cls, env: Mapping[str, str] = os.environ) -> Settings:
        given = {f.name: env.get(f.name.upper(), "").strip() for f in fields(cls)}
        kinds = {f.name: type(f.default) for f in fields(cls)}
        return cls(**{k: kinds[k](v) for k, v in given.items() if v})
