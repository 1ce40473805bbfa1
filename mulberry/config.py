"""Default parameters of the retrieval and learner operators (fixed values, all can be overridden per call)."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    k: int = 5
    dense_k: int = 10
    sparse_k: int = 20
    rrf_k: int = 20
    degraded_sparse_k: int = 60
    topup_k: int = 40
    variants: int = 2
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    relevance_floor: float = 0.45
    rerank_alpha: float = 0.5
    rerank_k: int = 10
    chunk_target: int = 220
    chunk_max: int = 420
    chunk_overlap: int = 1
    fixed_target: int = 300
    fixed_overlap: int = 100
    weak_threshold: float = 0.6
    weak_probability: float = 0.7
    half_life_days: float = 7.0
    due_strength: float = 0.5
    elo_start: float = 1500.0
    elo_k: float = 32.0
    ask_min: int = 3
    ask_bonus: float = 1.5
    dup_similarity: float = 0.85
    memory_rounds: int = 5
    memory_k: int = 3

    def problems(self) -> list[str]:
        """What is wrong with the settings; nothing for the defaults."""
        counts = ("k", "dense_k", "sparse_k", "rrf_k", "degraded_sparse_k", "topup_k", "rerank_k", "chunk_target", "chunk_max", "fixed_target", "memory_rounds", "memory_k")
        shares = ("bm25_b", "relevance_floor", "rerank_alpha", "weak_threshold", "weak_probability", "due_strength", "dup_similarity")
        found = [f"{n} must be 1 or more" for n in counts if getattr(self, n) < 1]
        found += [f"{n} must lie between 0 and 1" for n in shares if not 0 <= getattr(self, n) <= 1]
        found += [f"{n} must be above 0" for n in ("bm25_k1", "half_life_days", "elo_k") if getattr(self, n) <= 0]
        if self.chunk_target > self.chunk_max:
            found.append("chunk_target must not exceed chunk_max")
        if not 0 <= self.fixed_overlap < self.fixed_target:
            found.append("fixed_overlap must be smaller than fixed_target")
        return found

    def checked(self) -> Settings:
        """These settings, or an error that names all that is wrong."""
        if found := self.problems():
            raise ValueError("; ".join(found))
        return self


DEFAULTS = Settings()
