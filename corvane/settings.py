"""Defaults that change results."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Search:
    candidates: int = 60
    results: int = 25
    vector_weight: float = 0.7
    keyword_weight: float = 0.3
    multi_hit_bonus: float = 0.15
    filename_weight: float = 0.5
    filename_exact_bonus: float = 1.0
    current_project_boost: float = 1.15
    relative_gap: float = 0.5
    min_term_coverage: float = 0.5
    min_content_chars: int = 20
    bm25_k1: float = 1.2
    bm25_b: float = 0.75


@dataclass(frozen=True)
class Chunking:
    max_chars: int = 4500
    target_chars: int = 1800
    min_chars: int = 400
    overlap: int = 6
    stored_chars: int = 5000


@dataclass(frozen=True)
class Match:
    recall_k: int = 10
    threshold: float = 0.3
    must_weight: float = 2.0
    nice_weight: float = 1.0
    evidence_threshold: float = 0.85


SEARCH, CHUNKING, MATCH = Search(), Chunking(), Match()
PLAIN = Chunking(max_chars=2500, overlap=3)  # windows of plain text
DIM = 64  # of the default hashed embedder
