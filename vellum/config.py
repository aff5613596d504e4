"""Settings of the catalogue and their defaults."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class CatalogConfig:
    root: str = "./vellum-catalog"
    chunk_max_tokens: int = 800
    chunk_overlap_tokens: int = 80
    summary_max_chars: int = 1200
    summary_input_chars: int = 8000
    default_k: int = 8
    enable_chunk_fallback: bool = True
    chunk_fallback_score_threshold: float = 0.30
    semantic_weight: float = 0.7
    lexical_weight: float = 0.3
    include_archived: bool = False
    crawl_max_pages: int = 100
    crawl_max_depth: int = 6
    embedding_dim: int = 512
    #: "snapshots", or "flat" for filters after the vector search.
    backend: str = "snapshots"
    #: "local", or "openai" for the models of that service, whose package executors need.
    embedding_provider: str = "local"
    summarizer_provider: str = "local"
    embedding_model: str = "text-embedding-3-small"
    summarizer_model: str = "gpt-4o-mini"
    api_key: str | None = field(default=None, repr=False)
    extras: dict = field(default_factory=dict)
