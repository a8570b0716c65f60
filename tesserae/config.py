"""All limits and defaults of the engine, in one place."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    chunk_size: int = 1000
    chunk_overlap: int = 200
    table_max_chars: int = 3000
    image_max_chars: int = 3000
    heading_prefix_max: int = 200
    router_max_topics: int = 3
    history_max_messages: int = 6
    history_max_chars: int = 600
    rewrite_max_chars: int = 600
    context_max_tokens: int = 6000
    chars_per_token: float = 3.5
    max_pictures: int = 3
    table_embed_rows: int = 500
    table_group_chars: int = 1000
    table_cell_max: int = 150
    table_enum_max: int = 15
    table_sample_seed: int = 42
    summary_columns: int = 60
    column_line_max: int = 400
    top_k: int = 6
    question_max_chars: int = 2000
    rrf_k: int = 60
    id_boost: int = 3
    dedup_similarity: float = 0.9
    max_requests: int = 3
    default_limit: int = 20
    max_limit: int = 50
    max_group_columns: int = 2
    max_catalog_columns: int = 60
    near_match_cutoff: float = 0.85
    near_match_gap: float = 0.08
    suggestion_cutoff: float = 0.6
    column_cutoff: float = 0.4
    max_calc_rounds: int = 2
    embed_batch: int = 100
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    bm25_epsilon: float = 0.25
    low_correctness: float = 0.67
    low_faithfulness: float = 0.8


DEFAULTS = Settings()
