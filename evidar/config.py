"""Fixed limits, weights and thresholds shared by every operator.

All numbers below are fixed values: results depend on them exactly.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    # index budgets
    max_file_bytes: int = 20 * 1024 * 1024
    # None takes documents of any size
    max_sections: int | None = None
    max_chars: int | None = None
    max_chunks: int | None = None
    chunk_size: int = 1_200
    chunk_overlap: int = 160
    index_version: int = 5
    # OCR manifest budgets; None takes manifests of any size
    ocr_max_pages: int | None = None
    ocr_page_chars: int | None = None
    ocr_total_chars: int | None = None
    ocr_max_manifest_bytes: int | None = None
    ocr_max_visuals: int | None = None
    ocr_max_visual_url: int = 200_000
    ocr_min_confidence: float = 35.0
    auto_ocr_chars: int = 48
    # lexical scoring
    k1: float = 1.4
    b: float = 0.75
    phrase_bonus: float = 3.0
    phrase_min_chars: int = 4
    # hybrid scoring
    lexical_weight: float = 0.5
    vector_weight: float = 0.42
    title_boost: float = 0.08
    type_boost: float = 0.08
    page_boost: float = 0.14
    # reciprocal rank fusion
    rrf_k: int = 60
    rrf_depth: int = 80
    rrf_floor: float = 1e-4
    hybrid_blend: float = 0.72
    rrf_blend: float = 0.28
    # question answering gate and funnel
    gate_lexical: float = 0.28
    gate_coverage: float = 0.18
    gate_vector: float = 0.42
    candidates: int = 40
    rerank_top: int = 12
    rerank_floor: float = 0.12
    diverse: int = 8
    evidence: int = 10
    neighbour_decay: float = 0.72
    mmr_relevance: float = 0.82
    mmr_redundancy: float = 0.16
    mmr_locator: float = 0.08
    coverage_chunks: int = 80
    coverage_chars: int = 60_000
    # learning sessions
    session_ms: int = 25 * 60 * 1000
    client_slack_ms: int = 2_000
    late_batch: int = 500
    # physical choices (not part of the semantics)
    salts: int = 16
    vector_block: int = 4_096
    query_block: int = 1_024


DEFAULT = Config()

# Study factors by condition (grounding, attribution, core variant).
FACTORS = {
    "A": (False, False, "U"),
    "B": (True, False, "G"),
    "C": (False, True, "U"),
    "D": (True, True, "G"),
}

# Progress range of each pipeline phase, in percent.
PHASES = {
    "hashing": (0, 5),
    "preparing_ocr": (5, 8),
    "rendering": (8, 25),
    "ocr": (25, 45),
    "uploading": (45, 55),
    "parsing": (55, 68),
    "vision": (68, 82),
    "indexing": (82, 99),
    "ready": (100, 100),
}

# Weight of each evaluation category.
PRIORITIES = {
    "overview": 0.30,
    "detail": 0.25,
    "visual": 0.20,
    "review": 0.15,
    "comparison": 0.10,
}
