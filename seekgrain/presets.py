"""The two retrieval configurations a caller can pick."""

from __future__ import annotations

from dataclasses import dataclass, field


# The thresholds, depths and weights of the settings classes and both presets.
@dataclass(frozen=True)
class TermSettings:
    minimum_idf: float = 0.5
    maximum_df_ratio: float = 0.62
    bonus_per_term: float = 0.04
    maximum_bonus: float = 0.12


@dataclass(frozen=True)
class EvidenceSettings:
    pool: int = 12
    passages: int = 2
    minimum_quality: float = 0.52
    minimum_printable: float = 0.95
    minimum_alphabetic: float = 0.42
    minimum_tokens: int = 5
    maximum_single: float = 0.22
    maximum_line_fragmentation: float = 0.58
    maximum_leading_fragmentation: float = 0.55
    maximum_repeated: float = 0.35
    maximum_symbols: float = 0.12
    minimum_coverage: float = 0.15
    cross_language_floor: float = 0.70


@dataclass(frozen=True)
class RelevanceSettings:
    field_lexical: float = 0.45
    evidence_coverage: float = 0.12
    agreement_coverage: float = 0.08
    strong_dense: float = 0.78
    dense_floor: float = 0.65
    technology_dense_floor: float = 0.65


@dataclass(frozen=True)
class AbstentionSettings:
    minimum_tokens: int = 1
    minimum_bm25: float = 1.20
    minimum_dense: float = 0.70
    strong_dense: float = 0.82
    semantic_only_dense: float = 0.76
    minimum_coverage: float = 0.18
    minimum_mean_dense: float = 0.64
    minimum_agreement: int = 1
    exact_override: float = 4.0
    minimum_passages: int = 1
    minimum_quality: float = 0.52


# Lexical field weights, exact-match settings and the fusion weights to compare.
FIELD_WEIGHTS = {
    "title": 2.40,
    "mission_name": 2.00,
    "services_delivered": 2.20,
    "description": 1.50,
    "technologies": 2.80,
    "offerings": 1.00,
    "sector": 0.35,
    "client": 0.05,
    "evidence": 0.80,
}
FIELD_BONUS_MULTIPLIERS = {
    "title": 1.20,
    "mission_name": 1.10,
    "services_delivered": 1.20,
    "description": 1.00,
    "technologies": 1.50,
    "offerings": 0.50,
    "sector": 0.25,
    "client": 0.00,
    "evidence": 1.00,
}
EXACT_PER_TERM = 0.08
EXACT_MAXIMUM = 0.48
EXACT_STRONG_MULTIPLIER = 2.5
WEIGHT_PAIRS = ((0.90, 0.10), (0.80, 0.20), (0.75, 0.25), (0.70, 0.30), (0.60, 0.40))


@dataclass(frozen=True)
class Preset:
    name: str
    lexical_weight: float
    dense_weight: float
    aggregation: str
    field_scoring: bool
    relevance_gate: bool
    evidence: EvidenceSettings
    k1: float = 1.2
    b: float = 0.75
    rrf_k: int = 60
    depth: int = 2000
    agreement_depth: int = 50
    support_bonus: float = 0.0008
    page_sizes: tuple[int, ...] = (10, 20, 50)
    largest_page: int = 500
    maximum_query_length: int = 1000
    terms: TermSettings = field(default_factory=TermSettings)
    relevance: RelevanceSettings = field(default_factory=RelevanceSettings)
    abstention: AbstentionSettings = field(default_factory=AbstentionSettings)


SELECTED = Preset(
    name="selected",
    lexical_weight=0.75,
    dense_weight=0.25,
    aggregation="C_BEST_PLUS_SUPPORT",
    field_scoring=True,
    relevance_gate=True,
    evidence=EvidenceSettings(),
)
BASELINE = Preset(
    name="baseline",
    lexical_weight=0.50,
    dense_weight=0.50,
    aggregation="A_MAX",
    field_scoring=False,
    relevance_gate=False,
    evidence=EvidenceSettings(passages=1, cross_language_floor=0.78),
)
