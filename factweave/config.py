"""Thresholds of matching, comparison and confidence, in one frozen record."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Settings:
    # The same thresholds decide the same results as elsewhere.
    equal_tolerance: float = 0.005
    scale_tolerance: float = 0.02
    vintage_days: int = 45
    contradiction_confidence: float = 0.45
    entity_score: float = 90.0
    attribute_score: float = 92.0
    vector_score: float = 0.86
    quote_score: float = 92.0
    identifier_score: float = 88.0
    chunk_chars: int = 4800
    full_pairing: int = 60
    rule_base: dict = field(
        default_factory=lambda: {
            "EXACT": 0.95,
            "ROUNDING": 0.90,
            "UNIT_SCALE": 0.80,
            "PERIOD": 0.90,
            "ESTIMATE_VINTAGE": 0.85,
            "SCOPE": 0.80,
            "BASIS": 0.80,
            "IDENTIFIER_REVISION": 0.75,
            "ATTRIBUTION": 0.60,
            "NONE": 0.70,
        }
    )


SETTINGS = Settings()
