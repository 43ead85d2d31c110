"""Thresholds of every stage in one place."""

from __future__ import annotations

from dataclasses import dataclass

# Default sentiment vocabulary.
POSITIVE_WORDS = ("good", "great", "excellent", "love", "amazing", "satisfied", "recommend", "fantastic", "nice")
NEGATIVE_WORDS = ("bad", "terrible", "worst", "hate", "awful", "disappointed", "poor")

# Words that mark a column as prose in the identifier test.
PROSE_WORDS = (
    "good", "bad", "game", "love", "hate", "amazing", "excellent", "great",
    "poor", "review", "experience", "fun", "graphics", "hotel", "service",
)

# Column-name patterns.
ID_NAME = "(id|uuid|guid|hash|code|key)$"
IDENTITY_NAME = "(username|user_name|author|profile|player)"
TIME_NAME = "(timestamp|date|time)$"


@dataclass(frozen=True)
class Settings:
    sample_rows: int = 500
    id_sample_rows: int = 200
    id_sample_seed: int = 42
    sample_seed: int = 1
    split_seed: int = 42
    max_classes: int = 50
    kept_classes: int = 10
    other_class: str = "__OTHER__"
    missing_class: str = "__MISSING__"
    null_category: str = "nan"
    label_encode_max: int = 30
    existing_min_rows: int = 30
    existing_share: float = 0.9
    opinion_share: float = 0.25
    min_confidence: float = 0.5
    keyword_share: float = 0.01
    alpha: float = 0.05
    min_effect: float = 0.15
    top_numeric: int = 6
    protect_targets: bool = True
    exempt_dates_from_ids: bool = True


DEFAULTS = Settings()
