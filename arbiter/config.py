"""Settings of runs. They stay on the driver and parameterise plans."""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass, field, fields
from typing import Any

from arbiter.errors import DataValidationError
from arbiter.functions.text import STOPWORDS

STRATEGIES = ("optimal", "greedy", "minmax", "maximin", "maximin-flow", "fair-local")
COMPONENTS = ("content", "topics", "bid", "recency", "seniority")


def _number(name: str, value: Any, low: float = -math.inf, high: float = math.inf) -> None:
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not math.isfinite(value) or not low <= value <= high:
        raise DataValidationError(f"{name} must be a finite number in [{low}, {high}]")


def _whole(name: str, value: Any, low: int, high: int | None = None) -> None:
    if isinstance(value, bool) or not isinstance(value, int) or value < low or (high is not None and value > high):
        raise DataValidationError(f"{name} must be an integer from {low}" + (f" to {high}" if high is not None else ""))


def _known(cls: type, values: Mapping[str, Any]) -> dict[str, Any]:
    if not isinstance(values, Mapping):
        raise DataValidationError("settings must be a mapping")
    if unknown := set(values) - {f.name for f in fields(cls)}:
        raise DataValidationError(f"unknown settings: {sorted(map(str, unknown))}")
    return dict(values)


#: The parts' names and defaults.
@dataclass(frozen=True)
class ScoreWeights:
    content: float = 0.50
    topics: float = 0.20
    bid: float = 0.15
    recency: float = 0.10
    seniority: float = 0.05

    def __post_init__(self) -> None:
        for c in COMPONENTS:
            _number(f"weight {c}", getattr(self, c), 0.0)
        if not any(getattr(self, c) for c in COMPONENTS):
            raise DataValidationError("one weight at least must be above 0")

    @classmethod
    def from_mapping(cls, values: Mapping[str, float]) -> ScoreWeights:
        """A weight that isn't named is 0."""
        return cls(**{c: 0.0 for c in COMPONENTS} | _known(cls, values))

    def normalised(self) -> dict[str, float]:
        total = sum(getattr(self, c) for c in COMPONENTS)
        return {c: getattr(self, c) / total for c in COMPONENTS}


#: The settings' names, defaults and bounds.
@dataclass(frozen=True)
class MatchConfig:
    reviewers_per_document: int = 2
    minimum_score: float = 0.0
    strategy: str = "optimal"
    current_year: int = 2026
    publication_half_life: float = 6.0
    require_distinct_institutions: bool = False
    load_balance_penalty: float = 0.0
    minimum_senior_reviewers: int = 0
    senior_threshold: float = 0.75
    fair_local_max_steps: int = 32
    fair_local_max_checks: int = 200_000
    weights: ScoreWeights = field(default_factory=ScoreWeights)
    #: Keep the exhaustive and local strategies within the sizes they were made for.
    enforce_ceilings: bool = True

    def __post_init__(self) -> None:
        _whole("reviewers_per_document", self.reviewers_per_document, 1)
        _number("minimum_score", self.minimum_score)
        if self.strategy not in STRATEGIES:
            raise DataValidationError(f"strategy must be one of {STRATEGIES}")
        _whole("current_year", self.current_year, 1800, 2200)
        _number("publication_half_life", self.publication_half_life, math.ulp(0.0))
        for name in ("require_distinct_institutions", "enforce_ceilings"):
            if not isinstance(getattr(self, name), bool):
                raise DataValidationError(f"{name} must be true or false")
        _number("load_balance_penalty", self.load_balance_penalty, 0.0, 1.0)
        _whole("minimum_senior_reviewers", self.minimum_senior_reviewers, 0)
        _number("senior_threshold", self.senior_threshold, 0.0, 1.0)
        _whole("fair_local_max_steps", self.fair_local_max_steps, 1, 128)
        _whole("fair_local_max_checks", self.fair_local_max_checks, 1, 2_000_000)
        if not isinstance(self.weights, ScoreWeights):
            raise DataValidationError("weights must be ScoreWeights")
        if self.minimum_senior_reviewers and self.require_distinct_institutions:
            raise DataValidationError("minimum_senior_reviewers and require_distinct_institutions can't be combined: one flow network can't express both")
        if self.strategy in ("maximin", "maximin-flow", "fair-local") and self.load_balance_penalty:
            raise DataValidationError(f"{self.strategy} has no load_balance_penalty")
        if self.strategy != "fair-local" and (self.fair_local_max_steps, self.fair_local_max_checks) != (32, 200_000):
            raise DataValidationError("fair_local limits need strategy fair-local")

    @classmethod
    def from_mapping(cls, values: Mapping[str, Any]) -> MatchConfig:
        known = _known(cls, values)
        if "weights" in known:
            known["weights"] = ScoreWeights.from_mapping(known["weights"])
        return cls(**known)

    @property
    def label(self) -> str:
        """The strategy's name with what was asked for besides; only optimal and greedy say so."""
        if self.strategy not in ("optimal", "greedy"):
            return self.strategy
        extra = (("diverse", self.require_distinct_institutions), ("balanced", self.load_balance_penalty > 0), ("senior", self.minimum_senior_reviewers > 0))
        if self.strategy == "optimal" and self.minimum_senior_reviewers:
            extra = extra[1:]
        return "-".join((self.strategy, *[name for name, on in extra if on]))


#: Guards that an expertise run may set. Fixed values.
LIMITS = (
    "max_submissions", "max_reviewers", "max_publications_per_reviewer", "max_total_publications", "max_document_characters", "max_document_bytes",
    "max_tokens_per_document", "max_token_characters", "max_total_tokens", "max_vocabulary_terms", "max_pairs", "max_total_contributions",
)


#: The settings' names, defaults and bounds.
@dataclass(frozen=True)
class ExpertiseConfig:
    model: str = "tfidf"
    aggregation: str = "aggregate"
    submission_fields: tuple[str, ...] = ("title", "abstract", "topics", "keywords")
    profile_fields: tuple[str, ...] = ("summary", "topics", "keywords")
    publication_fields: tuple[str, ...] = ("title", "abstract")
    include_profile: bool = True
    require_submission_abstract: bool = False
    require_publication_abstract: bool = False
    minimum_publication_year: int | None = None
    maximum_publication_year: int | None = None
    undated_publications: str = "include"
    minimum_evidence_tokens: int = 1
    minimum_token_length: int = 2
    stopwords: tuple[str, ...] = STOPWORDS
    bm25_k1: float = 1.2
    bm25_b: float = 0.75
    minimum_output_score: float = 0.0
    #: Optional guards by name (LIMITS); one that isn't named sets no limit.
    limits: Mapping[str, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.model not in ("tfidf", "bm25"):
            raise DataValidationError("model must be tfidf or bm25")
        if self.aggregation not in ("aggregate", "max", "average"):
            raise DataValidationError("aggregation must be aggregate, max or average")
        for name, allowed in (("submission_fields", ("title", "abstract", "topics", "keywords")), ("profile_fields", ("summary", "topics", "keywords")), ("publication_fields", ("title", "abstract"))):
            chosen = getattr(self, name)
            if not chosen or len(set(chosen)) != len(chosen) or set(chosen) - set(allowed):
                raise DataValidationError(f"{name} must be distinct names of {allowed}")
        if self.undated_publications not in ("include", "exclude"):
            raise DataValidationError("undated_publications must be include or exclude")
        low, high = self.minimum_publication_year, self.maximum_publication_year
        for name, year in (("minimum_publication_year", low), ("maximum_publication_year", high)):
            if year is not None:
                _whole(name, year, 1800, 2200)
        if low is not None and high is not None and low > high:
            raise DataValidationError("minimum_publication_year is above maximum_publication_year")
        _whole("minimum_evidence_tokens", self.minimum_evidence_tokens, 1)
        _whole("minimum_token_length", self.minimum_token_length, 1)
        _number("bm25_k1", self.bm25_k1, math.ulp(0.0))
        _number("bm25_b", self.bm25_b, 0.0, 1.0)
        _number("minimum_output_score", self.minimum_output_score, 0.0, 1.0)
        if self.require_publication_abstract and "abstract" not in self.publication_fields:
            raise DataValidationError("publication_fields must have abstract if require_publication_abstract is set")
        for name, value in self.limits.items():
            if name not in LIMITS:
                raise DataValidationError(f"unknown limit {name}")
            _whole(name, value, 1)

    @classmethod
    def from_mapping(cls, values: Mapping[str, Any]) -> ExpertiseConfig:
        """Limits may stand beside the other settings."""
        limits = {k: v for k, v in values.items() if k in LIMITS}
        known = _known(cls, {k: v for k, v in values.items() if k not in LIMITS})
        known["limits"] = {**known.get("limits", {}), **limits}
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in known.items()})


#: The settings' names, defaults and bounds.
@dataclass(frozen=True)
class KeyphraseConfig:
    window_size: int = 2
    damping: float = 0.85
    iterations: int = 30
    top_k: int = 20

    def __post_init__(self) -> None:
        _whole("window_size", self.window_size, 2, 16)
        _number("damping", self.damping, math.ulp(0.0), 1.0 - math.ulp(0.5))
        _whole("iterations", self.iterations, 1, 100)
        _whole("top_k", self.top_k, 1, 1000)


#: The settings' names, defaults and bounds.
@dataclass(frozen=True)
class CentroidConfig:
    dimensions: int = 8
    epochs: int = 8
    learning_rate: float = 0.1
    l2: float = 0.0
    seed: int = 17

    def __post_init__(self) -> None:
        _whole("dimensions", self.dimensions, 1, 32)
        _whole("epochs", self.epochs, 1, 50)
        _number("learning_rate", self.learning_rate, math.ulp(0.0), 1.0)
        _number("l2", self.l2, 0.0, 1.0)
        _whole("seed", self.seed, 0, 2**32 - 1)


#: The settings' names, defaults and bounds.
@dataclass(frozen=True)
class GoldEvaluationConfig:
    k_values: tuple[int, ...] = (1, 3, 5, 10)
    relevance_threshold: int = 1
    strict_coverage: bool = False

    def __post_init__(self) -> None:
        object.__setattr__(self, "k_values", tuple(sorted(self.k_values)))
        if not self.k_values or len(set(self.k_values)) != len(self.k_values) or len(self.k_values) > 20:
            raise DataValidationError("k_values must be 1 to 20 distinct numbers")
        for k in self.k_values:
            _whole("k", k, 1, 1000)
        _whole("relevance_threshold", self.relevance_threshold, 1, 1000)
