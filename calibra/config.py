"""Settings shared by the operators. Every value can be replaced per call."""

from __future__ import annotations

from dataclasses import dataclass

NULL_LABEL = "__null__"
MISSING_CATEGORY = "__missing__"
NO_RESAMPLING = "none"


@dataclass(frozen=True)
class TierPolicy:
    """Share limits (percent of rows) of the class tiers, and the purge limit."""

    # Tier limits and the label of the discarded tail.
    thresholds: tuple[tuple[str, float], ...] = (("A", 15.0), ("B", 1.0), ("C", 0.1))
    discard_label: str = "D"
    min_percentage: float = 0.1

    def descending(self) -> list[tuple[str, float]]:
        return sorted(self.thresholds, key=lambda item: item[1], reverse=True)


@dataclass(frozen=True)
class ProfilePolicy:
    """Limits of the column heuristics."""

    # Null share, mean text length and distinct ratio limits.
    high_null_pct: float = 50.0
    free_text_avg_len: float = 30.0
    free_text_ratio: float = 0.80
    deny_list: tuple[str, ...] = ()
    # Columns whose estimated distinct share lies below this part of the limit
    # are settled by the sketch, whose error is about 0.65 percent for 2**14
    # registers; all others are counted exactly.
    screen_margin: float = 0.95
    sketch_lg_k: int = 14


@dataclass(frozen=True)
class PreparePolicy:
    correlation_threshold: float = 0.95
    enable_reduction: bool = True
    components: float | int = 0.95
    sparse_components: int = 128
    enable_purge: bool = True
    # "all" fits the feature transforms on every row, "train" on the train split.
    fit_scope: str = "all"
    # Levels and features up to which lists and square matrices are held on the driver; beyond, tables and iterations.
    max_width: int = 4000


@dataclass(frozen=True)
class ReviewPolicy:
    """Settings of the review gate."""

    enabled: bool = True
    provider: str = "openai"
    has_key: bool = True
    skip_tier_a: bool = True
    # Gate limits.
    min_proba: float = 0.70
    min_top_gap: float = 0.15

    @property
    def configured(self) -> bool:
        return self.enabled and self.has_key


@dataclass(frozen=True)
class TrainPolicy:
    """One classification run: grid, split, balancing and validation choices."""

    target: str
    algorithms: tuple[str, ...] = ("gbt",)
    resampling: tuple[str | None, ...] = ("smote",)
    test_size: float = 0.2
    seed: int = 42
    min_class_count: int = 2
    min_percentage: float = 0.1
    cross_validate: bool = False
    cv_folds: int = 5
    search: bool = False
    search_iterations: int = 15
    search_folds: int = 3
    search_scoring: str = "f1_macro"
    overrides: tuple[tuple[str, tuple[tuple[str, object], ...]], ...] = ()

    def params_for(self, algorithm: str) -> dict[str, object]:
        return dict(dict(self.overrides).get(algorithm, ()))


DEFAULT_TIERS = TierPolicy()
DEFAULT_PROFILE = ProfilePolicy()
DEFAULT_REVIEW = ReviewPolicy()
