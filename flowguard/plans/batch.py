"""Log lines or windows -> scored windows."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from flowguard import vocabulary as V
from flowguard.config import DecisionConfig, EnsembleConfig
from flowguard.functions.features import resolve_base_features, sanitize_numeric, with_features
from flowguard.operators.decision import decide
from flowguard.operators.ensemble import ai_support, ensemble_support
from flowguard.operators.events import prepare_events
from flowguard.operators.forest import Forest, ForestConfig, fit_forest, score_forest
from flowguard.operators.parse import parse_filterlog
from flowguard.operators.reconstruction import Reconstruction, fit_reconstruction, score_reconstruction
from flowguard.operators.rules import analyze_behaviour, refine_with_context
from flowguard.operators.windows import window_features


@dataclass(frozen=True)
class ScoringModel:
    """Everything scoring needs besides the rows."""

    forest: Forest
    reconstruction: Reconstruction
    ensemble: EnsembleConfig = field(default_factory=EnsembleConfig)


def fit_models(
    windows: DataFrame,
    forest: ForestConfig | None = None,
    percentile: float = 80.0,
    key_cols: tuple[str, ...] = ("window_id",),
) -> ScoringModel:
    """Untuned fit of both detectors on all windows; several passes, so pass a stored table."""
    return ScoringModel(
        fit_forest(windows, V.FEATURES, forest, key_cols=list(key_cols)),
        fit_reconstruction(windows, V.FEATURES, percentile=percentile),
    )


def score_windows(
    windows: DataFrame,
    model: ScoringModel,
    *,
    profile: str | None = None,
    decision: DecisionConfig | None = None,
    context: bool = True,
) -> DataFrame:
    """Detectors, rules, neighbour context, ensemble, AI support and decision.

    One exchange (the neighbour context); everything else is narrow.
    """
    df = sanitize_numeric(windows, V.FEATURES)
    df = score_reconstruction(score_forest(df, model.forest), model.reconstruction)
    df = analyze_behaviour(df)
    if context:
        df = refine_with_context(df)
    df = ensemble_support(df, model.ensemble, profile=profile, ae_reference=model.reconstruction.threshold)
    return decide(ai_support(df), decision, profile=profile)


def score_records(records: DataFrame, model: ScoringModel, *, profile: str | None = None) -> DataFrame:
    """score structured records of the five base values (or the raw flow columns)."""
    return score_windows(with_features(resolve_base_features(records)), model, profile=profile, context=False)


def analyse_lines(
    lines: DataFrame,
    model: ScoringModel,
    *,
    default_year: int,
    line_col: str = "value",
    line_number_col: str | None = None,
    window: str | int = 5,
    profile: str | None = None,
    addresses: str = "any",
) -> DataFrame:
    """Raw lines to scored windows in one plan."""
    events = prepare_events(
        parse_filterlog(lines, line_col, default_year=default_year, line_number_col=line_number_col),
        keep=("line_number",),
    )
    sequence = "line_number" if line_number_col else None
    return score_windows(
        window_features(events, window, sequence_col=sequence, addresses=addresses, free_flags=False), model, profile=profile
    )
