"""Parameters of the scoring profiles, resolved on the driver into literals."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

PROFILES = ("balanced", "conservative")


@dataclass(frozen=True)
class EnsembleConfig:
    """Parameters of the ensemble support score."""

    profile: str = "balanced"
    if_weight: float = 0.12
    ae_weight: float = 0.88
    threshold: float = 0.55
    strong: float = 0.72
    moderate: float = 0.55
    low_ratio: float = 0.24
    medium_ratio: float = 0.32
    high_ratio: float = 0.64
    conflict: float = 0.08
    agreement: float = 0.05
    if_min: float | None = None
    if_max: float | None = None
    ae_min: float | None = None
    ae_max: float | None = None
    ae_reference: float | None = None
    alert_center: float = 0.0
    alert_scale: float = 0.05
    alert_floor: float = 0.0
    medium_boost: float = 0.0
    high_boost: float = 0.0

    def weights(self) -> tuple[float, float]:
        """Runtime weights (forest, reconstruction); reconstruction stays dominant."""
        ae, iforest = max(self.ae_weight, 0.80), min(self.if_weight, 0.20)
        return iforest / (ae + iforest), ae / (ae + iforest)

    def support_threshold(self) -> float:
        return min(max(self.threshold, 0.25), 0.80)


@dataclass(frozen=True)
class DecisionConfig:
    """Parameters of the decision rules."""

    profile: str = "balanced"
    prioritize_precision: bool = False
    if_weight: float = 0.10
    ae_weight: float = 0.90
    heuristic_weight: float = 0.10
    strong: float = 0.72
    moderate: float = 0.55
    low_ratio: float = 0.24
    medium_ratio: float = 0.32
    high_ratio: float = 0.64
    supportive: float = 0.08
    contextual: float = 0.04
    suppressive: float = 0.18
    agreement: float = 0.06
    safe_negative: float = 0.08


# Fixed values: (lower, upper) of every profile parameter; equal bounds set the value.
ENSEMBLE_BOUNDS = {
    "balanced": {
        "threshold": (0.28, 0.32),
        "if_weight": (0.18, None),
        "ae_weight": (0.82, None),
        "conflict": (0.02, 0.04),
        "agreement": (0.08, None),
        "strong": (0.62, 0.68),
        "moderate": (0.44, 0.50),
        "alert_center": (-0.18, -0.18),
        "alert_scale": (0.04, 0.04),
        "alert_floor": (0.72, 0.72),
        "medium_boost": (0.06, 0.06),
        "high_boost": (0.12, 0.12),
    },
    "conservative": {
        "threshold": (0.60, None),
        "if_weight": (0.12, 0.20),
        "ae_weight": (0.88, None),
        "conflict": (0.08, None),
        "agreement": (0.05, None),
        "alert_center": (0.0, 0.0),
        "alert_scale": (0.05, 0.05),
        "alert_floor": (0.0, 0.0),
        "medium_boost": (0.0, 0.0),
        "high_boost": (0.0, 0.0),
    },
}
DECISION_BOUNDS = {
    "balanced": {
        "if_weight": (0.14, None),
        "ae_weight": (0.82, None),
        "heuristic_weight": (0.10, None),
        "strong": (0.62, 0.68),
        "moderate": (0.44, 0.50),
        "supportive": (0.10, None),
        "contextual": (0.03, None),
        "suppressive": (0.0, 0.04),
        "agreement": (0.08, None),
        "safe_negative": (0.02, 0.05),
    },
    "conservative": {
        "if_weight": (0.10, 0.20),
        "ae_weight": (0.88, None),
        "heuristic_weight": (0.08, 0.15),
        "strong": (0.72, None),
        "moderate": (0.55, None),
        "supportive": (0.08, None),
        "contextual": (0.0, 0.0),
        "suppressive": (0.18, None),
        "agreement": (0.06, None),
        "safe_negative": (0.08, None),
    },
}
# Limits that hold for every profile.
DECISION_LIMITS = {
    "if_weight": (0.05, 0.20),
    "ae_weight": (0.75, None),
    "heuristic_weight": (0.05, 0.15),
    "strong": (0.60, 0.80),
    "moderate": (0.42, 0.65),
    "supportive": (0.04, 0.12),
    "contextual": (0.0, 0.08),
    "suppressive": (0.0, 0.22),
    "agreement": (0.03, 0.10),
}
# Floors when precision is preferred.
PRECISION_FLOORS = {"strong": (0.76, None), "moderate": (0.58, None)}


def resolve_profile(name: str | None) -> str:
    wanted = (name or "balanced").strip().lower()
    return wanted if wanted in PROFILES else "balanced"


def _within(config, bounds: dict[str, tuple[float | None, float | None]]):
    changes = {}
    for name, (low, high) in bounds.items():
        value = getattr(config, name)
        value = value if low is None else max(value, low)
        changes[name] = value if high is None else min(value, high)
    return replace(config, **changes)


def ensemble_profile(config: EnsembleConfig | None = None, profile: str | None = None) -> EnsembleConfig:
    """Ensemble parameters under a profile."""
    config = config or EnsembleConfig()
    name = resolve_profile(profile or config.profile)
    return replace(_within(config, ENSEMBLE_BOUNDS[name]), profile=name)


def decision_profile(
    config: DecisionConfig | None = None,
    profile: str | None = None,
    prioritize_precision: bool | None = None,
) -> DecisionConfig:
    """Decision parameters under a profile."""
    config = config or DecisionConfig()
    name = resolve_profile(profile or config.profile)
    config = _within(_within(config, DECISION_BOUNDS[name]), DECISION_LIMITS)
    precise = config.prioritize_precision if prioritize_precision is None else prioritize_precision
    if precise:
        config = _within(config, PRECISION_FLOORS)
    return replace(config, profile=name, prioritize_precision=precise)


def as_dict(config) -> dict:
    return {f.name: getattr(config, f.name) for f in fields(config)}
