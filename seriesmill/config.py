"""Configuration: validated dataclasses, optionally read from YAML."""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from pathlib import Path

LEVEL_KEYS = {"store_family": ["store_nbr", "family"], "family": ["family"], "store": ["store_nbr"], "total": []}


def _positive(**values) -> None:
    for name, v in values.items():
        if v is None or v <= 0:
            raise ValueError(f"{name} must be positive")


@dataclass
class TrendConfig:
    seasonality_mode: str = "multiplicative"
    changepoint_prior_scale: float = 0.0198
    yearly_seasonality: bool = True
    weekly_seasonality: bool = True
    daily_seasonality: bool = False
    holidays_country: str = "EC"

    def __post_init__(self):
        _positive(changepoint_prior_scale=self.changepoint_prior_scale)


@dataclass
class BoostConfig:
    iterations: int = 1000
    learning_rate: float = 0.0576
    depth: int = 6
    loss_function: str = "RMSEWithUncertainty"
    task_type: str = "CPU"
    verbose: int = 100
    early_stopping_rounds: int = 50

    def __post_init__(self):
        _positive(iterations=self.iterations, learning_rate=self.learning_rate, early_stopping_rounds=self.early_stopping_rounds)
        if not 1 <= self.depth <= 16:
            raise ValueError("depth must lie in 1..16")
        if self.task_type not in ("CPU", "GPU"):
            raise ValueError("task_type is CPU or GPU; either runs on CPU here")
        if self.loss_function not in ("RMSEWithUncertainty", "RMSE"):
            raise ValueError("the loss is RMSEWithUncertainty (mean and spread) or RMSE (mean alone)")


@dataclass
class PipelineConfig:
    forecast_horizon: int = 28
    cv_windows: int = 5
    cv_stride: int = 14
    residual_min_train_size: int = 365
    target_transform: str = "box_cox"
    aggregation_level: str = "store_family"

    def __post_init__(self):
        _positive(horizon=self.forecast_horizon, windows=self.cv_windows, stride=self.cv_stride, min_train=self.residual_min_train_size)
        if self.aggregation_level not in LEVEL_KEYS:
            raise ValueError(f"unknown level {self.aggregation_level!r}")


@dataclass
class BaseConfig:
    """The sections of a base configuration file; names of sections are those of the file."""

    trend: TrendConfig = field(default_factory=TrendConfig, metadata={"section": "prophet"})
    boost: BoostConfig = field(default_factory=BoostConfig, metadata={"section": "catboost"})
    pipeline: PipelineConfig = field(default_factory=PipelineConfig)


@dataclass
class FeatureConfig:
    lags: list[int] = field(default_factory=lambda: [28, 35, 42, 56, 90])
    rolling_windows: list[int] = field(default_factory=lambda: [7, 14, 28])
    rolling_functions: list[str] = field(default_factory=lambda: ["mean", "std", "max"])
    rolling_base_lags: list[int] = field(default_factory=lambda: [28, 35])
    expanding_functions: list[str] = field(default_factory=lambda: ["mean", "std"])
    expanding_min_periods: int = 28
    calendar: list[str] = field(default_factory=lambda: ["day_of_week", "month", "quarter", "day_of_month", "week_of_year", "is_weekend", "is_month_start", "is_month_end", "is_payday"])
    oil_lags: list[int] = field(default_factory=lambda: [28, 35, 42])
    include_promotion: bool = True
    include_transactions: bool = True
    categorical: list[str] = field(default_factory=lambda: ["store_nbr", "family", "city", "state", "type", "cluster"])

    def __post_init__(self):
        _positive(expanding_min_periods=self.expanding_min_periods)
        if any(n <= 0 for n in [*self.lags, *self.rolling_windows, *self.rolling_base_lags, *self.oil_lags]):
            raise ValueError("lags and windows must be positive")


#: Sections of a feature configuration file and the settings of theirs.
FEATURE_SECTIONS = {
    "rolling": {"windows": "rolling_windows", "functions": "rolling_functions", "base_lags": "rolling_base_lags"},
    "expanding": {"functions": "expanding_functions", "min_periods": "expanding_min_periods"},
    "external": {"oil_lags": "oil_lags", "include_promotion": "include_promotion", "include_transactions": "include_transactions"},
    "categorical": {"features": "categorical"},
}


def _flat_features(given: dict) -> dict:
    """A feature file's sections as settings of ``FeatureConfig``; names that are neither stay, to be told as unknown."""
    out = {}
    for name, value in given.items():
        if name == "calendar" and isinstance(value, dict):
            unknown = set(value) - {"features", "binary"}
            if unknown:
                raise ValueError(f"unknown settings: {sorted(unknown)}")
            usual = FeatureConfig().calendar
            parts = {"features": [c for c in usual if not c.startswith("is_")], "binary": [c for c in usual if c.startswith("is_")]} | value
            out["calendar"] = [*parts["features"], *parts["binary"]]
        elif name in FEATURE_SECTIONS and (isinstance(value, dict) or value is None):
            known = FEATURE_SECTIONS[name]
            unknown = set(value or {}) - set(known)
            if unknown:
                raise ValueError(f"unknown settings: {sorted(unknown)}")
            out |= {known[k]: v for k, v in (value or {}).items()}
        else:
            out[name] = value
    return out


def from_yaml(kind: type, path: str):
    """An instance of ``kind`` with the values of a YAML file; an empty file gives the defaults."""
    if not Path(path).exists():
        raise FileNotFoundError(path)
    import yaml

    given = yaml.safe_load(Path(path).read_text()) or {}
    return _build(kind, given)


def _build(kind: type, given: dict):
    if kind is FeatureConfig:
        given = _flat_features(given)
    known = {f.metadata.get("section", f.name): f for f in fields(kind)}
    unknown = set(given) - set(known)
    if unknown:
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    nested = {"TrendConfig": TrendConfig, "BoostConfig": BoostConfig, "PipelineConfig": PipelineConfig}
    return kind(**{known[k].name: _build(nested[known[k].type], v or {}) if known[k].type in nested else v for k, v in given.items()})
