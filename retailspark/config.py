"""Operator configuration: one frozen dataclass, validated on construction."""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass

# Fixed values of the forecasting and reporting workers (defaults and bounds).
DEFAULT_PREDICTION_DAYS = 7  # allowed 1..16
DEFAULT_DEFICIT_THRESHOLD = -15.0  # must be < 0, inclusive (<=)
DEFAULT_SUPERAVIT_THRESHOLD = 15.0  # must be > 0, inclusive (>=)
DEFAULT_MIN_EXAMPLES_COLD_START = 30
DEFAULT_TRAINING_WINDOW_DAYS = 2
DEFAULT_HISTORY_DAYS = 30
DEFAULT_REPORT_DAYS = 7  # allowed 1..31
DEFAULT_MAX_FEATURED = 10  # allowed 1..50
DEFAULT_RIDGE_ALPHA = 1e-4
DEFAULT_TEMPERATURE = 22.0  # forecast fallback and daily-fill fallback
TRAINING_ZERO_TEMPERATURE = 20.0  # training treats 0.0 / NULL temperature as 20.0
DEFAULT_WEATHER_CODE = 1
RETENTION_DAYS = 30


@dataclass(frozen=True)
class Config:
    prediction_days: int = DEFAULT_PREDICTION_DAYS
    deficit_threshold: float = DEFAULT_DEFICIT_THRESHOLD
    superavit_threshold: float = DEFAULT_SUPERAVIT_THRESHOLD
    min_examples_cold_start: int = DEFAULT_MIN_EXAMPLES_COLD_START
    training_window_days: int = DEFAULT_TRAINING_WINDOW_DAYS
    history_days: int = DEFAULT_HISTORY_DAYS
    report_days: int = DEFAULT_REPORT_DAYS
    max_featured: int = DEFAULT_MAX_FEATURED
    ridge_alpha: float = DEFAULT_RIDGE_ALPHA
    zero_as_missing: bool = True

    def __post_init__(self) -> None:
        if not 1 <= self.prediction_days <= 16:
            raise ValueError(f"prediction_days must be within 1..16, got {self.prediction_days}")
        if self.deficit_threshold >= 0:
            raise ValueError(f"deficit_threshold must be negative, got {self.deficit_threshold}")
        if self.superavit_threshold <= 0:
            raise ValueError(f"superavit_threshold must be positive, got {self.superavit_threshold}")
        if self.min_examples_cold_start < 1:
            raise ValueError("min_examples_cold_start must be >= 1")
        # The reference falls back to the default window when given 0 (``days or default``).
        if self.training_window_days < 0:
            raise ValueError("training_window_days must be >= 0")
        if self.history_days < 1:
            raise ValueError("history_days must be >= 1")
        if not 1 <= self.report_days <= 31:
            raise ValueError(f"report_days must be within 1..31, got {self.report_days}")
        if not 1 <= self.max_featured <= 50:
            raise ValueError(f"max_featured must be within 1..50, got {self.max_featured}")
        if self.ridge_alpha < 0:
            raise ValueError("ridge_alpha must be >= 0")


def as_date(value) -> _dt.date:
    """Accept ``date``, ``datetime`` or ISO text; operators never read the wall clock."""
    if isinstance(value, _dt.datetime):
        return value.date()
    if isinstance(value, _dt.date):
        return value
    if isinstance(value, str):
        return _dt.date.fromisoformat(value)
    raise TypeError(f"as_of must be a date, got {type(value).__name__}")
