"""The parameters of the engine, in one frozen object."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    """Steps are minutes, windows weeks or days; a table on another grid differs only in `step`."""

    step: int = 60
    fit_weeks: int = 8
    refit_weeks: int = 4
    quantiles: tuple[float, float, float] = (0.05, 0.5, 0.95)
    min_samples: int = 2
    settle_days: int = 2
    reference_weeks: int = 8
    min_reference_weeks: int = 4
    clean_day_weeks: int = 12
    odd_days_per_month: int = 3
    alarm_budget: float = 0.2
    min_duration: int = 60
    merge_gap: int = 60
    cusum_slack: float = 0.5
    cusum_limit: float = 8.0
    drift_gap: int = 2880
    load_floor: float = 0.05
    settled_minutes: int = 15
    frequency_band: tuple[float, float] = (49.0, 51.0)
    power_factor_floor: float = 0.9
    unbalance_pct: float = 2.0
    delta_t_floor: float = 4.0


DEFAULT = Config()
