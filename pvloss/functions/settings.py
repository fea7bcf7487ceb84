"""All thresholds of the analysis, as one frozen value. Fixed values of the method."""

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    # readings
    min_daylight_coverage: float = 0.90
    max_counter_gap_hours: float = 18.0
    max_capacity_factor: float = 1.3
    max_daily_specific_yield: float = 9.5
    negative_clip_fraction: float = 0.02
    daylight_min_elevation_deg: float = 5.0
    logging_gap_step_factor: float = 1.5
    counter_min_rising_share: float = 0.995
    daily_reset_min_rising_share: float = 0.9
    daily_reset_drops_per_day: tuple = (0.5, 1.5)
    daily_reset_max_restart: float = 0.2
    unit_peak_quantile: float = 0.995
    plausible_peak_fraction: tuple = (0.3, 1.5)
    plausible_daily_yield: tuple = (0.3, 9.0)
    dark_day_peak_fraction: float = 0.05
    straddle_min_hours: float = 0.25
    hourly_coverage: tuple = (0.9, 1.1)
    missing_flag: float = -999.0
    # expected yield
    mode: str = "auto"
    temp_coeff_per_c: float = -0.004
    noct_c: float = 45.0
    clear_day_min_clearness: float = 0.85
    min_daily_irradiation: float = 1.5
    sustained_days: int = 7
    sustained_min_days: int = 4
    sustained_max_span_days: int = 30
    trend_window_days: int = 61
    trend_min_clear_days: int = 10
    reference_quantile: float = 0.90
    reference_min_days: int = 8
    # detection
    smoothing_min_clear_days: int = 4
    min_shortfall_fraction: float = 0.03
    min_episode_days: int = 7
    release_ratio: float = 0.33
    deep_fraction: float = 0.25
    max_bridge_days: int = 21
    false_alarm_rate: float = 0.01
    power: float = 0.80
    windows_days: tuple = (14, 30)
    trend_window_multiple: int = 3
    bootstrap_min_clear_days: int = 30
    outage_max_fraction: float = 0.10
    outage_min_clearness: float = 0.50
    # bootstrap
    samples: int = 2000
    confidence: float = 0.95
    block_days: int = 7
    seed: int = 90_417
    # causes
    degradation_min_years: float = 2.0
    dip_fraction: float = 0.15
    dip_min_share_of_days: float = 0.70
    shading_min_elevation_deg: float = 15.0
    shading_min_clear_days: int = 10
    midday_hours: int = 3
    symmetry_band_deg: float = 10.0
    symmetry_min_difference: float = 0.10
    clock_max_offset_minutes: float = 20.0
    clock_max_seasonal_minutes: float = 30.0
    summer_months: tuple = (5, 6, 7, 8)
    winter_months: tuple = (11, 12, 1, 2)
    soiling_min_clear_days: int = 60
    soiling_min_loss_pct: float = 0.5
    soiling_min_points: int = 5
    soiling_min_days: int = 14
    soiling_reps: int = 300
    soiling_shuffle_runs: int = 3
    slope_band: float = 0.68
    degradation_min_pairs: int = 30
    degradation_block_days: int = 30
    cold_below_c: float = 2.0
    # events
    days_before: int = 14
    days_after: int = 14
    min_clear_days_each_side: int = 4
    heavy_rain_mm: float = 10.0
    # money
    days_per_month: float = 30.44
    # validation
    stretch_days: int = 240
    stretch_step_days: int = 7
    stretch_min_valid_share: float = 0.9
    stretch_min_clear_share: float = 0.3
    ramp_offset_days: int = 45
    ramp_days: int = 60
    ramp_fraction: float = 0.10
    outage_gap_days: int = 30
    outage_days: int = 3
    trials: int = 30
    multiples: tuple = (0.5, 1.0, 1.5, 2.0, 2.5, 3.0)


DEFAULT = Settings()
