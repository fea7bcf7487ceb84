"""What is put into made-up series comes out again: intervals, soiling, ageing, steps, noise."""

from dataclasses import replace
from datetime import date, timedelta

import numpy as np
import pytest

from pvloss.functions.settings import DEFAULT as S
from pvloss.operators import causes, detect, events
from pvloss.operators.frame import performance_index
from pvloss.operators.reference import find_outages

from test_analysis import SCHEMA, plant

FIRST = date(2021, 3, 1)
COLUMNS = "system_id string, date date, clear boolean, fault boolean, ratio double, pi double, ghi double, precip_mm double, expected_kwh double"


def frame(spark, series):
    """series: name -> (ratios by day, rain by day or None, clear days or None)."""
    rows = []
    for name, (ratio, rain, clear) in series.items():
        for i, r in enumerate(ratio):
            rows.append((name, FIRST + timedelta(days=i), bool(clear is None or clear[i]), False, float(r), float(r), 5.0, float(rain[i]) if rain is not None else 0.0, 40.0))
    return spark.createDataFrame(rows, COLUMNS)


def test_event_intervals_cover_the_truth(spark):
    """A nominal 95 % interval of few days holds the true change in 88 to 99 of 100 cases."""
    rng, series = np.random.default_rng(12), {}
    for k in range(240):
        clear = np.zeros(29, bool)
        clear[rng.choice(14, 5, replace=False)] = clear[15 + rng.choice(14, 5, replace=False)] = True
        series[f"s{k}"] = (np.where(np.arange(29) > 14, 1.04, 1.0) * (1 + 0.025 * rng.standard_normal(29)), None, clear)
    f = frame(spark, series)
    when = FIRST + timedelta(days=14)
    chosen = spark.createDataFrame([(n, when, when, "cleaning") for n in series], "system_id string, start date, end date, type string")
    got = events.event_intervals(f, chosen, samples=400).collect()
    share = np.mean([r.change_lo <= 4.0 <= r.change_hi for r in got])
    assert len(got) == 240 and 0.88 <= share <= 0.99
    assert np.mean([r.kwh_lo <= 1.6 <= r.kwh_hi for r in got]) == pytest.approx(share, abs=0.05)


def test_a_cleaning_step_is_found_and_no_step_is_not(spark):
    rng = np.random.default_rng(3)
    noise = lambda: 1 + 0.01 * rng.standard_normal(60)
    f = frame(spark, {"step": (np.where(np.arange(60) > 30, 0.98, 0.91) * noise(), None, None), "flat": (0.95 * noise(), None, None)})
    when = FIRST + timedelta(days=30)
    chosen = spark.createDataFrame([(n, when, when, "cleaning") for n in ("step", "flat")], "system_id string, start date, end date, type string")
    change = {r.system_id: r for r in events.compare(f, chosen).collect()}
    span = {r.system_id: r for r in events.event_intervals(f, chosen, samples=500).collect()}
    assert change["step"].change_pct == pytest.approx(100 * (0.98 / 0.91 - 1), abs=1.5) and span["step"].distinguishable
    assert abs(change["flat"].change_pct) < 1.5 and span["flat"].change_lo < 1 and span["flat"].change_hi > -1


def test_soiling_between_rains_is_measured_and_its_absence_too(spark):
    rng, n = np.random.default_rng(5), 600
    rain = np.where(np.arange(n) % 50 == 49, 25.0, 0.0)
    since = (np.arange(n) + 1) % 50
    dirty = (1 - 0.0015 * since) * (1 + 0.004 * rng.standard_normal(n))
    f = frame(spark, {"dirty": (dirty, rain, None), "clean": (1 + 0.004 * rng.standard_normal(n), rain, None)})
    dated = spark.createDataFrame([], "system_id string, date date, type string, note string")
    points = causes.soiling_points(f, causes.cleaning_dates(f, dated))
    slopes = causes.theil_sen(points.where("usable"))
    got = {r.system_id: r.soiling_loss_pct for r in causes.soiling_ratio(points, slopes).collect()}
    truth = 100 * 0.0015 * since.mean()
    assert got["dirty"] == pytest.approx(truth, rel=0.15) and got["clean"] < 0.35
    span = {r.system_id: r for r in causes.soiling_range(causes.soiling_draws(points, slopes)).collect()}
    assert span["dirty"].loss_lo < truth * 1.05 and span["dirty"].loss_hi > truth * 0.95
    status = {r.system_id: r.status for r in causes.soiling_status(points, causes.soiling_range(causes.soiling_draws(points, slopes)), nulls=causes.shuffled_losses(f, causes.cleaning_dates(f, dated))).collect()}
    assert status == {"dirty": "indicated", "clean": "not indicated"}


def test_slopes_and_bands_against_loops(spark):
    rng = np.random.default_rng(9)
    for n in (5, 23):
        x, y = np.sort(rng.choice(80, n, replace=False)), np.round(1 - 0.001 * np.arange(n) + 0.01 * rng.standard_normal(n), 2)
        rows = [("s", 1, int(a), float(b), FIRST, FIRST) for a, b in zip(x, y)]
        r = causes.theil_sen(spark.createDataFrame(rows, "system_id string, part int, x int, y double, first_day date, last_day date")).first()
        pairs = sorted((y[j] - y[i]) / (x[j] - x[i]) for i in range(n) for j in range(i + 1, n))
        assert r.slope == pytest.approx(np.median(pairs) / np.median(y)) and r.n == n
        ties = sum(t * (t - 1) * (2 * t + 5) for t in (list(y).count(v) for v in set(y)))
        half = 0.994457883 * np.sqrt((n * (n - 1) * (2 * n + 5) - ties) / 18)
        lo, hi = pairs[int(max(round((len(pairs) - half) / 2) - 1, 0))], pairs[int(min(round((len(pairs) + half) / 2), len(pairs) - 1))]
        assert r.sd == pytest.approx(max((hi - lo) / 2 / np.median(y), 1e-9), rel=1e-6)


def test_ageing_of_two_percent_a_year(spark):
    rng, n = np.random.default_rng(21), 365 * 4
    season = 1 + 0.05 * np.sin(2 * np.pi * np.arange(n) / 365)
    f = frame(spark, {"old": (season * 0.98 ** (np.arange(n) / 365) * (1 + 0.01 * rng.standard_normal(n)), None, None), "new": (season * (1 + 0.01 * rng.standard_normal(n)), None, None)})
    got = {r.system_id: r for r in causes.year_on_year(f).collect()}
    span = {r.system_id: r for r in causes.year_on_year_range(f, replace(S, samples=200)).collect()}
    assert got["old"].change_pct_per_year == pytest.approx(-2, abs=0.3) and span["old"].status == "indicated"
    assert abs(got["new"].change_pct_per_year) < 0.3 and span["new"].status == "not indicated"


def test_less_noise_gives_a_smaller_limit(spark):
    limits = []
    for scatter in (0.01, 0.02, 0.05):
        rows = [tuple(r) for r in plant(scatter=scatter)]
        f = find_outages(performance_index(spark.createDataFrame(rows, SCHEMA)))
        limits.append({r.window_days: r.detection_limit for r in detect.noise_profile(f).collect()})
    for w in S.windows_days:
        a, b, c = (x[w] for x in limits)
        assert a < b < c
    assert all(x[S.windows_days[1]] <= x[S.windows_days[0]] for x in limits)
