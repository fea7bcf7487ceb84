"""The shading verdict against the rule applied row by row, and the cases that a thin rule gets wrong."""

import datetime as dt

import numpy as np
import pytest

from pvloss.functions.slopes import inversions, ranked_slopes
from pvloss.operators import causes

SUN = {h: 90 - 15 * abs(h - 12) for h in range(6, 19)}
MODEL = {h: 10 - abs(h - 12) for h in range(6, 19)}


def fleet(low=lambda system, day, hour: 1.0, systems=("a",), months=(1, 6), sun=SUN):
    """Hours of 20 days in each month with the given factors, and the days; days 18 to 20 are cloudy, 17 has a fault."""
    measured, model, days = [], [], []
    for s in systems:
        for m in months:
            for d in range(1, 21):
                date = dt.date(2024, m, d)
                days.append((s, date, d < 18, d == 17))
                for h in SUN:
                    ts = dt.datetime(2024, m, d, h)
                    measured.append((s, ts, 0.8 * MODEL[h] * low(s, d, h)))
                    model.append((s, ts, float(sun[h]), float(MODEL[h])))
    return measured, model, days


def verdicts(spark, measured, model, days, systems=("a",), coarse=()):
    base = causes.shading_base(
        spark.createDataFrame(measured, "system_id string, hour_ts timestamp_ntz, actual_kwh double"),
        spark.createDataFrame(model, "system_id string, hour_ts timestamp_ntz, elevation double, model_kwh double"),
        spark.createDataFrame(days, "system_id string, date date, clear boolean, fault boolean"),
    )
    known = spark.createDataFrame([(s, s not in coarse) for s in systems], "system_id string, subdaily boolean")
    return {r.system_id: r for r in causes.shading_status(known, causes.daily_shape(base)).collect()}


def test_an_afternoon_obstruction_and_systems_that_cannot_be_tested(spark):
    low = lambda s, d, h: 0.6 if s in "ab" and h >= 16 else 0.6 if s == "c" and (h >= 16 or h <= 8) else 1.0
    names = ("a", "b", "c", "d", "none")
    got = verdicts(spark, *fleet(low, ("a", "b", "c", "d")), systems=names, coarse=("b",))
    assert {k: r.status for k, r in got.items()} == {"a": "indicated", "b": "cannot be assessed", "c": "not indicated", "d": "not indicated", "none": "insufficient data"}
    assert got["a"].side == "afternoon" and got["a"].dips == 4 and got["a"].morning == pytest.approx(1) and got["a"].afternoon == pytest.approx(0.6)
    assert got["c"].side == "both ends of the day" and got["d"].dips == 0 and got["d"].side is None


def test_cloudy_and_faulty_days_make_no_dip(spark):
    low = lambda s, d, h: 0.1 if d >= 17 and h == 9 else 1.0
    measured, model, days = fleet(low)
    assert verdicts(spark, measured, model, days)["a"].dips == 0
    shaped = causes.daily_shape(causes.shading_base(*[spark.createDataFrame(r, k) for r, k in ((measured, "system_id string, hour_ts timestamp_ntz, actual_kwh double"), (model, "system_id string, hour_ts timestamp_ntz, elevation double, model_kwh double"), (days, "system_id string, date date, clear boolean, fault boolean"))]))
    assert shaped.select("date").distinct().count() == 32 and shaped.where("shape < 0.99").count() == 0


def test_a_missing_season_fails_the_clock(spark):
    low = lambda s, d, h: 0.6 if h >= 16 else 1.0
    assert verdicts(spark, *fleet(low, months=(1, 2)))["a"].status == "cannot be assessed"
    late = lambda s, d, h: 0.2 if h < 12 else 1.0
    assert verdicts(spark, *fleet(late))["a"].status == "cannot be assessed"  # the day's centre is over 20 minutes late


def test_low_sun_ends_below_its_upper_bound(spark):
    sun = {**SUN, 7: 25, 17: 25, 8: 40, 16: 40}
    low = lambda s, d, h: 0.6 if h == 17 else 1.0
    got = verdicts(spark, *fleet(low, sun=sun))["a"]
    assert got.dips == 2 and got.morning is None and got.afternoon is None and got.status == "not indicated"  # 25 degrees are not low


def test_months_of_a_dip(spark):
    low = lambda s, d, h: 0.7 if h in (16, 17) else 1.0
    measured, model, days = fleet(low, months=(1, 5, 6))
    measured = [(s, t, e if t.month != 5 or t.hour != 16 else e / 0.7) for s, t, e in measured]
    base = causes.shading_base(*[spark.createDataFrame(r, k) for r, k in ((measured, "system_id string, hour_ts timestamp_ntz, actual_kwh double"), (model, "system_id string, hour_ts timestamp_ntz, elevation double, model_kwh double"), (days, "system_id string, date date, clear boolean, fault boolean"))])
    got = {r.hour: (r.months, round(r.dip_pct, 6)) for r in causes.dip_hours(causes.recurring_dips(causes.daily_shape(base))).collect()}
    assert got == {16: ([1, 6], 30.0), 17: ([1, 5, 6], 30.0)}


def test_gap_days_are_those_without_data(spark):
    day = lambda i: dt.date(2024, 1, i)
    f = spark.createDataFrame([("a", day(i), False, i == 2, 0.0, 1.0, 20.0) for i in range(1, 6)], "system_id string, date date, flagged boolean, outage boolean, loss_fraction double, smooth_ratio double, t2m_c double")
    days = spark.createDataFrame([("a", day(i), i == 4) for i in range(1, 6)], "system_id string, date date, flag_gap boolean")
    r = causes.outage_evidence(f, days).first()
    assert (r.outage_days, r.gap_days, r.deep_days, r.status) == (1, 1, 0, "indicated")


@pytest.mark.parametrize("kind", range(5))
def test_slopes_by_rank_equal_all_pairs(kind):
    rng = np.random.default_rng(kind)
    for n in (2, 3, 30, 300, 900):
        x = np.sort(rng.choice(4000, n, replace=False)).astype(float)
        y = [rng.normal(size=n), np.round(rng.normal(size=n), 1), np.zeros(n), 0.3 * x, rng.integers(0, 3, n) * 0.1][kind]
        i, j = np.triu_indices(n, 1)
        want = np.sort((y[j] - y[i]) / (x[j] - x[i]))
        ranks = [0, len(want) - 1, (len(want) - 1) // 2, len(want) // 2, len(want) // 6]
        assert np.allclose(ranked_slopes(x, y, ranks, few=0), want[ranks], rtol=1e-9, atol=1e-13)
        assert np.allclose(ranked_slopes(x, y, ranks), want[ranks], rtol=1e-9, atol=1e-13)


def test_inversions_are_counted_and_listed():
    rng = np.random.default_rng(9)
    for n in (0, 1, 2, 7, 33):
        v = rng.integers(0, 5, n).astype(float)
        want = sorted((a, b) for a in range(n) for b in range(a + 1, n) if v[a] >= v[b])
        count, a, b = inversions(v, 10_000)
        assert count == len(want) and sorted(zip(a.tolist(), b.tolist(), strict=True)) == want


def test_ten_thousand_points_in_one_interval_take_little_memory():
    import tracemalloc

    x = np.arange(10_000.0)
    y = 1 - 1e-4 * (x % 90) + np.random.default_rng(2).normal(size=len(x)) * 0.02
    tracemalloc.start()
    middle = ranked_slopes(x, y, [len(x) * (len(x) - 1) // 4])[0]
    assert tracemalloc.get_traced_memory()[1] < 20e6
    tracemalloc.stop()
    below = sum(int(((y[i + 1 :] - y[i]) < middle * (x[i + 1 :] - x[i]) * (1 + 1e-9)).sum()) for i in range(len(x) - 1))
    assert abs(below - len(x) * (len(x) - 1) // 4) <= 2
