from datetime import date, timedelta

import numpy as np
import pytest

from pvloss.operators import detect, events, frame


def plant(seed=1, years=3, systems=("A",), scatter=0.015):
    """Days of 10 kWp plants without faults: spells of clear and overcast weather under a sky that is brightest in
    June, and a performance of 0.83 with scatter."""
    rows = []
    for k, name in enumerate(systems):
        rng, bright = np.random.default_rng([seed, k]), True
        for i in range(365 * years):
            day = date(2019, 1, 1) + timedelta(days=i)
            bright = rng.random() < (0.8 if bright else 0.45)
            sky = 7.4 - 3.6 * abs(day.timetuple().tm_yday - 172) / 193
            share = float(0.99 - 0.11 * rng.random() ** 2 if bright else rng.uniform(0.2, 0.75))
            model = 10 * sky * share
            rows.append([name, day, model * 0.83 * float(np.exp(scatter * rng.standard_normal())), True, sky * share, sky, share, 25.0, 0.0, model])
    return rows


SCHEMA = "system_id string, date date, energy_kwh double, valid boolean, ghi double, clear_ghi double, clearness double, t2m_c double, precip_mm double, model_kwh double"


def analyse(spark, rows):
    return detect.analyse_frame(frame.performance_index(spark.createDataFrame([tuple(r) for r in rows], SCHEMA)))


def test_healthy_system_has_next_to_no_loss(spark):
    assert detect.estimate_loss(analyse(spark, plant())).collect()[0].loss_pct < 0.5


def test_planted_ramp_and_outage_and_batches(spark):
    """The same answer for one system and for two in a batch; the planted loss is found."""
    two = plant(systems=("A", "B"))
    truth = 0.0
    for r in two:
        day = (r[1] - date(2020, 3, 1)).days
        if r[0] == "B" and 0 <= day < 60:
            truth += r[2] * 0.12
            r[2] *= 0.88
    f = analyse(spark, two)
    got = {r.system_id: r for r in detect.estimate_loss(f).collect()}
    assert got["A"].loss_pct < 0.5 and 0.6 < got["B"].sustained_kwh / truth < 1.3
    alone = detect.estimate_loss(analyse(spark, [r for r in two if r[0] == "B"])).collect()[0]
    assert alone.lost_kwh == pytest.approx(got["B"].lost_kwh, rel=1e-9)
    longest = max((r for r in detect.episodes(f).collect() if r.system_id == "B"), key=lambda r: r.days)
    assert longest.start < date(2020, 3, 10) and longest.end > date(2020, 4, 20)


def test_student_t_quantiles():
    for df, want in [(3, 3.1824), (10, 2.2281), (27, 2.0518)]:
        assert events.student_t_quantile(0.975, df) == pytest.approx(want, abs=2e-3)


def loop_extend(seed, allowed):
    out = list(seed)
    for i in range(1, len(out)):
        out[i] |= out[i - 1] and allowed[i]
    for i in reversed(range(len(out) - 1)):
        out[i] |= out[i + 1] and allowed[i]
    return out


def test_extend_equals_the_loop(spark):
    rng = np.random.default_rng(4)
    rows, want = [], {}
    for k in range(60):
        seed, allowed = rng.random(30) < 0.15, rng.random(30) < 0.6
        for i, (a, b, c) in enumerate(zip(seed, allowed, loop_extend(seed, allowed))):
            rows.append((str(k), date(2020, 1, 1) + timedelta(days=i), bool(a), bool(b)))
            want[str(k), rows[-1][1]] = bool(c)
    d = spark.createDataFrame(rows, "system_id string, date date, seed boolean, allowed boolean")
    assert {(r.system_id, r.date): r.keep for r in detect.extend(d, "seed", "allowed", "keep").collect()} == want
