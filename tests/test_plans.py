"""Registered queries do the whole job: a small fixture stands in for the analysed frame."""

from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from pvloss.functions.settings import DEFAULT as S
from pvloss.operators import bootstrap, causes, detect, events, loss_bootstrap, money, validation
from pvloss.operators.frame import performance_index
from pvloss.plans import cause_queries, chain, event_queries, feeds, output_queries, range_queries, source_queries

from test_analysis import SCHEMA, plant


@pytest.fixture(scope="module")
def analysed(spark):
    rows = plant(years=3, systems=("A", "B"))
    for r in rows:
        day = (r[1] - rows[0][1]).days
        if r[0] == "B" and 0 <= day - 800 < 60:
            r[2] *= 0.88
        if 500 <= day < 504:
            r[2] = 0.0
    return detect.analyse_frame(performance_index(spark.createDataFrame([tuple(r) for r in rows], SCHEMA))).persist()


@pytest.fixture
def plans(spark, analysed, monkeypatch):
    """The feeds and the chain of the name "fixture"; shared frames are kept by that name."""
    systems = spark.createDataFrame([("A", "x", 2.0, 150.0), ("B", "x", 3.0, 150.0)], "system_id string, data_label string, tariff double, cleaning_cost double")
    monkeypatch.setattr(chain, "analysed", lambda *_: analysed)
    monkeypatch.setattr(chain, "state", lambda *_: ())
    monkeypatch.setattr(feeds, "systems", lambda *_: systems)
    chain.forget()
    return analysed


def test_portfolio_adds_up_all_replicates_with_outages(spark, plans):
    noise = detect.noise_profile(plans)
    got = loss_bootstrap.loss_replicates(plans, noise).collect()
    lost, money, outage = np.zeros(S.samples), np.zeros(S.samples), np.zeros(S.samples)
    for r in got:
        lost[r.replicate] += r.lost
        money[r.replicate] += r.lost * {"A": 2, "B": 3}[r.system_id]
        outage[r.replicate] += r.outage
    assert (outage > 0).all()
    (row,) = output_queries.QUERIES["p02_portfolio_range"](spark, "fixture").collect()
    assert (row.lo, row.hi) == pytest.approx(tuple(np.quantile(lost, [0.025, 0.975])), abs=2e-3)
    rows = output_queries.QUERIES["p03_portfolio_money"](spark, "fixture").collect()
    assert len(rows) == S.samples and all(r.money == pytest.approx(money[r.replicate], abs=2e-3) for r in rows)
    (row,) = output_queries.QUERIES["p03_money_range"](spark, "fixture").collect()
    lo, hi = np.quantile(money, [0.025, 0.975])
    assert (row.money_lo, row.money_hi) == pytest.approx((min(lo, row.money_lost), max(hi, row.money_lost)), abs=2e-3)


def test_block_draws_and_their_interval_have_all_replicates(spark, plans):
    sums = output_queries.QUERIES["d10_block_indices"](spark, "fixture").where("system_id = 'B'").toPandas().set_index("replicate").sort_index()
    sizes = output_queries.daily_lost(spark, "fixture").groupBy("system_id").agg(F.count("*").alias("m"))
    draws = bootstrap.block_indices(sizes, S.samples, S.block_days).where("system_id = 'B'").toPandas()
    assert len(sums) == draws["replicate"].nunique() == S.samples
    by = draws.assign(w=draws["place"].astype("int64") * draws["idx"]).groupby("replicate")
    assert sums["places"].tolist() == by["idx"].sum().tolist() and sums["in_order"].tolist() == by["w"].sum().tolist() and (sums["draws"] == by.size()).all()
    days = plans.where("system_id = 'B' and valid and expected_kwh is not null and not outage").orderBy("date").toPandas()
    lost = (days["expected_kwh"] * days["loss_fraction"]).to_numpy(float)
    totals = np.bincount(draws["replicate"], lost[draws["idx"]])
    (row,) = output_queries.QUERIES["d11_percentile_interval"](spark, "fixture").where("system_id = 'B'").collect()
    assert (row.lo, row.hi) == pytest.approx(tuple(np.quantile(totals, [0.025, 0.975])), abs=2e-3)


def test_best_event_of_equals_has_the_narrowest_interval(spark, monkeypatch):
    first, noise = date(2020, 1, 1), {("P", 40): 0.05, ("P", 120): 0.01, ("P", 200): 0.02, ("Q", 30): 0.03, ("R", 60): 0.04}
    days = [(s, first + timedelta(at + k), True, False, 1 + e * (-1) ** k * (1 + k % 3), 5.0, 0.0) for (s, at), e in noise.items() for k in range(-14, 15)]
    f = spark.createDataFrame(days, "system_id string, date date, clear boolean, fault boolean, ratio double, expected_kwh double, precip_mm double")
    chosen = spark.createDataFrame([(s, first + timedelta(at), first + timedelta(at), "rain") for s, at in noise], "system_id string, start date, end date, type string")
    monkeypatch.setattr(chain, "state", lambda *_: ())
    monkeypatch.setattr(event_queries, "faulty", lambda *_: f)
    monkeypatch.setattr(event_queries, "chosen", lambda *_: chosen)
    monkeypatch.setattr(feeds, "systems", lambda *_: spark.createDataFrame([("P", "x"), ("Q", "x"), ("R", "y")], "system_id string, data_label string"))
    got = {r[0]: (r.start - first).days for q in ("v07_clearest_event", "v08_headline_event") for r in event_queries.QUERIES[q](spark, "ties").collect()}
    want = {}
    for (s, at), e in noise.items():
        for key in (s, "y" if s == "R" else "x"):
            want[key] = min(want.get(key, (9, 0)), (e, at))
    assert got == {k: at for k, (_, at) in want.items()}


def test_clearest_event_draws_for_events_with_most_clear_days_alone(spark, monkeypatch):
    first, at = date(2020, 1, 1), {20: 14, 60: 9, 100: 14, 140: 8}  # clear days before the event
    days = [("P", first + timedelta(x + k), k >= -n, False, 1 + 0.01 * (k % 3) + (x == 20) * 0.02 * (k % 2), 5.0, 0.0) for x, n in at.items() for k in range(-14, 15)]
    f = spark.createDataFrame(days, "system_id string, date date, clear boolean, fault boolean, ratio double, expected_kwh double, precip_mm double")
    chosen = spark.createDataFrame([("P", first + timedelta(x), first + timedelta(x), "rain") for x in at], "system_id string, start date, end date, type string")
    drawn, intervals = [], events.event_intervals
    monkeypatch.setattr(chain, "state", lambda *_: ())
    monkeypatch.setattr(event_queries, "faulty", lambda *_: f)
    monkeypatch.setattr(event_queries, "chosen", lambda *_: chosen)
    monkeypatch.setattr(events, "event_intervals", lambda f, e, *a: drawn.extend((r.start - first).days for r in e.collect()) or intervals(f, e, *a))
    chain.forget()
    (row,) = event_queries.QUERIES["v07_clearest_event"](spark, "rivals").collect()
    assert (row.start - first).days == 100 and sorted(drawn) == [20, 100]


def test_verdict_is_uncertain_where_the_range_straddles_the_cost(spark, plans, monkeypatch):
    rows = {r.system_id: r for r in event_queries.loss_rows(spark, "fixture").collect()}
    draws = loss_bootstrap.loss_replicates(plans, detect.noise_profile(plans)).where("system_id = 'B'").toPandas()["moderate"]
    months = rows["B"].period_days / S.days_per_month
    lo, hi = min(np.quantile(draws, 0.025), rows["B"].moderate_kwh), max(np.quantile(draws, 0.975), rows["B"].moderate_kwh)
    assert hi > lo
    for cost, want in (((lo * 0.01 + hi * 0.99), "uncertain"), (lo * 0.99 - 1, "pays"), (hi * 1.01, "does not pay"), (None, "not available")):
        systems = spark.createDataFrame([("B", "x", 1.0, cost and float(cost / months))], "system_id string, data_label string, tariff double, cleaning_cost double")
        monkeypatch.setattr(feeds, "systems", lambda *_, systems=systems: systems)
        assert event_queries.QUERIES["e02_verdict"](spark, "fixture").where("system_id = 'B'").first().verdict == want
    assert money.economics(event_queries.loss_rows(spark, "fixture"), systems.withColumn("cleaning_cost", F.lit(1e9))).where("system_id = 'B'").first().verdict == "uncertain"


def test_event_intervals_and_ageing_ranges_have_all_samples(spark, plans, monkeypatch):
    used = {}
    intervals, ageing = events.event_intervals, causes.year_on_year_range
    monkeypatch.setattr(feeds, "events", lambda *_: spark.createDataFrame([("A", date(2020, 7, 1), "cleaning", "")], "system_id string, date date, type string, note string"))
    few = plans.where("system_id = 'A'")
    monkeypatch.setattr(chain, "analysed", lambda *_: few)
    got = event_queries.QUERIES["v05_event_intervals"](spark, "one system").collect()
    f = event_queries.faulty(spark, "one system")
    want = intervals(f, event_queries.chosen(spark, "one system", f), samples=2000).collect()
    assert len(got) == len(want) == 1 and (got[0].change_lo, got[0].change_hi) == pytest.approx((want[0].change_lo, want[0].change_hi), abs=1e-4)
    monkeypatch.setattr(causes, "year_on_year_range", lambda f, s=S: used.update(samples=s.samples) or ageing(f, s))
    cause_queries.QUERIES["c11_year_on_year_range"](spark, "one system")
    assert used["samples"] == 2000


def test_sweep_has_all_places_and_sizes(spark, plans, monkeypatch):
    seen = {}
    monkeypatch.setattr(validation, "detection_rates", lambda f, scenarios, s=S: seen.update(rows=scenarios, s=s) or scenarios)
    range_queries.QUERIES["x04_detection_rates"](spark, "fixture")
    assert (seen["s"].trials, len(seen["s"].multiples)) == (30, 6)
    n = seen["rows"].groupBy("system_id").count().collect()
    assert n and all(r["count"] == 30 * 6 * len(S.windows_days) for r in n)


def test_sheets_and_day_files_hold_the_whole_feed(spark, monkeypatch):
    days = [date(1996, 12, 19), date(1996, 12, 31), date(1997, 2, 10), date(1997, 2, 11), date(1998, 6, 30)]
    rows = [(s, x, k + i / 4) for k, s in enumerate(("S0", "S1")) for i, x in enumerate(days)]
    monkeypatch.setattr(feeds, "daily", lambda *_: spark.createDataFrame(rows, "system_id string, date date, energy_kwh double"))
    got = source_queries.QUERIES["s09_tidy_sheet"](spark, "sheets").select("system_id", "date", "energy_kwh").collect()
    assert sorted(map(tuple, got)) == rows
    asked = {}
    reader = source_queries.files.read_day_files
    monkeypatch.setattr(source_queries.files, "read_day_files", lambda s, path, *a: asked.update(path=path) or reader(s, path, *a))
    got = source_queries.QUERIES["s04_read_day_files"](spark, "days").collect()
    assert sorted((r.system_id, r.date, r.energy_kwh) for r in got) == [r for r in rows if r[1] in days[1:3]]
    assert spark.read.option("header", True).csv(asked["path"]).count() == len(rows)
