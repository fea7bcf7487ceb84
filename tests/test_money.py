"""Money, emissions, records of systems and datasets, worked out by hand."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from pvloss.functions.settings import DEFAULT as S
from pvloss.operators import loss_bootstrap, money
from pvloss.sources import files

MONTH = S.days_per_month


def test_money_ranges_and_verdicts(spark):
    loss = spark.createDataFrame(
        [("low", 100.0, 40.0, 3044, 90.0, 120.0, 10.0, 50.0), ("high", 1000.0, 900.0, 3044, 950.0, 1100.0, 800.0, 950.0), ("wide", 500.0, 300.0, 3044, 300.0, 900.0, 100.0, 700.0), ("free", 10.0, 1.0, 3044, 9.0, 11.0, 1.0, 2.0), ("half", 0.5, 0.0, 3044, 0.5, 1.5, None, None)],
        "system_id string, lost_kwh double, moderate_kwh double, period_days int, lost_lo double, lost_hi double, moderate_lo double, moderate_hi double",
    )
    systems = spark.createDataFrame([("low", 5.0, 30.0), ("high", 5.0, 30.0), ("wide", 5.0, 15.0), ("free", None, 30.0), ("half", 1.0, 1.0)], "system_id string, tariff double, cleaning_cost double")
    got = {r.system_id: r for r in money.economics(loss, systems).collect()}
    assert {k: r.verdict for k, r in got.items()} == {"low": "does not pay", "high": "pays", "wide": "uncertain", "free": "not available", "half": "uncertain"}
    r = got["high"]
    assert (r.months, r.money_lost, r.money_lost_lo, r.money_lost_hi) == (100.0, 5000.0, 4750.0, 5500.0)
    assert (r.money_lost_per_month, r.money_lost_per_month_lo, r.money_lost_per_month_hi) == (50.0, 48.0, 55.0)  # 47.5 and 55: half to even
    assert (r.moderate_per_month, r.moderate_per_month_lo, r.moderate_per_month_hi) == (45.0, 40.0, 48.0)
    assert got["free"].money_lost is None and got["half"].money_lost == 0.0 and got["half"].money_lost_hi == 2.0
    bare = money.economics(loss.select("system_id", "lost_kwh", "moderate_kwh", "period_days"), systems).where("system_id = 'high'").first()
    assert bare.verdict == "uncertain" and bare.money_lost == 5000.0 and bare.money_lost_lo is None


def test_emissions_have_the_range_of_the_loss(spark):
    loss = spark.createDataFrame([("a", 10.0, 8.0, 14.0)], "system_id string, lost_kwh double, lost_lo double, lost_hi double")
    assert tuple(money.emissions(loss, 0.5).select("emissions_kg", "emissions_kg_lo", "emissions_kg_hi").first()) == (5.0, 4.0, 7.0)
    assert tuple(money.emissions(loss, None).select("emissions_kg", "emissions_kg_lo").first()) == (None, None)


def test_record_of_a_run_and_borrowed_months(spark):
    rows = [("a", None, True, 0.9, False, False, 0.0), ("a", 5.0, True, None, False, False, 0.0), ("a", 5.0, True, None, True, False, 0.0), ("a", 5.0, False, 0.6, False, True, 0.4), ("b", 5.0, True, 0.9, False, True, 0.1)]
    f = spark.createDataFrame(rows, "system_id string, ghi double, valid boolean, smooth_ratio double, outage boolean, flagged boolean, loss_fraction double")
    monthly = spark.createDataFrame([("a", m, 1.0 if m < 11 else None) for m in range(2, 13)], "system_id string, month int, value double")
    got = {r.system_id: tuple(r)[1:] for r in money.run_quality(f, monthly).collect()}
    assert got == {"a": (1, 1, 1, "1,11,12"), "b": (0, 0, 0, "1,2,3,4,5,6,7,8,9,10,11,12")}


def test_headline_names_places_or_gives_coordinates(spark):
    rows = [("x", "s1", date(2020, 1, 1), date(2020, 12, 31), True, None, 10.0, 20.006, 0.03), ("x", "s2", date(2020, 3, 1), date(2021, 12, 31), False, " ", 10.0, 20.006, 0.05), ("y", "s3", date(2020, 1, 1), date(2020, 2, 1), True, "Pune", 1.0, 2.0, None)]
    d = spark.createDataFrame(rows, "data_label string, system_id string, start date, end date, subdaily boolean, location string, latitude double, longitude double, detection_limit double")
    got = {r.data_label: r for r in money.headline(d).collect()}
    assert (got["x"].systems, got["x"].months, got["x"].resolution, got["x"].locations, got["x"].limit_min, got["x"].limit_max) == (2, 22, "daily", "10.00°, 20.01°", 0.03, 0.05)
    assert (got["y"].resolution, got["y"].locations, got["y"].limit_min) == ("hourly", "Pune", None)


def test_nested_summaries_keep_finite_numbers_only(spark, tmp_path):
    d = spark.createDataFrame([("a", (1.000049, float("nan")), [(float("inf"), 2)]), ("b", None, None)], "system_id string, loss struct<x: double, y: double>, runs array<struct<v: double, n: int>>")
    files.write_summary(d, str(tmp_path / "out"))
    got = {r.system_id: r for r in spark.read.schema(d.schema).json(str(tmp_path / "out")).collect()}
    assert tuple(got["a"].loss) == (1.0, None) and tuple(got["a"].runs[0]) == (None, 2) and got["b"].loss is None


def test_portfolio_money_needs_all_tariffs(spark):
    replicates = spark.createDataFrame([(s, k, float(k + 1)) for s in ("a", "b", "c") for k in range(3)], "system_id string, replicate int, lost double")
    systems = spark.createDataFrame([("a", "x", 2.0), ("b", "x", 3.0), ("c", "y", None)], "system_id string, data_label string, tariff double")
    got = {(r.data_label, r.replicate): r.lost for r in money.portfolio_replicates(replicates, systems, tariff=True).collect()}
    assert got == {**{("x", k): 5.0 * (k + 1) for k in range(3)}, **{("y", k): None for k in range(3)}}
    assert money.portfolio_replicates(replicates, systems).where("data_label = 'x'").agg(F.sum("lost")).first()[0] == pytest.approx(12.0)


def test_portfolio_ranges_are_all_or_nothing_and_hold_their_points(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    loss = [("a", "ok", 100.0, 1000.0), ("b", "ok", 50.5, 700.0), ("c", "ok", 9.0, 90.0), ("d", "too few clear days", 0.0, 0.0), ("e", "ok", 30.0, 300.0), ("f", "ok", 1.0, 10.0)]
    systems = [("a", "x", 2.0), ("b", "x", 3.0), ("c", "y", None), ("d", "x", None), ("e", "z", 1.0), ("f", "z", 1.0), ("g", "empty", 1.0)]
    draws = {k: (rng.uniform(0.8, 0.9, 50) * lost, rng.uniform(0.9, 1.1, 50) * exp) for k, _, lost, exp in loss if k in "abce"}
    rows = [(k, i, float(x[i]), float(y[i])) for k, (x, y) in draws.items() for i in range(50)]
    got = money.portfolio_ranges(
        spark.createDataFrame(rows, "system_id string, replicate int, lost double, expected double"),
        spark.createDataFrame(loss, "system_id string, status string, lost_kwh double, expected_kwh double"),
        spark.createDataFrame(systems, "system_id string, data_label string, tariff double"),
    ).collect()
    got = {r.data_label: r for r in got}
    assert set(got) == {"x", "y", "z"}
    x, lost, exp = got["x"], draws["a"][0] + draws["b"][0], draws["a"][1] + draws["b"][1]
    assert (x.systems, x.lost_kwh, x.money_lost) == (2, 150.5, 200.0 + 152.0)
    assert x.lost_lo == pytest.approx(np.percentile(lost, 2.5)) and x.lost_hi == 150.5  # widened to the point
    assert x.loss_pct_lo == pytest.approx(np.percentile(100 * lost / exp, 2.5)) and x.loss_pct_hi == pytest.approx(max(np.percentile(100 * lost / exp, 97.5), 100 * 150.5 / 1700))
    assert x.money_lo == pytest.approx(np.percentile(2 * draws["a"][0] + 3 * draws["b"][0], 2.5)) and x.money_hi == 352.0
    assert got["y"].money_lost is None and got["y"].money_lo is None and got["y"].lost_lo is not None  # no tariff
    assert got["z"].lost_lo is None and got["z"].loss_pct_hi is None and got["z"].money_lost == 31.0 and got["z"].money_lo is None  # f has no replicates


def test_nested_parts_of_records(spark):
    base = spark.createDataFrame([("a",), ("b",)], "system_id string")
    one = spark.createDataFrame([("a", 1.5, None)], "system_id string, x double, y string")
    many = spark.createDataFrame([("a", 2, "q"), ("a", 1, "r")], "system_id string, n int, m string")
    got = {r.system_id: r for r in money.nested(base, {"one": one}, {"many": many}, "system_id").collect()}
    assert tuple(got["a"].one) == (1.5, None) and [tuple(x) for x in got["a"].many] == [(1, "r"), (2, "q")] and got["b"].one is None and got["b"].many == []


def test_prices_that_are_missing(spark, tmp_path):
    (tmp_path / "s.csv").write_text("system_id,capacity_kwp,latitude,longitude,tilt_deg,azimuth_deg,tariff,cleaning_cost\n a,5,10,73,,,,3\nb,5,10,73,1,2,7,8\nc,5,10,73,1,2,x, \n")
    systems = files.read_systems(spark, str(tmp_path / "s.csv"))
    assert {r.system_id: (r.location, r.utc_offset_hours) for r in systems.collect()} == {k: ("", 5.0) for k in "abc"}
    assert {r.system_id: r.missing for r in files.economic_warnings(systems).collect()} == {"a": ["tariff"], "c": ["tariff", "cleaning_cost"]}


def test_ends_of_a_range_share_one_aggregate(spark):
    """An aggregate of exact percentiles holds all values of its group, so a kind has one for both its ends."""
    draws = spark.createDataFrame([("S", k, float(k), float(k % 7), 0.0, 0.0, float(k), 100.0) for k in range(41)], "system_id string, replicate int, lost double, sustained double, outage double, deep double, moderate double, expected double")
    loss = spark.createDataFrame([("S", 20.0, 3.0, 0.0, 0.0, 20.0, 20.0)], "system_id string, lost_kwh double, sustained_kwh double, outage_kwh double, deep_kwh double, moderate_kwh double, loss_pct double")
    ranges, interval = loss_bootstrap.loss_ranges(draws, loss), money.percentile_interval(draws, ["system_id"], "lost")
    for d, kinds in ((ranges, 6), (interval, 1)):
        assert d._jdf.queryExecution().optimizedPlan().toString().count("percentile(") == kinds
        row = d.first()
        assert [row[k] for k in (("lost_lo", "lost_hi") if kinds > 1 else ("lo", "hi"))] == pytest.approx([1.0, 39.0])
