"""Running medians against plain loops, and day files by months."""

import datetime as dt
import statistics

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pvloss.functions.rolling import Running, with_running_medians
from pvloss.operators import detect
from pvloss.sources import files

SERIES = st.lists(st.tuples(st.integers(0, 60), st.one_of(st.none(), st.integers(-5, 5).map(float))), max_size=50)


@settings(max_examples=200, deadline=None)
@given(SERIES, st.sampled_from([1, 5, 11]), st.integers(1, 4))
def test_windows_of_days(rows, width, least):
    rows = sorted(rows, key=lambda r: r[0])
    day, values = np.array([r[0] for r in rows], np.int64), np.array([np.nan if r[1] is None else r[1] for r in rows], float)
    got = Running("m", "v", width, least).of(day, values)
    for i, (d, _) in enumerate(rows):
        inside = [v for e, v in rows if abs(e - d) <= width // 2 and v is not None]
        assert got[i] == statistics.median(inside) if len(inside) >= least else np.isnan(got[i])


@settings(max_examples=200, deadline=None)
@given(SERIES, st.integers(1, 6))
def test_gaps_between_medians_are_bridged_on_their_first_days(rows, bridge):
    rows = sorted({d: v for d, v in rows}.items())
    day, values = np.array([r[0] for r in rows], np.int64), np.array([np.nan if r[1] is None else r[1] for r in rows], float)
    raw, got = Running("m", "v", 3, 2).of(day, values), Running("m", "v", 3, 2, bridge=bridge).of(day, values)
    for i, d in enumerate(day):
        before, after = [k for k in range(i) if not np.isnan(raw[k])], [k for k in range(i + 1, len(day)) if not np.isnan(raw[k])]
        if not np.isnan(raw[i]):
            assert got[i] == raw[i]
        elif before and after and d - day[before[-1]] <= bridge:
            p, q = before[-1], after[0]
            assert got[i] == raw[p] + (raw[q] - raw[p]) * ((d - day[p]) / (day[q] - day[p]))
        else:
            assert np.isnan(got[i])


def test_long_runs_in_one_order(spark):
    """Runs of days, also where days are missing, told from the series in its order: one sort."""
    first, flags = dt.date(2024, 1, 1), "1110111101111111011100" + "1111" * 3
    rows = [("S", first + dt.timedelta(k + (k > 30)), c == "1") for k, c in enumerate(flags)]
    d = detect.long_runs(spark.createDataFrame(rows, "system_id string, date date, flag boolean"), "flag", "long", 4)
    assert d._jdf.queryExecution().executedPlan().toString().count("Sort [") == 1
    want, run = {}, []
    for _, day, flag in [*rows, ("S", dt.date(2030, 1, 1), False)]:
        if run and (not flag or (day - run[-1]).days > 1):
            want |= {x: len(run) >= 4 for x in run}
            run = []
        run += [day] if flag else []
        want.setdefault(day, False)
    assert {r.date: r.long for r in d.collect()} == {x: want[x] for _, x, _ in rows} and any(want.values())


@settings(max_examples=200, deadline=None)
@given(SERIES, st.sampled_from([1, 5, 7]), st.integers(1, 4), st.sampled_from([None, 6]))
def test_windows_of_rows(rows, width, least, span):
    rows = sorted(rows, key=lambda r: r[0])
    day, values = np.array([r[0] for r in rows], np.int64), np.array([np.nan if r[1] is None else r[1] for r in rows], float)
    got = Running("m", "v", width, least, rows=True, span=span).of(day, values)
    known = [i for i, r in enumerate(rows) if r[1] is not None]
    for i in range(len(rows)):
        if i not in known:
            assert np.isnan(got[i])
            continue
        at = known.index(i)
        window = known[max(0, at - width // 2) : at + width // 2 + 1]
        fits = len(window) >= least and (span is None or rows[window[-1]][0] - rows[window[0]][0] <= span)
        assert got[i] == statistics.median(rows[j][1] for j in window) if fits else np.isnan(got[i])


def test_other_columns_go_through(spark):
    first = dt.date(2024, 1, 1)
    rows = [(k, first + dt.timedelta(n), float(n) if n % 3 else None, None if n % 2 else bool(n % 4), "x" * n) for k in ("A", None) for n in range(9)]
    d = spark.createDataFrame(rows[::-1], "system_id string, date date, v double, flag boolean, note string")
    wanted = [Running("m", "v", 3, 1), Running("r", "v", 3, 2, rows=True)]
    got = {(r.system_id, r.date): r for r in with_running_medians(d, wanted).collect()}
    assert len(got) == 18
    for k, day, v, flag, note in rows:
        r, n = got[k, day], (day - first).days
        near = [x for kk, e, x, *_ in rows if kk == k and abs((e - day).days) <= 1 and x is not None]
        assert (r.v, r.flag, r.note) == (v, flag, note) and r.m == statistics.median(near)
        assert (r.r is None) == (v is None), n
    assert with_running_medians(d.limit(0), wanted).columns == [*d.columns, "m", "r"]
    assert with_running_medians(d.where("false"), wanted).count() == 0


def test_infinite_values_are_unknown(spark):
    rows = [("A", dt.date(2024, 1, 1 + n), v) for n, v in enumerate([1.0, float("inf"), float("nan"), 3.0])]
    got = with_running_medians(spark.createDataFrame(rows, "system_id string, date date, v double"), [Running("m", "v", 7, 2)]).select("m").collect()
    assert [r.m for r in got] == [2.0] * 4


def test_day_files_of_some_months(spark, tmp_path):
    path = "file://" + str(tmp_path / "days")
    days = spark.createDataFrame([(k, dt.date(2023, 11, 29) + dt.timedelta(n), n) for k in ("01", "b") for n in range(40)], "system_id string, date date, v int")
    padded = F.when(F.col("system_id") == "b", F.date_format("date", "MM")).otherwise(F.month("date").cast("string"))
    parts = days.select("system_id", F.year("date").alias("year"), padded.alias("month"), F.day("date").alias("day"), "v")
    parts.where("v % 5 = 0").repartition(1).write.partitionBy("system_id", "year", "month", "day").option("header", True).csv(path)
    read = lambda a, b: sorted((r.date, int(r.v)) for r in files.read_day_files(spark, path, a, b).collect())
    want = lambda a, b: sorted((r.date, r.v) for r in days.where(f"v % 5 = 0 and date between '{a}' and '{b}'").collect())
    for a, b in [("2023-11-29", "2024-01-07"), ("2023-12-04", "2023-12-20"), ("2024-01-01", "2024-01-31"), ("2025-01-01", "2025-12-31")]:
        assert read(a, b) == want(a, b)
    assert len(want("2023-12-04", "2023-12-20")) == 8
