"""Exports with different headers, and fleets with one reading a day."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pvloss.operators import intervals as iv
from pvloss.operators import layout
from pvloss.sources import files

FILES = {
    "a.csv": 'time,ac_power\n2024-01-01 00:00,1.5\n2024-01-01 01:00,\n\n2024-01-01 02:00,"2"\n',
    "b.csv": "\ufeffenergy_kwh,stamp\r\n7,2024-02-01\r\n8,2024-02-02\r\n",
    "c.csv": 'note,"Power, AC",x,,x\n"one, ""two""",3,4,5,6,7\nshort,9\nnote,"Power, AC",x,,x\n',
    "blank.csv": "",
    "empty_lines.csv": "\n\n",
    "head_only.csv": "a,b\n",
}


def write(tmp_path, names):
    for n in names:
        (tmp_path / n).write_text(FILES[n], encoding="utf-8", newline="")
    return [str(tmp_path / n) for n in names]


def test_each_file_is_read_under_its_own_header(spark, tmp_path):
    got = [(r.file, r.column, r.position, r.value) for r in files.read_exports(spark, write(tmp_path, FILES)).orderBy("file", "row_no", "position").collect()]
    assert got == [
        ("a.csv", "time", 0, "2024-01-01 00:00"), ("a.csv", "ac_power", 1, "1.5"), ("a.csv", "time", 0, "2024-01-01 01:00"), ("a.csv", "ac_power", 1, None), ("a.csv", "time", 0, "2024-01-01 02:00"), ("a.csv", "ac_power", 1, "2"),
        ("b.csv", "energy_kwh", 0, "7"), ("b.csv", "stamp", 1, "2024-02-01"), ("b.csv", "energy_kwh", 0, "8"), ("b.csv", "stamp", 1, "2024-02-02"),
        *[("c.csv", n, i, v) for i, (n, v) in enumerate(zip(["note", "Power, AC", "x", "Unnamed: 3", "x.1"], ['one, "two"', "3", "4", "5", "6"]))],
        *[("c.csv", n, i, v) for i, (n, v) in enumerate(zip(["note", "Power, AC", "x", "Unnamed: 3", "x.1"], ["short", "9", None, None, None]))],
    ]
    assert files.read_exports(spark, write(tmp_path, ["blank.csv"])).count() == 0


@pytest.mark.parametrize("most", [100_000, 0])
def test_folder_of_many_layouts(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(files, "BROADCAST_FILES", most)
    for k in range(12):
        columns = [f"c{i}" for i in range(k % 5 + 1)]
        (tmp_path / f"f{k}.csv").write_text("\n".join([",".join(columns), *[",".join(str(100 * k + 10 * j + i) for i in range(len(columns))) for j in range(3)]]))
    rows = files.read_export_rows(spark, [str(tmp_path)]).collect()
    assert len(rows) == 36
    for r in rows:
        k = int(r.file[1:-4])
        assert [c.column for c in r.cells] == [f"c{i}" for i in range(k % 5 + 1)] and all(int(c.value) // 100 == k and int(c.value) % 10 == c.position for c in r.cells)


def daily_fleet(spark, days, per_day=1, system="d"):
    rows = [(f"{system}.csv", system, dt.datetime(2024, 2, 1) + dt.timedelta(days=i, hours=24 * j // per_day), 20.0 / per_day) for i in days for j in range(per_day)]
    return iv.sample_hours(spark.createDataFrame(rows, "file string, system_id string, ts timestamp_ntz, energy_kwh double"), keys=("file", "system_id"))


def light(df):
    days = df.select("system_id", F.explode(F.array(F.date_sub("date", 1), "date", F.date_add("date", 1))).alias("date")).distinct()
    start = iv.us(F.col("date").cast("timestamp_ntz"))
    return days.select("system_id", "date", (start + 6 * iv.HOUR_US).alias("rise"), (start + 18 * iv.HOUR_US).alias("set"))


def through(parts, sites):
    d = iv.dated(iv.flag_impossible(layout.combined(parts), sites))
    found, cover = iv.coverage(d, light(d))
    return d, found, iv.daily(found, cover, sites)


def test_forty_daily_readings_are_forty_valid_days(spark):
    sites = spark.createDataFrame([("d", 5.0)], "system_id string, capacity_kwp double")
    d, found, days = through(daily_fleet(spark, [i for i in range(41) if i != 7]), sites)
    days = {r.date: r for r in days.collect()}
    assert len(days) == 41 and sum(r.valid for r in days.values()) == 40 and min(days) == dt.date(2024, 2, 1)
    gap = days[dt.date(2024, 2, 8)]
    assert gap.flag_gap and gap.coverage is None and not gap.flag_partial and days[dt.date(2024, 3, 1)].energy_kwh == 20
    assert {r.hours for r in d.collect()} == {24.0} and iv.hourly(found).count() == 0


def test_mixed_fleet_in_one_frame(spark):
    sites = spark.createDataFrame([("d", 5.0), ("h", 5.0), ("one", 5.0), ("big", 0.1)], "system_id string, capacity_kwp double")
    parts = daily_fleet(spark, range(30)).unionByName(daily_fleet(spark, range(30), 24, "h")).unionByName(daily_fleet(spark, [3], 1, "one")).unionByName(daily_fleet(spark, range(4), 1, "big"))
    days = through(parts, sites)[2].groupBy("system_id").agg(F.count("*").alias("n"), F.count_if("valid").alias("valid"), F.count_if("flag_impossible").alias("bad")).collect()
    got = {r.system_id: (r.n, r.valid, r.bad) for r in days}
    assert got["d"] == (30, 30, 0) and got["one"] == (1, 1, 0) and got["big"] == (4, 0, 4)
    assert got["h"][0] == 30 and got["h"][1] >= 29  # its first reading, at midnight, belongs to the day before


@pytest.mark.parametrize("samples", [[5], [1], [1, 1], [1, 1, 1, 1], [1, 1, 5], [5, 1, 1], [1, 2, 9, 0, 9, 2, 1, 1], [0, 9, 1], [9, 9, 9], [1, 9]])
def test_trimmed_ends_leave_two_days(spark, samples):
    want = list(enumerate(samples))
    while len(want) > 2 and want[0][1] <= 2:
        want = want[1:]
    while len(want) > 2 and want[-1][1] <= 2:
        want = want[:-1]
    rows = [("s", dt.date(2024, 1, 1) + dt.timedelta(days=i), n) for i, n in enumerate(samples)]
    got = iv.trimmed(spark.createDataFrame(rows, "system_id string, date date, n_samples long")).collect()
    assert sorted((r.date.day - 1, r.n_samples) for r in got) == want
