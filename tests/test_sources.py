import json
from datetime import date

from pyspark.sql import functions as F

from pvloss.functions import solar
from pvloss.operators import hourly_model
from pvloss.sources import files


def test_weather_fill_values_become_null(spark, tmp_path):
    p = tmp_path / "w.json"
    p.write_text("\n".join(json.dumps({"system_id": s, **h, "properties": {"parameter": {"T2M": {"20200101": v, "20200102": 3.0}}}}) for s, h, v in [("a", {}, -999.0), ("b", {"header": {"fill_value": -1.0}}, -1.0)]))
    got = {(r.system_id, r.date): r.t2m_c for r in files.read_weather(spark, str(p)).collect()}
    assert got == {(s, date(2020, 1, d)): v for s in "ab" for d, v in ((1, None), (2, 3.0))}


def test_sheet_without_numbers_is_empty(spark):
    d = spark.createDataFrame([("Title", None, None), ("Month", "Day", "Main"), ("2", "29", "5.5"), ("2", "28", "x")], "a string, b string, c string")
    got = files.tidy_month_sheet(d, 2020, "a", "b", "c")
    assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == [(date(2020, 2, 28), None), (date(2020, 2, 29), 5.5)]
    assert files.tidy_month_sheet(d.limit(2), 2020, "a", "b", "c").count() == 0


def test_sun_stands_where_it_should(spark):
    """Noon height at the solstices and the equator's twelve-hour day, within half a degree."""
    d = spark.createDataFrame([(172, 50.0), (355, 50.0), (80, 0.0)], "doy int, lat double")
    dec = solar.declination(solar.day_angle(F.col("doy")))
    up = [r[0] for r in d.select(F.degrees(F.asin(solar.sin_elevation(F.lit(0.0), dec, F.col("lat"))))).collect()]
    assert all(abs(a - b) < 0.5 for a, b in zip(up, (63.4, 16.6, 90.0)))
    days = spark.createDataFrame([("a", date(2020, 3, 20), 0.0, 0.0, 0.0), ("b", date(2020, 12, 21), 80.0, 0.0, 0.0)], "system_id string, date date, latitude double, longitude double, utc_offset_hours double")
    (row,) = hourly_model.sun_windows(days).collect()
    assert row.system_id == "a" and 11.2 < (row.set - row.rise) / 3.6e9 < 11.6


def test_flat_array_sees_the_global_irradiation(spark):
    """Tilt zero: the plane's irradiation is the global one, so the model follows from it alone."""
    w = spark.sql("select 'a' as system_id, timestamp_ntz'2020-06-21 11:00:00' as hour_utc, 800e0 as ghi, 25e0 as t2m_c")
    s = spark.sql("select 'a' as system_id, 30e0 as latitude, 0e0 as longitude, 0e0 as tilt_deg, 180e0 as azimuth_deg, 10e0 as capacity_kwp, 2e0 as utc_offset_hours")
    (row,) = hourly_model.hourly_model(w, s).collect()
    assert abs(row.model_kwh - 8 * (1 - 0.004 * 25)) < 0.02 and row.hour_ts.hour == 13
    assert hourly_model.hourly_model(w.withColumn("ghi", F.lit(None).cast("double")), s).first().model_kwh is None


def test_day_files_of_one_and_of_many_systems(spark, tmp_path, monkeypatch):
    """The feed takes one file a day, not one for each system and day; files of single systems are read as before."""
    from pvloss.plans import feeds, source_queries

    days = [date(1996, 12, 31), date(1997, 1, 1), date(1997, 5, 1)]
    rows = [(f"S{k}", d, k + i / 2) for k in range(12) for i, d in enumerate(days)]
    daily = spark.createDataFrame(rows, "system_id string, date date, energy_kwh double")
    monkeypatch.setattr(feeds, "daily", lambda *_: daily)
    reader, asked = files.read_day_files, {}
    monkeypatch.setattr(source_queries.files, "read_day_files", lambda s, path, *a: asked.update(path=path) or reader(s, path, *a))
    wanted = [r for r in rows if r[1] in days[:2]]
    got = source_queries.QUERIES["s04_read_day_files"](spark, "days").collect()
    assert sorted((r.system_id, r.date, r.energy_kwh) for r in got) == sorted(wanted)
    written = spark.read.option("header", True).csv(asked["path"])
    assert len(written.inputFiles()) == len(days) and written.count() == len(rows)
    single = daily.where("system_id in ('S1', 'S2')").select("system_id", F.year("date").alias("year"), F.month("date").alias("month"), F.day("date").alias("day"), "energy_kwh")
    single.write.partitionBy("system_id", "year", "month", "day").option("header", True).csv(str(tmp_path / "own"))
    got = reader(spark, str(tmp_path / "own"), "1996-12-20", "1997-02-10").collect()
    assert sorted((r.system_id, r.date, float(r.energy_kwh)) for r in got) == sorted(r for r in wanted if r[0] in ("S1", "S2"))
    assert reader(spark, str(tmp_path / "own"), "2001-01-01", "2001-02-01").count() == 0


def test_hours_of_days_that_are_dealt_by_system_are_not_shuffled(spark):
    """Before, every hour went to its system's payload through shuffles of its own, and each part of the years made all hours again."""
    from pvloss.functions.common import dealt
    from pvloss.plans.solar_queries import hourly_weather
    from pvloss.plans.source_queries import weather_payload

    rows = [(s, date(y, 7, 1), 5.0 + k, 25.0 if k else None) for k, s in enumerate("ab") for y in (1996, 1997)]
    days = spark.createDataFrame(rows, "system_id string, date date, ghi double, t2m_c double")
    w = hourly_weather(spark, None, dealt(days, ["system_id"])).withColumn("from", F.year("hour_utc"))
    got = weather_payload(w, F.date_format("hour_utc", "yyyyMMddHH"), ["from"])
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    for r in got.collect():
        values = r.properties["parameter"]
        keys = [f"{r['from']}0701{h:02d}" for h in range(24)]
        assert sorted(values) == ["ALLSKY_SFC_SW_DWN", "T2M"] and all(sorted(v) == keys for v in values.values())
        assert set(values["T2M"].values()) == {25.0 if r.system_id == "b" else -99.0}
