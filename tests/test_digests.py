"""Draws in numpy against hashlib, and the work of few bytes dealt out to all tasks."""

import datetime as dt
from hashlib import md5

import numpy as np
import pytest
from pyspark.sql import functions as F

from pvloss.functions import digests
from pvloss.functions.common import many_parts
from pvloss.operators import bootstrap, causes, events

DAY = dt.date(2023, 1, 1)


def plain(text: bytes) -> float:
    return int(md5(text).hexdigest()[:12], 16) / 16**12


@pytest.mark.parametrize("together", [7, 16384])
def test_fractions_equal_hashlib_at_every_length(monkeypatch, together):
    monkeypatch.setattr(digests, "TOGETHER", together)
    ends = bootstrap.pairs(range(95, 106), range(9, 12))
    assert ends.dtype.itemsize == 6 and ends.tolist() == [b"%d|%d" % (r, k) for r in range(95, 106) for k in range(9, 12)]
    for n in range(70):
        prefix = bytes(range(1, n + 1))
        assert digests.fractions(prefix, ends).tolist() == [plain(prefix + e) for e in ends.tolist()], n


def test_draws_go_through_numpy(monkeypatch):
    """Ends of usual draws are short enough: before, each took a call of hashlib."""
    monkeypatch.setattr(digests, "md5", None)
    u = bootstrap.uniforms((90_417, "S2999", DAY, "a"), bootstrap.pairs(range(2000), range(14)))
    assert len(u) == 28_000 and u[-1] == plain(f"90417|S2999|{DAY}|a|1999|13".encode())


def test_block_sums_equal_sums_of_days():
    x, block = np.random.default_rng(1).random(31), 7
    starts = bootstrap.block_starts(("S0",), len(x), block, range(40), 1)
    days = (starts[:, :, None] + np.arange(block)).reshape(40, -1)[:, : len(x)]
    assert np.allclose(bootstrap.block_sums(x, starts, block), x[days].sum(axis=1), rtol=1e-12)
    assert np.allclose(bootstrap.block_sums(x[:3], bootstrap.block_starts(("S0",), 3, block, range(4), 1), block), x[:3].sum())


def busy(df) -> int:
    """Tasks that have rows."""
    return sum(df.rdd.mapPartitions(lambda rows: [int(any(True for _ in rows))]).collect())


def test_small_rows_of_much_work_are_dealt_out(spark):
    """Before, adaptive execution put such small partitions together: one task drew for all events, series or replicates."""
    rows = [(f"S{k}", DAY + dt.timedelta(i), True, False, 1.0 + i % 3 / 10, 1.0, 5.0) for k in range(24) for i in range(30)]
    f = spark.createDataFrame(rows, "system_id string, date date, clear boolean, fault boolean, ratio double, expected_kwh double, ghi double")
    day = DAY + dt.timedelta(15)
    found = events.event_intervals(f, spark.createDataFrame([(f"S{k}", day, day, "cleaning") for k in range(24)], "system_id string, start date, end date, type string"), samples=20)
    drawn = bootstrap.resampled(f, {"ratio": "r"}, bootstrap.block_sums, 5, 7)
    indices = bootstrap.block_indices(spark.createDataFrame([("S0", 30)], "system_id string, m int"), 40, 7)
    slopes = causes.theil_sen(f.selectExpr("system_id", "0 as part", "ratio as y", "datediff(date, date'2023-01-01') as x", "date'2023-01-01' as first_day", "date'2023-01-30' as last_day"))
    for got in (found, drawn, indices, slopes):
        assert busy(got) > many_parts(got) // 3


@pytest.mark.parametrize("share", [0.0, 0.1, 1.0])
def test_running_medians_of_columns_that_differ_in_a_part(monkeypatch, share):
    """Rows in which all columns are alike are worked through for one column; before, for all of them."""
    import pandas as pd

    from pvloss.operators import variants

    rng = np.random.default_rng(3)
    base = np.where(rng.random(400) < 0.7, rng.random(400), np.nan)
    x = np.repeat(base[:, None], variants.FEW + 3, axis=1)
    part = slice(150, 150 + int(400 * share)) if share < 1 else slice(0, 400)
    x[part] *= rng.random((1, x.shape[1]))
    x[300, 1] = np.nan if share else x[300, 1]
    worked, whole = [], variants._sorted_windows
    monkeypatch.setattr(variants, "_sorted_windows", lambda v, *a: worked.append(len(v)) or whole(v, *a))
    got = variants.rolling_median(x, 15, 4)
    assert np.array_equal(got, pd.DataFrame(x).rolling(15, center=True, min_periods=4).median().to_numpy(), equal_nan=True)
    assert sum(worked) <= {0.0: 0, 0.1: 120, 1.0: 400}[share]


def test_parts_of_the_analysis_grow_with_its_rows(spark, monkeypatch):
    """Before, their number was that of the session's shuffles, so a task's memory grew with the input."""
    from pvloss.functions import common
    from pvloss.operators import detect, frame, validation

    monkeypatch.setattr(common, "ROWS", 20)
    rows = [(f"S{k}", DAY + dt.timedelta(i), 5.0 + i % 7 / 50, True, 1.5 + i % 2 * 2, 5.0, 25.0, 0.0) for k in range(6) for i in range(100)]
    feed = common.stored(spark.createDataFrame(rows, "system_id string, date date, energy_kwh double, valid boolean, ghi double, clear_ghi double, t2m_c double, precip_mm double"), "feed")
    days = frame.on_calendar(feed.select("system_id", "date", "energy_kwh", "valid"), rows=feed.count())
    site = spark.sql("select concat('S', id) as system_id, 26e0 as latitude, 1e0 as capacity_kwp from range(6)")
    base = common.stored(frame.build_frame(days, feed.drop("energy_kwh", "valid"), site), "base")
    found = detect.analyse_frame(base)
    assert found.count() == 600 and many_parts(found) < 30
    for df in (days, found, common.dealt(found, ["system_id"], 600)):
        assert df.rdd.getNumPartitions() == 30, df.columns
    assert validation.clean_stretch(common.stored(found, "found")).count() == 0


def test_sums_over_places_come_without_a_row_for_each_place(spark):
    """Before, the query made a row for each place of each replicate to add them up."""
    sizes = spark.createDataFrame([("S0", 30), ("S1", 7), ("S2", 3), ("S3", 1), ("S4", 0), ("S5", 64)], "system_id string, m bigint")
    got = bootstrap.block_index_sums(sizes, 150, 7)
    rows = bootstrap.block_indices(sizes, 150, 7).groupBy("system_id", "replicate").agg(F.count("*").alias("draws"), F.sum("idx").alias("places"), F.sum(F.col("place").cast("bigint") * F.col("idx")).alias("in_order"))
    assert got.schema.names == rows.schema.names and sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.collect()))
    assert got.count() == 5 * 150 and "Generate" not in got._jdf.queryExecution().toString()
