from datetime import datetime, timedelta

import numpy as np
import pytest

from pvloss.operators import intervals as iv

START = datetime(2020, 1, 1, 6)


def counter(spark, values, hours=None, **more):
    rows = [("A", i, START + timedelta(hours=(hours or range(len(values)))[i]), v) for i, v in enumerate(values)]
    d = spark.createDataFrame(rows, "system_id string, row_no long, ts timestamp_ntz, v double")
    return iv.counter_to_interval(d, "v", **more).orderBy("ts").collect()


def test_steps_of_a_counter_add_up_to_its_rise(spark):
    rng = np.random.default_rng(2)
    steps = rng.integers(0, 40, 60) / 8
    got = [r.energy for r in counter(spark, (7300 + np.cumsum(steps)).tolist())]
    assert got[0] is None and got[1:] == steps[1:].tolist()


def test_a_lifetime_counter_that_falls_leaves_one_step_unknown(spark):
    got = counter(spark, [812.25, 812.75, 813.5, 0.25, 0.75, 2.0])
    assert [r.energy for r in got] == [None, 0.5, 0.75, None, 0.5, 1.25] and [r.is_reset for r in got].index(True) == 3 == sum(r.is_reset for r in got) * 3


def test_a_daily_counter_that_falls_tells_what_it_counted_since(spark):
    days = [[0.0, 2.25, 9.5], [0.75, 4.0, 4.0], [1.5]]
    got = [r.energy for r in counter(spark, [v for d in days for v in d], resets_daily=True)]
    assert got == [None, 2.25, 7.25, 0.75, 3.25, 0.0, 1.5]


def test_gaps_too_long_for_a_day_and_blank_readings(spark):
    assert [(r.energy, r.long_gap) for r in counter(spark, [20.0, 23.0, 24.0], hours=[0, 18, 37])] == [(None, False), (3.0, False), (None, True)]
    assert [r.energy for r in counter(spark, [8.0, None, None, 9.25, 9.5])] == [None, 1.25, 0.25]


def test_repeated_stamp_keeps_the_last_row(spark):
    assert [r.energy for r in counter(spark, [31.0, 30.5, 33.0, 34.0], hours=[0, 0, 2, 3])] == [None, 2.5, 1.0]


def test_empty(spark):
    assert counter(spark, []) == []


@pytest.mark.parametrize("partitions", [2, 16])
def test_hours_do_not_depend_on_partitioning(spark, partitions):
    rows = [("A", START + timedelta(minutes=m)) for m in [0, 15, 30, 45, 180, 195]] + [("B", START + timedelta(minutes=60 * m)) for m in range(4)]
    d = spark.createDataFrame(rows, "system_id string, ts timestamp_ntz").repartition(partitions)
    got = {(r.system_id, r.ts): r.hours for r in iv.sample_hours(d).collect()}
    assert {v for (k, _), v in got.items() if k == "A"} == {0.25} and {v for (k, _), v in got.items() if k == "B"} == {1.0}
