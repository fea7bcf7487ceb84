"""Window, island and statistics helpers that every operator shares. keys are the columns of one
series: a system, or a system and a scenario. null means unknown and is never filled."""

from __future__ import annotations

import tempfile
import uuid
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ("system_id",)


def z(p: float) -> float:
    return NormalDist().inv_cdf(p)


def odd(n: int) -> int:
    return n if n % 2 else n + 1


def day_number() -> Column:
    return F.unix_date("date")


def by(keys, order: str | Column | None = "date"):
    w = Window.partitionBy(*keys)
    return w if order is None else w.orderBy(order)


def calendar_window(keys, days: int):
    """Centred window over calendar days; it shrinks at the ends."""
    return Window.partitionBy(*keys).orderBy(day_number()).rangeBetween(-(days // 2), days // 2)


def row_window(keys, rows: int):
    """Centred window over the rows that are left; it shrinks at the ends."""
    return Window.partitionBy(*keys).orderBy(day_number()).rowsBetween(-(rows // 2), rows // 2)


def middle(values: Column) -> Column:
    """Median of a sorted array without nulls; null if it is empty."""
    n = F.size(values)
    return F.when(n > 0, (F.get(values, F.floor((n - 1) / 2).cast("int")) + F.get(values, F.floor(n / 2).cast("int"))) / 2)


def rolling_median(value: Column, window, min_n: int) -> Column:
    """Median of the known values of a frame, null under min_n of them."""
    values = F.sort_array(F.collect_list(value).over(window))
    return F.when(F.size(values) >= min_n, middle(values))


def true(c: Column) -> Column:
    """A predicate in which unknown counts as false."""
    return F.coalesce(c, F.lit(False))


def percentile(value: Column, q) -> Column:
    return F.percentile(value, q)


def robust_sigma(df: DataFrame, value: str, keys, name: str) -> DataFrame:
    """keys -> 1.4826 x median absolute deviation of `value`; null under five known values."""
    known = df.where(F.col(value).isNotNull()).select(*keys, value)
    centred = known.withColumn("_dev", F.abs(F.col(value) - F.median(value).over(by(keys, None))))
    return centred.groupBy(*keys).agg(F.when(F.count("*") >= 5, 1.4826 * F.median("_dev")).alias(name))


ROWS = 50_000  # rows of a task in dealt(), at most as a rule


def many_parts(d: DataFrame) -> int:
    """A number of partitions for series (or events) that are few bytes but much work each: several for each of the session's,
    so that a task that meets more series than others doesn't hold up the rest."""
    return 4 * int(d.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def dealt(d: DataFrame, keys, rows: int | None = None) -> DataFrame:
    """d dealt out by keys in many_parts(), however few bytes it has: left to itself, Spark puts small partitions together until
    one task does all the work. Where the number of `rows` is told, parts grow with it, so that a task's memory doesn't."""
    return d.repartition(max(many_parts(d), -(-(rows or 0) // ROWS)), *keys)


def islands(df: DataFrame, flag: str, keys) -> DataFrame:
    """Rows where flag holds, with `island`: the same value for a run of consecutive days."""
    return df.where(true(F.col(flag))).withColumn("island", F.date_sub(F.col("date"), F.row_number().over(by(keys))))


def spine(df: DataFrame, keys) -> DataFrame:
    """Every calendar day from the first to the last day of each series."""
    ends = df.groupBy(*keys).agg(F.min("date").alias("a"), F.max("date").alias("b"))
    return ends.select(*keys, F.explode(F.sequence("a", "b")).alias("date"))


def draw(*parts: Column) -> Column:
    """A number in [0, 1) that depends on its parts alone, the same on any partitioning."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 12), 16, 10).cast("double") / F.lit(float(16**12))


def fresh(spark, label: str) -> str:
    """A new path in the folder that driver and executors share, spark.checkpoint.dir. Where it is unset, a
    session on one machine (as in tests) gets a new local one; on a cluster that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="pvloss-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """df written to the shared folder and read back: a short plan, and nothing to compute again when an
    executor is lost."""
    path = fresh(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
