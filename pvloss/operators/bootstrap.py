"""Moving-block bootstrap whose draws depend on (seed, key, replicate, block) alone, so results are the
same on any partitioning. Replicates are never rows beside days: a series is sent to one task once, as it is, and its
blocks are drawn inside an Arrow pass there, CHUNK replicates at a time."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.common import KEYS, dealt, draw
from ..functions.digests import fractions
from ..functions.settings import DEFAULT, Settings

CHUNK = 128  # replicates whose days are held at a time


def uniforms(parts, ends: np.ndarray) -> np.ndarray:
    """draw() of (*parts, end) for every end, texts as numpy bytes: numbers in [0, 1) from the first 48 bits of a digest. Null
    parts are left out."""
    return fractions("".join(f"{p}|" for p in parts if p is not None).encode(), ends)


@lru_cache(maxsize=64)
def pairs(rows: range, columns: range) -> np.ndarray:
    """The texts row|column, as numpy bytes; series and events share them."""
    texts = (np.array([b"%d" % i for i in r]) for r in (rows, columns))
    row, column = (t.reshape(shape) for t, shape in zip(texts, ((-1, 1), (1, -1)), strict=True))
    return np.strings.add(np.strings.add(row, b"|"), column).ravel()


def block_starts(key, m: int, block: int, replicates: range, seed: int) -> np.ndarray:
    """Where the blocks of each replicate of range(m) start: replicates x blocks; the last block may be cut."""
    b = min(block, m)
    blocks = -(-m // b)
    return np.floor(uniforms((seed, *key), pairs(replicates, range(blocks))) * (m - b + 1)).astype(np.int64).reshape(len(replicates), blocks)


def block_sums(x: np.ndarray, starts: np.ndarray, block: int) -> np.ndarray:
    """Sums of x over the days of each replicate, from the sum of each block that may be drawn."""
    b, m = min(block, len(x)), len(x)
    last = m - b * (starts.shape[1] - 1)
    upto = np.concatenate([[0.0], np.cumsum(x)])
    sums = (upto[b:] - upto[:-b])[starts]
    sums[:, -1] = upto[starts[:, -1] + last] - upto[starts[:, -1]]
    return sums.sum(axis=1)


def block_medians(x: np.ndarray, starts: np.ndarray, block: int) -> np.ndarray:
    """Medians of x over the days of each replicate."""
    b, m = min(block, len(x)), len(x)
    days = (starts[:, :, None] + np.arange(b)).reshape(len(starts), -1)[:, :m]
    return np.median(x[days], axis=1)


def resampled(values: DataFrame, columns: dict[str, str], of, replicates: int, block: int, s: Settings = DEFAULT, keys=KEYS) -> DataFrame:
    """values (keys, date, ...) -> keys, replicate and for each column its name in the result: `of` (block_sums or
    block_medians) over a series in the order of its dates, drawn again in blocks; all columns are drawn alike. Days where a column
    is unknown are left out. Series without days give no rows."""
    known = [F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(columns)]
    rows = values.select(*keys, "date", *known).dropna(subset=[f"_{i}" for i in range(len(columns))])
    schema = T.StructType([*rows.select(*keys).schema.fields, T.StructField("replicate", T.IntegerType()), *[T.StructField(n, T.DoubleType()) for n in columns.values()]])

    def work(key: tuple, t: pa.Table) -> pa.Table:
        t, own = t.sort_by("date"), [k.as_py() for k in key]
        x = [t.column(f"_{i}").to_numpy() for i in range(len(columns))]
        got = [[] for _ in columns]
        for a in range(0, replicates, CHUNK):
            starts = block_starts(own, len(t), block, range(a, min(a + CHUNK, replicates)), s.seed)
            for out, values in zip(got, x, strict=True):
                out.append(of(values, starts, block))
        same = [pa.repeat(k, replicates) for k in key]
        return pa.table([*same, pa.array(np.arange(replicates, dtype=np.int32)), *[pa.array(np.concatenate(g)) for g in got]], names=schema.names)

    return dealt(rows, keys).groupBy(*keys).applyInArrow(work, schema)


def block_indices(sizes: DataFrame, replicates: int, block: int, s: Settings = DEFAULT, keys=KEYS) -> DataFrame:
    """sizes (keys, m) -> keys, replicate, place, idx: a resample of range(m) in whole blocks."""
    b = F.least(F.lit(block), F.col("m"))
    d = sizes.where("m > 0").select(*keys, "m", b.alias("b"), F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
    # A row of sizes becomes replicates x places: the replicates are dealt out before.
    d = dealt(d, [*keys, "replicate"]).select("*", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("m") / F.col("b")) - 1).cast("int"))).alias("block_no"))
    start = F.floor(draw(F.lit(str(s.seed)), *[F.col(k) for k in keys], F.col("replicate").cast("string"), F.col("block_no").cast("string")) * (F.col("m") - F.col("b") + 1)).cast("int")
    d = d.withColumn("start", start).select("*", F.explode(F.sequence(F.lit(0), (F.col("b") - 1).cast("int"))).alias("o"))
    return d.select(*keys, "replicate", (F.col("block_no") * F.col("b") + F.col("o")).cast("int").alias("place"), (F.col("start") + F.col("o")).cast("int").alias("idx")).where(F.col("place") < F.col("m"))


def block_index_sums(sizes: DataFrame, replicates: int, block: int, s: Settings = DEFAULT, keys=KEYS) -> DataFrame:
    """sizes (keys, m) -> keys, replicate, draws, places, in_order: of block_indices() the number of rows, the sum of idx and the
    sum of place * idx, one row a replicate. A block's part follows from its place and its start, so places are never rows."""
    schema = T.StructType([*sizes.select(*keys).schema.fields, T.StructField("replicate", T.IntegerType()), *[T.StructField(n, T.LongType()) for n in ("draws", "places", "in_order")]])

    def work(key: tuple, t: pa.Table) -> pa.Table:
        m, own = t.column("m")[0].as_py(), [k.as_py() for k in key]
        b = min(block, m)
        first = np.arange(-(-m // b), dtype=np.int64) * b
        size = np.minimum(b, m - first)
        steps, squares = size * (size - 1) // 2, (size - 1) * size * (2 * size - 1) // 6  # sums of 0..size-1 and of its squares
        places, in_order = [], []
        for a in range(0, replicates, CHUNK):
            starts = block_starts(own, m, block, range(a, min(a + CHUNK, replicates)), s.seed)
            places.append(starts @ size + steps.sum())
            in_order.append(starts @ (size * first + steps) + (first * steps + squares).sum())
        same = [pa.repeat(k, replicates) for k in key]
        return pa.table([*same, pa.array(np.arange(replicates, dtype=np.int32)), pa.repeat(pa.scalar(m, pa.int64()), replicates), pa.array(np.concatenate(places)), pa.array(np.concatenate(in_order))], names=schema.names)

    return dealt(sizes.where("m > 0").select(*keys, "m"), keys).groupBy(*keys).applyInArrow(work, schema)


def resampled_totals(values: DataFrame, value: str, replicates: int, s: Settings = DEFAULT, keys=KEYS) -> DataFrame:
    """values (keys, date, value) -> keys, replicate, lost: totals over block-resampled days."""
    return resampled(values, {value: "lost"}, block_sums, replicates, s.block_days, s, keys)


PARTS = ("lost", "sustained", "outage", "deep", "moderate", "expected")


def daily_parts(f: DataFrame, s: Settings = DEFAULT, keys=KEYS) -> DataFrame:
    """keys, date and what each day that counts (valid, something expected) adds to the totals of the loss."""
    d = f.where(F.col("valid") & F.col("expected_kwh").isNotNull())
    held = F.when(F.col("outage"), 0.0).otherwise(F.col("expected_kwh") * F.col("loss_fraction"))
    gone = F.when(F.col("outage"), F.coalesce(F.greatest(F.col("expected_kwh") - F.col("energy_kwh"), F.lit(0.0)), F.lit(0.0))).otherwise(0.0)
    deep = F.when(F.col("loss_fraction") > s.deep_fraction, held).otherwise(0.0)
    return d.select(*keys, "date", (held + gone).alias("lost"), held.alias("sustained"), gone.alias("outage"), deep.alias("deep"), (held - deep).alias("moderate"), F.col("expected_kwh").alias("expected"))


def block_replicates(f: DataFrame, s: Settings = DEFAULT, keys=KEYS) -> DataFrame:
    """The totals of an analysed frame with its days drawn again in blocks: a range for what the days happened to be,
    beside loss_replicates(), which also draws the reference and the noise again."""
    return resampled(daily_parts(f, s, keys), {c: c for c in PARTS}, block_sums, s.samples, s.block_days, s, keys)
