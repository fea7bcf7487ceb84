"""Near-duplicate vectors by a pivot-permutation index.

Pivots are vectors of a bounded sample, none close to another. A vector is described by its NEAREST nearest pivots,
in order of nearness. The inverted lists are kept for pairs of pivots: a list holds the vectors that have both among
their nearest, so two vectors of a list share two pivots at least, and vectors of different lists are never
compared. More vectors ask for more pivots, which keeps lists short. Inside a list, vectors are verified
by their cosine in double precision, as blocks of a matrix product. A pair that shares more pivots meets in several
lists; it is counted where its two smallest shared pivots are, and rows that can own no pair of a list are left out
before anything is multiplied. A list over CHUNK rows is dealt into chunks, one group for each pair of chunks. Groups
send on how many links each vector has, and a spanning forest of the links: never the pairs themselves.

Equal vectors collapse to one row first, which counts for all of them.

Recall: vectors at an angle of a cosine of 0.95 share two of their six nearest pivots in 99 to 100 % of cases (64 to 1024 pivots,
64 dimensions); tests/llm/test_pivots.py measures it against brute force. No pair below the threshold is linked.

Defined cases: null or empty vectors, zero vectors and those that hold null, NaN or infinite components link with nothing and
are components of their own; vectors of different dimensions don't link, and dimensions without two pivots share one list;
repeated rows stay and link with each other; a null vec_id keeps its row and its links but names no component (one of null
ids alone has a null component and is not kept); of rows with one vec_id each is kept that names its component; further columns are ignored; empty tables give
no rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .components import connected_components

NEAREST = 6  # pivots that describe a vector
FEWEST, MOST = 64, 4096  # pivots, by the number of vectors
APART = 0.7  # cosine that no two pivots exceed
SAMPLE = 4  # vectors of the sample for each pivot
SAMPLE_VALUES = 1 << 24  # components of all vectors of the sample at most
CHUNK = 1024  # rows of a list that one group compares at most with as many others
RUN = 4096  # small lists are held together up to about so many rows
BROADCAST_LISTS = 500_000  # lists over CHUNK rows that are broadcast at most
COMMON, SHARE = 100_000, 1000


def pivot_count(vectors: int) -> int:
    """A power of two of at least the square root of the number of vectors, within bounds."""
    return min(MOST, max(FEWEST, 1 << (max(0, vectors - 1).bit_length() + 1) // 2))


def unit(v: np.ndarray) -> np.ndarray:
    """Rows of length one in double precision, whatever their size."""
    v = v.astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def choose(sample: np.ndarray, most: int) -> np.ndarray:
    """Of some unit vectors the first ones that aren't close to one chosen before."""
    chosen = np.empty((0, sample.shape[1]))
    for v in sample:
        if len(chosen) < most and (not len(chosen) or (chosen @ v).max() <= APART):
            chosen = np.vstack([chosen, v])
    return chosen


def fit(classes: DataFrame, n: int) -> dict[int, np.ndarray]:
    """Pivots by dimension, from a sample by the vectors' hash: SAMPLE rows a pivot and SAMPLE_VALUES components at most."""
    most = pivot_count(n)
    width = classes.agg(F.max(F.size("v"))).first()[0] or 1
    rows = classes.select("v").orderBy(F.xxhash64("v"), "node").limit(max(2, min(SAMPLE * most, SAMPLE_VALUES // width))).collect()
    by_size: dict[int, list] = {}
    for r in rows:
        by_size.setdefault(len(r[0]), []).append(r[0])
    return {size: choose(unit(np.array(x)), most) for size, x in by_size.items()}


def described(classes: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """classes (node, n, v) with pivots: the numbers of the nearest pivots, in order of nearness."""

    def run(batches):
        for batch in batches:
            size = np.asarray(batch.column("v").value_lengths())
            out = [[]] * batch.num_rows
            for d in np.unique(size).tolist():
                if d in pivots:
                    at = np.flatnonzero(size == d)
                    near = unit(matrix(batch.column("v").take(pa.array(at)))) @ pivots[d].T
                    order = np.argsort(-near, axis=1, kind="stable")[:, :NEAREST].tolist()
                    for i, x in zip(at.tolist(), order, strict=True):
                        out[i] = x
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.int32()))], names=[*batch.schema.names, "pivots"])

    return classes.mapInArrow(run, f"node bigint, n bigint, v {classes.schema['v'].dataType.simpleString()}, pivots array<int>")


def with_lists(rows: DataFrame) -> DataFrame:
    """A row for each list that a vector is in: its dimension and two of its pivots, the smaller first. Vectors with
    fewer than two pivots are in the list of their dimension."""
    pair = lambda i, j: F.struct(F.least(F.col("near")[i], F.col("near")[j]).alias("p"), F.greatest(F.col("near")[i], F.col("near")[j]).alias("q"))
    at = [F.when(F.size("near") > j, pair(i, j)) for i, j in combinations(range(NEAREST), 2)]
    none = F.struct(F.lit(-1).alias("p"), F.lit(-1).alias("q"))
    lists = F.when(F.size("near") < 2, F.array(none)).otherwise(F.array_compact(F.array(*at)))
    rows = rows.withColumnRenamed("pivots", "near").select("*", F.explode(lists).alias("list"))
    return rows.select("node", "n", "v", "near", F.size("v").alias("dim"), "list.p", "list.q")


def owned(p: int, q: int, near: list[list[int]]) -> np.ndarray:
    """Numbers of rows' other pivots before q, one number for each different set; -> the number of each row's set, and
    which sets have no pivot in common: pairs of such rows have p and q as their two smallest shared pivots."""
    sets = [frozenset(x for x in row if x < q and x != p) for row in near]
    number = {s: i for i, s in enumerate(dict.fromkeys(sets))}
    apart = np.array([[a.isdisjoint(b) for b in number] for a in number], bool)
    return np.array([number[s] for s in sets]), apart


def compare(v: np.ndarray, n: np.ndarray, kind: np.ndarray, apart: np.ndarray, left: np.ndarray, right: np.ndarray, least: float, step: int = 512):
    """Links between rows `left` and rows `right` (the same, or none in common) of different rows whose kinds are apart:
    weight of the links of each row, and a spanning forest of them."""
    found, label, edges = np.zeros(len(v), np.int64), np.arange(len(v)), []
    same = left is right
    for at in range(0, len(left), step):
        a = left[at : at + step]
        b = right[at:] if same else right
        hit = (v[a] @ v[b].T >= least) & apart[kind[a]][:, kind[b]]
        if same:
            hit &= np.arange(len(b)) > np.arange(len(a))[:, None]
        i, j = np.nonzero(hit)
        i, j = a[i], b[j]
        np.add.at(found, i, n[j])
        np.add.at(found, j, n[i])
        far = label[i] != label[j]
        while far.any():  # each pass joins every remaining class with its smallest neighbour class
            i, j = i[far], j[far]
            high, low = np.maximum(label[i], label[j]), np.minimum(label[i], label[j])
            order = np.lexsort((low, high))
            first = order[np.concatenate([[True], np.diff(high[order]) > 0])]
            edges += zip(i[first].tolist(), j[first].tolist(), strict=True)
            to = np.arange(len(v))
            to[high[first]] = low[first]
            while (to != to[to]).any():
                to = to[to]
            label = to[label]
            far = label[i] != label[j]
    return found, edges


def links(rows: DataFrame, least: float) -> DataFrame:
    """rows (node, n, v, pivots) -> node, links, to: numbers of linked vectors to be added up, or an edge to another node."""
    listed = with_lists(rows)
    key = ["dim", "p", "q"]
    hot = listed.groupBy(*key).count().where(F.col("count") > CHUNK).select(*key, F.ceil(2 * F.col("count") / CHUNK).cast("int").alias("chunks"))
    hot = stored(hot, "hot")
    hot = F.broadcast(hot) if hot.count() <= BROADCAST_LISTS else hot  # else the vectors are shuffled once more
    own = F.pmod(F.xxhash64("node", "p"), F.coalesce("chunks", F.lit(1))).cast("int")
    dealt = listed.join(hot, key, "left").select(*listed.columns, own.alias("own"), F.explode(F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1)).alias("other"))
    dealt = dealt.select(*listed.columns, "own", F.least("own", "other").alias("c1"), F.greatest("own", "other").alias("c2"))
    group = [*key, "c1", "c2"]
    dealt = dealt.repartition(*group).sortWithinPartitions(*group)

    def one_list(batch):
        if batch.num_rows < 2:
            return [], [], []
        p, q, c1, c2 = (batch.column(c)[0].as_py() for c in ("p", "q", "c1", "c2"))
        node, n, own = (batch.column(c).to_numpy() for c in ("node", "n", "own"))
        kind, apart = owned(p, q, batch.column("near").to_pylist()) if p >= 0 else (np.zeros(len(node), np.int64), np.ones((1, 1), bool))
        if c1 == c2:
            left = right = np.flatnonzero(apart.any(axis=1)[kind])
        else:
            left, right = np.flatnonzero(own == c1), np.flatnonzero(own == c2)
            met = np.zeros((2, len(apart)), bool)
            met[0, kind[left]], met[1, kind[right]] = True, True
            left, right = left[(apart & met[1]).any(axis=1)[kind[left]]], right[(apart & met[0]).any(axis=1)[kind[right]]]
        if not len(left) or not len(right):
            return [], [], []
        found, edges = compare(unit(matrix(batch.column("v"))), n, kind, apart, left, right, least)
        some = np.flatnonzero(found)
        a, b = np.array(edges, np.int64).reshape(-1, 2).T
        return [*node[some], *node[a]], [*found[some], *[0] * len(a)], [*[None] * len(some), *node[b].tolist()]

    def run(batches):
        held, rows_held = [], 0

        def flush():
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()
            out = ([], [], [])
            for batch in whole:
                keys = np.stack([batch.column(c).to_numpy() for c in group])
                ends = [*(np.flatnonzero((np.diff(keys) != 0).any(axis=0)) + 1).tolist(), batch.num_rows]
                for a, b in zip([0, *ends], ends):
                    for x, y in zip(out, one_list(batch.slice(a, b - a)), strict=True):
                        x.extend(y)
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["node", "links", "to"])

        last = None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in group]) if batch.num_rows else np.empty((len(group), 0))
            if not batch.num_rows:
                continue
            ends = np.flatnonzero((np.diff(keys) != 0).any(axis=0)) + 1
            if held and rows_held >= RUN and tuple(keys[:, 0]) != last:
                yield flush()
                held, rows_held = [], 0
            at = 0
            for end in ends.tolist():
                if rows_held + end - at >= RUN:
                    held.append(batch.slice(at, end - at))
                    yield flush()
                    held, rows_held, at = [], 0, end
            held.append(batch.slice(at))
            rows_held += batch.num_rows - at
            last = tuple(keys[:, -1])
        if held:
            yield flush()

    return dealt.mapInArrow(run, "node bigint, links bigint, to bigint")


def usable(v) -> object:
    """Whether a vector can link: it has a direction."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def linked(vectors: DataFrame, least: float = 0.95) -> DataFrame:
    """vectors (vec_id, embedding) -> vec_id, n_links, component_id, kept: one row for each vector."""
    v = F.col("embedding")
    if vectors.schema["embedding"].dataType.elementType.simpleString() not in ("float", "double"):
        v = v.cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("v"))
    good, bad = rows.where(usable(F.col("v"))), rows.where(~usable(F.col("v")))
    classes = good.groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"))
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    count = classes.count()
    shape = classes.select("node", "n", "v")
    found = stored(links(described(shape, fit(shape, count)), least), "links")
    roots = connected_components(found.where("to is not null").select(F.col("node").alias("u"), F.col("to").alias("v")))
    sums = found.where("to is null").groupBy("node").agg(F.sum("links").alias("links"))
    placed = classes.join(roots.select("node", "root"), "node", "left").join(sums, "node", "left")
    placed = placed.select("v", "rep", "n", F.coalesce("root", "node").alias("root"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    names = placed.groupBy("root").agg(F.min("rep").alias("component_id"))
    known = stored(placed.join(names, "root").select("v", "n", "n_links", "component_id"), "known")
    # A vector of very many rows would send them all to one task. Those of over a SHARE-th of all rows are under SHARE in number, so they are broadcast.
    common = F.col("n") > F.lit(max(COMMON, classes.agg(F.sum("n")).first()[0] // SHARE if count else 0))
    out = [F.col("vec_id"), "n_links", "component_id"]
    often = stored(known.where(common).select(F.col("v").alias("w"), "n_links", "component_id"), "common")
    rows = good.join(F.broadcast(often), F.col("v") == F.col("w"), "left")
    rare = rows.where("w is null").select("vec_id", "v").join(known.where(~common).select("v", "n_links", "component_id"), "v").select(*out)
    alone = bad.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    every = rows.where("w is not null").select(*out).unionByName(rare).unionByName(alone)
    return every.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
