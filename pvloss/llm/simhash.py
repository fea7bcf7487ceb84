"""SimHash near-duplicates: fingerprints of word shingles, linked within a Hamming radius.

Fingerprints are made document by document. Equal fingerprints collapse to one row first. For the
rest, the 64 bits are cut into bands; two fingerprints within the radius agree on at least
bands - radius whole bands, so every choice of that many bands is one table of buckets and no link
can be missed. More distinct fingerprints ask for more bands, which keeps buckets small.

Inside a bucket, rows are compared bit-sliced: bit planes lie vertically (one bit of 64 rows in a
word), the XOR of a plane with the bits of the queries goes into carry-save counters of 64 distances
at once, and words whose 64 distances all exceed the radius are abandoned. A bucket over CHUNK rows is
dealt into chunks, one group for each pair of chunks, so one task never holds a whole hot bucket.
Groups send on a spanning forest of their links, which keeps the components and not the pairs.

Defined cases: a null or wordless text has fingerprint zero and is linked like any other; a text
with fewer words than a shingle is one shingle; repeated rows keep their rows; a null doc_id keeps
its row and its links but names no component: one of null ids alone is null; further input columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import slices
from .common import split_by_ids, stored
from .components import connected_components

SEED = 42
CHUNK = 1024  # rows of a bucket that one group compares at most with as many others
RUN = 1024  # small buckets are compared together up to about so many rows
CHECK_EVERY = 8  # planes between two looks for words to abandon


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """The fingerprint of one UTF-8 text as an unsigned 64-bit integer."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxh64_intdigest(b" ".join(words), SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    joined = b" ".join(words)
    hashes = np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)], np.uint64)
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        bits = np.unpackbits(hashes[i : i + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """docs (text and more) -> its columns but for text, and fp (the 64 bits as a signed bigint)."""
    names = [c for c in docs.columns if c not in ("text", "fp")]
    rows = docs.select(*names, F.coalesce("text", F.lit("")).alias("text"))
    schema = T.StructType([*rows.select(*names).schema.fields, T.StructField("fp", T.LongType())])

    def run(batches):
        for big in batches:
            for batch in slices(big, "text"):
                fps = np.array([fingerprint(t, shingle) for t in batch.column("text").cast(pa.binary()).to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(fps.view(np.int64))], names=[*names, "fp"])

    return rows.mapInArrow(run, schema)


def near_lanes(queries: np.ndarray, rows: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Bit-sliced comparison: (q, w, lane mask) packed as two arrays, the places q * words + w and the
    64 lanes of rows[64 w:] within the radius of queries[q], for places with any such lane."""
    words = -(-len(rows) // 64)
    padded = np.zeros(words * 64, np.uint64)
    padded[: len(rows)] = rows
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    planes = np.ascontiguousarray(np.packbits(bits.reshape(words, 64, 64).transpose(2, 0, 1), axis=2, bitorder="little")).view(np.uint64)[:, :, 0]
    n_counters = max(1, radius.bit_length())
    start = np.uint64((1 << n_counters) - 1 - radius)  # counters overflow exactly when the distance passes the radius
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    place = np.arange(len(queries) * words)
    q, w = np.divmod(place, words)
    counters = [np.full(len(place), full if int(start) >> k & 1 else np.uint64(0), np.uint64) for k in range(n_counters)]
    over = np.zeros(len(place), np.uint64)
    tail = len(rows) % 64
    if tail:
        over[w == words - 1] = ~np.uint64((1 << tail) - 1)
    flip = [np.where(queries >> np.uint64(b) & np.uint64(1), full, np.uint64(0)) for b in range(64)]
    for b in range(64):
        carry = planes[b][w] ^ flip[b][q]
        for k in range(n_counters):
            counters[k], carry = counters[k] ^ carry, counters[k] & carry
        over |= carry
        if b % CHECK_EVERY == CHECK_EVERY - 1:
            alive = np.flatnonzero(over != full)
            if len(alive) < 0.7 * len(place):
                place, q, w, over = place[alive], q[alive], w[alive], over[alive]
                counters = [c[alive] for c in counters]
                if not len(place):
                    break
    alive = over != full
    return place[alive], ~over[alive]


def forest(fps: np.ndarray, radius: int, step: int = 256) -> list[tuple[int, int]]:
    """A spanning forest (pairs of positions) of the links among some fingerprints."""
    n, words = len(fps), -(-len(fps) // 64)
    label = np.arange(n)
    edges = []
    for at in range(0, n, step):
        places, lanes = near_lanes(fps[at : at + step], fps, radius)
        if not len(places):
            continue
        hit, lane = np.nonzero(np.unpackbits(lanes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        a, b = places[hit] // words + at, places[hit] % words * 64 + lane
        far = label[a] != label[b]
        while far.any():  # each pass joins every remaining class with its smallest neighbour class
            a, b = a[far], b[far]
            la, lb = label[a], label[b]
            high, low = np.maximum(la, lb), np.minimum(la, lb)
            order = np.lexsort((low, high))
            first = order[np.concatenate([[True], np.diff(high[order]) > 0])]
            edges += zip(a[first].tolist(), b[first].tolist(), strict=True)
            to = np.arange(n)
            to[high[first]] = low[first]
            while (to != to[to]).any():
                to = to[to]
            label = to[label]
            far = label[a] != label[b]
    return edges


def band_choice(n: int, radius: int) -> tuple[int, int]:
    """(bands, bands that must agree): buckets hold about n >> bits rows, bits = 64 * agree / bands."""
    agree = 1 if n < 1 << 24 else 2 if n < 1 << 32 else 4
    return radius + agree, agree


def bucket_keys(bands: int, agree: int):
    """Columns: for each choice of bands, a hash of the choice and of its bits."""
    edges = [64 * i // bands for i in range(bands + 1)]
    piece = [F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)) for lo, hi in zip(edges, edges[1:], strict=False)]
    return [F.xxhash64(F.lit(k), *[piece[i] for i in pick]) for k, pick in enumerate(combinations(range(bands), agree))]


def links(distinct: DataFrame, radius: int = 4) -> DataFrame:
    """distinct (fp), one row per fingerprint -> u, v: links between fingerprints that keep all components.
    distinct must be stored, as it is read several times."""
    keys = bucket_keys(*band_choice(distinct.count(), radius))
    rows = distinct.select("fp", F.explode(F.array(*keys)).alias("bucket"))
    hot = rows.groupBy("bucket").count().where(F.col("count") > CHUNK).select("bucket", F.ceil(2 * F.col("count") / CHUNK).cast("int").alias("chunks"))
    own = F.pmod(F.xxhash64("fp", "bucket"), F.col("chunks")).cast("int")
    dealt = rows.join(hot, "bucket", "left").select("fp", "bucket", F.coalesce(own, F.lit(0)).alias("own"), F.explode(F.sequence(F.lit(0), F.coalesce(F.col("chunks"), F.lit(1)) - 1)).alias("other"))
    group = F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other"))
    dealt = dealt.select("fp", group.alias("grp"))
    dealt = dealt.repartition("grp").sortWithinPartitions("grp")

    def run(batches):
        fps, held = [], 0

        def flush():
            f = np.concatenate(fps)
            pairs = np.array(forest(f.view(np.uint64), radius), np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(f[pairs[:, 0]]), pa.array(f[pairs[:, 1]])], names=["u", "v"])

        last = None
        for batch in batches:
            f, g = (batch.column(c).to_numpy() for c in ("fp", "grp"))
            # Cut after groups only, once RUN rows are held.
            ends = np.flatnonzero(np.diff(g)) + 1
            at = 0
            if last is not None and len(g) and g[0] != last and held >= RUN:
                yield flush()
                fps, held = [], 0
            for end in ends:
                if held + end - at >= RUN:
                    fps.append(f[at:end])
                    yield flush()
                    fps, held, at = [], 0, end
            if len(g):
                fps.append(f[at:])
                held += len(g) - at
                last = g[-1]
        if held:
            yield flush()

    return dealt.mapInArrow(run, "u bigint, v bigint").where("u <> v").distinct()


COMMON, SHARE = 100_000, 1000


def components(docs: DataFrame, shingle: int = 4, radius: int = 4) -> DataFrame:
    """docs (doc_id bigint, text) -> doc_id, fp, component_id, root (a fingerprint that names the component)."""
    prints = stored(fingerprints(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), shingle), "fingerprints")
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "distinct")
    roots = connected_components(links(distinct, radius))
    placed = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "rep", "n", F.coalesce("root", "fp").alias("root"))
    names = placed.groupBy("root").agg(F.min("rep").alias("component_id"))
    known = stored(placed.join(names, "root").select("fp", "n", "component_id", "root"), "known")
    # A fingerprint of very many rows would send them all to one task. Those of over a SHARE-th of all rows
    # are under SHARE in number, so they are broadcast.
    least = max(COMMON, prints.count() // SHARE)
    common = known.where(F.col("n") > least).select(F.col("fp").alias("common"), F.col("component_id").alias("of_common"), F.col("root").alias("root"))
    common = stored(common, "common")
    rows = prints.join(F.broadcast(common), F.col("fp") == F.col("common"), "left")
    rare = rows.where("common is null").select("doc_id", "fp").join(known.select("fp", "component_id", "root"), "fp")
    return rows.where("common is not null").select("doc_id", "fp", F.col("of_common").alias("component_id"), "root").unionByName(rare.select("doc_id", "fp", "component_id", "root"))


def one_of_each(docs: DataFrame, shingle: int = 4, radius: int = 4) -> DataFrame:
    """One row of docs (doc_id bigint, text and more) for each component: that of the smallest id. Ids that are
    neither null nor repeated, as a rule all, are told by their id alone, and their texts are not shuffled.
    Of rows with the same id one of each component that it names stays, of components of null ids one row."""
    found = stored(components(docs, shingle, radius), "components")
    several = stored(found.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").select("doc_id"), "several")
    away = found.where("doc_id <> component_id").select("doc_id").union(several)
    alone = split_by_ids(docs, away)[0]
    if several.isEmpty():
        return alone
    rows = split_by_ids(docs, several)[1]
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    known = found.select("fp", "component_id", "root").distinct()
    kept = fingerprints(rows.select("doc_id", "text", whole), shingle).join(known, "fp").where("component_id is null or component_id = doc_id").dropDuplicates(["root"])
    return alone.unionByName(kept.select("row.*"))
