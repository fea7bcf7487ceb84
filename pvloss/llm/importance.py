"""Importance resampling towards a target distribution: documents whose hashed n-gram features look like
the target's are drawn without replacement.

Counts: every run of 1 to 3 words of every text is hashed into one of BUCKETS places; each task adds up its own
array of counts before anything is shuffled, and the log ratios of target to corpus come back as one array of
BUCKETS gains. Weights: a document's weight is the sum of that array over its features. The score adds Gumbel
noise that depends on the id alone, so the highest scores are a weighted draw.

Cutoff: a quantile sketch of the scores gives a bracket around the cutoff. Exact counts above and inside the
bracket tell whether the cutoff lies in it; if not, the bracket is widened and counted again. Only rows inside
are sorted to find it. Ranks come from a range-partitioned sort and one count for each partition, so no task
holds all the drawn rows.

Texts are taken in pieces of PIECE bytes, cut between words; what a task holds beside them is two arrays.

Defined cases: a null or wordless text has no features and weight 0; rows of a null id are scored with an empty id
and come after all others on ties; repeated rows are documents of their own, with ties broken by n_features and then
in any order; further columns are kept, if none has a name of the results; without eligible documents (or under 100 / share of
them) none is drawn; an empty target makes all gains those of an empty count; empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import slices
from .common import stored

BUCKETS = 10_000
PIECE = 1 << 20  # bytes of one text whose features are held at a time
ACCURACY = 10_000  # of the quantile sketch: its rank error is a share of 1 / ACCURACY of the rows

#: A-Z become a-z; ASCII characters that are neither letters nor digits become spaces; all bytes of other
#: characters stay.
_PLAIN = bytes(c if c > 127 or chr(c).isalnum() and not 65 <= c <= 90 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def pieces(text: bytes, most: int = PIECE) -> Iterator[list[bytes]]:
    """The words of a text, about `most` bytes of them at a time."""
    plain = text.translate(_PLAIN)
    if len(plain) <= most:
        yield plain.split()
        return
    at = 0
    while at < len(plain):
        end = plain.find(b" ", at + most)
        end = len(plain) if end < 0 else end
        yield plain[at:end].split()
        at = end


def hashes(text: bytes, most: int = PIECE) -> Iterator[tuple[int, np.ndarray]]:
    """(words, CRC-32 of the runs of 1 to 3 words that end in them) for each piece of a text. A run's CRC goes on
    from that of the run without its last word."""
    last_one, last_two = [], []
    for words in pieces(text, most):
        if not words:
            continue
        spaced = [b" " + w for w in words]
        one = list(map(crc32, words))
        before = [*last_one, *one[:-1]]
        two = list(map(crc32, spaced[len(words) - len(before) :], before))
        before = [*last_two, *two]
        before = before[: len(before) - 1] if two else before
        three = list(map(crc32, spaced[len(words) - len(before) :], before)) if before else []
        last_one, last_two = one[-1:], two[-1:] or last_two
        yield len(words), np.array([*one, *two, *three], np.int64)


def counted(texts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """texts (text) -> bucket, n: how many features of all texts each bucket has; buckets without any are left out."""

    def run(batches):
        n = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column("text").cast(pa.binary()):
                for _, found in hashes(text.as_py() or b""):
                    n += np.bincount(found % buckets, minlength=buckets)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], names=["bucket", "n"])

    return texts.select("text").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of every bucket in thousandths, rounded down: the log of its smoothed share among the target's
    features over that among the documents'. What comes to the driver is one number for each bucket."""
    s, t = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    both = counted(docs, buckets).withColumn("of", F.lit(0)).unionByName(counted(target, buckets).withColumn("of", F.lit(1)))
    for r in both.collect():
        (t if r["of"] else s)[r["bucket"]] = r["n"]
    all_s, all_t = int(s.sum()) + buckets, int(t.sum()) + buckets
    return np.array([math.floor(1000 * math.log(float((a + 1) * all_s) / float((b + 1) * all_t))) for a, b in zip(t.tolist(), s.tolist(), strict=True)], np.int64)


def weighted(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """docs (text and more) -> its columns but for text, and n_words, n_features, weight."""
    names = [c for c in docs.columns if c != "text"]
    if clash := {"n_words", "n_features", "weight", "score", "rank"} & set(names):
        raise ValueError(f"columns have names of results: {sorted(clash)}")
    rows = docs.select(*[F.col(f"`{c}`") for c in names], "text")
    schema = T.StructType([*rows.drop("text").schema.fields, *[T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight")]])

    def run(batches):
        for big in batches:
            for batch in slices(big, "text"):
                out = np.zeros((batch.num_rows, 3), np.int64)
                for i, text in enumerate(batch.column("text").cast(pa.binary())):
                    for n, found in hashes(text.as_py() or b""):
                        out[i] += n, len(found), gain[found % len(gain)].sum()
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], *[pa.array(out[:, k].copy()) for k in range(3)]], names=schema.names)

    return rows.mapInArrow(run, schema)


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, rounded down, from the first 32 bits of a digest of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    uniform = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / float(1 << 32)
    return F.floor(-1000 * F.ln(-F.ln(uniform)))


def _order() -> list[Column]:
    return [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("_row")]


def ranked(rows: DataFrame, after: int = 0) -> DataFrame:
    """rows with rank: after + 1, after + 2, ... in order, by a range-partitioned sort and each partition's size."""
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # Spark counts a partition's rows in these bits
    placed = rows.repartitionByRange(*_order()).sortWithinPartitions(*_order()).select("*", F.spark_partition_id().alias("_part"), inside.alias("_at"))
    placed = stored(placed, "ranked")
    sizes = {r["_part"]: r["n"] for r in placed.groupBy("_part").agg(F.count("*").alias("n")).collect()}  # one row a partition
    before, total = [], after
    for part in sorted(sizes):
        before.append((part, total))
        total += sizes[part]
    starts = rows.sparkSession.createDataFrame(before, "_part int, _before bigint")
    return placed.join(F.broadcast(starts), "_part").withColumn("rank", F.col("_before") + F.col("_at") + 1).drop("_part", "_at", "_before")


def bracket(scores: DataFrame, k: int, n: int, accuracy: int = ACCURACY) -> tuple[float, float, int]:
    """Two scores between which the k-th highest of n lies, and how many are above both: sketched, then
    counted exactly, and widened until the counts agree."""
    width = 2 / accuracy
    while True:
        at = [max(0.0, 1 - k / n - width), min(1.0, 1 - k / n + width)]
        low, high = scores.agg(F.percentile_approx("score", at, accuracy)).first()[0] if width < 1 else scores.agg(F.min("score"), F.max("score")).first()
        above, inside = scores.agg(F.count_if(F.col("score") > high), F.count_if(F.col("score").between(low, high))).first()
        if above < k <= above + inside:
            return low, high, above
        width *= 8


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, seed: int = 42, least_words: int = 20, buckets: int = BUCKETS, accuracy: int = ACCURACY) -> DataFrame:
    """docs (doc_id, text and more) and target (text) -> the columns of docs but for text, and n_words, n_features,
    weight, score, rank. Of the documents with `least_words` words or more, `percent` in a hundred (rounded down) have a
    rank: 1 for the highest score, ties to the smaller id."""
    scored = weighted(docs, gains(docs, target, buckets)).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    scored = stored(scored.withColumn("_row", F.monotonically_increasing_id()), "scores")
    able = F.col("n_words") >= least_words
    n = scored.where(able).count()
    k = percent * n // 100
    none = F.lit(None).cast("bigint")
    if not k:
        return scored.withColumn("rank", none).drop("_row")
    low, high, above = bracket(scored.where(able), k, n, accuracy)
    inside = ranked(scored.where(able & F.col("score").between(low, high)), above)
    inside = inside.withColumn("rank", F.when(F.col("rank") <= k, F.col("rank")))
    top = ranked(scored.where(able & (F.col("score") > high)))
    rest = scored.where(~able | (F.col("score") < low)).withColumn("rank", none)
    return top.unionByName(inside).unionByName(rest).drop("_row")
