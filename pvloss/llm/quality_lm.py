"""Quality rules: counts over words and lines, and bands on n-gram perplexity.

Words are runs of characters other than space and U+0009-U+000D. The language model is a modified
Kneser-Ney model over the bytes of running text: the words of a text joined by single spaces, after one
byte that marks its start. Every byte is predicted from the ORDER - 1 bytes before it, so contexts run
across words. (A model over words can't be kept within the disk limits: almost every word pair of a corpus
occurs once.) Tasks count the n-grams of their texts, and Spark adds the counts up. An n-gram of up to
seven bytes fits a 64-bit integer, which stands for its hash and has no collisions. Contexts, continuation
counts (raw counts for n-grams at a text's start, which nothing precedes), discounts and probabilities
follow by grouping and joining, order by order, without a bound on rows.

The model is written as sorted arrays of n-grams and log probabilities. Up to IN_TASK n-grams, each Python
worker holds the arrays and looks up the different n-grams of some texts at a time. A larger model is
joined to the different n-grams of each chunk of texts instead, and no task holds it; both give the same
values. The order is the same at every size.

A document's log perplexity is the mean negative log probability of its bytes. For each language,
exact percentiles of the different values of its documents (so copies count once) set a lower and an upper
band; documents outside are rejected. The rule is the same for all languages and any number of documents:
up to about 1 / TAIL different values, none lies outside.

Defined cases: null and wordless texts have no perplexity and fail the word count; null languages are
one language; repeated rows stay; further columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import uuid
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bpe import slices
from .common import fresh_path, stored

ORDER = 6
START = 0xFF  # no byte of UTF-8; stands before a text
PREFIX = bytes(ORDER - 2) + bytes([START])
HELD = 1 << 21  # n-grams that a counting task holds before it sends them on
IN_TASK = 1 << 24  # n-grams of a model that a Python worker holds (16 bytes each)
LOW_BAND, HIGH_BAND = 4.0, 2.5  # distances of the bands, in spreads between the median and a tail percentile
TAIL = 0.1
SYMBOLS = "#*$%&|<>"
SPACES = "\t\n\x0b\x0c\r "


def grams(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Texts as lists of words -> the packed n-gram that ends at each of their bytes, and how many each text
    has. Near a start the n-gram is the start byte and what follows it, after zero bytes."""
    joined = [b" ".join(words) for words in texts]
    sizes = np.fromiter(map(len, joined), np.int64, len(joined))
    data = np.frombuffer(b"".join([PREFIX + t for t in joined]), np.uint8).astype(np.int64)
    if not sizes.sum():
        return np.empty(0, np.int64), sizes
    packed = np.zeros(len(data) - ORDER + 1, np.int64)
    for k in range(ORDER):
        packed = packed << 8 | data[k : k + len(packed)]
    # The n-gram at place i ends at byte i + ORDER - 1, which is the text's own but for the prefixes.
    of = np.repeat(np.arange(len(texts)), sizes)
    return packed[np.arange(len(of)) + of * len(PREFIX)], sizes


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[first], np.add.reduceat(n, first) if len(n) else n


def gram_counts(docs: DataFrame) -> DataFrame:
    """docs (text) -> gram (packed), n over all bytes of all texts."""

    def run(batches):
        keys, counts, size = [], [], 0
        row = lambda k, n: pa.RecordBatch.from_arrays([pa.array(k), pa.array(n)], names=["gram", "n"])
        for big in batches:
            for batch in slices(big, "text"):
                found, _ = grams([t.split() for t in batch.column("text").cast(pa.binary()).to_pylist()])
                some = pa.array(found).value_counts()
                keys.append(some.field("values").to_numpy())
                counts.append(some.field("counts").to_numpy())
                size += len(some)
                if size > HELD:
                    k, n = summed(np.concatenate(keys), np.concatenate(counts))
                    if len(k) > HELD // 2:
                        yield row(k, n)
                        k, n = k[:0], n[:0]
                    keys, counts, size = [k], [n], len(k)
        if size:
            yield row(*summed(np.concatenate(keys), np.concatenate(counts)))

    return docs.where("text is not null").select("text").mapInArrow(run, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))


def suffix(gram: Column, level: int) -> Column:
    return gram.bitwiseAND(F.lit((1 << 8 * level) - 1))


def model(counts: DataFrame) -> DataFrame:
    """counts (gram, n) of gram_counts() -> gram, logp of all of them."""
    counts = stored(counts, "grams")
    level_of = F.lit(ORDER)
    for k in range(2, ORDER):
        level_of = F.when(F.shiftright("gram", 8 * (k - 1)) == START, k).otherwise(level_of)
    counts = counts.withColumn("level", level_of)
    at_start = lambda k: counts.where(F.col("level") == k).select("gram", "n")
    levels = [at_start(ORDER)]
    for k in range(ORDER - 1, 0, -1):
        continued = levels[0].groupBy(suffix(F.col("gram"), k).alias("gram")).agg(F.count("*").alias("n"))
        levels.insert(0, stored(continued.unionByName(at_start(k)) if k > 1 else continued, "grams"))
    lower, out = None, None
    for k, table in enumerate(levels, 1):
        of = [max(1, n) for n in table.agg(*[F.count_if(F.col("n") == i) for i in range(1, 5)]).first()]
        y = of[0] / (of[0] + 2 * of[1])
        cut = np.clip([1 - 2 * y * of[1] / of[0], 2 - 3 * y * of[2] / of[1], 3 - 4 * y * of[3] / of[2]], 0.05, [0.95, 1.9, 2.8]).tolist()
        same = Window.partitionBy(F.shiftright("gram", 8))
        d = table.withColumn("cut", F.when(F.col("n") == 1, cut[0]).when(F.col("n") == 2, cut[1]).otherwise(cut[2]))
        d = d.select("gram", ((F.col("n") - F.col("cut")) / F.sum("n").over(same)).alias("own"), (F.sum("cut").over(same) / F.sum("n").over(same)).alias("left"))
        if lower is None:
            d = d.withColumn("below", F.lit(1 / 256))
        else:
            d = d.withColumn("of", suffix(F.col("gram"), k - 1)).join(lower.select(F.col("gram").alias("of"), F.col("p").alias("below")), "of")
        lower = d.select("gram", (F.col("own") + F.col("left") * F.col("below")).alias("p"))
        if k < ORDER:
            lower = stored(lower, "probabilities")
        own = lower if k == ORDER else lower.where(F.shiftright("gram", 8 * (k - 1)) == START) if k > 1 else None
        out = own if out is None else out.unionByName(own)
    return out.select("gram", F.log("p").alias("logp"))


@lru_cache(maxsize=1)
def arrays(path: str) -> tuple[np.ndarray, np.ndarray]:
    """A stored model as sorted n-grams and their log probabilities."""
    where, name = fs.FileSystem.from_uri(path)
    t = ds.dataset(name, filesystem=where, format="parquet").to_table(columns=["gram", "logp"])
    keys, logp = t.column("gram").to_numpy(), t.column("logp").to_numpy()
    if (keys[1:] < keys[:-1]).any():  # files were written sorted, so as a rule nothing is sorted or copied here
        order = np.argsort(keys)
        keys, logp = keys[order], logp[order]
    return keys, logp


def looked_up(keys: np.ndarray, have: np.ndarray, logp: np.ndarray) -> np.ndarray:
    """Log probabilities of n-grams; each different one is looked for once."""
    if not len(keys):
        return np.empty(0)
    coded = pa.array(keys).dictionary_encode()
    different = coded.dictionary.to_numpy()
    at = np.minimum(np.searchsorted(have, different), max(0, len(have) - 1))
    if not len(have) or not np.array_equal(have[at], different):
        raise ValueError("an n-gram has no probability")
    return logp[at][coded.indices.to_numpy()]


def perplexities(logp: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Mean negative log probability of each text, rounded to nine places; null without words."""
    sums, some = np.zeros(len(sizes)), sizes > 0
    if some.any():
        sums[some] = np.add.reduceat(logp, (np.cumsum(sizes) - sizes)[some])
    return pa.array(np.round(-sums / np.maximum(sizes, 1), 9), pa.float64(), mask=sizes == 0)


def base_counts(text: str, words: list[bytes]) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    lines, dup = set(), 0
    for line in text.split("\n"):
        if line in lines:
            dup += bool(line.strip(SPACES))
        else:
            lines.add(line)
    repeat, triples = 0, list(zip(words, words[1:], words[2:], strict=False))
    if len(set(triples)) < len(triples):
        n, covered = Counter(triples), 0  # covered: words before this place that are already counted
        for i, t in enumerate(triples):
            if n[t] > 1:
                repeat += i + 3 - max(covered, i)
                covered = i + 3
    return len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), dup, repeat


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def prepared(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))


def counted(batch: pa.RecordBatch) -> tuple[list[list[bytes]], list[pa.Array]]:
    """The words of a batch's texts, and their base counts by column."""
    texts = batch.column("text").to_pylist()
    words = [t.encode().split() for t in texts]
    rows = [base_counts(t, w) for t, w in zip(texts, words, strict=True)]
    return words, [pa.array([r[i] for r in rows], pa.int64()) for i in range(len(COUNTS))]


def score_mapped(docs: DataFrame, path: str) -> DataFrame:
    """prepared() rows -> doc_id, lang, base counts, log_ppl with the model at `path` held by the workers."""

    def run(batches):
        for big in batches:
            for batch in slices(big, "text"):
                words, counts = counted(batch)
                keys, sizes = grams(words)
                ppl = perplexities(looked_up(keys, *arrays(path)), sizes)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), *counts, ppl], names=["doc_id", "lang", *COUNTS, "log_ppl"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {RESULT}")


def score_joined(docs: DataFrame, probabilities: DataFrame) -> DataFrame:
    """The same with a model that no task could hold, joined to the n-grams of each chunk of texts."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def chunked(batches):
        for big in batches:
            for batch in slices(big, "text"):
                chunk = pa.array(np.full(batch.num_rows, uuid.uuid4().int >> 65))
                yield pa.RecordBatch.from_arrays([chunk, *batch.columns, *counted(batch)[1]], names=["chunk", "doc_id", "lang", "text", *COUNTS])

    def different(batches):
        for batch in batches:
            chunks = batch.column("chunk").to_numpy()
            keys, sizes = grams([t.split() for t in batch.column("text").cast(pa.binary()).to_pylist()])
            of = np.repeat(chunks, sizes)
            for c in np.unique(chunks):
                found = np.unique(keys[of == c])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), c)), pa.array(found)], names=["chunk", "gram"])

    def joined(rows: pa.Table, known: pa.Table) -> pa.Table:
        have, logp = known.column("gram").to_numpy(), known.column("logp").to_numpy()
        order = np.argsort(have)
        keys, sizes = grams([t.split() for t in rows.column("text").cast(pa.binary()).to_pylist()])
        ppl = perplexities(looked_up(keys, have[order], logp[order]), sizes)
        return rows.select(["doc_id", "lang", *COUNTS]).append_column("log_ppl", ppl)

    chunks = stored(docs.mapInArrow(chunked, f"chunk bigint, doc_id {kind}, lang string, text string, {', '.join(f'{c} bigint' for c in COUNTS)}"), "chunks")
    asked = chunks.select("chunk", "text").mapInArrow(different, "chunk bigint, gram bigint").distinct()
    known = asked.join(probabilities, "gram").select("chunk", "gram", "logp")
    return chunks.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(joined, f"doc_id {kind}, {RESULT}")


RESULT = f"lang string, {', '.join(f'{c} bigint' for c in COUNTS)}, log_ppl double"


def scored(docs: DataFrame, in_task: int = IN_TASK) -> DataFrame:
    """docs (doc_id, text, lang) -> doc_id, lang, the base counts and log_ppl (null without words)."""
    rows, path = prepared(docs), fresh_path(docs.sparkSession, "model")
    model(gram_counts(docs)).sort("gram").write.parquet(path)
    kept = docs.sparkSession.read.schema("gram bigint, logp double").parquet(path)
    return score_mapped(rows, path) if kept.count() <= in_task else score_joined(rows, kept)


def percentiles(rows: DataFrame, key: str, value: str, shares: tuple[float, ...]) -> DataFrame:
    """key, v0, v1, ...: for each key the values of which that share of its rows are no larger, exactly. Rows are sorted
    over all partitions; one count for each key in each partition gives every row its rank, so no task
    and no sketch holds a key's values."""
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # Spark counts a partition's rows in these bits
    placed = rows.select(key, value).repartitionByRange(key, value).sortWithinPartitions(key, value)
    placed = stored(placed.select(key, value, F.spark_partition_id().alias("part"), inside.alias("at")), "ranks")
    counts = placed.groupBy(key, "part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    all_of, before = Window.partitionBy(key), Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col(key).alias("_key"), F.col("part").alias("_part"), F.sum("n").over(all_of).alias("total"), (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first") + 1).alias("shift"))
    ranked = placed.join(starts, (F.col("part") == F.col("_part")) & F.col(key).eqNullSafe(F.col("_key")))
    wanted = [F.greatest(F.ceil(F.col("total") * q), F.lit(1)) for q in shares]
    return ranked.groupBy(key).agg(*[F.max(F.when(F.col("at") + F.col("shift") == w, F.col(value))).alias(f"v{i}") for i, w in enumerate(wanted)])


def rules(docs: DataFrame, in_task: int = IN_TASK) -> DataFrame:
    """docs (doc_id, text, lang) -> doc_id, counts, base_failed, kept, log_ppl, low_band, high_band."""
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = stored(scored(docs, in_task).withColumn("base_failed", failed), "scored")
    judged = rows.where("not base_failed").select("lang", "log_ppl").distinct()
    m = [F.col(f"v{i}") for i in range(3)]
    low, high = m[1] - LOW_BAND * (m[1] - m[0]), m[1] + HIGH_BAND * (m[2] - m[1])
    bands = percentiles(judged, "lang", "log_ppl", (TAIL, 0.5, 1 - TAIL)).select("lang", low.alias("low_band"), high.alias("high_band"))
    inside = F.coalesce(F.col("log_ppl").between(F.col("low_band"), F.col("high_band")), F.lit(True))
    return rows.join(bands, "lang", "left").select("doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & inside).alias("kept"), "log_ppl", "low_band", "high_band")
