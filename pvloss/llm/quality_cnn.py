"""Quality classifier: a byte-level convolutional network in numpy.

The UTF-8 bytes of a whole text are cut into chunks of CHUNK bytes that overlap by KERNEL, so every
window of KERNEL bytes at a multiple of STRIDE lies in some chunk. Bytes are embedded, learned filters
slide over each chunk, ReLU and a maximum over the chunk give one feature for each filter; a document
has the mean and the maximum of its chunks' features, and a logistic unit makes one probability of
them. Everything (embedding, filters, output) is fitted together by Adam on the log loss.

Fit and scoring take all chunks of a text. The fit takes at most TRAIN_ROWS labelled rows and
TRAIN_BYTES of whole texts, the first by a hash of the id that fit. The weights (some 10 KB) go to the
tasks.

Defined cases: null and empty texts are one chunk of padding and get a score like any other; without
labelled rows of both classes the score is the share of label 1 (1.0 with no rows at all); other
input columns pass through; repeated rows stay; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import slices
from .common import stored

CHUNK, KERNEL, STRIDE, FILTERS, WIDTH, PAD = 512, 8, 4, 24, 6, 256
TRAIN_ROWS, TRAIN_BYTES, STEPS, BATCH, RATE = 6000, 1 << 27, 700, 48, 4e-3
AT_ONCE = 1024  # chunks that are scored at a time


def chunk_count(n: int) -> int:
    return 1 if n <= CHUNK else 1 + -(-(n - CHUNK) // (CHUNK - KERNEL))


def chunks(data: bytes) -> np.ndarray:
    """The chunks of a text as rows of byte values, padded with PAD."""
    step = CHUNK - KERNEL
    padded = np.full((chunk_count(len(data)) - 1) * step + CHUNK, PAD, np.int16)
    padded[: len(data)] = np.frombuffer(data, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::step]


@dataclass
class Net:
    table: np.ndarray  # (257, WIDTH)
    filters: np.ndarray  # (KERNEL * WIDTH, FILTERS)
    bias: np.ndarray
    out: np.ndarray  # (2 * FILTERS,)
    out_bias: np.ndarray  # (1,)

    def parameters(self):
        return [self.table, self.filters, self.bias, self.out, self.out_bias]

    def windows(self, x: np.ndarray) -> np.ndarray:
        e = self.table[x].reshape(len(x), CHUNK * WIDTH)
        places = (CHUNK - KERNEL) // STRIDE + 1
        view = np.lib.stride_tricks.as_strided(e, (len(x), places, KERNEL * WIDTH), (e.strides[0], STRIDE * WIDTH * e.itemsize, e.itemsize))
        return view.reshape(-1, KERNEL * WIDTH)

    def pooled(self, x: np.ndarray) -> np.ndarray:
        z = (self.windows(x) @ self.filters).reshape(len(x), -1, FILTERS)
        return np.maximum(z.max(axis=1) + self.bias, 0)

    def peaks(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each chunk and filter the place of the highest response, and that response."""
        where, raw = np.empty((len(x), FILTERS), np.int64), np.empty((len(x), FILTERS), np.float32)
        for at in range(0, len(x), AT_ONCE):
            z = (self.windows(x[at : at + AT_ONCE]) @ self.filters).reshape(len(x[at : at + AT_ONCE]), -1, FILTERS)
            where[at : at + AT_ONCE] = z.argmax(axis=1)
            raw[at : at + AT_ONCE] = z.max(axis=1) + self.bias
        return where, raw

    def score(self, texts: list[bytes]) -> np.ndarray:
        counts = np.array([chunk_count(len(t)) for t in texts])
        total, high = np.zeros((len(texts), FILTERS), np.float32), np.zeros((len(texts), FILTERS), np.float32)
        held, of, size = [], [], 0

        def flush():
            f, at = self.pooled(np.concatenate(held)), np.concatenate(of)
            np.add.at(total, at, f)
            np.maximum.at(high, at, f)

        for i, t in enumerate(texts):
            for c in np.split(all_chunks := chunks(t), range(AT_ONCE, len(all_chunks), AT_ONCE)):
                held.append(c)
                of.append(np.full(len(c), i))
                size += len(c)
                if size >= AT_ONCE:
                    flush()
                    held, of, size = [], [], 0
        if held:
            flush()
        z = np.concatenate([total / counts[:, None], high], axis=1) @ self.out + self.out_bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30).astype(float)))


def fit(texts: list[bytes], labels: np.ndarray, seed: int = 7) -> Net | float:
    """Fits a network on whole texts; -> the share of ones if there's one class only."""
    if len(set(labels.tolist())) < 2:
        return float(labels.mean()) if len(labels) else 1.0
    rng = np.random.default_rng(seed)
    f32 = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
    net = Net(f32(257, WIDTH, scale=0.5), f32(KERNEL * WIDTH, FILTERS, scale=0.15), np.zeros(FILTERS, np.float32), f32(2 * FILTERS, scale=0.1), np.zeros(1, np.float32))
    first, second = [np.zeros_like(p) for p in net.parameters()], [np.zeros_like(p) for p in net.parameters()]
    step = 0
    for _ in range(-(-STEPS * BATCH // len(texts))):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), BATCH):
            pick = order[at : at + BATCH]
            samples, y = [chunks(texts[i]) for i in pick], labels[pick].astype(np.float32)
            x, counts = np.concatenate(samples), np.array(list(map(len, samples)))
            starts = np.cumsum(counts) - counts
            of = np.repeat(np.arange(len(pick)), counts)
            where, raw = net.peaks(x)
            feat = np.maximum(raw, 0)
            mean, high = np.add.reduceat(feat, starts) / counts[:, None], np.maximum.reduceat(feat, starts)
            p = 1 / (1 + np.exp(-np.clip(np.concatenate([mean, high], 1) @ net.out + net.out_bias, -30, 30)))
            dz = (p - y) / len(pick)
            g_out = np.concatenate([mean, high], 1).T @ dz
            d_feat = (dz[:, None] * net.out[:FILTERS] / counts[:, None])[of]
            d_feat += np.where(feat == high[of], (dz[:, None] * net.out[FILTERS:])[of], 0)
            d_feat = np.where(raw > 0, d_feat, 0).astype(np.float32)
            # Only windows that pass something back: where a filter's response is positive.
            chunk, filt = np.nonzero(d_feat)
            passed = d_feat[chunk, filt]
            ids = x[chunk[:, None], where[chunk, filt][:, None] * STRIDE + np.arange(KERNEL)]
            rows = net.table[ids].reshape(len(ids), -1)
            g_filters = np.stack([passed[filt == f] @ rows[filt == f] for f in range(FILTERS)], 1)
            d_rows = (passed[:, None] * net.filters.T[filt]).reshape(-1, KERNEL, WIDTH)
            g_table = np.stack([np.bincount(ids.ravel(), d_rows[:, :, k].ravel(), 257) for k in range(WIDTH)], 1)
            step += 1
            rate = RATE * max(0.2, 1 - step / STEPS)
            for k, (param, g) in enumerate(zip(net.parameters(), [g_table, g_filters, d_feat.sum(0), g_out, dz.sum(keepdims=True)], strict=True)):
                g = g.astype(np.float32)
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                param -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)
    return net


def train(sample: DataFrame, most: int = TRAIN_BYTES) -> Net | float:
    """sample (doc_id, text, label), whose rows its maker bounds -> a network fitted on those of its texts
    that together have at most `most` bytes."""
    sample = stored(sample.select("doc_id", "text", "label"), "sample")
    sizes = sample.select("doc_id", F.xxhash64("doc_id").alias("hash"), F.octet_length("text").alias("size")).collect()
    upto, picked = 0, []
    for r in sorted(sizes, key=lambda r: (r["hash"], r["doc_id"])):
        upto += r["size"]
        if upto > most:
            break
        picked.append((r["doc_id"],))
    ids = sample.sparkSession.createDataFrame(picked, sample.select("doc_id").schema)
    rows = sample.join(F.broadcast(ids), "doc_id")
    rows = rows.select("doc_id", F.col("text").cast("binary").alias("text"), "label").toArrow().sort_by([("doc_id", "ascending"), ("text", "ascending")])
    return fit([t or b"" for t in rows.column("text").to_pylist()], np.array(rows.column("label").to_pylist(), int))


def with_score(docs: DataFrame, net: Net | float, column: str = "score", text_col: str = "text") -> DataFrame:
    """docs with a probability of label 1 added as `column` (which replaces one of that name)."""
    names = [c for c in docs.columns if c != column]
    schema = T.StructType([*docs.select(*names).schema.fields, T.StructField(column, T.DoubleType())])

    def run(batches):
        for big in batches:
            for batch in slices(big, text_col):
                texts = [t or b"" for t in batch.column(text_col).cast(pa.binary()).to_pylist()]
                scores = net.score(texts) if isinstance(net, Net) else np.full(len(texts), net)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*names, column])

    return docs.select(*names).mapInArrow(run, schema)
