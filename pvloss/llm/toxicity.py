"""Toxicity by weak supervision.

Voters look at whole texts. Lexicon voters fire on a word, pattern voters on words that begin with a
given stem or on a shape of the text (exclamation runs, shouting, ...); a last voter speaks for "clean"
where no lexicon or stem voter fires. Words and stems are mined from labelled training rows: Spark
counts in how many toxic and clean texts each stands, and all that stand in at least SUPPORT toxic texts
and SUPPORT_SHARE of them, PRECISION of their texts being toxic, become voters, besides the fixed words in
SEEDS; a word or stem that begins with a stronger stem says nothing new and is left out.

A generative label model takes the votes as drawn from one Gaussian for each hidden class with a
shared covariance: class means are the voters' accuracies, the covariance their correlations, so
voters that always fire together count once. EM estimates means, covariance and class share from the
votes alone, starting from the majority vote. Its posteriors are the labels of a linear (logistic)
classifier over the same voters, fitted by Newton steps with a ridge. Labels take part in mining only.

Bounds: at most TRAIN_ROWS labelled rows for the fit, of whole texts. A voter stands in a share of the toxic
ones, so voters don't grow in number with the rows. The model (some 50 KB) goes to the tasks. Scoring
reads all words of all texts.

Defined cases: null and empty texts fire no voter but the last; without labelled rows only SEEDS and
shapes vote; if no training text exists at all every score is 0.0; other input columns pass through;
repeated rows stay; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import slices
from .common import stored

TRAIN_ROWS, SUPPORT, SUPPORT_SHARE, PRECISION = 10_000, 5, 0.005, 0.9
STEMS = range(3, 9)  # lengths of the stems that are mined
SEEDS = ("idiot", "moron", "stupid", "pathetic", "worthless", "disgusting")
_WORD = re.compile(r"[^\W\d_]+")
#: Shapes of a text that may go with abuse; the label model finds out whether they do.
SHAPES = (r"!{2,}", r"\?{2,}", r"\b[A-Z]{4,}\b", r"[#*$%&]{3,}", r"\b(?:you|your)\b", r"@\w+")
MEMORY = 120_000  # words whose voters a worker remembers


def words(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def traits(word: str) -> list[str]:
    """What a word can be recognised by: '=word' and its stems '^ste'."""
    return ["=" + word, *("^" + word[:k] for k in STEMS if k <= len(word))]


@dataclass
class Model:
    voters: list[str]  # traits
    weights: np.ndarray  # of voters, shapes and the clean voter
    bias: float
    known: dict = field(default_factory=dict)

    def fired(self, text: str) -> list[int]:
        """The voters that fire on a text, by number; shapes follow the traits, the clean voter is last."""
        index = self.known.setdefault(None, {v: i for i, v in enumerate(self.voters)})
        hits = set()
        for w in words(text):
            found = self.known.get(w)
            if found is None:
                found = tuple(index[t] for t in traits(w) if t in index)
                if len(w) <= 40:
                    if len(self.known) > MEMORY:
                        self.known.clear()
                        self.known[None] = index
                    self.known[w] = found
            hits.update(found)
        n = len(self.voters)
        out = sorted(hits) if hits else [n + len(SHAPES)]
        return out + [n + k for k, p in enumerate(_shapes()) if p.search(text)]

    def score(self, text: str) -> float:
        z = self.bias + float(self.weights[self.fired(text)].sum())
        return 1 / (1 + np.exp(-min(30.0, max(-30.0, z))))


def _shapes(known=[]):  # noqa: B006  compiled once for each worker
    if not known:
        known.extend(map(re.compile, SHAPES))
    return known


def mine(sample: DataFrame) -> list[str]:
    """sample (text, label) -> traits of toxic texts, the strongest first."""

    def run(batches):
        counts = {0: Counter(), 1: Counter()}
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                counts[label].update({t for w in words(text) for t in traits(w)})
        keys = list(counts[1])  # what no toxic text of this part has only lowers others' precision
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([counts[1][k] for k in keys], pa.int64()), pa.array([counts[0][k] for k in keys], pa.int64())], names=["trait", "toxic", "clean"])
        rest = [k for k in counts[0] if k not in counts[1]]
        yield pa.RecordBatch.from_arrays([pa.array(rest, pa.string()), pa.array([0] * len(rest), pa.int64()), pa.array([counts[0][k] for k in rest], pa.int64())], names=["trait", "toxic", "clean"])

    found = sample.select("text", "label").mapInArrow(run, "trait string, toxic bigint, clean bigint").groupBy("trait").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    least = max(SUPPORT, SUPPORT_SHARE * sample.where("label = 1").count())
    found = found.where((F.col("toxic") >= least) & (F.col("toxic") >= PRECISION * (F.col("toxic") + F.col("clean") + 0.5)))
    strength = F.col("toxic") * F.log((F.col("toxic") + 1) / (F.col("clean") + 1))
    chosen: list[str] = []
    stems: set[str] = set()
    for (trait,) in found.orderBy(F.round(strength, 9).desc(), F.length("trait"), "trait").select("trait").collect():
        if not any(trait[1 : 1 + k] in stems for k in STEMS):
            chosen.append(trait)
            if trait[0] == "^":
                stems.add(trait[1:])
    return list(dict.fromkeys(chosen + ["=" + s for s in SEEDS]))


def label_model(votes: np.ndarray, start: np.ndarray, rounds: int = 12, ridge: float = 0.02) -> np.ndarray:
    """EM for two Gaussians with shared covariance over votes (rows x voters); start: the first
    guess at the probability of class 1. -> posterior probability of class 1 for each row."""
    p, n, m = start.copy(), *votes.shape
    for _ in range(rounds):
        share = float(np.clip(p.mean(), 1e-3, 1 - 1e-3))
        one, zero = p @ votes / max(p.sum(), 1e-9), (1 - p) @ votes / max((1 - p).sum(), 1e-9)
        mixed = p[:, None] * one + (1 - p)[:, None] * zero
        centred = votes - mixed
        spread = (centred.T @ centred + (p * (1 - p)).sum() * np.outer(one - zero, one - zero)) / n + ridge * np.eye(m)
        direction = np.linalg.solve(spread, one - zero)
        z = (votes - (one + zero) / 2) @ direction + np.log(share / (1 - share))
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    return p


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 12) -> tuple[np.ndarray, float]:
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(penalty)
        w = w - np.linalg.solve(h, x.T @ (p - y) + penalty * w)
    return w[:-1], float(w[-1])


def train(sample: DataFrame) -> Model:
    """sample (doc_id, text, label), bounded by its maker -> a fitted model."""
    sample = stored(sample.select("doc_id", "text", "label"), "sample")
    voters = mine(sample)
    model = Model(voters, np.zeros(len(voters) + len(SHAPES) + 1), 0.0)
    kind = sample.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for big in batches:
            for batch in slices(big, "text"):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([model.fired(t) for t in batch.column("text").to_pylist()], pa.list_(pa.int32()))], names=["doc_id", "fired"])

    fired = sample.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fired array<int>").toArrow().sort_by([("doc_id", "ascending")]).column("fired").to_pylist()
    if not fired:
        model.bias = -30.0
        return model
    x = np.zeros((len(fired), len(model.weights)))
    for i, f in enumerate(fired):
        x[i, f] = 1
    votes = x.copy()
    votes[:, -1] *= -1  # the clean voter votes the other way
    majority = 1 / (1 + np.exp(-3 * (np.sign(x[:, : len(voters)].sum(axis=1)) - 0.5)))
    model.weights, model.bias = logistic(x, label_model(votes, majority))
    model.known = {}
    return model


def with_score(docs: DataFrame, model: Model, column: str = "score", text_col: str = "text") -> DataFrame:
    """docs with a probability of toxicity added as `column` (which replaces one of that name)."""
    names = [c for c in docs.columns if c != column]
    schema = T.StructType([*docs.select(*names).schema.fields, T.StructField(column, T.DoubleType())])

    def run(batches):
        for big in batches:
            for batch in slices(big, text_col):
                scores = [model.score(t or "") for t in batch.column(text_col).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*names, column])

    return docs.select(*names).mapInArrow(run, schema)
