"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Every line is good or bad. A line's features are its shape (length, symbols, capitals, repetition, ending) and
the shape of the lines beside it; no words, ids, languages or sources. Labels are of documents, so the lines of a
training document all have its label; that there are documents of both kinds of lines is told by mixtures: beside each
training document stands one that is made of it and a block of lines of a document of the other label, each line with the
label of its own document. Training maximises the likelihood of the lines' labels over both, with the gradient from
forward-backward marginals; so the field learns where labels change, not only that they stay. A
document's score is the mean of its lines' marginals for "good", weighted by line length, then a logistic
calibration fitted on the same training documents.

Training reads a bounded sample: the `sample` labelled documents of the training folds with the smallest hash
of their id, one row of each id (that with the smallest hash of its text), and of a document with more than
`sample_lines` lines a stretch of so many, its place by a hash (features still look at the whole text). So at most
`sample` x `sample_lines` lines of 23 numbers reach the driver. Scoring reads every text whole. An empty or null text
is one empty line and gets its score;
lines may be prepared before they are looked at (see fit); equal ids and repeated rows are scored each on their own; without both labels in training, the score is the
share of label 1 (0.5 without labels).
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phantomlake.llm.common import by_bytes, id_text, is_fold, raw, small_batches

SHAPE, BESIDE = 12, (2, 3, 4, 6, 7)
N_FEATURES = SHAPE + 2 * len(BESIDE)
SCORES = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("n_lines", pa.int64()), ("good_share", pa.float64())])

_SYM = (b"#", b"*", b"$", b"%", b"&", b"<", b">")
_NOT_UPPER = bytes(x for x in range(256) if not 65 <= x <= 90)
_NOT_LOWER = bytes(x for x in range(256) if not 97 <= x <= 122)
_NOT_DIGIT = bytes(x for x in range(256) if not 48 <= x <= 57)
_ENDS = (b".", b"!", b"?", b":", b";", b'"', b")", "…".encode())


def line_shapes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Features (lines x N_FEATURES) and lengths of the lines of a text."""
    lines = text.split(b"\n")
    rows, seen = [], set()
    for line in lines:
        words = line.split()
        n = len(words) or 1
        upper = len(line.translate(None, _NOT_UPPER))
        letters = upper + len(line.translate(None, _NOT_LOWER)) or 1
        rows.append((
            1.0, np.log1p(len(words)) / 5, min(2.0, sum(line.count(x) for x in _SYM) / n), upper / letters, min(1.0, (line.count(b"!!") + line.count(b"??")) / n),
            min(1.0, 2 * line.count(b"|") / n), 1 - len(set(words)) / n if words else 0.0, float(bool(words) and line in seen), len(line.translate(None, _NOT_DIGIT)) / (len(line) or 1),
            float(line.endswith(_ENDS)), len(line) / n / 10 if len(line) < 30 * n else 3.0, float(not words),
        ))
        seen.add(line)
    own = np.array(rows)
    out = np.zeros((len(lines), N_FEATURES))
    out[:, :SHAPE] = own
    k = SHAPE + len(BESIDE)
    out[1:, SHAPE:k] = own[:-1, BESIDE]
    out[:-1, k:] = own[1:, BESIDE]
    return out, np.array([len(x) + 1.0 for x in lines])


@dataclass
class LineCrf:
    """weights: of the features for "good"; start and change: scores of the first label and of label pairs (bad 0, good 1)."""

    weights: np.ndarray
    start: np.ndarray
    change: np.ndarray
    scale: float = 1.0
    shift: float = 0.0
    prior: float | None = None

    def marginals(self, x: np.ndarray, sizes: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """P(good) of every line of chains that lie one after another; with pairs also the sum of pair marginals."""
        emit = np.zeros((len(x), 2))
        emit[:, 1] = x @ self.weights
        ends = np.cumsum(sizes)
        order = np.argsort(-sizes, kind="stable")
        first, sizes = (ends - sizes)[order], sizes[order]
        left, right = np.zeros_like(emit), np.zeros_like(emit)
        alive = np.searchsorted(-sizes, -np.arange(sizes[0]) if len(sizes) else [], side="left")  # chains longer than t
        both = np.zeros((2, 2))
        for t in range(int(sizes[0]) if len(sizes) else 0):
            at = first[: alive[t]] + t
            if t:
                before = left[at - 1][:, :, None] + self.change[None]
                left[at] = np.logaddexp(before[:, 0], before[:, 1]) + emit[at]
            else:
                left[at] = self.start + emit[at]
        for t in range(int(sizes[0]) - 2 if len(sizes) else -1, -1, -1):
            at = first[: alive[t + 1]] + t
            after = self.change[None] + (emit[at + 1] + right[at + 1])[:, None, :]
            right[at] = np.logaddexp(after[:, :, 0], after[:, :, 1])
            if pairs:
                joint = left[at][:, :, None] + after
                joint -= joint.max(axis=(1, 2), keepdims=True)
                joint = np.exp(joint)
                both += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        total = left + right
        return 1 / (1 + np.exp(np.clip(total[:, 0] - total[:, 1], -60, 60))), both

    def scores(self, x: np.ndarray, sizes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(score, length-weighted mean marginal) of each document."""
        starts = np.cumsum(sizes) - sizes
        good, _ = self.marginals(x, sizes)
        mean = np.add.reduceat(good * lengths, starts) / np.add.reduceat(lengths, starts)
        if self.prior is not None:
            return np.full(len(sizes), self.prior), mean
        z = np.log(np.clip(mean, 1e-9, 1 - 1e-9) / np.clip(1 - mean, 1e-9, 1))
        return 1 / (1 + np.exp(-np.clip(self.scale * z + self.shift, -60, 60))), mean


def beside(x: np.ndarray) -> np.ndarray:
    """The features with those of the neighbours put in anew, for lines that now stand in this order."""
    k = SHAPE + len(BESIDE)
    out = x.copy()
    out[:, SHAPE:] = 0
    out[1:, SHAPE:k] = x[:-1, BESIDE]
    out[:-1, k:] = x[1:, BESIDE]
    return out


def mixtures(docs: list[tuple[np.ndarray, np.ndarray, int]], most: int = 12) -> list[tuple[np.ndarray, np.ndarray]]:
    """(features, labels of lines): of each document with a block of 1 to `most` lines of one of the other label put in."""
    rng, out = np.random.default_rng(5), []
    by_label = [[x for x, _, y in docs if y == k] for k in (0, 1)]
    for x, _, y in docs:
        other = by_label[1 - y][rng.integers(len(by_label[1 - y]))]
        n = int(rng.integers(1, min(most, len(other)) + 1))
        at, place = int(rng.integers(0, len(other) - n + 1)), int(rng.integers(0, len(x) + 1))
        rows = np.concatenate([x[:place], other[at : at + n], x[place:]])
        out.append((beside(rows), np.concatenate([np.full(place, y), np.full(n, 1 - y), np.full(len(x) - place, y)])))
    return out


def trained(docs: list[tuple[np.ndarray, np.ndarray, int]], rounds: int = 150, rate: float = 0.1, ridge: float = 1e-3) -> LineCrf:
    """The field fitted by Adam on (features, lengths, label) of documents and on mixtures of them."""
    labels = np.array([y for _, _, y in docs])
    model = LineCrf(np.zeros(N_FEATURES), np.zeros(2), np.zeros((2, 2)))
    if not len(docs) or labels.min() == labels.max():
        model.prior = float(labels.mean()) if len(docs) else 0.5
        return model
    chains = [(f, np.full(len(f), y)) for f, _, y in docs] + mixtures(docs)
    x, y, sizes = np.concatenate([f for f, _ in chains]), np.concatenate([y for _, y in chains]), np.array([len(f) for f, _ in chains])
    starts = np.cumsum(sizes) - sizes
    inside = np.ones(len(y), bool)
    inside[starts] = False
    seen_pairs = np.bincount(2 * y[:-1][inside[1:]] + y[1:][inside[1:]], minlength=4).reshape(2, 2).astype(float)
    seen_start = np.bincount(y[starts], minlength=2).astype(float)
    params = np.zeros(N_FEATURES + 6)
    m, v = np.zeros_like(params), np.zeros_like(params)
    for k in range(1, rounds + 1):
        model.weights, model.start, model.change = params[:N_FEATURES], params[N_FEATURES : N_FEATURES + 2], params[N_FEATURES + 2 :].reshape(2, 2)
        good, pairs = model.marginals(x, sizes, pairs=True)
        first = good[starts]
        grad = np.concatenate([x.T @ (y - good) / len(y), (seen_start - [(1 - first).sum(), first.sum()]) / len(sizes), ((seen_pairs - pairs) / len(y)).ravel()]) - ridge * params
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        params = params + rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    model.weights, model.start, model.change = params[:N_FEATURES].copy(), params[N_FEATURES : N_FEATURES + 2].copy(), params[N_FEATURES + 2 :].reshape(2, 2).copy()
    own = [f for f, _, _ in docs]
    _, mean = model.scores(np.concatenate(own), np.array([len(f) for f in own]), np.concatenate([n for _, n, _ in docs]))
    z = np.clip(np.log(np.clip(mean, 1e-9, 1) / np.clip(1 - mean, 1e-9, 1)), -20, 20)
    scale, shift = 1.0, 0.0
    for _ in range(25):  # Newton steps of a logistic fit with a little ridge
        p = 1 / (1 + np.exp(-np.clip(scale * z + shift, -60, 60)))
        w = p * (1 - p)
        g = np.array([(z * (labels - p)).sum() - 0.1 * (scale - 1), (labels - p).sum() - 0.1 * shift])
        h = np.array([[(w * z * z).sum() + 0.1, (w * z).sum()], [(w * z).sum(), w.sum() + 0.1]])
        step = np.linalg.solve(h, g)
        scale, shift = scale + step[0], shift + step[1]
    model.scale, model.shift = max(0.05, float(scale)), float(shift)
    return model


def fit(docs: DataFrame, labels: DataFrame, held_mod: int = 4, held_rest: int = 2, sample: int = 3000, sample_lines: int = 500, prepare: Callable[[bytes], bytes] | None = None) -> LineCrf:
    """Learns from the labelled documents outside the held-out fold, at most `sample` of them and `sample_lines` of each.
    `prepare` does to their texts what was done to those that will be scored."""
    spark = docs.sparkSession
    usable = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~is_fold("doc_id", held_mod, held_rest))
    chosen = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("long").alias("quality"))
    chosen = spark.createDataFrame(chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).toPandas(), "doc_id long, quality long")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for doc_id, quality, text in zip(part.column("doc_id").to_pylist(), part.column("quality").to_pylist(), raw(part.column("text")), strict=True):
                x, lengths = line_shapes(prepare(text) if prepare else text)
                at = zlib.crc32(str(doc_id).encode()) % max(1, len(x) - sample_lines + 1)
                x, lengths = x[at : at + sample_lines], lengths[at : at + sample_lines]
                yield pa.RecordBatch.from_arrays([pa.array([doc_id]), pa.array([quality]), pa.array([x.ravel()]), pa.array([lengths])], names=["doc_id", "quality", "x", "lengths"])

    found = id_text(docs).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("m"))
    rows = found.select("doc_id", "quality", F.col("m.text").alias("text")).mapInArrow(run, "doc_id long, quality long, x array<double>, lengths array<double>").toArrow()
    rows = rows.sort_by("doc_id")
    each = zip(rows.column("x"), rows.column("lengths"), rows.column("quality").to_pylist(), strict=True)
    return trained([(np.asarray(x.values).reshape(-1, N_FEATURES), np.asarray(n.values), y) for x, n, y in each])


def scored(texts: list[bytes], model: LineCrf) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(score, lines, mean marginal) of each text."""
    shapes = [line_shapes(x) for x in texts]
    sizes = np.array([len(n) for _, n in shapes])
    score, mean = model.scores(np.concatenate([x for x, _ in shapes]), sizes, np.concatenate([n for _, n in shapes]))
    return score, sizes, mean


def classify(docs: DataFrame, model: LineCrf, threshold: float = 0.7, held_mod: int = 4, held_rest: int = 2) -> DataFrame:
    """doc_id, held_out, score, predicted, n_lines, good_share of every document."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts, ids = raw(part.column("text")), part.column("doc_id")
            for a, z in by_bytes(texts):
                score, lines, mean = scored(texts[a:z], model)
                yield pa.RecordBatch.from_arrays([ids.slice(a, z - a), pa.array(score), pa.array(lines, pa.int64()), pa.array(mean)], schema=SCORES)

    rows = id_text(docs).mapInArrow(run, "doc_id long, score double, n_lines long, good_share double")
    return rows.select("doc_id", is_fold("doc_id", held_mod, held_rest).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_lines", "good_share")


def good_documents(docs: DataFrame, model: LineCrf, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The documents that the field finds good, with all their columns."""
    small_batches(docs.sparkSession)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = raw(part.column(text_col))
            keep = [bool(s >= threshold) for a, z in by_bytes(texts) for s in scored(texts[a:z], model)[0]]
            yield part.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
