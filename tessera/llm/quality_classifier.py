"""Quality classifier by positive-unlabelled learning.

Learns from trusted positives (rows of a label table) and from the documents
themselves as the unlabelled mixture. Labelled negatives are never read.

1. One scan of all texts makes a short vector of style features (`FEATURES`:
   shares of letter, digit, space and symbol classes, of the transitions
   between them, word and line statistics, repetition), which is written once.
   All later passes read only those.
2. A logistic model, fitted to one half of the rows (by a hash of their
   features), tells positives from the mixture. Its scores' histograms over
   the other half bound the class prior: for any threshold,
   mixture share above it / positive share above it >= prior, as positives are
   part of the mixture. The least ratio, with a margin for the sizes of both
   samples, is the estimate.
3. The linear model g is fitted to the non-negative risk
   prior * E_p[l(g)] + max(0, E_u[l(-g)] - prior * E_p[l(-g)]) with logistic
   loss l, by Newton steps over all documents. While the second term is
   positive the risk is convex and the step is damped until it falls; a step
   that would make the term negative is shortened, and where even a twentieth
   of it would, fitting ends there: going on along the border would only tell
   the trusted positives apart better (measured: it keeps a third of the bad).
   That is the correction that keeps the risk from being driven below zero by
   memorising positives.
4. A document is kept if g >= 0, that is if it is more likely good than not.

Sums over documents are taken on the executors in two levels, so the driver
gets `GATHERED` small rows a pass however many documents there are.

Defined results: a null, empty or blank text has no words; it is not used for
learning, has score 0 and is rejected. Ids that are null or repeat are scored
row by row. Without any positive or any text with words nothing can be
learned; all documents then have a null score and are kept. Equal texts have
equal scores. An empty table gives an empty table. Further columns are left
out of `score` and pass through `keep` untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera import scratch
from tessera.llm.textarrays import NOT_SPACE, Words, char_counts, lean, mix, slices, text_bytes

RIDGE = 1e-3
#: What is added to the ridge, divided by the number of positives: few of them say little about many weights.
RIDGE_OF_FEW = 5.0
#: Words at which a text's features count half; those of shorter texts say less about them.
HALF_WORDS = 5
STEPS = 12
BINS = 2000
GATHERED = 16
#: A side of a join is broadcast up to this estimated size, and shuffled beyond it.
BROADCAST_BYTES = 32_000_000

_KINDS = ["lower", "upper", "digit", "space", "feed", "stop", "comma", "quote", "bracket", "rule", "shout", "sign"]
_CLASS = np.full(256, _KINDS.index("sign"), dtype=np.uint8)
_CLASS[97:123] = _CLASS[128:] = 0
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[[9, 11, 12, 32]] = 3
_CLASS[[10, 13]] = 4
_CLASS[[ord(c) for c in ".?:;"]] = 5
_CLASS[ord(",")] = 6
_CLASS[[ord(c) for c in "'\"`"]] = 7
_CLASS[[ord(c) for c in "()[]{}<>"]] = 8
_CLASS[[ord(c) for c in "|/\\_-=+~"]] = 9
_CLASS[ord("!")] = 10
_COARSE = np.array([0, 1, 2, 3, 4, 5, 5, 6, 6, 6, 6, 6], dtype=np.int64)
_N_COARSE = 7
FEATURES = ["constant", *_KINDS, *(f"pair_{a}_{b}" for a in range(_N_COARSE) for b in range(_N_COARSE)), "log_words", "word_length", "long_words", "word_signs", "shouted_words", "distinct_words", "line_words", "distinct_lines"]


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(matrix of FEATURES, whether the text has words) of each text."""
    data, offsets = text_bytes(column)
    n = len(offsets) - 1
    out = np.zeros((n, len(FEATURES)), dtype=np.float64)
    real = np.zeros(n, dtype=bool)
    k_pairs = 1 + len(_KINDS)
    rest = k_pairs + _N_COARSE**2
    for lo, hi in slices(offsets):
        part, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        m = hi - lo
        size = np.maximum(np.diff(at), 1)[:, None]
        row = np.repeat(np.arange(m), np.diff(at))
        kind = _CLASS[part].astype(np.int64)
        x = out[lo:hi]
        x[:, 1:k_pairs] = np.bincount(row * len(_KINDS) + kind, minlength=m * len(_KINDS)).reshape(m, -1) / size
        if len(part) > 1:
            coarse = _COARSE[kind]
            same = row[1:] == row[:-1]
            pair = (row[1:] * _N_COARSE + coarse[:-1]) * _N_COARSE + coarse[1:]
            x[:, k_pairs:rest] = np.bincount(pair[same], minlength=m * _N_COARSE**2).reshape(m, -1) / size
        words = Words(part, at, NOT_SPACE)
        count = np.diff(words.first)
        real[lo:hi] = count > 0
        safe = np.maximum(count, 1)
        chars = char_counts(part)
        length = chars[words.end] - chars[words.start]
        total = lambda values: np.bincount(words.doc, weights=values, minlength=m) / safe
        signs = np.concatenate([[0], np.cumsum(kind >= 7)])
        upper = np.concatenate([[0], np.cumsum(kind == 1)])
        hashes = words.hashes()
        salt = mix(words.doc.astype(np.uint64))
        keys = np.sort((hashes ^ salt) >> np.uint64(20) | (words.doc.astype(np.uint64) << np.uint64(44)))
        new = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, bool)
        distinct = np.bincount((keys[new] >> np.uint64(44)).astype(np.int64), minlength=m)
        feeds = np.concatenate([[0], np.cumsum(part == 10)])
        line = feeds[words.start] + words.doc
        head = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]])) if len(words) else np.zeros(0, np.int64)
        lines = np.bincount(words.doc[head], minlength=m)
        if len(head):
            line_key = np.unique(mix(np.add.reduceat(mix(hashes + np.arange(len(words), dtype=np.uint64) - np.repeat(head, np.diff(np.concatenate([head, [len(words)]]))).astype(np.uint64)), head)) >> np.uint64(20) | (words.doc[head].astype(np.uint64) << np.uint64(44)))
            distinct_lines = np.bincount((line_key >> np.uint64(44)).astype(np.int64), minlength=m)
        else:
            distinct_lines = np.zeros(m)
        x[:, rest] = np.log1p(count)
        x[:, rest + 1] = np.minimum(total(length), 50) / 10
        x[:, rest + 2] = total(length > 20)
        x[:, rest + 3] = total(signs[words.end] > signs[words.start])
        x[:, rest + 4] = total((upper[words.end] - upper[words.start] > 1) & (upper[words.end] - upper[words.start] >= 0.5 * (words.end - words.start)))
        x[:, rest + 5] = distinct / safe
        x[:, rest + 6] = np.log1p(count / np.maximum(lines, 1))
        x[:, rest + 7] = distinct_lines / np.maximum(lines, 1)
        x[:, 0] = 1.0
    return out, real


def _matrix(column: pa.Array) -> np.ndarray:
    width = len(FEATURES)
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float32).reshape(-1, width).astype(np.float64)


def _held_out(x: np.ndarray) -> np.ndarray:
    """One half of the rows, equal rows together."""
    return (mix(np.floor(x.sum(axis=1) * 1e6).astype(np.int64).view(np.uint64)) & np.uint64(1)).astype(bool)


def _feature_table(docs: DataFrame, positives: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """x (float32 bytes) and whether the row is a trusted positive, for each document with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, real = features(batch.column(0))
            rows = x[real].astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in rows], pa.binary()), batch.column(1).filter(pa.array(real))], ["x", "positive"])

    trusted = positives.where("_trusted is not null").distinct().withColumn("positive", F.lit(True))
    small = trusted.count() * 16 <= BROADCAST_BYTES
    marked = docs.select(docs[text_col].cast("string").alias("text"), docs[id_col].alias("_id")).join(F.broadcast(trusted) if small else trusted, F.col("_id") == F.col("_trusted"), "left")
    return marked.select("text", F.coalesce("positive", F.lit(False)).alias("positive")).mapInArrow(lean(run), "x binary, positive boolean")


def _sums(table: DataFrame, of) -> list[np.ndarray]:
    """The sum over all rows of the arrays that of(x, positive) gives, added up on the executors first."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                found = of(_matrix(batch.column(0)), np.asarray(batch.column(1).to_numpy(zero_copy_only=False), dtype=bool))
                total = found if total is None else [a + b for a, b in zip(total, found)]
        if total is not None:
            flat = np.concatenate([np.ravel(a) for a in total]).astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array([flat.tobytes()], pa.binary())], ["s"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                one = np.frombuffer(blob, dtype=np.float64)
                total = one if total is None else total + one
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["s"])

    rows = table.mapInArrow(part, "s binary").repartition(GATHERED).mapInArrow(add, "s binary").collect()
    shapes = [np.shape(a) for a in of(np.zeros((1, len(FEATURES))), np.zeros(1, dtype=bool))]
    flat = np.sum([np.frombuffer(r.s, dtype=np.float64) for r in rows], axis=0) if rows else np.zeros(sum(int(np.prod(s)) for s in shapes))
    cuts = np.cumsum([int(np.prod(s)) for s in shapes])[:-1]
    return [a.reshape(s) for a, s in zip(np.split(flat, cuts), shapes)]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


def standardised(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Features less their means, in units of their spread, drawn towards 0 in short texts."""
    words = np.expm1(x[:, FEATURES.index("log_words")])
    z = (x - mean) / scale * (words / (words + HALF_WORDS))[:, None]
    z[:, 0] = 1.0
    return z


@dataclass
class Model:
    """A linear model over standardised features, its class prior and its history of (risk, negative part)."""

    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    prior: float
    history: list[tuple[float, float]]

    def margin(self, x: np.ndarray) -> np.ndarray:
        return standardised(x, self.mean, self.scale) @ self.weights


def class_prior(positive: np.ndarray, mixture: np.ndarray, trust: float = 1.0) -> float:
    """The prior from histograms of scores, both in the order of ascending score."""
    above_p, above_u = np.cumsum(positive[::-1]), np.cumsum(mixture[::-1])
    n_p, n_u = max(above_p[-1], 1), max(above_u[-1], 1)
    slack = trust * (np.sqrt(1 / n_p) + np.sqrt(1 / n_u))
    some = above_p > 0
    p, u = above_p[some] / n_p, above_u[some] / n_u
    best = np.argmin((u + slack) / p) if len(p) else 0
    return float(np.clip(u[best] / p[best], 0.01, 0.99)) if len(p) else 0.5


def fit(table: DataFrame, steps: int = STEPS, ridge: float = RIDGE) -> Model | None:
    """The model of a feature table; None if either side is empty."""
    width = len(FEATURES)
    n, n_p, s1, s2 = _sums(table, lambda x, pos: [np.array(float(len(x))), np.array(float(pos.sum())), x.sum(0), (x * x).sum(0)])
    if not n or not n_p:
        return None
    mean = s1 / n
    scale = np.sqrt(np.maximum(s2 / n - mean**2, 0.0))
    scale = np.where(scale < 1e-6, 1.0, scale)
    ridge_diagonal = np.full(width, ridge + RIDGE_OF_FEW / n_p)
    ridge_diagonal[0] = 1e-9
    standard = lambda x: standardised(x, mean, scale)

    weights = np.zeros(width)  # positives against the mixture, each class with half the weight
    for _ in range(max(2, steps // 2)):

        def passed(x, pos, weights=weights):
            seen = ~_held_out(x)
            z, pos = standard(x[seen]), pos[seen]
            s = _sigmoid(z @ weights)
            w = np.where(pos, 1 / n_p + 1 / n, 1 / n)
            target = np.where(pos, 1 / n_p, 0.0)
            return [z.T @ (w * s - target), (z * (w * s * (1 - s))[:, None]).T @ z]

        gradient, hessian = _sums(table, passed)
        step = np.linalg.solve(hessian + np.diag(ridge_diagonal), gradient + ridge_diagonal * weights)
        weights = weights - step
        if np.abs(step).max() < 1e-4:
            break

    def histogram(x, pos):
        held = _held_out(x)
        x, pos = x[held], pos[held]
        bin_ = np.minimum((_sigmoid(standard(x) @ weights) * BINS).astype(np.int64), BINS - 1)
        return [np.bincount(bin_[pos], minlength=BINS).astype(float), np.bincount(bin_, minlength=BINS).astype(float)]

    prior = class_prior(*_sums(table, histogram))

    def risk(w: np.ndarray, more: bool) -> list[np.ndarray]:
        def passed(x, pos):
            z = standard(x)
            g = z @ w
            s = _sigmoid(g)
            zero = 0.0 * w
            return [
                np.array([_softplus(-g[pos]).sum() / n_p, _softplus(g[pos]).sum() / n_p, _softplus(g).sum() / n]),
                z[pos].sum(0) / n_p if more else zero,
                z.T @ s / n if more else zero,
                (z * (s * (1 - s))[:, None]).T @ z / n if more else np.zeros((width, width)),
            ]

        return _sums(table, passed)

    weights, history, last = np.zeros(width), [], None
    found = risk(weights, True)
    for _ in range(steps):
        (pos_loss, pos_as_neg, all_as_neg), pos_mean, all_gradient, hessian = found
        negative = all_as_neg - prior * pos_as_neg
        value = prior * pos_loss + max(0.0, negative) + 0.5 * float(ridge_diagonal @ weights**2)
        history.append((float(value), float(negative)))
        if last is not None and last - value < 1e-6:
            break
        last = value
        # with logistic loss, l(g) - l(-g) = -g: the positives' part of the gradient doesn't depend on g
        gradient = all_gradient - prior * pos_mean + ridge_diagonal * weights
        step = np.linalg.solve(hessian + np.diag(ridge_diagonal), gradient)
        size = 1.0
        while True:
            trial = weights - size * step
            found = risk(trial, True)
            (a, b, c), *_ = found
            rest = c - prior * b
            if (rest >= 0 and prior * a + rest + 0.5 * float(ridge_diagonal @ trial**2) <= value + 1e-12) or size < 0.05:
                break
            size /= 2
        if rest < 0:
            break
        weights = trial
    return Model(weights, mean, scale, prior, history)


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "quality") -> Model | None:
    """The model from all documents and the rows of `labels` whose label is 1."""
    positives = labels.where(labels[label_col] == 1).select(labels[label_id].alias("_trusted"))
    return fit(scratch.materialise(_feature_table(docs, positives, id_col, text_col), "features"))


def _judged(model: Model | None, column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    if model is None:
        return pa.nulls(len(column), pa.float64()), np.ones(len(column), dtype=bool)
    x, real = features(column)
    score = np.where(real, np.round(_sigmoid(model.margin(x)), 6), 0.0)
    return pa.array(score), score >= 0.5


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (chance of being good, 6 places) and keep of each document."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value, good = _judged(model, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), value, pa.array(good)], ["doc_id", "score", "keep"])

    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(lean(run), f"doc_id {kind}, score double, keep boolean")


def keep(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows of `docs` that pass, with all their columns as they were."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_judged(model, batch.column(at))[1]))

    return docs.mapInArrow(lean(run), docs.schema)
