"""Quality scores by a support vector machine on naive-Bayes features (operator 3).

Features are indicators of n-grams of word shapes (letters, capitals, digits and marks, runs
collapsed), so that the score follows how a text is written and not what it is about. Each
indicator is scaled by the log-count ratio of the two classes; a linear hinge-loss model is
fitted on them by dual coordinate descent, and its margin turned into a chance by a logistic
curve through out-of-fold margins. Fitted on a bounded sample of labelled rows, applied to all.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reaction_norms.llm.common import by_batch, documents, table
from reaction_norms.llm.labelled import sample

SAMPLE, THRESHOLD = 20_000, 0.3


@cache
def _classes() -> np.ndarray:
    """Shape letter of each code point of the basic plane."""

    def one(c: str) -> int:
        if c.isspace():
            return ord(" ")
        if c.isupper():
            return ord("A")
        if c.isalpha():
            return ord("a")
        if c.isdigit():
            return ord("0")
        return ord(c) if 33 <= ord(c) < 127 else ord("?")

    return np.array([one(chr(i)) for i in range(1 << 16)], np.uint8)


def shapes(text: str) -> list[bytes]:
    """Shapes of the words, such as b'Aa', b'a,' or b'0'; equal neighbouring classes count once."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = np.where(points < 1 << 16, _classes()[points & 0xFFFF], ord("?")).astype(np.uint8)
    if len(kinds):
        kinds = kinds[np.r_[True, kinds[1:] != kinds[:-1]]]
    return kinds.tobytes().split()


def features(text: str) -> list[int]:
    """Signed 64-bit names of the n-grams present: one to three shapes, a word two or three times
    in a row, and the length class."""
    s, words = shapes(text), text.split()
    grams = set(s)
    grams.update(map(b" ".join, set(zip(s, s[1:]))))
    grams.update(map(b" ".join, set(zip(s, s[1:], s[2:]))))
    same = [a == b for a, b in zip(words, words[1:])]
    if True in same:
        grams.add(b" same")
        if any(a and b for a, b in zip(same, same[1:])):
            grams.add(b" same same")
    grams.add(b" length %d" % len(words).bit_length())
    return [xxhash.xxh3_64_intdigest(g) - (1 << 63) for g in grams]


def dual_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, n: int, cost: np.ndarray, epochs: int = 12, seed: int = 0) -> np.ndarray:
    """Weights of the L2-regularised hinge loss: each step solves one dual variable exactly and
    moves the weights along its row."""
    w, alpha = np.zeros(n), np.zeros(len(rows))
    square = np.array([v @ v for v in values])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            if not square[i]:
                continue
            slope = y[i] * (w[rows[i]] @ values[i]) - 1
            new = min(max(alpha[i] - slope / square[i], 0.0), cost[i])
            if new != alpha[i]:
                w[rows[i]] += (new - alpha[i]) * y[i] * values[i]
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-4:
            break
    return w


def log_count_ratio(rows: list[np.ndarray], y: np.ndarray, n: int, smooth: float = 1.0) -> np.ndarray:
    count = {}
    for sign in (1, -1):
        chosen = [r for r, s in zip(rows, y) if s == sign]
        count[sign] = smooth + np.bincount(np.concatenate([*chosen, np.empty(0, np.int64)]).astype(np.int64), minlength=n)
    return np.log(count[1] / count[1].sum()) - np.log(count[-1] / count[-1].sum())


def logistic_curve(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and height of the curve 1 / (1 + exp(-(slope * margin + height))), by Newton steps
    with slightly softened labels."""
    up = (y > 0).sum()
    goal = np.where(y > 0, (up + 1) / (up + 2), 1 / (len(y) - up + 2))
    x = np.c_[margin, np.ones(len(margin))]
    at = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
        grad = x.T @ (p - goal) + 1e-3 * at
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        at -= step
        if np.abs(step).max() < 1e-8:
            break
    return float(at[0]), float(at[1])


@dataclass
class QualityModel:
    """Weights by feature name; ``slope`` and ``height`` of the logistic curve."""

    names: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float
    height: float

    def score(self, text: str) -> float:
        found = np.fromiter(features(text), np.int64)
        at = np.minimum(np.searchsorted(self.names, found), max(0, len(self.names) - 1))
        margin = self.bias + (self.weights[at[self.names[at] == found]].sum() if len(self.names) else 0.0)
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.height, -30, 30))))


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE, folds: int = 5, least: int = 3, cost: float = 0.5) -> QualityModel:
    """Fit on at most ``rows`` labelled documents whose crc32 of doc_id is not divisible by 5.

    Features of fewer than ``least`` sampled texts are left out. Copies of a text are in one
    fold. With one class only, or none, every score is the smoothed share of good texts.
    """
    learn = F.crc32(F.col("doc_id").cast("string")) % 5 != 0
    kind = "label int, fold long, names array<long>"

    def named(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch["text"].to_pylist()
        fold = [xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) % folds for t in texts]
        return pa.RecordBatch.from_arrays([batch["label"], pa.array(fold, pa.int64()), pa.array([features(t) for t in texts], pa.list_(pa.int64()))], ["label", "fold", "names"])

    got = by_batch(sample(docs, labels, "quality", rows, where=learn), named, kind).toArrow()
    y = np.where(got["label"].to_numpy() == 1, 1, -1)
    fold = got["fold"].to_numpy()
    listed = got["names"].combine_chunks()
    flat, ends = listed.flatten().to_numpy(), np.r_[0, np.cumsum(listed.value_lengths().to_numpy())].astype(int)
    if len(set(y)) < 2:
        share = ((y > 0).sum() + 1) / (len(y) + 2)
        return QualityModel(np.empty(0, np.int64), np.empty(0), 0.0, 0.0, float(np.log(share / (1 - share))))
    names, n = np.unique(flat, return_counts=True)
    names = names[n >= least]
    at = np.searchsorted(names, flat)
    at = np.where((at < len(names)) & (names[np.minimum(at, len(names) - 1)] == flat), at, -1)
    x = [(r := at[a:b])[r >= 0] for a, b in zip(ends[:-1], ends[1:])]
    order = np.lexsort((flat[ends[:-1]], fold))  # independent of the order in which tasks end
    x, y, fold = [np.sort(x[i]) for i in order], y[order], fold[order]
    per_class = {s: len(y) / (2 * (y == s).sum()) for s in (1, -1)}

    def one(chosen: np.ndarray) -> tuple[np.ndarray, float]:
        rows_, y_ = [x[i] for i in chosen], y[chosen]
        ratio = log_count_ratio(rows_, y_, len(names))
        # the last feature is the constant; rows have unit length
        wide = [np.r_[r, len(names)] for r in rows_]
        values = []
        for r in rows_:
            v = np.r_[ratio[r], 1.0]
            values.append(v)
        scale = np.array([1 / np.sqrt(v @ v) for v in values])
        w = dual_descent(wide, [v * s for v, s in zip(values, scale)], y_, len(names) + 1, cost * np.array([per_class[s] for s in y_]))
        return w[:-1] * ratio, float(w[-1])

    def margins(w: np.ndarray, bias: float, chosen: np.ndarray) -> np.ndarray:
        return np.array([bias + w[x[i]].sum() for i in chosen])

    out = np.zeros(len(y))
    for f in range(folds):
        held = np.flatnonzero(fold == f)
        rest = np.flatnonzero(fold != f)
        if len(held) and len(set(y[rest])) == 2:
            out[held] = margins(*one(rest), held)
    w, bias = one(np.arange(len(y)))
    return QualityModel(names, w, bias, *logistic_curve(out, y))


def scored(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted of every row. Null texts are scored as empty ones; repeated rows
    alike. No rows: no rows. Only doc_id and text are read, so extra columns have no effect."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        score = np.array([model.score(t or "") for t in batch["text"].to_pylist()], np.float64)
        return pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return by_batch(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), rows, "doc_id long, score double, predicted int")


def op3_quality(spark, sf_dir) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(docs, table(spark, sf_dir, "labels"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return scored(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")
