"""Toxicity by a chain of linear classifiers (operator 2).

Categories are predicted one after another: abuse of persons, contempt, and at last toxicity
as labelled. Each later model also sees the chances that the earlier models give. In training
these come from models that did not see the row (out-of-fold), so that a later model learns
how far to trust them. Features are indicators of lower-cased words and of word beginnings, chosen on a bounded
sample of labelled rows; the chain scores every whole text.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reaction_norms.llm.common import DOCUMENT, by_batch, documents, stored, table
from reaction_norms.llm.labelled import sample

SAMPLE, VOCABULARY, THRESHOLD = 10_000, 800, 0.5
PREFIXES = (4, 6)

# Seed words of the categories that the labels do not tell apart. A labelled toxic
# text with a seed word is an example of the category.
SEEDS = {
    "abuse": ("idiot", "moron", "stupid", "loser", "clown", "scum", "fool", "dumb"),
    "contempt": ("trash", "garbage", "pathetic", "worthless", "disgusting", "filthy", "hate"),
}
CATEGORIES = (*SEEDS, "toxic")
_WORD = re.compile(r"[^\W\d_]+")


def words(text: str) -> set[str]:
    """Lower-cased words, and their beginnings, marked ``~``, and ``~~`` where two different words
    share them: these catch inflected forms that no labelled text has."""
    found = set(_WORD.findall(text.lower()))
    out = set(found)
    for n in PREFIXES:
        starts = [w[:n] for w in found if len(w) > n]
        once = set(starts)
        out.update([p + "~" for p in once])
        if len(once) < len(starts):
            out.update([p + "~~" for p, k in Counter(starts).items() if k > 1])
    return out


def logistic(x: np.ndarray, y: np.ndarray, used: np.ndarray, ridge: float = 1e-4, steps: int = 300) -> np.ndarray:
    """Ridge logistic weights (constant last) of the rows ``used``, by accelerated gradient steps; x is never copied."""
    weight = (used / used.sum()).astype(x.dtype)

    def times(v: np.ndarray) -> np.ndarray:
        return x @ v[:-1].astype(x.dtype) + x.dtype.type(v[-1])

    def back(v: np.ndarray) -> np.ndarray:
        return np.r_[v.astype(x.dtype) @ x, v.sum()]

    w = now = np.zeros(x.shape[1] + 1)
    # the curvature is at most a quarter of the greatest eigenvalue of x'x/n, found by power steps
    v = np.ones(x.shape[1] + 1, x.dtype)
    for _ in range(20):
        v = back(weight * times(v))
        top = float(np.linalg.norm(v))
        v /= top
    rate = 1 / (0.25 * 1.1 * top + ridge)
    for t in range(steps):
        p = 1 / (1 + np.exp(-np.clip(times(now), -30, 30)))
        new = now - rate * (back(weight * (p - y)) + ridge * now)
        if (new - now) @ (new - w) < 0:  # overshot: start the momentum anew
            now = w
            continue
        w, now = new, new + t / (t + 3) * (new - w)
    return w


def chance(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1].astype(x.dtype) + w[-1], -30, 30)))


@dataclass
class Chain:
    """Words by place, and for each category the weights of words, earlier chances and constant."""

    place: dict[str, int]
    models: dict[str, np.ndarray]

    def chances(self, text: str) -> list[float]:
        found = [self.place[w] for w in self.place.keys() & words(text)]
        out: list[float] = []
        for w in self.models.values():
            n = len(self.place)
            z = w[found].sum() + sum(a * b for a, b in zip(w[n:-1], out)) + w[-1]
            out.append(float(1 / (1 + np.exp(-np.clip(z, -30, 30)))))
        return out


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE, vocabulary: int = VOCABULARY, folds: int = 3, seeds: dict = SEEDS) -> Chain:
    """Fit the chain on at most ``rows`` labelled documents and ``vocabulary`` words.

    Words are those whose shares in toxic and other texts differ most for their counts. Copies of a
    text are in one fold. A category with one class only has the smoothed share for all.
    """
    picked = sample(docs, labels, "toxic", rows)

    def listed(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch["text"].to_pylist()
        return pa.RecordBatch.from_arrays([batch["doc_id"], batch["label"], pa.array([sorted(words(t)) for t in texts], pa.list_(pa.string()))], ["doc_id", "label", "words"])

    picked = stored(by_batch(picked, listed, "doc_id long, label int, words array<string>").withColumn("fold", F.pmod(F.xxhash64("words"), F.lit(folds))), "sample")
    n = picked.agg(F.count("*").alias("all"), F.coalesce(F.sum("label"), F.lit(0)).alias("toxic")).first()
    share = (n["toxic"] + 1) / (n["all"] + 2)
    seen = picked.select("label", F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"), F.sum("label").alias("toxic"))
    spread = F.sqrt(F.col("n") * share * (1 - share))
    top = seen.filter("n >= 5").orderBy(F.desc(F.abs(F.col("toxic") - F.col("n") * share) / spread), "word").limit(vocabulary)
    place = {w: i for i, w in enumerate(sorted(r["word"] for r in top.collect()))}
    seeded = [(len(place) + i, frozenset(ws)) for i, ws in enumerate(seeds.values())]

    def placed(batch: pa.RecordBatch) -> pa.RecordBatch:
        # places of the words, and behind them those of the categories that have a seed word in the text
        at = [[place[w] for w in ws if w in place] + [i for i, known in seeded if not known.isdisjoint(ws)] for ws in batch["words"].to_pylist()]
        return pa.RecordBatch.from_arrays([batch["doc_id"], batch["label"], batch["fold"], pa.array(at, pa.list_(pa.int32()))], ["doc_id", "label", "fold", "at"])

    got = by_batch(picked.select("doc_id", "label", "fold", "words"), placed, "doc_id long, label int, fold long, at array<int>").orderBy("doc_id", "label").toArrow()
    fold, toxic = (got[c].to_numpy().astype(np.float64) for c in ("fold", "label"))
    at = got["at"].combine_chunks()
    # one dense matrix, at most ``rows`` by ``vocabulary`` and the categories: words, then each category's place
    n_words = len(place)
    x = np.zeros((len(got), n_words + len(seeds)), np.float32)
    x[np.repeat(np.arange(len(at)), at.value_lengths().to_numpy()), at.flatten().to_numpy()] = 1
    marks = {c: toxic * x[:, n_words + i] for i, c in enumerate(seeds)} | {"toxic": toxic}
    models = {}
    for i, (name, y) in enumerate(marks.items()):
        both = x[:, : n_words + i]  # words and earlier chances
        if len(set(y)) < 2:
            even = (y.sum() + 1) / (len(y) + 2)
            w = np.r_[np.zeros(both.shape[1]), np.log(even / (1 - even))]
            out = np.full(len(y), even)
        else:
            w, out = logistic(both, y, np.ones(len(y))), np.full(len(y), y.mean())
            for f in range(folds):
                held = fold == f
                if held.any() and len(set(y[~held])) == 2:
                    out[held] = chance(both, logistic(both, y, ~held))[held]
        models[name] = w
        if name in seeds:
            x[:, n_words + i] = out  # the place of the category, whose marks are read already
    return Chain(place, models)


def scored(docs: DataFrame, chain: Chain, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, a chance per category (p_...), rejected, of every row.

    Null texts are scored as empty ones; repeated rows alike. No rows: no rows. Extra columns
    are not read.
    """
    names = [f"p_{c}" for c in chain.models]

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        p = np.array([chain.chances(t or "") for t in batch["text"].to_pylist()]).reshape(-1, len(names))
        return pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(p[:, i]) for i in range(len(names))), pa.array(p[:, -1] >= threshold)], ["doc_id", *names, "rejected"])

    return by_batch(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), rows, "doc_id long, " + ", ".join(f"{n} double" for n in names) + ", rejected boolean")


def without_toxic(docs: DataFrame, chain: Chain, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the chain does not reject, as they are."""

    def keep(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array([chain.chances(t or "")[-1] < threshold for t in batch["text"].to_pylist()], pa.bool_()))

    docs = docs.select(*DOCUMENT)
    return by_batch(docs, keep, docs.schema.simpleString()[len("struct<") : -1])


def op2_toxicity(spark, sf_dir) -> DataFrame:
    docs = documents(spark, sf_dir)
    return scored(docs, fit(docs, table(spark, sf_dir, "labels")))
