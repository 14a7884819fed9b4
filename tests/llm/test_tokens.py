"""Token counts against the tokenizer's library, and task code on workers without the package."""

import os
import random
import subprocess
import sys

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from reaction_norms.llm import common, tokens

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_every_document_counts_as_in_the_library(spark, sf, library):
    got = {r.doc_id: r for r in tokens.op12_token_counts(spark, sf).collect()}
    rows = common.documents(spark, sf).collect()
    assert len(got) == len(rows)
    for r in rows:
        n = len(library.encode(r.text or ""))
        found = got[r.doc_id]
        assert (found.n_bytes, found.n_tokens, found.over_limit) == (len((r.text or "").encode()), n, n > 4096)


def test_random_texts_count_as_in_the_library(library):
    rng, count = random.Random(5), tokens.Counter(MODEL).count
    parts = ["a", "the", " ", "   ", "\n", "\t", "▁", "é", "漢字", "́", "😀", "\x00", "<s>", "</s>", "<0x0A>", "12", ".", "ing", "　", "Hello", "\r\n", "==", "﻿", " " * 37]
    for _ in range(5000):
        text = "".join(rng.choice(parts) if rng.random() < 0.7 else chr(rng.choice([rng.randrange(32, 0x500), rng.randrange(0x4E00, 0x9FFF), rng.randrange(0x1F300, 0x1F700)])) for _ in range(rng.randrange(40)))
        assert count(text) == len(library.encode(text)), text


@pytest.mark.parametrize("text", [" " * 300_000 + "x", "漢字" * 50_000, "ab" * 100_000, "word " * 100_000, "<s>" * 50_000, "͸" * 50_000])
def test_long_texts(library, text):
    assert tokens.Counter(MODEL).count(text) == len(library.encode(text))


def test_remembered_counts_are_bounded(library, monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 10)
    counter = tokens.Counter(MODEL)
    text = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300))
    assert counter.count(text) == len(library.encode(text)) and len(counter) <= 10


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, " "), (None, "a b"), (4, "same"), (4, "same")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n_tokens": F.lit("clash"), "n_bytes": F.lit(1)})
    got = sorted(tuple(r) for r in tokens.token_counts(df, limit=1).filter("doc_id is not null").collect())
    assert got == [(1, 0, 0, False), (2, 0, 0, False), (3, 1, 1, False), (4, 4, 1, False), (4, 4, 1, False)]
    assert [tuple(r) for r in tokens.token_counts(df, limit=1).filter("doc_id is null").collect()] == [(None, 3, 2, True)]
    assert tokens.token_counts(df.limit(0)).count() == 0


def test_workers_without_the_package(tmp_path):
    """A driver that has the package, workers that have not."""
    code = f"""
import sys; sys.path.insert(0, {ROOT!r})
from reaction_norms.session import local_session
from reaction_norms.llm import centroids, codes, packing, tokens, winnowing, simhash
spark = local_session("bare", 2)
df = spark.createDataFrame([(1, "one two"), (2, "three")], "doc_id long, text string")
print(tokens.token_counts(df).count(), packing.pack(df).count(), simhash.near_duplicates(df).count(), winnowing.edit_trial(df).count())
vectors = spark.createDataFrame([(i, [float(i)] * 64, 1) for i in range(9)], "vec_id long, embedding array<float>, label int")
print(centroids.clusters(vectors)[0].count(), codes.codes(vectors)[0].count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=280)
    assert done.returncode == 0, done.stderr[-3000:]
    assert done.stdout.split() == ["2", "2", "2", "2", "9", "9"]
