"""Concatenate-and-cut packing (operator 1).

First pass: documents become ids where they lie; a written table keeps them with the part
they are in and the ids before them in that part. The totals of the parts, one row each, give
the global offset of every part by a prefix sum. Second pass: the stream of all ids is cut
into fixed windows, a document that crosses a boundary leaving one piece on each side. Ids
are never shuffled.
"""

from __future__ import annotations

import base64
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from reaction_norms.llm.common import documents, process_cache, stored

LENGTH, END = 1024, 0


@dataclass
class Coder:
    """Byte-level BPE ids of whole texts. ``ranks`` holds the vocabulary of ``tokenizer`` as ranks;
    texts with the string of a special token, and those whose runs of white space are too long
    for the matcher of the ranks' coder, go to ``tokenizer`` itself."""

    tokenizer: str
    ranks: str

    def __post_init__(self):
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(self.ranks, "rb"))}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        self.full = Tokenizer.from_file(self.tokenizer)
        self.special = [t.content for t in self.full.get_added_tokens_decoder().values()]
        self.kind = np.dtype("<u2" if self.full.get_vocab_size() <= 1 << 16 else "<u4")

    def encode(self, text: str) -> bytes:
        ids = None
        if not any(s in text for s in self.special):
            try:
                ids = self.fast.encode_to_numpy(text)
            except ValueError:  # its matcher ran out of stack
                pass
        if ids is None:
            ids = np.array(self.full.encode(text, add_special_tokens=False).ids)
        return ids.astype(self.kind).tobytes()


def coder(tokenizer: str, ranks: str) -> Coder:
    """One coder for each worker process."""
    made = process_cache()
    if (tokenizer, ranks) not in made:
        made[tokenizer, ranks] = Coder(tokenizer, ranks)
    return made[tokenizer, ranks]


def encoded(docs: DataFrame, tokenizer: str | None = None, ranks: str | None = None, end: int = END) -> DataFrame:
    """chunk, before, doc_id, n, width, ids: ids (little-endian, two or four bytes each) with the end id."""
    tokenizer = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    ranks = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def run(batches):
        code = coder(tokenizer, ranks)
        close, width, before = np.array([end], code.kind).tobytes(), code.kind.itemsize, 0
        for batch in batches:
            texts = batch["text"].to_pylist()
            for i in range(0, len(texts), 500):
                ids = [code.encode(t or "") + close for t in texts[i : i + 500]]
                n = np.fromiter((len(x) // width for x in ids), np.int64, len(ids))
                starts = before + np.cumsum(n) - n
                before += int(n.sum())
                part = batch.slice(i, 500)
                yield pa.RecordBatch.from_arrays(
                    [part["chunk"], pa.array(starts), part["doc_id"], pa.array(n), pa.array([width] * len(ids), pa.int32()), pa.array(ids, pa.binary())],
                    ["chunk", "before", "doc_id", "n", "width", "ids"],
                )

    rows = docs.select(F.spark_partition_id().alias("chunk"), F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "chunk int, before long, doc_id long, n long, width int, ids binary")


def pack(docs: DataFrame, length: int = LENGTH, tokenizer: str | None = None, ranks: str | None = None, end: int = END) -> DataFrame:
    """Pieces that fill sequences of ``length`` ids without a gap; only the last may be short.

    Columns: doc_id, start, length, doc_tokens, sequence_id, offset, ids (binary, little-endian
    unsigned 32-bit). Documents lie in the order of the input's parts. Null and empty texts are
    the end id alone. Repeated rows are packed as often as they come. No rows: no pieces. Extra
    columns are not read.
    """
    tokens = stored(encoded(docs, tokenizer, ranks, end), "ids")
    # one row per part of the input: its number is bounded by the number of scan tasks
    totals = tokens.groupBy("chunk").agg(F.max(F.col("before") + F.col("n")).alias("total"))
    ahead = Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("chunk", F.coalesce(F.sum("total").over(ahead), F.lit(0)).alias("ahead"))
    placed = tokens.join(F.broadcast(offsets), "chunk").select("doc_id", (F.col("ahead") + F.col("before")).alias("at"), "n", "width", "ids")

    def run(batches):
        for batch in batches:
            at, n = batch["at"].to_numpy(), batch["n"].to_numpy()
            # a piece for each window that a document touches
            first, last = at // length, (at + n - 1) // length
            count = last - first + 1
            row = np.repeat(np.arange(len(at)), count)
            window = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + first[row]
            begin = np.maximum(at[row], window * length)
            stop = np.minimum(at[row] + n[row], (window + 1) * length)
            low, high = begin - at[row], stop - at[row]
            width, ids = batch["width"].to_pylist(), batch["ids"].to_pylist()
            wide = [np.frombuffer(x, "<u2" if w == 2 else "<u4").astype("<u4").tobytes() for x, w in zip(ids, width)]
            for i in range(0, len(row), 20_000):
                s = slice(i, i + 20_000)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["doc_id"].take(pa.array(row[s])),
                        *(pa.array(c[s]) for c in (low, high - low, n[row], window, begin - window * length)),
                        pa.array([wide[r][4 * a : 4 * b] for r, a, b in zip(row[s].tolist(), low[s].tolist(), high[s].tolist())], pa.binary()),
                    ],
                    ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
                )

    return placed.mapInArrow(run, "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


def op1_packing(spark, sf_dir) -> DataFrame:
    return pack(documents(spark, sf_dir)).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
