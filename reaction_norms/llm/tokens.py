"""Token counts by heap-and-linked-list byte-pair merging (operator 12).

A text's symbols, at first its characters, lie in a doubly linked list; a heap holds the adjacent
pairs that are pieces of the vocabulary, by rank, then from left to right. The lowest pair is popped
and merged again and again until none is left. The count is the number of initial symbols less the
number of merges; a character without a piece counts one symbol for each of its bytes. No ids arise.

No merge crosses a place where no piece has the two characters side by side. Texts are cut
at such places before merging, so the short strings that come up again and again are
merged once for each worker process and then looked up. Nothing is shuffled.
"""

from __future__ import annotations

import re
from heapq import heapify, heappop, heappush

import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from reaction_norms.llm.common import by_batch, documents, process_cache

LIMIT = 4096
#: Most counts that a worker process remembers, and most characters of a string whose count it remembers.
REMEMBERED, SHORT = 1 << 19, 48
SPACE_MARK = "▁"


class Counter(dict):
    """Counts of strings under a sentencepiece BPE model with byte fallback, remembered within bounds.

    Of the library's reader of the model it uses the pieces, their scores and the normalisation of texts
    (white-space marks, leading mark), never its encoder. Control pieces are no text, so their
    strings in a text are merged like any other. Models with user-defined or unused pieces are not covered.
    """

    def __init__(self, model: str):
        reader = SentencePieceProcessor(model_file=model)
        self.normalize = reader.normalize
        pieces = {reader.id_to_piece(i): -reader.get_score(i) for i in range(reader.get_piece_size()) if not (reader.is_byte(i) or reader.is_control(i) or reader.is_unknown(i))}
        if not any(map(reader.is_byte, range(reader.get_piece_size()))) or any(map(reader.is_unused, range(reader.get_piece_size()))):
            raise ValueError(f"{model}: token counts need byte fallback and no unused pieces")
        #: Lower rank merges first; equal scores have equal ranks, and the leftmost pair of them goes first.
        self.rank = {p: r for p, r in pieces.items() if len(p) > 1}
        self.known = {p for p in pieces if len(p) == 1}
        #: Characters side by side in some piece: merges happen nowhere else.
        self.pairs = {p[i : i + 2] for p in self.rank for i in range(len(p) - 1)}
        merging = re.escape("".join(sorted(set("".join(self.rank)) - {SPACE_MARK})))
        joined = any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in self.rank)
        mark = re.escape(SPACE_MARK)
        # marks and what follows them; or, where pieces hold inner marks, all that merges
        together = f"[{mark}{merging}]+" if joined else f"{mark}*[{merging}]+|{mark}+"
        self.parts = re.compile(f"{together}|[^{mark}{merging}]+").findall

    def __missing__(self, part: str) -> int:
        cuts = [i for i in range(1, len(part)) if part[i - 1 : i + 1] not in self.pairs]
        n = sum(map(self.__getitem__, map(part.__getitem__, map(slice, [0, *cuts], [*cuts, None])))) if cuts else self.merged(part)
        if len(part) <= SHORT:
            if len(self) >= REMEMBERED:
                self.clear()
            self[part] = n
        return n

    def merged(self, part: str) -> int:
        """Initial symbols less merges, for a string that is normalised."""
        rank, known = self.rank, self.known
        piece: list[str | None] = list(part)
        count = sum(1 if c in known else len(c.encode("utf-8", "surrogatepass")) for c in piece)
        after, ahead = list(range(1, len(piece) + 1)), list(range(-1, len(piece) - 1))
        heap = [(rank[p], i, i + 1, 2) for i in range(len(piece) - 1) if (p := part[i : i + 2]) in rank]
        heapify(heap)
        while heap:
            _, left, right, size = heappop(heap)
            a, b = piece[left], piece[right]
            if a is None or b is None or len(a) + len(b) != size:
                continue  # one side has been merged meanwhile
            # characters that merge stand for one symbol each: every piece's characters are pieces themselves,
            # or else they had counted as bytes, which the merge makes up for
            count -= 1 + sum(len(c.encode()) - 1 for c in (a, b) if len(c) == 1 and c not in known)
            piece[left], piece[right] = a + b, None
            after[left] = stop = after[right]
            start = ahead[left]
            if stop < len(piece):
                ahead[stop] = left
                if (r := rank.get(p := piece[left] + piece[stop])) is not None:
                    heappush(heap, (r, left, stop, len(p)))
            if start >= 0 and (r := rank.get(p := piece[start] + piece[left])) is not None:
                heappush(heap, (r, start, left, len(p)))
        return count

    def count(self, text: str) -> int:
        return sum(map(self.__getitem__, self.parts(self.normalize(text)))) if text else 0


def counter(model: str) -> Counter:
    """One counter for each worker process and model."""
    made = process_cache()
    if model not in made:
        made[model] = Counter(model)
    return made[model]


def token_counts(docs: DataFrame, model: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row, counted on the whole text.

    Null texts count as empty ones: no bytes, no tokens. Repeated rows count alike. No rows: no rows.
    Extra columns are not read. A text of any length is held in one task, like any value of a row.
    """
    model = model or public_tokenizers.path("piece_bpe_32k.model")

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        count = counter(model).count
        n = pa.array([count(t) if t else 0 for t in batch["text"].to_pylist()], pa.int64())
        size = pc.fill_null(pc.cast(pc.binary_length(batch["text"]), pa.int64()), 0)
        return pa.RecordBatch.from_arrays([batch["doc_id"], size, n, pc.greater(n, limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return by_batch(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), rows, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op12_token_counts(spark, sf_dir) -> DataFrame:
    return token_counts(documents(spark, sf_dir))
