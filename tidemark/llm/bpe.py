"""Problem 8: encoding of the whole corpus with a public byte-level BPE tokenizer.

Method: contiguous rank array.  A word is kept as its part boundaries and, beside
them, the rank of every two adjacent parts; the minimum is looked up again and
again, the boundary it stands for deleted, and the two neighbouring ranks
refreshed.  Words above ``LONG`` bytes use a heap with linked parts, which gives
the same merges without the quadratic scans.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.arrowmap import bounded

#: Fixed value: the public word pattern of the 50k byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
NEVER = 1 << 60
LONG = 400
#: Words a worker remembers before it starts anew.
REMEMBERED = 400_000


def load_ranks(content: bytes) -> dict[bytes, int]:
    """Ranks of a vocabulary file: one token in base64 and its rank a line."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines())}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one word."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    if len(word) > LONG:
        return _merge_long(word, ranks)
    get = ranks.get
    bounds = list(range(len(word) + 1))
    rank = [get(word[i : i + 2], NEVER) for i in range(len(word) - 1)]
    while rank:
        lowest = min(rank)
        if lowest == NEVER:
            break
        i = rank.index(lowest)
        del bounds[i + 1], rank[i]
        if i < len(rank):
            rank[i] = get(word[bounds[i] : bounds[i + 2]], NEVER)
        if i:
            rank[i - 1] = get(word[bounds[i - 1] : bounds[i + 1]], NEVER)
    return [ranks[word[a:b]] for a, b in zip(bounds, bounds[1:])]


def _merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    get, n = ranks.get, len(word)
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    # An entry is stale once either part has changed; its end tells.
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, end = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or j >= n or after[j] != end:
            continue
        alive[j] = False
        after[i] = end
        if end < n:
            before[end] = i
            if (r := get(word[i : after[end]])) is not None:
                heapq.heappush(heap, (r, i, after[end]))
        if (p := before[i]) >= 0 and (r := get(word[p:end])) is not None:
            heapq.heappush(heap, (r, p, end))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : after[i]]])
        i = after[i]
    return out


class Encoder(dict):
    """Ids by word, filled on demand."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        super().__init__()
        self.ranks, self.find = ranks, regex.compile(pattern).findall

    def __missing__(self, word: str) -> list[int]:
        if len(self) >= REMEMBERED:
            self.clear()
        # A lone surrogate can't come out of Spark; it would be encoded as the replacement character.
        ids = merge(word.encode("utf-8", "replace"), self.ranks)
        if len(word) <= LONG:
            self[word] = ids
        return ids


_ENCODERS: dict[str, Encoder] = {}


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """One row ``id, ids`` per row of ``df``: the token ids of its text, without special tokens.

    A null and an empty text have an empty list.  The vocabulary (a fixed file of
    about 50,000 tokens) is read on the driver and broadcast.  Strings of special
    tokens are ordinary text.  A narrow operator: rows are neither moved nor
    counted, and repeated rows are encoded as often as they come.
    """
    content = df.sparkSession.sparkContext.broadcast(Path(vocabulary).read_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"{vocabulary}\n{pattern}"
        encoder = _ENCODERS.get(name)
        if encoder is None:
            encoder = _ENCODERS[name] = Encoder(load_ranks(content.value), pattern)
        for batch in bounded(batches, "text"):
            ids: list[int] = []
            cuts = [0]
            for text in batch.column("text").to_pylist():
                if text:
                    for word in encoder.find(text):
                        ids += encoder[word]
                cuts.append(len(ids))
            values = pa.array(np.array(ids, np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), values)], ["id", "ids"])

    kind = dict(df.dtypes)[id_col]
    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, ids array<int>")
