"""Byte-pair encoding of whole texts with a public vocabulary of merge ranks.

A word's bytes form a doubly linked list of symbols; a priority queue holds the merge of each adjacent
pair by rank and place. The lowest is taken, entries whose symbols have changed since are skipped, and
the pairs left and right of the merged symbol are queued. Words repeat, so each Python worker keeps the
ids of those it met in a dictionary of bounded size.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

#: Where the vocabulary files lie; a parameter of every entry point.
TOKENIZERS = "/opt/tokenizers"
# Fixed value: the public pattern that splits text before merging; blanks are those of Unicode.
_WS = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+"
#: Words a worker remembers before it starts over.
REMEMBERED = 200_000


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank, from a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}


class Bpe:
    """Encoder and decoder over one vocabulary."""

    def __init__(self, ranks: dict[bytes, int]):
        import regex

        self.ranks = ranks
        self.split = regex.compile(SPLIT).findall
        self.known: dict[str, list[int]] = {}

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word."""
        ranks = self.ranks
        if word in ranks:
            return [ranks[word]]
        n = len(word)
        parts: list[bytes | None] = [word[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = []
        for i in range(n - 1):
            if (r := ranks.get(word[i : i + 2])) is not None:
                queue.append((r, i, 1, 1))
        heapq.heapify(queue)
        while queue:
            _, i, left, right = heapq.heappop(queue)
            j = after[i]
            # Stale: one of the two symbols has been merged since the entry was queued.
            if parts[i] is None or j >= n or len(parts[i]) != left or len(parts[j]) != right:
                continue
            parts[i] += parts[j]
            parts[j] = None
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (r := ranks.get(parts[a] + parts[b])) is not None:
                    heapq.heappush(queue, (r, a, len(parts[a]), len(parts[b])))
        return [ranks[p] for p in parts if p is not None]

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; [] for null and empty. Nothing in a text is a special token."""
        ids: list[int] = []
        if not text:
            return ids
        known = self.known
        for w in self.split(text):
            got = known.get(w)
            if got is None:
                got = self.merge(w.encode("utf-8", "replace"))
                if len(known) >= REMEMBERED:
                    known.clear()
                if len(w) <= 64:
                    known[w] = got
            ids += got
        return ids

    def decoder(self) -> dict[int, bytes]:
        return {i: t for t, i in self.ranks.items()}


def decode(ids: list[int], strings: dict[int, bytes]) -> str:
    """The text of ids, by concatenating vocabulary strings."""
    return b"".join(strings[i] for i in ids).decode("utf-8", "replace")


def encode_column(df: DataFrame, text: str, to: str, vocabulary: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken") -> DataFrame:
    """`df` with the token ids of `text` in a new column `to`; [] for null and empty texts.

    The vocabulary is read once on the driver and broadcast (50 thousand short strings, whatever the
    data). Narrow: no shuffle, rows stay where they are, however long a text is. `to` must be new.
    """
    if to in df.columns:
        raise ValueError(f"column {to} is there already")
    ranks = df.sparkSession.sparkContext.broadcast(load_ranks(vocabulary))
    schema = StructType([*df.schema.fields, StructField(to, ArrayType(IntegerType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe(ranks.value)
        for b in batches:
            lists = [bpe.encode(t) for t in b.column(text).to_pylist()]
            ends = np.cumsum([0, *map(len, lists)]).astype(np.int32)
            flat = np.fromiter((i for x in lists for i in x), np.int32, ends[-1])
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*b.columns, ids], names=[*b.schema.names, to])

    return df.mapInArrow(run, schema)


def corpus_ids(df: DataFrame, key: str, text: str, vocabulary: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken") -> DataFrame:
    """(key, ids) of every row."""
    return encode_column(df.select(F.col(key).alias("__k"), F.col(text).alias("__t")), "__t", "ids", vocabulary).select(F.col("__k").alias(key), "ids")
