"""Evaluation texts leaking into a corpus: winnowed fingerprints, joined, and hits extended word by word.

A text is folded (see `folding`), lowered and cut into words. Of every window of consecutive k-grams of
words the smallest hash is kept, so any two texts that share `span` consecutive words share a kept
hash (window = span - k + 1). Hits are extended to both sides over the words themselves; only runs of at
least `span` words count, so a chance meeting of hashes adds nothing.

A test side of bounded size is broadcast whole. A larger one leaves a bitmap of its fingerprints, of a
fixed size at most, by which documents drop theirs before anything is shuffled; those left are extended
to the windows of `span` words around them, and windows meet by two 64-bit hashes. So what is joined is
what is found: a boilerplate shingle that very many texts share makes no pairs, and no text travels.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.llm.folding import Folder
from gristmill.session import checkpointed

#: Words of a shingle, and of the shortest shared run that is found.
K, SPAN = 5, 10
#: Test words up to which the test side is broadcast; beyond it fingerprints meet in a shuffled join.
BROADCAST_WORDS = 2_000_000
#: Bits of the bitmap of fingerprints: so many for each of them, between these bounds (8 KB and 64 MB), in chunks.
BITS_EACH, FEWEST_BITS, MOST_BITS, CHUNK = 16, 1 << 16, 1 << 29, 1 << 16
#: Words whose hash a worker remembers before it starts over.
REMEMBERED = 300_000

_words = re.compile(r"[^\W_]+").findall
_BASE, _OTHER_BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class Words:
    """Texts -> hashes of their words, with the folding of equal-looking characters."""

    def __init__(self) -> None:
        self.folder = Folder()
        self.known: dict[str, int] = {}

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(hashes of all words one text after another, start of each text and the end)."""
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        flat: list[int] = []
        ends = [0]
        for t in self.folder.fold(texts).to_pylist():
            if t:
                for w in _words(t.casefold()):
                    h = known.get(w)
                    if h is None:
                        h = known[w] = xxhash.xxh64_intdigest(w)
                    flat.append(h)
            ends.append(len(flat))
        return np.array(flat, np.uint64), np.array(ends)


def shingles(words: np.ndarray, k: int, base: np.uint64 = _BASE) -> np.ndarray:
    """Hash of the k words that start at each place; shorter at the end by k - 1."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            h = h * base + words[j : j + n]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return h


def winnow(words: np.ndarray, ends: np.ndarray, k: int, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, place in `words`, hash) of the kept shingles of each text; ties keep the last."""
    window = span - k + 1
    h = shingles(words, k)
    starts = len(words) - span + 1
    if starts <= 0 or not len(h):
        e = np.empty(0, np.int64)
        return e, e, np.empty(0, np.uint64)
    owner = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    # A window counts where its first and last word are of one text.
    inside = owner[:starts] == owner[span - 1 : span - 1 + starts]
    at = np.flatnonzero(inside)
    best, value = at + window - 1, h[at + window - 1]
    for j in range(window - 2, -1, -1):
        lower = h[at + j] < value
        best = np.where(lower, at + j, best)
        value = np.where(lower, h[at + j], value)
    kept = np.unique(best)
    return owner[kept], kept, h[kept]


def longest_run(a: np.ndarray, b: np.ndarray, i: int, j: int) -> int:
    """Length of the run of equal words around a[i] = b[j], both ways."""
    if a[i] != b[j]:
        return 0
    left = 1
    while left <= min(i, j) and a[i - left] == b[j - left]:
        left += 1
    right, most = 1, min(len(a) - i, len(b) - j)
    while right < most and a[i + right] == b[j + right]:
        right += 1
    return left + right - 1


class TestSide:
    """Words and fingerprints of the test items, sorted by hash."""

    __test__ = False

    def __init__(self, ids: list[int], texts: list[str | None], k: int, span: int):
        words, ends = Words()(pa.array(texts, pa.string()))
        owner, place, hashes = winnow(words, ends, k, span)
        order = np.argsort(hashes, kind="stable")
        self.ids, self.words, self.ends = np.array(ids, np.int64), words, ends
        self.hashes, self.owner, self.place = hashes[order], owner[order], place[order]

    def item(self, n: int) -> np.ndarray:
        return self.words[self.ends[n] : self.ends[n + 1]]


_FOUND = "doc long, item long, words int"


def _meet(spark_side: TestSide, docs: np.ndarray, words: np.ndarray, ends: np.ndarray, k: int, span: int) -> dict[tuple[int, int], int]:
    """{(doc, item id): longest shared run} of a batch of documents against the test side."""
    owner, place, hashes = winnow(words, ends, k, span)
    low = np.searchsorted(spark_side.hashes, hashes, "left")
    high = np.searchsorted(spark_side.hashes, hashes, "right")
    best: dict[tuple[int, int], int] = {}
    for n in np.flatnonzero(high > low):
        d, p = int(owner[n]), int(place[n])
        text = words[ends[d] : ends[d + 1]]
        for m in range(low[n], high[n]):
            item = int(spark_side.owner[m])
            run = longest_run(text, spark_side.item(item), p - int(ends[d]), int(spark_side.place[m] - spark_side.ends[item]))
            key = (int(docs[d]), int(spark_side.ids[item]))
            if run >= span and run > best.get(key, 0):
                best[key] = run
    return best


def _rows(best: dict[tuple[int, int], int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([d for d, _ in best], pa.int64()), pa.array([i for _, i in best], pa.int64()), pa.array(list(best.values()), pa.int32())],
        names=["doc", "item", "words"],
    )


def leaked(
    corpus: DataFrame, key: str, text: str, tests: DataFrame, test_key: str, test_text: str, k: int = K, span: int = SPAN,
    broadcast_words: int = BROADCAST_WORDS,
) -> DataFrame:
    """(key, test_key, words): documents that hold at least `span` consecutive words of a test item.

    `words` is the longest shared run. Null and empty texts and items of fewer words than `span` give no
    row; a repeated document or item counts once per id; very long texts are read whole. Other columns
    are not read. The test side is broadcast only while its size is below `broadcast_words` words; a
    larger one is joined by hash, see above, with the same result.
    """
    spark = corpus.sparkSession
    docs = corpus.select(F.col(key).cast("long").alias("doc"), F.col(text).cast("string").alias("t")).filter(F.length("t") > 0)
    items = tests.select(F.col(test_key).cast("long").alias("item"), F.col(test_text).cast("string").alias("q")).filter(F.length("q") > 0)
    size = items.agg(F.coalesce(F.sum(F.length("q")), F.lit(0)).alias("n")).first().n
    if size <= 2 * broadcast_words:  # a word and its gap are two characters at least
        got = items.distinct().toArrow()
        side = spark.sparkContext.broadcast(TestSide(got.column("item").to_pylist(), got.column("q").to_pylist(), k, span))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            read = Words()
            for b in batches:
                words, ends = read(b.column("t"))
                yield _rows(_meet(side.value, b.column("doc").to_numpy(), words, ends, k, span))

        found = docs.mapInArrow(scan, _FOUND)
    else:
        found = _shuffled(docs, items, k, span)
    return found.groupBy(F.col("doc").alias(key), F.col("item").alias(test_key)).agg(F.max("words").alias("words"))


def fingerprints(df: DataFrame, k: int = K, span: int = SPAN) -> DataFrame:
    """(id, h) of a table (id, t): the kept shingle hashes of each text, once each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = Words()
        for b in batches:
            words, ends = read(b.column("t"))
            owner, _, hashes = winnow(words, ends, k, span)
            ids = b.column("id").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(ids[owner]), pa.array(hashes.view(np.int64))], names=["id", "h"])

    return df.mapInArrow(run, "id long, h long").distinct()


def bitmap(hashes: DataFrame) -> np.ndarray:
    """Bits of the hashes (h) of a table, as bytes: made in the cluster chunk by chunk, of `MOST_BITS` at most."""
    hashes = checkpointed(hashes.select("h").distinct())
    size = min(MOST_BITS, max(FEWEST_BITS, 1 << (BITS_EACH * hashes.count()).bit_length()))
    at = hashes.select(F.pmod("h", F.lit(size)).alias("bit")).distinct()
    chunks = at.select(F.floor(F.col("bit") / CHUNK).alias("chunk"), F.pmod("bit", F.lit(CHUNK)).cast("int").alias("bit"))

    def pack(t: pa.Table) -> pa.Table:
        bits = np.zeros(CHUNK, bool)
        bits[t.column("bit").to_numpy()] = True
        return pa.table({"chunk": t.column("chunk").slice(0, 1), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    found = np.zeros(size // 8, np.uint8)
    got = chunks.groupBy("chunk").applyInArrow(pack, "chunk long, bits binary").toArrow()
    for chunk, bits in zip(got.column("chunk").to_pylist(), got.column("bits").to_pylist()):
        found[chunk * (CHUNK // 8) : (chunk + 1) * (CHUNK // 8)] = np.frombuffer(bits, np.uint8)
    return found


def _known(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = (hashes.view(np.int64) % np.int64(len(bits) * 8)).astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def windows(df: DataFrame, k: int = K, span: int = SPAN, known: np.ndarray | None = None) -> DataFrame:
    """(id, text, start, key, other) of a table (id, t): the windows of `span` words around the kept shingles, those that the bitmap
    `known` has, by two hashes; `text` tells different texts of one id apart. Any window of `span` words holds a kept shingle, so without a bitmap these are all windows."""
    sent = None if known is None else df.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = Words()
        for b in batches:
            words, ends = read(b.column("t"))
            owner, place, hashes = winnow(words, ends, k, span)
            if sent is not None:
                some = _known(sent.value, hashes)
                owner, place = owner[some], place[some]
            start = place[:, None] - np.arange(span - k + 1)
            start = np.unique(start[(start >= ends[owner][:, None]) & (start + span <= ends[owner + 1][:, None])])
            of = np.searchsorted(ends, start, "right") - 1
            both = [shingles(words, span, base)[start] if len(start) else np.empty(0, np.uint64) for base in (_BASE, _OTHER_BASE)]
            ids = b.column("id").to_numpy()
            text = np.zeros(len(ends) - 1, np.uint64)
            for i in np.unique(of):
                text[i] = xxhash.xxh64_intdigest(words[ends[i] : ends[i + 1]].tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[of]), pa.array(text[of].view(np.int64)), pa.array((start - ends[of]).astype(np.int32)), *[pa.array(h.view(np.int64)) for h in both]], names=["id", "text", "start", "key", "other"]
            )

    return df.mapInArrow(run, "id long, text long, start int, key long, other long")


def _shuffled(docs: DataFrame, items: DataFrame, k: int, span: int) -> DataFrame:
    """(doc, item, words) of every run: equal windows that follow each other at one distance are one run."""
    items = items.withColumnsRenamed({"item": "id", "q": "t"})
    of_items = windows(items, k, span).withColumnsRenamed({"id": "item", "text": "of", "start": "at"})
    of_docs = windows(docs.withColumnRenamed("doc", "id"), k, span, bitmap(fingerprints(items, k, span)))
    pair = ["doc", "text", "item", "of", "apart"]
    met = of_docs.join(of_items, ["key", "other"]).withColumns({"doc": F.col("id"), "apart": F.col("start") - F.col("at")}).select(*pair, "start").distinct()
    # Starts that follow each other differ from their place in order by one number.
    order = Window.partitionBy(*pair).orderBy("start")
    runs = met.withColumn("run", F.col("start") - F.row_number().over(order)).groupBy(*pair, "run")
    return runs.agg((F.count("*") + (span - 1)).cast("int").alias("words")).select("doc", "item", "words")
