"""Plug-ins for what needs a model: encoders, scorers, detectors, captioners, with deterministic defaults.

A plug-in works on batches; it is made once per Python worker by its factory, so a large model is loaded
once and not per row.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Encoder(Protocol):
    """Texts (or image bytes) -> vectors."""

    dim: int

    def encode(self, items: list) -> list[list[float] | None]: ...


class Scorer(Protocol):
    """(query, text) pairs -> scores from 0 to 10."""

    def score(self, pairs: list[tuple[str, str]]) -> list[float]: ...


class Detector(Protocol):
    """Texts -> (language, confidence, method)."""

    def detect(self, texts: list[str]) -> list[tuple[str, float, str]]: ...


class Captioner(Protocol):
    """Image bytes -> captions."""

    def caption(self, images: list[bytes]) -> list[str | None]: ...


class Prompter(Protocol):
    """Prompts -> answers of a language model."""

    def answer(self, prompts: list[str]) -> list[str]: ...


class NoPrompter:
    """Where no model is there: every call fails, and the operator says so."""

    def answer(self, prompts: list[str]) -> list[str]:
        raise OSError("no model is loaded")


class HashingEncoder:
    """Feature-hashed bag of words of unit length; empty texts give the zero vector. Needs no model.

    The first 32 bits of a word's MD5 give its dimension (modulo `dim`) and, by bit 16, its sign, so SQL can say the same.
    `words` is how many words of a text are read, as models read a limited number of tokens; all by default.
    """

    def __init__(self, dim: int = 64, words: int | None = None, remembered: int = 300_000):
        self.dim, self.words, self.remembered = dim, words, remembered
        self.known: dict[str, tuple[int, float]] = {}

    def place(self, word: str) -> tuple[int, float]:
        """(dimension, sign) of a word."""
        found = self.known.get(word)
        if found is None:
            if len(self.known) > self.remembered:
                self.known.clear()
            h = int(hashlib.md5(word.encode()).hexdigest()[:8], 16)
            found = self.known[word] = h % self.dim, 1.0 if h >> 16 & 1 else -1.0
        return found

    def encode(self, items: list) -> list[list[float] | None]:
        x = np.zeros((len(items), self.dim))
        for i, t in enumerate(items):
            for w in re.findall(r"\w+", (t or "").lower())[: self.words]:
                d, sign = self.place(w)
                x[i, d] += sign
        n = np.sqrt((x * x).sum(1, keepdims=True))
        return (x / np.where(n > 0, n, 1.0)).tolist()


class ConstantScorer:
    """The same score for every pair; ranking by it keeps the order it had."""

    def __init__(self, value: float = 0.0):
        self.value = value

    def score(self, pairs: list[tuple[str, str]]) -> list[float]:
        return [self.value] * len(pairs)


def encode(df: DataFrame, text: str, to: str, factory: Callable[[], Encoder] = HashingEncoder) -> DataFrame:
    """`df` with the vectors of `text` in a new column `to`."""
    schema = df.select("*", F.lit(None).cast("array<double>").alias(to)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = factory()
        for b in batches:
            vectors = pa.array(model.encode(b.column(text).to_pylist()), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*b.columns, vectors], names=[*b.schema.names, to])

    return df.mapInArrow(run, schema)


def score(df: DataFrame, query: str, text: str, to: str, factory: Callable[[], Scorer] = ConstantScorer) -> DataFrame:
    """`df` with the score of each (query, text) in a new column `to`."""
    schema = df.select("*", F.lit(None).cast("double").alias(to)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = factory()
        for b in batches:
            pairs = list(zip(b.column(query).to_pylist(), b.column(text).to_pylist()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.score(pairs), pa.float64())], names=[*b.schema.names, to])

    return df.mapInArrow(run, schema)


def prompted(df: DataFrame, prompt: str, to: str, factory: Callable[[], Prompter] = NoPrompter) -> DataFrame:
    """`df` with the answer to each prompt in a new column `to`; where the model fails, a JSON object that names the error."""
    schema = df.select("*", F.lit(None).cast("string").alias(to)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = factory()
        for b in batches:
            prompts = [p or "" for p in b.column(prompt).to_pylist()]
            try:
                answers = model.answer(prompts)
            except Exception as e:
                answers = [json.dumps({"error": str(e)})] * len(prompts)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(answers, pa.string())], names=[*b.schema.names, to])

    return df.mapInArrow(run, schema)


def percent_score(answer: Column) -> Column:
    """The first whole number of a model's answer as a score from 0 to 100; 0 where it gives none."""
    found = F.regexp_extract(answer, r"[0-9]+", 0).try_cast("double")
    return F.when(found.isNull(), F.lit(0.0)).otherwise(F.least(found, F.lit(100.0)))


def detect(df: DataFrame, text: str, to: str, factory: Callable[[], Detector]) -> DataFrame:
    """`df` with a detector's STRUCT(language, confidence, method_used) of `text` in a new column `to`.

    A detector that raises gives unknown with confidence 0 and its method's name with `_failed`.
    """
    kind = "struct<language:string,confidence:double,method_used:string>"
    schema = df.select("*", F.lit(None).cast(kind).alias(to)).schema
    inner = pa.struct([("language", pa.string()), ("confidence", pa.float64()), ("method_used", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = factory()
        for b in batches:
            texts = [t or "" for t in b.column(text).to_pylist()]
            try:
                found = model.detect(texts)
            except Exception:
                found = [("unknown", 0.0, f"{getattr(model, 'name', type(model).__name__)}_failed")] * len(texts)
            cells = pa.array([{"language": x, "confidence": c, "method_used": m} for x, c, m in found], inner)
            yield pa.RecordBatch.from_arrays([*b.columns, cells], names=[*b.schema.names, to])

    return df.mapInArrow(run, schema)


def caption(files: DataFrame, factory: Callable[[], Captioner], to: str = "caption") -> DataFrame:
    """(path, caption) of a binary file table (path, content); files that can't be read give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = factory()
        for b in batches:
            captions = []
            for c in b.column("content").to_pylist():
                try:
                    captions += model.caption([c])
                except Exception:
                    captions.append(None)
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(captions, pa.string())], names=["path", to])

    return files.select("path", "content").mapInArrow(run, f"path string, {to} string")


def embed_files(files: DataFrame, factory: Callable[[], Encoder], dim: int, to: str = "embedding") -> DataFrame:
    """(path, embedding) of a binary file table; files that can't be read give the zero vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = factory()
        for b in batches:
            vectors = []
            for c in b.column("content").to_pylist():
                try:
                    vectors += [v if v is not None else [0.0] * dim for v in model.encode([c])]
                except Exception:
                    vectors.append([0.0] * dim)
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(vectors, pa.list_(pa.float64()))], names=["path", to])

    return files.select("path", "content").mapInArrow(run, f"path string, {to} array<double>")


class AccentDetector:
    """pt for texts with a tilde or cedilla: the smallest detector that follows the protocol."""

    name = "accent"

    def detect(self, texts: list[str]) -> list[tuple[str, float, str]]:
        return [("pt", 0.7, self.name) if re.search("[ãõç]", t) else ("unknown", 0.0, self.name) for t in texts]


class FailingDetector:
    """A detector that is never there, for the failure path."""

    name = "broken"

    def detect(self, texts: list[str]) -> list[tuple[str, float, str]]:
        raise OSError("no such service")


class ByteCountEncoder:
    """Byte histogram of a file at unit length: a stand-in for an image model."""

    dim = 16

    def encode(self, items: list) -> list[list[float] | None]:
        out = []
        for c in items:
            v = np.bincount(np.frombuffer(c, np.uint8) >> 4, minlength=self.dim).astype(float)
            n = np.linalg.norm(v)
            out.append((v / n).tolist() if n else None)
        return out


class SizeCaptioner:
    """A caption that says what can be said without a model."""

    def caption(self, images: list[bytes]) -> list[str | None]:
        return [f"file of {len(c)} bytes" if c else None for c in images]


def mean_pool(vectors: Column, mask: Column) -> Column:
    """Mean of the token vectors whose mask is 1; `vectors` is an array of arrays, `mask` an array of 0 and 1."""
    kept = F.transform(F.filter(F.arrays_zip(vectors.alias("v"), mask.alias("m")), lambda z: z["m"] == 1), lambda z: z["v"])
    n = F.greatest(F.size(kept).cast("double"), F.lit(1e-9))
    total = F.aggregate(kept, F.array_repeat(F.lit(0.0), F.size(F.get(vectors, F.lit(0)))), lambda a, v: F.zip_with(a, v, lambda x, y: x + y))
    return F.transform(total, lambda x: x / n)


def softmax(logits: Column) -> Column:
    """Probabilities of an array of logits, stable against large ones."""
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))
