"""CSV, JSON, NumPy, log and HTML sources and sinks."""

from __future__ import annotations

import html.parser
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gristmill.session import checkpointed
from gristmill.sources.tables import require


#: Blanks belong to values, and quotes are doubled inside quoted values.
_AS_WRITTEN = {"header": "true", "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def read_csv(spark: SparkSession, path: str, schema: StructType | str, required: list[str] | None = None, null: str = "") -> DataFrame:
    """A CSV with header; quoted values may span lines and hold doubled quotes; a byte order mark is skipped.

    `null` is how a null is written; where it is not the empty text, empty values are empty texts. A missing path gives an empty table of the schema; missing required columns raise ValueError.
    """
    try:
        df = spark.read.schema(schema).options(**_AS_WRITTEN, multiLine="true", enforceSchema="false", nullValue=null).csv(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        df = spark.createDataFrame([], schema)
    return require(df, *(required or []))


def csv_header(spark: SparkSession, path: str) -> list[str]:
    """Column names of a CSV; only its schema is read."""
    return spark.read.option("header", True).csv(path).columns


def write_csv(df: DataFrame, path: str, null: str = "") -> None:
    """A folder of CSV files with header, quotes doubled inside quoted values, nulls as `null`."""
    df.write.mode("overwrite").options(**_AS_WRITTEN, nullValue=null).csv(path)


def list_files(spark: SparkSession, folder: str, glob: str = "*.csv") -> DataFrame:
    """(path, length, modificationTime) of the files of a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).select("path", "length", "modificationTime")


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """(row, embedding) of a matrix file; the file is mapped, not read whole, by the tasks that hold its parts. The path is one
    that every machine sees."""
    shape = np.load(path, mmap_mode="r").shape
    rows = spark.range(shape[0]).withColumnRenamed("id", "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = np.load(path, mmap_mode="r")
        for b in batches:
            at = b.column("row").to_numpy()
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(list(np.asarray(m[at], np.float32)), pa.list_(pa.float32()))], names=["row", "embedding"])

    return rows.mapInArrow(run, "row long, embedding array<float>")


def write_npy(df: DataFrame, order: str, vector: str, path: str) -> None:
    """A matrix file of the vectors in the order of a column; an empty table leaves an empty matrix.

    The driver lays out the file, and each task writes its rows into their place in it; a task that runs again writes the same
    bytes. The path is one that every machine sees.
    """
    ranged = df.select(F.col(order).alias("o"), F.col(vector).alias("v")).repartitionByRange("o").withColumn("part", F.spark_partition_id())
    placed = checkpointed(ranged.sortWithinPartitions("o"))
    facts = placed.groupBy("part").agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim")).orderBy("part").collect()  # a row for each partition
    if not facts:
        np.save(path, np.empty((0, 0), np.float32))
        return
    shape = sum(r.n for r in facts), max(r.dim for r in facts)
    starts = dict(zip((r.part for r in facts), np.cumsum([0, *[r.n for r in facts]]).tolist()))
    del facts
    np.lib.format.open_memmap(path, "w+", np.float32, shape).flush()

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, at = np.load(path, mmap_mode="r+"), None
        for b in batches:
            if b.num_rows:
                at = starts[b.column("part")[0].as_py()] if at is None else at
                out[at : at + b.num_rows] = np.array(b.column("v").to_pylist(), np.float32)
                at += b.num_rows
        out.flush()
        yield pa.RecordBatch.from_arrays([pa.array([1], pa.int64())], names=["n"])

    placed.mapInArrow(save, "n long").agg(F.sum("n")).collect()


def read_state(path: str, default: dict) -> dict:
    """A small JSON document; the default where it is missing or broken."""
    try:
        with open(path, encoding="utf-8") as f:
            return json.load(f)
    except (OSError, ValueError):
        return dict(default)


def write_state(path: str, state: dict) -> None:
    """Replace a small JSON document as a whole."""
    part = f"{path}.part"
    with open(part, "w", encoding="utf-8") as f:
        json.dump(state, f, ensure_ascii=False)
    os.replace(part, path)


def log_text(detector: Column, text: Column, language: Column, confidence: Column, ms: Column) -> Column:
    """One detection as a log record; the text's first hundred characters stand for it."""
    return F.concat(
        F.lit("Detector: "), detector, F.lit("\nText: "), F.left(text, F.lit(100)), F.lit("\nLanguage: "), language,
        F.lit("\nConfidence: "), F.format_string("%.2f", confidence), F.lit("\nProcessing Time: "), F.format_string("%.2f", ms), F.lit("ms"),
    )


def parse_log(text: Column) -> Column:
    """ARRAY<STRUCT(detector, text, language, confidence, time_ms)> of a text of log records; broken records are left out."""
    pattern = r"(?s)^([^\n]*)\nText: (.*?)\nLanguage: ([^\n]*)\nConfidence: ([\d.]+)\nProcessing Time: ([\d.]+)"
    records = F.split(text, "Detector: ")  # what stands before the first is no record
    part = lambda r, i: F.regexp_extract(r, pattern, i)
    return F.transform(
        F.filter(records, lambda r, i: (i > 0) & (part(r, 5) != "")),
        lambda r: F.struct(
            part(r, 1).alias("detector"), part(r, 2).alias("text"), part(r, 3).alias("language"),
            part(r, 4).try_cast("double").alias("confidence"), part(r, 5).try_cast("double").alias("time_ms"),
        ),
    )


class _Images(html.parser.HTMLParser):
    """All images of a page with their attributes, and whether they stand in the main wrapper."""

    def __init__(self) -> None:
        super().__init__()
        self.images: list[tuple[dict, bool]] = []
        self.inside = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = {k: v or "" for k, v in attrs}
        if tag == "img":
            self.images.append((a, self.inside > 0))
        elif tag == "div" and (self.inside or a.get("id") == "imgTagWrapperId"):
            self.inside += 1

    def handle_endtag(self, tag: str) -> None:
        if tag == "div" and self.inside:
            self.inside -= 1


# What tells the main image of a product page, the most telling first: attribute, comparison, value.
IMAGE_SIGNS = [
    ("id", "is", "landingImage"), ("data-a-dynamic-image", "stands", ""), ("class", "word", "a-dynamic-image"), ("class", "word", "imgTagWrapper"),
    ("class", "word", "image-item"), ("alt", "part", "product"), ("", "wrapped", ""), ("data-old-hires", "stands", ""),
]


def _shows(attributes: dict, wrapped: bool, sign: tuple[str, str, str]) -> bool:
    name, how, value = sign
    held = attributes.get(name)
    if how == "wrapped":
        return wrapped
    if held is None:
        return False
    return {"is": held == value, "stands": True, "word": value in held.split(), "part": value in held.lower()}[how]


def image_of_page(page: str | None) -> str | None:
    """The url of a page's main image: the first image that the most telling of the signs finds."""
    p = _Images()
    p.feed(page or "")
    for sign in IMAGE_SIGNS:
        for a, wrapped in p.images:
            if _shows(a, wrapped, sign):
                if "data-a-dynamic-image" in a:
                    try:
                        return next(iter(json.loads(a["data-a-dynamic-image"])), None)
                    except ValueError:
                        return None
                return a.get("src")
    return None


def image_urls(df: DataFrame, key: str, page: str) -> DataFrame:
    """(key, image_url) of stored pages; null where a page shows no image."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            urls = pa.array([image_of_page(x) for x in b.column(page).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(key), urls], names=[key, "image_url"])

    return df.select(key, page).mapInArrow(run, f"`{key}` {kind}, image_url string")
