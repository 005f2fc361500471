"""What the text operators share: held-out rows, bounded labelled samples, and work on Arrow batches of texts."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

SLICE_BYTES = 1 << 20
WORD = r"[^\x20\x09-\x0D]+"


class Shared:
    """A broadcast model, with its class by value: workers need not have the package."""

    def __init__(self, spark: SparkSession, model: Any):
        self.sent = spark.sparkContext.broadcast(cloudpickle.dumps(model))
        self.model = None

    @property
    def value(self) -> Any:
        if self.model is None:
            self.model = pickle.loads(self.sent.value)
        return self.model


def free_name(name: str, taken: list[str]) -> str:
    """``name``, with underscores behind it until no column has it; names differ in more than case."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name += "_"
    return name


def crc_bucket(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % modulus


def hash_share(column: Column) -> Column:
    """A number in [0, 1) that depends on the value alone."""
    return F.pmod(F.xxhash64(column, F.lit("share")), F.lit(1 << 30)) / float(1 << 30)


def text_slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of pieces of about ``most`` bytes; a longer text is a piece alone.

    Null texts are empty.
    """
    column = column.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        last = min(last, len(column))
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def map_texts(df: DataFrame, work: Callable[[np.ndarray, np.ndarray], dict], fields: list[T.StructField], text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``fields`` that ``work(bytes, offsets)`` gives for each text, beside the kept columns.

    ``work`` gets pieces of about SLICE_BYTES and returns arrays of one value per text. A kept column
    with the name of a new one is replaced.
    """
    names = {f.name for f in fields}
    kept = [c for c in (df.columns if keep is None else keep) if c not in names]
    schema = T.StructType([df.schema[c] for c in kept] + fields)
    out = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pieces = [work(data, offsets) for _, _, data, offsets in text_slices(batch.column(len(kept)))]
            columns = [batch.column(i) for i in range(len(kept))]
            for f in fields:
                parts = [pa.array(p[f.name], out.field(f.name).type) for p in pieces]
                columns.append(pa.concat_arrays(parts) if parts else pa.array([], out.field(f.name).type))
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])

    return df.select(*[F.col(c) for c in kept], F.col(text).cast("string").alias(free_name("__text", kept))).mapInArrow(run, schema)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return data + np.uint8(32) * ((data >= 65) & (data <= 90))


def text_of_byte(offsets: np.ndarray) -> np.ndarray:
    """For each byte the number of its text."""
    return np.repeat(np.arange(len(offsets) - 1, dtype=np.int64), np.diff(offsets))


def ngram_buckets(data: np.ndarray, offsets: np.ndarray, orders: tuple[int, ...], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: the hash bucket of the bytes from each position, and whether they end within the text."""
    owner = text_of_byte(offsets)
    room = offsets[1:][owner] - np.arange(len(data))
    code = data.astype(np.uint32) + np.uint32(1)
    running = np.zeros(len(data), np.uint32)
    for n in range(1, max(orders) + 1):
        shifted = np.zeros(len(data), np.uint32)
        shifted[: max(0, len(data) - n + 1)] = code[n - 1 :]
        running = running * np.uint32(0x01000193) + shifted
        if n in orders:
            mixed = (running ^ (running >> np.uint32(15))) * np.uint32(0x9E3779B1) + np.uint32(n)
            yield (mixed * np.uint32(0x85EBCA6B)) >> np.uint32(32 - bits), room >= n


def class_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, remainder: int, bound: int, doc_id: str = "doc_id") -> tuple[DataFrame, dict[int, int]]:
    """Labelled documents to learn from, about ``bound`` / 2 a class, and the number of label rows of each class.

    Rows whose crc32(id as text) mod ``modulus`` is ``remainder`` are never used. The rows of a class are those
    with the least hash shares; labels other than 0 and 1, null labels and ids without a document are left out,
    and of rows with one id the least text is taken. The chosen ids are at most 2 * ``bound`` rows, so the join
    with the documents broadcasts them.
    """
    known = labels.select(F.col(doc_id), F.col(label).cast("int").alias("__label")).where(
        F.col("__label").isin(0, 1) & F.col(doc_id).isNotNull() & (crc_bucket(F.col(doc_id), modulus) != remainder)
    ).distinct()
    counts = {r["__label"]: r["n"] for r in known.groupBy("__label").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.lit(0.0)
    for value, n in counts.items():
        share = F.when(F.col("__label") == value, F.lit(bound / 2 / n)).otherwise(share)
    chosen = known.where(hash_share(F.col(doc_id)) < share).limit(2 * bound)
    return docs.select(doc_id, "text").join(F.broadcast(chosen), doc_id).groupBy(doc_id, "__label").agg(F.min("text").alias("text")), counts
