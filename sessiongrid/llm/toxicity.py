"""Toxicity: a linear classifier on character n-grams that are scaled by naive Bayes log-count ratios.

Fitting takes a bounded sample of labelled documents (``bound``, about half of each class, weighted back to
the classes' real sizes); scoring reads every whole text. A feature is the presence of a byte n-gram, hashed
to 2^BITS buckets; its value is the log ratio of its smoothed shares in toxic and other documents, and a
logistic regression with an L2 term weighs all scaled features whose shares differ by SIGNIFICANT standard deviations.

Defined results: a null text scores as an empty one; without labels of both classes every score is the share
of toxic labels (0 where there are none); repeated rows score alike; columns named as an output are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessiongrid.llm.texts import Shared, class_sample, crc_bucket, lower_ascii, map_texts, ngram_buckets, text_of_byte
from sessiongrid.session import settle

ORDERS = (3, 4, 5)
BITS = 20
BOUND = 3000
#: standard deviations from which the shares of an n-gram in the classes differ surely
SIGNIFICANT = 4.0
PENALTY = 1.0
ROUNDS = 100
TASKS = 8
THRESHOLD = 0.3


@dataclass(frozen=True)
class Model:
    bucket: np.ndarray
    weight: np.ndarray
    intercept: float


def presence(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sorted distinct (text, bucket) codes."""
    owner = text_of_byte(offsets)
    found = [owner[fits] << BITS | bucket[fits] for bucket, fits in ngram_buckets(lower_ascii(data), offsets, ORDERS, BITS)]
    return np.unique(np.concatenate(found))


def _features(data: np.ndarray, offsets: np.ndarray) -> dict:
    code = presence(data, offsets)
    cuts = np.searchsorted(code, np.arange(1, len(offsets) - 1) << BITS)
    return {"buckets": pa.array([part.astype(np.uint32).tobytes() for part in np.split(code & (1 << BITS) - 1, cuts)], pa.binary())}


def bucket_counts(sample: DataFrame) -> DataFrame:
    """(bucket, toxic, other): in how many documents of each class a bucket is, added up within each task before it is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        documents = np.zeros((2, 1 << BITS), np.int64)
        for batch in batches:
            for kind, held in zip(batch.column("__label").to_pylist(), batch.column("buckets")):
                documents[kind, np.frombuffer(held.as_buffer(), np.uint32)] += 1  # distinct within a document
        bucket = np.flatnonzero(documents.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(documents[1, bucket]), pa.array(documents[0, bucket])], names=["bucket", "toxic", "other"])

    counted = sample.select("__label", "buckets").mapInArrow(run, "bucket long, toxic long, other long")
    return counted.groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def significant_buckets(counts: DataFrame, toxic: int, other: int, limit: float = SIGNIFICANT) -> tuple[np.ndarray, np.ndarray]:
    """The buckets whose shares in the classes differ by ``limit`` standard deviations or more, sorted, and their log-count ratios.

    All of them, at most 2^BITS, whatever the sample's size; the counts of a class are brought to half of the sample.
    """
    half = (toxic + other) / 2
    totals = counts.agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")).first()
    pooled = (F.col("toxic") + F.col("other")) / F.lit(toxic + other)
    apart = F.abs(F.col("toxic") / F.lit(toxic) - F.col("other") / F.lit(other))
    sure = apart >= F.sqrt(pooled * (1 - pooled) * (1 / toxic + 1 / other)) * limit
    chosen = counts.where(sure & (apart > 0)).toArrow().sort_by("bucket")
    bucket, one, two = (chosen.column(c).to_numpy() for c in ("bucket", "toxic", "other"))
    every = 1 << BITS
    ratio = np.log((1 + one * half / toxic) / (every + totals["toxic"] * half / toxic)) - np.log((1 + two * half / other) / (every + totals["other"] * half / other))
    return bucket.astype(np.int64), ratio


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int = 4, remainder: int = 2, bound: int = BOUND, limit: float = SIGNIFICANT) -> Model:
    """Learn from labelled documents outside the held-out remainder.

    The n-grams of the sample stay in a table; counts and the regression's slopes are summed by Spark, so the driver holds weights
    alone, however long the texts are.
    """
    found, sizes = class_sample(docs, labels, label, modulus, remainder, bound)
    sample = settle(map_texts(found, _features, [T.StructField("buckets", T.BinaryType())], keep=["__label"]).repartition(TASKS))
    many = {r["__label"]: r["n"] for r in sample.groupBy("__label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(many) < 2:
        share = sizes.get(1, 0) / max(1, sum(sizes.values()))
        return Model(np.zeros(0, np.int64), np.zeros(0), float(np.log((share + 1e-9) / (1 - share + 1e-9))))
    bucket, ratio = significant_buckets(settle(bucket_counts(sample)), many[1], many[0], limit)
    if not len(bucket):
        return Model(bucket, np.zeros(0), float(np.log(sizes[1] / sizes[0])))
    shared = Shared(docs.sparkSession, (bucket, ratio))

    @F.udf(VectorUDT())
    def scaled(held: bytes) -> SparseVector:
        buckets, ratios = shared.value
        own = np.flatnonzero(np.isin(buckets, np.frombuffer(held, np.uint32), assume_unique=True))
        return SparseVector(len(buckets), own, ratios[own])

    weight = F.when(F.col("__label") == 1, F.lit(sizes[1] / many[1])).otherwise(F.lit(sizes[0] / many[0]))
    rows = settle(sample.select(F.col("__label").cast("double").alias("label"), weight.alias("weight"), scaled("buckets").alias("features")))
    regression = LogisticRegression(weightCol="weight", regParam=PENALTY / sum(many.values()), standardization=False, maxIter=ROUNDS)
    model = regression.fit(rows)
    return Model(bucket, model.coefficients.toArray() * ratio, float(model.intercept))


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``score`` in [0, 1] and ``predicted`` (1 from a score of THRESHOLD on)."""
    shared = Shared(docs.sparkSession, model)

    def work(data: np.ndarray, offsets: np.ndarray) -> dict:
        m = shared.value
        table = np.zeros(1 << BITS, np.float32)
        table[m.bucket] = m.weight
        owner = text_of_byte(offsets)
        codes = []
        for bucket, fits in ngram_buckets(lower_ascii(data), offsets, ORDERS, BITS):
            hit = np.flatnonzero((table[bucket] != 0) & fits)
            codes.append(owner[hit] << BITS | bucket[hit])
        code = np.unique(np.concatenate(codes))
        margin = m.intercept + np.bincount(code >> BITS, table[code & (1 << BITS) - 1], len(offsets) - 1)
        value = 1 / (1 + np.exp(-np.clip(margin, -40, 40)))
        return {"score": value, "predicted": (value >= THRESHOLD).astype(np.int32)}

    fields = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    return map_texts(docs, work, fields, keep=keep)


def held_out(docs: DataFrame) -> DataFrame:
    return docs.withColumn("held_out", crc_bucket(F.col("doc_id"), 4) == 2)
