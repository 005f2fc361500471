"""Language identification by multilingual mixture inference.

Each language has smoothed byte-trigram probabilities, learned from a bounded sample of about ``bound``
documents a language. Of a document, every word has a likelihood under every language; expectation-maximisation
estimates the document's language proportions, over sets of languages that shrink by the least proportion, and
the set with the best penalised likelihood (half the log of the number of words for each language) is kept.

Defined results: ``und`` with score 0 and no languages for a null text or one without a letter, or where
nothing could be learned; ties go to the first language in order; columns named as an output are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessiongrid.llm.texts import Shared, crc_bucket, hash_share, lower_ascii, map_texts, ngram_buckets, text_of_byte

BITS = 16
BOUND = 400
SMOOTHING = 0.5
ROUNDS = 8
#: a trigram weighs half, because neighbouring trigrams share two bytes
TEMPER = 0.5
UNKNOWN = "und"


@dataclass(frozen=True)
class Model:
    languages: list[str]
    log_share: np.ndarray


def _counted(data: np.ndarray, offsets: np.ndarray) -> dict:
    owner = text_of_byte(offsets)
    bucket, fits = next(ngram_buckets(lower_ascii(data), offsets, (3,), BITS))
    code, n = np.unique(owner[fits] << BITS | bucket[fits], return_counts=True)
    cuts = np.searchsorted(code, np.arange(1, len(offsets) - 1) << BITS)
    parts = zip(np.split((code & (1 << BITS) - 1).astype(np.int32), cuts), np.split(n.astype(np.int64), cuts))
    return {"grams": pa.array([[{"bucket": int(b), "n": int(k)} for b, k in zip(*part)] for part in parts], pa.list_(pa.struct([("bucket", pa.int32()), ("n", pa.int64())])))}


def fit(docs: DataFrame, lang: str = "lang", modulus: int = 3, remainder: int = 1, bound: int = BOUND) -> Model:
    """Trigram shares of each language from documents outside the held-out remainder.

    What reaches the driver is a count for each language and trigram bucket, at most 2^BITS a language.
    """
    known = docs.select("doc_id", "text", F.col(lang).alias("__lang")).where(F.col("__lang").isNotNull() & F.col("text").isNotNull() & (crc_bucket(F.col("doc_id"), modulus) != remainder))
    sizes = {r["__lang"]: r["n"] for r in known.groupBy("__lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((1 << BITS, 0), np.float32))
    share = F.coalesce(*[F.when(F.col("__lang") == k, F.lit(bound / n)) for k, n in sizes.items()])
    sample = known.where(hash_share(F.col("doc_id")) < share)
    fields = [T.StructField("grams", T.ArrayType(T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("n", T.LongType())])))]
    grams = map_texts(sample, _counted, fields, keep=["__lang"]).select("__lang", F.explode("grams").alias("g"))
    counts = np.zeros((1 << BITS, len(languages)))
    place = {k: i for i, k in enumerate(languages)}
    for r in grams.groupBy("__lang", "g.bucket").agg(F.sum("g.n").alias("n")).toLocalIterator():
        counts[r["bucket"], place[r["__lang"]]] = r["n"]
    smooth = counts + SMOOTHING
    return Model(languages, np.log(smooth / smooth.sum(0)).astype(np.float32))


def mixtures(like: np.ndarray, top: np.ndarray, owner: np.ndarray, firsts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Proportions of the best set of languages for each text.

    like: likelihood of each word under each language, divided by its largest, whose log is ``top``. The texts'
    words stand together; ``sizes`` are their numbers, all at least 1.
    """
    texts, many = len(sizes), like.shape[1]
    mix = np.full((texts, many), 1 / many)
    best, best_value = mix.copy(), np.full(texts, -np.inf)
    base = np.add.reduceat(top, firsts)
    for size in range(many, 0, -1):
        if size < many:  # the language with the least proportion goes
            order = np.argsort(-mix, axis=1, kind="stable")
            mix[np.arange(texts), order[:, size]] = 0
            mix /= mix.sum(1, keepdims=True)
        for _ in range(ROUNDS if size > 1 else 0):
            part = like * mix[owner]
            part /= part.sum(1, keepdims=True) + 1e-300
            mix = np.add.reduceat(part, firsts) / sizes[:, None]
        value = base + np.add.reduceat(np.log((like * mix[owner]).sum(1) + 1e-300), firsts) - 0.5 * size * np.log(sizes + 1)
        better = value > best_value
        best[better], best_value[better] = mix[better], value[better]
    return best


def identify(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (its proportion), ``languages`` and ``proportions`` of the chosen set."""
    shared = Shared(docs.sparkSession, model)

    def work(data: np.ndarray, offsets: np.ndarray) -> dict:
        m = shared.value
        texts = len(offsets) - 1
        proportions = np.zeros((texts, max(1, len(m.languages))))
        low = lower_ascii(data)
        gap = (low == 32) | ((low >= 9) & (low <= 13))
        start = ~gap
        start[1:] &= gap[:-1]
        start[offsets[:-1][np.diff(offsets) > 0]] = ~gap[offsets[:-1][np.diff(offsets) > 0]]
        words = np.flatnonzero(start)
        if len(words) and m.languages:
            bucket, fits = next(ngram_buckets(low, offsets, (3,), BITS))
            logs = m.log_share[bucket]
            logs[~fits] = 0
            whose = text_of_byte(offsets)
            opening = np.full(texts, len(low))
            np.minimum.at(opening, whose[words], words)
            logs[np.arange(len(low)) < opening[whose]] = 0  # what precedes a text's first word is no part of the word before it
            each = TEMPER * np.add.reduceat(logs, words).astype(np.float64)
            top = each.max(1)
            owner = whose[words]
            there, firsts, sizes = np.unique(owner, return_index=True, return_counts=True)
            proportions[there] = mixtures(np.exp(each - top[:, None]), top, np.repeat(np.arange(len(there)), sizes), firsts, sizes)
        chosen = proportions.argmax(1)
        names = m.languages or [UNKNOWN]
        sets = [np.flatnonzero(p > 1e-6) for p in proportions]
        return {
            "__pred": [names[i] for i in chosen], "__score": proportions[np.arange(texts), chosen],
            "__languages": [[names[i] for i in s] for s in sets], "__proportions": [p[s].tolist() for p, s in zip(proportions, sets)],
        }

    fields = [T.StructField("__pred", T.StringType()), T.StructField("__score", T.DoubleType()), T.StructField("__languages", T.ArrayType(T.StringType())), T.StructField("__proportions", T.ArrayType(T.DoubleType()))]
    kept = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score", "languages", "proportions")]
    marked = docs.withColumn("__letters", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    found = map_texts(marked, work, fields, keep=[*kept, "__letters"])
    known = F.col("__letters") & (F.size("__languages") > 0)
    return found.select(
        *kept,
        F.when(known, F.col("__pred")).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(known, F.least(F.col("__score"), F.lit(1.0))).otherwise(0.0).alias("score"),
        F.when(known, F.col("__languages")).otherwise(F.array().cast("array<string>")).alias("languages"),
        F.when(known, F.col("__proportions")).otherwise(F.array().cast("array<double>")).alias("proportions"),
    )


def held_out(docs: DataFrame) -> DataFrame:
    return docs.withColumn("held_out", crc_bucket(F.col("doc_id"), 3) == 1)
