"""SimHash near-duplicates with a byte-position inverted index and count filtering.

A fingerprint has 8 bytes. Within a radius of R bits at least 8 - R positional bytes agree (4 for radius 4),
so a pair is kept only if its tally of shared positional bytes reaches that minimum, and then its Hamming
distance is verified. The postings of the inverted index are sets of three byte positions from a covering
design: any four positions contain one of its 20 triples, so no pair within the radius is missed, while a
posting list stays 2^16 times shorter than that of one byte. A pair counts at its first shared triple only.
Equal fingerprints are collapsed before, so copies are never paired.

Defined results: a null text is an empty one; texts without words have fingerprint zero and link like any
other; a null id takes part, and its component is the least id that is not null (null if there is none);
repeated rows share a component; columns named as an output are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessiongrid.llm.components import components
from sessiongrid.llm.texts import WORD, lower_ascii, map_texts
from sessiongrid.session import settle

SHINGLE = 4
RADIUS = 4
SEED = 42
GROUPS = ((0, 1, 2), (3, 4, 5), (6, 7))


def triples() -> list[tuple[int, ...]]:
    """Sets of three of eight positions such that any four positions contain one of them."""
    found = [g for g in GROUPS if len(g) == 3]
    for group, following in zip(GROUPS, GROUPS[1:] + GROUPS[:1]):
        found += [(a, b, c) for i, a in enumerate(group) for b in group[i + 1 :] for c in following]
    return [tuple(sorted(t)) for t in found]


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of lower-cased words; ``text`` is lower-cased already."""
    words = re.findall(WORD.encode(), text)
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes + 1) - 1
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[i:j], SEED) for i, j in zip((ends - sizes)[: -shingle + 1].tolist(), ends[shingle - 1 :].tolist())]
    return majority(np.array(hashes, np.uint64))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes.

    Eight sums hold eight byte lanes each; a lane of sum j counts the bits j, j + 8, ..., in pieces of 255 hashes.
    """
    pieces = np.arange(0, len(hashes), 255)
    counts = np.empty((8, 8), np.int64)
    for j in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(j)) & np.uint64(0x0101010101010101), pieces)
        counts[:, j] = lanes.astype("<u8").view(np.uint8).reshape(-1, 8).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes), axis=1, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``fingerprint`` as a signed long."""

    def work(data: np.ndarray, offsets: np.ndarray) -> dict:
        low = lower_ascii(data).tobytes()
        found = [fingerprint(low[a:b], shingle) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        return {"fingerprint": np.array(found, np.uint64).view(np.int64)}

    return map_texts(docs, work, [T.StructField("fingerprint", T.LongType())], keep=keep)


def _byte(value: Column, position: int) -> Column:
    return F.shiftrightunsigned(value, 8 * position).bitwiseAND(F.lit(255))


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs (a, b), a < b, of the distinct fingerprints in column ``fingerprint`` within ``radius`` (4 or less) bits."""
    if radius > 4:
        raise ValueError("the index covers a radius of at most 4 bits")
    design = triples()
    postings = F.array(*[
        F.lit(k << 24) + reduce(lambda x, y: x * 256 + y, [_byte(F.col("fingerprint"), p) for p in triple]) for k, triple in enumerate(design)
    ])
    index = distinct.select("fingerprint", F.explode(postings).alias("posting"))
    first = [next((k for k, t in enumerate(design) if all(m >> p & 1 for p in t)), -1) for m in range(256)]
    a, b = F.col("a.fingerprint"), F.col("b.fingerprint")
    shared = reduce(lambda x, y: x + y, [F.when(_byte(a, p) == _byte(b, p), 1 << p).otherwise(0) for p in range(8)])
    return index.alias("a").join(
        index.alias("b"),
        (F.col("a.posting") == F.col("b.posting")) & (a < b)
        & (F.bit_count(shared) >= 8 - radius) & (F.bit_count(a.bitwiseXOR(b)) <= radius)
        & (F.get(F.array(*map(F.lit, first)), shared) == F.shiftright(F.col("a.posting"), 24)),
    ).select(a.alias("a"), b.alias("b"))


def fingerprint_components(prints: DataFrame, radius: int = RADIUS, settle: Callable[[DataFrame], DataFrame] = settle) -> DataFrame:
    """(fingerprint, root) for every fingerprint of ``prints``: those joined by links have one root."""
    distinct = prints.select("fingerprint").distinct()
    roots = components(links(distinct, radius), "a", "b", settle)
    return settle(distinct.join(roots, F.col("fingerprint") == F.col("node"), "left").select("fingerprint", F.coalesce("root", "fingerprint").alias("root")))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, fingerprint, component_id): a row per document, with the least id reachable over links."""
    prints = settle(fingerprints(docs.select(doc_id, "text"), shingle, keep=[doc_id]))
    placed = fingerprint_components(prints, radius)
    least = prints.groupBy("fingerprint").agg(F.min(doc_id).alias("__least")).join(placed, "fingerprint").groupBy("root").agg(F.min("__least").alias("component_id"))
    component = placed.join(least, "root").select("fingerprint", "component_id")
    return prints.join(component, "fingerprint").select(doc_id, "fingerprint", "component_id")


def deduplicated(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, doc_id: str = "doc_id") -> DataFrame:
    """One row of ``docs`` of each component: the one with the least id, nulls last, and of equal ids the least hash.

    Only ids, hashes and fingerprints are grouped; the texts are joined once with the rows that stay.
    """
    key = F.xxhash64(F.col(doc_id), F.col("text"))
    prints = settle(fingerprints(docs.select(F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"), key.alias("key")).alias("__row"), "text"), shingle, keep=["__row"]))
    rows = prints.groupBy("fingerprint").agg(F.min(F.struct("__row")).alias("first"))
    placed = fingerprint_components(prints, radius)
    stays = settle(rows.join(placed, "fingerprint").groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.__row.key").alias("__key")))
    kept = docs.withColumn("__key", key).join(stays, "__key", "left_semi")
    repeated = prints.groupBy("__row.key").count().where(F.col("count") > 1).select(F.col("key").alias("__key"))
    if repeated.join(stays, "__key", "left_semi").isEmpty():
        return kept.drop("__key")
    return kept.dropDuplicates(["__key"]).drop("__key")


def hex_digits(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))
