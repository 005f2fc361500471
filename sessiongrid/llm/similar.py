"""Near duplicates by the exact similarity of word shingles: an all-pairs join on prefixes, which loses no pair.

A document is its set of shingles of SHINGLE lower-cased words (fewer words: the whole sequence); two documents are
linked if the shared shingles are at least SIMILARITY of all shingles of both. With any one order of all shingles, two
such sets share one of their first n - ceil(SIMILARITY n) + 1 shingles, so only these prefixes are posted to an
inverted index, and every pair that meets is verified over whole sets.

The first links are those of SimHash (:mod:`~sessiongrid.llm.simhash`, op9): every document meets the least one of its component
of fingerprints, found by the positional-byte index with count filtering, and an exact check follows. What SimHash cannot
see, as 0.8 is about ten differing bits, the join on prefixes finds.

The order puts shingles that are frequent in a sample of documents last, so that boilerplate is seldom posted. It
decides the cost alone: any order finds the same pairs. Equal sets are collapsed before. Links are found in
rounds: every document meets one document of each of its posting lists, until a round hardly joins anything; then only lists that still
hold several components are paired, and only across components, so a group of copies costs no square. Pairs whose parity
bitmaps differ in more bits than the sets may in shingles are never made, nor pairs at a shingle with too few behind it to be their
first in common. A pair's texts move
only if the prefixes share as many shingles as similar sets must (:func:`shared_at_least`). Tables written on the way are deleted
before the result is returned.

Defined results: null texts and texts without words are equal to each other; a null id takes part; repeated rows
count once; columns named as an output are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sessiongrid.llm import simhash
from sessiongrid.llm.components import components
from sessiongrid.llm.texts import WORD, Shared, free_name, hash_share, lower_ascii, text_slices
from sessiongrid.session import Scratch, settle

SHINGLE = 5
SIMILARITY = 0.8
SEED = 42
#: share of the documents whose shingles are counted for the order, and what counts as frequent there
ORDER_SHARE = 0.125
ORDER_LEAST = 3
ORDER_MOST = 1 << 20
#: rounds in which each document meets one further document of each of its lists; they end when one leaves more than this share of the postings
LEADERS = 2
LEFT = 0.9
BROADCAST_KEYS = 1_000_000
#: bits of the parity bitmap of a set
PARITY_BITS = 1024


def shingle_set(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted distinct 64-bit hashes of runs of words; ``text`` is lower-cased already."""
    words = re.findall(WORD.encode(), text)
    if not words:
        return np.empty(0, np.int64)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64).view(np.int64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[i:j], SEED) for i, j in zip((ends - sizes)[: -shingle + 1].tolist(), ends[shingle - 1 :].tolist())]
    return np.unique(np.array(hashes, np.uint64).view(np.int64))


def prefix_size(n: int, similarity: float) -> int:
    """How many first shingles of n are posted: one of them is in every set that is similar enough."""
    return n - int(np.ceil(similarity * n - 1e-9)) + 1 if n else 0


def shingle_sets(docs: DataFrame, key: str, shingle: int = SHINGLE) -> DataFrame:
    """(key, shingles): the sorted set of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in text_slices(batch.column("text")):
                low = lower_ascii(data).tobytes()
                found = [shingle_set(low[a:b], shingle) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                ends = np.append(0, np.cumsum([len(s) for s in found])).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found)))
                yield pa.RecordBatch.from_arrays([batch.column("key").slice(first, last - first), lists], names=["key", "shingles"])

    return docs.select(F.col(key).alias("key"), "text").mapInArrow(run, "key long, shingles array<long>")


def frequent_shingles(docs: DataFrame, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several documents of a sample hold, sorted, and in how many: they come last in the order.

    The sample is a fixed share of the documents, so that the lists of what is not in it do not grow with their number; of
    more than ORDER_MOST shingles those in more documents are taken, by the least count that leaves no more.
    """
    seen = shingle_sets(docs.where(hash_share(F.col("__key")) < ORDER_SHARE), "__key", shingle)
    found = settle(seen.select(F.explode("shingles").alias("shingle")).groupBy("shingle").count().where(F.col("count") >= ORDER_LEAST))
    held = found.groupBy("count").agg(F.count(F.lit(1)).alias("shingles"))
    over = held.select("count", F.sum("shingles").over(W.orderBy(F.desc("count"))).alias("so_far")).where(F.col("so_far") <= ORDER_MOST)
    least = over.agg(F.min("count")).first()[0]
    counts = found.where(F.col("count") >= (2**62 if least is None else least)).toArrow()
    shingles, count = (np.asarray(counts.column(c).combine_chunks()).astype(np.int64) for c in ("shingle", "count"))
    order = np.argsort(shingles)
    return shingles[order], count[order]


def parity(own: np.ndarray) -> np.ndarray:
    """A bitmap that flips a bit for each shingle: two sets differ in at least as many shingles as their bitmaps in bits."""
    odd = np.bincount((own.view(np.uint64) % np.uint64(PARITY_BITS)).astype(np.int64), minlength=PARITY_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def prefixes(docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(row, node, n, fingerprint, parity, prefix): the hash, size, SimHash and bitmap of each document's set, and the first of its shingles."""
    shared = Shared(docs.sparkSession, frequent_shingles(docs, shingle))
    kind = docs.schema["__row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, count = shared.value
        for batch in batches:
            for first, last, data, offsets in text_slices(batch.column("text")):
                low = lower_ascii(data).tobytes()
                nodes, sizes, prints, odd, posted = [], [], [], [], []
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                    own = shingle_set(low[a:b], shingle)
                    nodes.append(xxhash.xxh64_intdigest(own.tobytes(), SEED))
                    sizes.append(len(own))
                    prints.append(simhash.fingerprint(low[a:b]))
                    odd.append(parity(own))
                    rank = np.zeros(len(own), np.int64)
                    if len(frequent):
                        at = np.minimum(np.searchsorted(frequent, own), len(frequent) - 1)
                        rank = np.where(frequent[at] == own, count[at], 0)
                    posted.append(own[np.argsort(rank, kind="stable")[: prefix_size(len(own), similarity)]])
                ends = np.append(0, np.cumsum([len(p) for p in posted])).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(posted)))
                bits = pa.ListArray.from_arrays(pa.array(np.arange(len(odd) + 1, dtype=np.int32) * (PARITY_BITS // 64)), pa.array(np.concatenate(odd)))
                longs = [pa.array(np.array(found, np.uint64).view(np.int64)) for found in (nodes, prints)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("__row").slice(first, last - first), longs[0], pa.array(sizes, pa.int64()), longs[1], bits, lists],
                    names=["__row", "node", "n", "fingerprint", "parity", "prefix"],
                )

    return docs.select("__row", "text").mapInArrow(run, f"__row {kind}, node long, n long, fingerprint long, parity array<long>, prefix array<long>")


def similar(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The (a, b) of ``pairs`` whose sets have the similarity; texts are shuffled, being smaller than their sets."""
    left = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("one")), "a")
    both = left.join(texts.select(F.col("node").alias("b"), F.col("text").alias("two")), "b").select("a", "b", "one", "two")

    def own_set(text: pa.Scalar) -> np.ndarray:
        return shingle_set(lower_ascii(np.frombuffer(text.as_buffer() or b"", np.uint8)).tobytes(), shingle)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, last, two = [], None, None
            for i in range(len(batch)):
                if batch.column("b")[i] != last:
                    last, two = batch.column("b")[i], own_set(batch.column("two")[i])
                one = own_set(batch.column("one")[i])
                common = len(np.intersect1d(one, two, assume_unique=True))
                good.append(common >= (len(one) + len(two) - common) * similarity - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def _sizes_fit(m: Column, n: Column, similarity: float) -> Column:
    return F.least(m, n) >= F.greatest(m, n) * similarity - 1e-9


def least_shared(m: Column, n: Column, similarity: float) -> Column:
    """How many shingles sets of ``m`` and ``n`` shingles share if they have the similarity; none of them stands before the first."""
    return F.ceil((m + n) * (similarity / (1 + similarity)) - 1e-9)


def parity_fits(m: Column, n: Column, one: Column, two: Column, similarity: float) -> Column:
    """Whether the bitmaps leave room for the similarity: sets of ``m`` and ``n`` shingles differ in at most m + n - 2 :func:`least_shared`."""
    return sum((F.bit_count(F.get(one, i).bitwiseXOR(F.get(two, i))) for i in range(PARITY_BITS // 64)), F.lit(0)) <= m + n - 2 * least_shared(m, n, similarity)


def shared_at_least(m: Column, n: Column, similarity: float) -> Column:
    """How many shingles the prefixes of two sets of ``m`` and ``n`` shingles share if the sets have the similarity.

    They share at least o = ceil(similarity / (1 + similarity) (m + n)) shingles, and the k-th of these stands at most n - o places
    further back than k in either order; so the first o - ceil(similarity n) + 1 of them lie in the prefix of n.
    """
    return least_shared(m, n, similarity) - F.ceil(F.greatest(m, n) * similarity - 1e-9) + 1


def set_components(docs: DataFrame, rows: DataFrame, scratch: Scratch, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(node, root) of the nodes with a link. ``docs`` has ``__key`` and text, ``rows`` one (node, n, fingerprint, parity, prefix, key) for each set."""
    postings = rows.select(F.posexplode("prefix").alias("at", "shingle"), "node", "n").repartition("shingle")  # one exchange for the lists and their join
    lists = postings.groupBy("shingle").agg(F.min("node").alias("first"), F.max("node").alias("last")).where(F.col("first") != F.col("last")).select("shingle")
    # the lists of one document, by far the most, go before anything is paired
    shared = scratch.settle(postings.join(lists, "shingle").select("shingle", "node", "n", "at"))

    def verified(pairs: DataFrame) -> DataFrame:
        needed = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        keys = rows.select("node", "key").join(needed, "node").select("node", F.col("key").alias("__key"))
        keys = scratch.settle(keys)
        texts = docs.select("__key", "text").join(F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys, "__key").select("node", "text")
        return scratch.settle(similar(pairs, texts.dropDuplicates(["node"]), shingle, similarity))

    def linked(near: DataFrame) -> DataFrame:
        """The (a, b) of ``near`` that are similar: the prefixes say which can be, before any text moves."""
        pairs = scratch.settle(near.distinct())
        ends = scratch.settle(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())
        sets = rows.select("node", "n", "prefix").join(ends, "node", "left_semi")
        one, two = (sets.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("prefix").alias(f"p_{c}")) for c in "ab")
        enough = F.size(F.array_intersect("p_a", "p_b")) >= shared_at_least(F.col("n_a"), F.col("n_b"), similarity)
        return verified(scratch.settle(pairs.join(one, "a").join(two, "b").where(enough).select("a", "b")))

    def joined(stars: DataFrame, links: DataFrame) -> DataFrame:
        """(node, root) as ``stars`` has them, joined further by ``links``: their own links are not gone through again."""
        return components(stars.select(F.col("root").alias("a"), F.col("node").alias("b")).union(links.select("a", "b")), "a", "b", scratch.settle)

    def still_mixed(placed: DataFrame, roots: DataFrame) -> DataFrame:
        """(shingle, node, n, at, root) of the lists that hold several components of ``roots``."""
        placed = placed.select("shingle", "node", "n", "at").join(roots, "node", "left").select("shingle", "node", "n", "at", F.coalesce("root", "node").alias("root"))
        placed = scratch.settle(placed)
        mixed = placed.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high")).where(F.col("low") != F.col("high")).select("shingle")
        left = scratch.settle(placed.join(mixed, "shingle"))
        scratch.drop(placed)
        return left

    # every document against the least one of its component of fingerprints: a pair a document at most
    own = rows.select("node", "fingerprint").join(simhash.fingerprint_components(rows, settle=scratch.settle), "fingerprint").select("node", "root")
    own = scratch.settle(own)
    leaders = own.groupBy("root").agg(F.min("node").alias("a"))
    links = linked(own.join(leaders, "root").where(F.col("node") != F.col("a")).select("a", F.col("node").alias("b")))
    stars = scratch.settle(components(links, "a", "b", scratch.settle))
    left = still_mixed(shared, stars)
    scratch.drop(shared)
    # then against a leader of each of its lists that hold several components, first the least and then others by hash: groups of
    # copies grow together in time linear in them. Each round is a fixed number of jobs, so one that hardly joins anything is the last
    before = 0
    for turn in range(LEADERS + 1):
        postings = left.count()
        if postings == 0 or turn and postings > LEFT * before:
            break
        order = F.xxhash64("node", F.lit(turn)) if turn else F.lit(0)
        leader = F.min(F.struct(order.alias("order"), F.col("node").alias("a"), F.col("n").alias("m"), F.col("root").alias("top")))
        leaders = left.groupBy("shingle").agg(leader.alias("l")).select("shingle", "l.a", "l.m", "l.top")
        near = left.join(leaders, "shingle").where((F.col("root") != F.col("top")) & _sizes_fit(F.col("n"), F.col("m"), similarity))
        links = linked(near.select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")))
        stars = scratch.settle(joined(stars, links))
        old, left, before = left, still_mixed(left, stars), postings
        scratch.drop(old)
    left = left.join(rows.select("node", "parity"), "node")
    x, y = left.alias("x"), left.alias("y")
    m, n = F.col("x.n"), F.col("y.n")
    across = x.join(y, (
        (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.root") != F.col("y.root")) & _sizes_fit(m, n, similarity)
        & (F.least(m - F.col("x.at"), n - F.col("y.at")) >= least_shared(m, n, similarity)) & parity_fits(m, n, F.col("x.parity"), F.col("y.parity"), similarity)
    ))
    more = linked(across.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")))
    return joined(stars, more)


def deduplicated(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, doc_id: str = "doc_id") -> DataFrame:
    """One row of ``docs`` of each component: the one with the least id, nulls last, and of equal ids the least hash."""
    hashed = F.xxhash64(F.col(doc_id), F.col("text"))
    key_name = free_name("__key", docs.columns)
    own = docs.select(F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"), hashed.alias("key")).alias("__row"), hashed.alias("__key"), "text")
    with Scratch(docs.sparkSession) as scratch:
        prints = scratch.settle(prefixes(own, shingle, similarity))
        rows = scratch.settle(prints.groupBy("node").agg(F.min("__row").alias("first"), F.first("n").alias("n"), F.min("fingerprint").alias("fingerprint"), F.first("parity").alias("parity"), F.first("prefix").alias("prefix")).withColumn("key", F.col("first.key")))
        times = prints.groupBy("__row.key").count().where(F.col("count") > 1).select(F.col("key").alias(key_name))
        repeated = scratch.settle(times)
        scratch.drop(prints)
        roots = set_components(own, rows, scratch, shingle, similarity)
        placed = rows.select("node", "first").join(roots, "node", "left").select("first", F.coalesce("root", "node").alias("root"))
        # the only table that the result reads
        stays = settle(placed.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.key").alias(key_name)))
        single = repeated.join(stays, key_name, "left_semi").isEmpty()
    kept = docs.withColumn(key_name, hashed).join(stays, key_name, "left_semi")
    return (kept if single else kept.dropDuplicates([key_name])).drop(key_name)
