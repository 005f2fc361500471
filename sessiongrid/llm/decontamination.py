"""Benchmark decontamination by SimHash of item-sized windows, in DataFrame functions only.

Texts are lower-cased and cut at white space; shingles are SHINGLE words (fewer: the whole sequence), as 64-bit
hashes. Every window of a document with as many words as an item gets a 64-bit SimHash of its shingles, each
weighted by its count. Fingerprints are cut into RADIUS + 1 blocks, so that any two within the radius agree in one block:
a multi-index join on (item size, block, value) finds all of them. Candidates are verified by their exact weighted
similarity: the sum of the lesser shingle counts over the sum of the greater ones, SIMILARITY or more.

At a similarity of 0.8 the expected distance is about 10 bits with a deviation of 3; the radius of 20 leaves room.
Only windows that can be similar are fingerprinted: a first pass over the documents joins their shingles with those of
items of each size, and windows with fewer of them than the similarity needs are left out, which loses none; the
second pass reads the documents that have windows left. The items' shingles are broadcast up to BROADCAST_SHINGLES,
the windows' places up to BROADCAST_PLACES, beyond that they are joined by shuffle.

Defined results: null and empty items and documents match nothing; a document with fewer words than an item is
one window; an item of fewer than SHINGLE words matches the same word sequence; repeated rows of a document
count once; a null id takes part (documents are told apart by a hash of id and text); columns named as an output
are replaced. Counts of windows up to MOST_WORDS words fill 14 bits; those of longer ones are added up in wider lanes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessiongrid.llm.texts import free_name
from sessiongrid.session import settle

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 20
BROADCAST_SHINGLES = 400_000
BROADCAST_PLACES = 1_000_000
MOST_WORDS = 16_000
SPACE = r"[\x20\x09-\x0D]+"
LANES = 0x0001000100010001
WIDE_LANES = 0x0000000100000001


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), SPACE), "")


def shingle_hashes(hashes: Column, size: int) -> Column:
    """The hash of each run of ``size`` word hashes; none in shorter texts."""
    runs = F.transform(F.sequence(F.lit(0), F.size(hashes) - size), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(size)]))
    return F.when(F.size(hashes) >= size, runs).otherwise(F.array().cast("array<bigint>"))


def simhash(shingles: Column, weight: Column, wide: bool = False) -> Column:
    """Bit b is 1 if it is set in over half of the shingles.

    16 sums of four 16-bit lanes count the bits: lane k of sum j counts bit 16 k + j. Adding 0x3FFF minus half of
    the weight carries into bit 14 of a lane where the count is over the half; bit 15 stays free of overflow.
    With ``wide``, 32 sums of two 32-bit lanes do the same for up to 2^30 - 1 shingles.
    """
    width, lanes = (32, WIDE_LANES) if wide else (16, LANES)

    def lane_counts(j: int) -> Column:
        return F.aggregate(shingles, F.lit(0).cast("long"), lambda total, s: total + F.shiftrightunsigned(s, j).bitwiseAND(F.lit(lanes)))

    top = width - 2
    push = (F.lit((1 << top) - 1) - F.floor(weight / 2)).cast("long") * F.lit(lanes)
    bits = []
    for j in range(width):
        carried = (lane_counts(j) + push).bitwiseAND(F.lit((1 << top) * lanes))
        bits.append(F.shiftrightunsigned(carried, top - j) if j <= top else F.shiftleft(carried, 1))
    return reduce(lambda x, y: x.bitwiseOR(y), bits)


def fingerprint(shingles: Column, most: int) -> Column:
    """The SimHash of windows of up to ``most`` shingles: wide lanes only for those that need them."""
    narrow = simhash(shingles, F.size(shingles))
    return narrow if most <= MOST_WORDS else F.when(F.size(shingles) <= MOST_WORDS, narrow).otherwise(simhash(shingles, F.size(shingles), wide=True))


def blocks(fingerprint: Column, radius: int = RADIUS) -> Column:
    """The values of radius + 1 blocks of nearly equal width."""
    cuts = [64 * k // (radius + 1) for k in range(radius + 2)]
    return F.array(*[F.shiftrightunsigned(fingerprint, a).bitwiseAND(F.lit((1 << b - a) - 1)) for a, b in zip(cuts, cuts[1:])])


def _numbered(values: Column) -> Column:
    """The values with the k-th copy of each told apart, so that the elements are distinct."""

    def bound(value: Column, use) -> Column:  # worked out once, not for each element
        return F.get(F.transform(F.array(value), use), 0)

    def number(own: Column) -> Column:
        firsts = F.filter(F.sequence(F.lit(0), F.size(own) - 1), lambda i: (i == 0) | (F.get(own, i) != F.get(own, i - 1)))

        def copies(at: Column) -> Column:
            ends = F.concat(F.slice(at, 2, F.size(at)), F.array(F.size(own)))
            runs = F.zip_with(at, ends, lambda p, q: F.transform(F.sequence(p, q - 1), lambda i: F.when(i == p, F.get(own, i)).otherwise(F.xxhash64(F.get(own, i), i - p))))
            return F.flatten(runs)

        return bound(firsts, copies)

    return bound(F.array_sort(values), number)


def weighted_similarity(a: Column, b: Column, most: int = 0) -> Column:
    """Sum of the lesser over the sum of the greater counts of two arrays of shingles.

    Arrays of more than MOST_WORDS, if ``most`` says that there can be such, are compared by their numbered copies,
    in n log n.
    """

    def times(values: Column, value: Column) -> Column:
        return F.size(F.filter(values, lambda v: v == value))

    common = F.aggregate(F.array_distinct(b), F.lit(0), lambda n, s: n + F.least(times(a, s), times(b, s)))
    if most > MOST_WORDS:
        common = F.when(F.size(b) > MOST_WORDS, F.size(F.array_intersect(_numbered(a), _numbered(b)))).otherwise(common)
    return common / (F.size(a) + F.size(b) - common)


def _shingled_items(items: DataFrame, item_id: str) -> DataFrame:
    split = items.select(F.col(item_id).alias("item_id"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    sized = split.select("item_id", F.size("w").alias("n_words"), F.least(F.size("w"), F.lit(SHINGLE)).alias("size"), F.transform("w", lambda v: F.xxhash64(v)).alias("h"))
    parts = [sized.where(F.col("size") == k).withColumn("shingles", shingle_hashes(F.col("h"), k)) for k in range(1, SHINGLE + 1)]
    every = reduce(lambda x, y: x.union(y), parts).drop("h").distinct()
    every = settle(every)
    most = every.agg(F.max(F.size("shingles"))).first()[0] or 0
    return settle(every.withColumn("fingerprint", fingerprint(F.col("shingles"), most)))


def contaminated(docs: DataFrame, items: DataFrame, radius: int = RADIUS, similarity: float = SIMILARITY, doc_id: str = "doc_id", item_id: str = "item_id") -> DataFrame:
    """(key, doc_id, item_id, similarity, n_windows, first_word): documents with a window similar to an item.

    ``key`` is ``document_key``; ``first_word`` is the start of the first of the ``n_windows`` similar windows.
    """
    known = _shingled_items(items, item_id)
    counted = known.agg(F.sum(F.size("shingles")).alias("n"), F.max(F.size("shingles")).alias("most"), F.collect_set("size").alias("sizes")).first()
    most = counted["most"] or 0

    def bounded(table: DataFrame) -> DataFrame:
        return F.broadcast(table) if (counted["n"] or 0) <= BROADCAST_SHINGLES else table

    hashed = docs.select(document_key(doc_id).alias("key"), F.col(doc_id).alias("doc_id"), F.transform(words(F.col("text")), lambda v: F.xxhash64(v)).alias("h"))
    wanted = known.select("n_words", "size", F.explode(F.array_distinct("shingles")).alias("shingle")).distinct()
    starts = []
    for size in sorted(counted["sizes"]):
        runs = hashed.select("key", F.size("h").alias("long"), F.posexplode(shingle_hashes(F.col("h"), size)).alias("at", "shingle"))
        hits = runs.join(bounded(wanted.where(F.col("size") == size).drop("size")), "shingle")
        first = F.greatest(F.lit(0), F.col("at") + size - F.col("n_words"))
        last = F.greatest(F.lit(0), F.least(F.col("at"), F.col("long") - F.col("n_words")))
        counted_starts = hits.select("key", "n_words", "long", F.explode(F.sequence(first, last)).alias("start")).groupBy("key", "n_words", "long", "start").agg(F.count(F.lit(1)).alias("shared"))
        weights = F.col("n_words") - size + 1 + F.least(F.col("n_words"), F.col("long")) - size + 1
        enough = F.col("shared") >= weights * (similarity / (1 + similarity)) - 1e-6
        starts.append(counted_starts.where(enough).select("key", F.struct("n_words", F.lit(size).alias("size"), "start").alias("place")))
    none = "key long, doc_id long, item_id long, similarity double, n_windows long, first_word int"
    if not starts:
        return docs.sparkSession.createDataFrame([], none).withColumn("doc_id", F.lit(None).cast(docs.schema[doc_id].dataType))
    places = settle(reduce(lambda x, y: x.union(y), starts).groupBy("key").agg(F.collect_list("place").alias("places")))
    few = (places.agg(F.sum(F.size("places"))).first()[0] or 0) <= BROADCAST_PLACES
    again = docs.select(document_key(doc_id).alias("key"), F.col(doc_id).alias("doc_id"), "text").join(F.broadcast(places) if few else places, "key")
    found = again.select("key", "doc_id", "places", F.transform(words(F.col("text")), lambda v: F.xxhash64(v)).alias("h"))
    windows = []
    for size in sorted(counted["sizes"]):
        own = found.select("key", "doc_id", shingle_hashes(F.col("h"), size).alias("all"), F.filter("places", lambda p: p["size"] == size).alias("places"))
        each = own.select("key", "doc_id", "all", F.explode("places").alias("p"))
        windows.append(each.select("key", "doc_id", F.col("p.n_words").alias("n_words"), F.col("p.start").alias("start"), F.slice("all", F.col("p.start") + 1, F.col("p.n_words") - size + 1).alias("window")))
    windows = reduce(lambda x, y: x.union(y), windows)
    prints = windows.withColumn("fingerprint", fingerprint(F.col("window"), most))
    left = prints.select("*", F.posexplode(blocks(F.col("fingerprint"), radius)).alias("block", "value"))
    right = known.select("item_id", F.col("n_words").alias("item_words"), "shingles", F.col("fingerprint").alias("item_print"), F.posexplode(blocks(F.col("fingerprint"), radius)).alias("item_block", "item_value"))
    agree = F.zip_with(blocks(F.col("fingerprint"), radius), blocks(F.col("item_print"), radius), lambda x, y: x == y)
    near = left.join(bounded(right), (F.col("n_words") == F.col("item_words")) & (F.col("block") == F.col("item_block")) & (F.col("value") == F.col("item_value")))
    within = F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("item_print"))) <= radius
    first_block = F.array_position(agree, True) == F.col("block") + 1  # a pair counts at the first block it agrees in
    # nested conditions: the costly ones see only what the cheap ones let through
    verified = F.when(within, F.when(first_block, weighted_similarity(F.col("window"), F.col("shingles"), most)))
    scored = near.select("key", "doc_id", "item_id", "start", verified.alias("similarity")).where(F.col("similarity") >= similarity)
    return scored.groupBy("key", "doc_id", "item_id").agg(F.max("similarity").alias("similarity"), F.count_distinct("start").alias("n_windows"), F.min("start").alias("first_word"))


def document_key(doc_id: str = "doc_id") -> Column:
    return F.xxhash64(F.col(doc_id), F.col("text"))


def clean(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The documents without any window similar to an item, with all their columns."""
    name = free_name("__key", docs.columns)
    keys = settle(contaminated(docs, items, doc_id=doc_id).select(F.col("key").alias(name)).distinct())
    return docs.join(keys, document_key(doc_id) == F.col(name), "left_anti")


def contaminated_sql(documents: str = "documents", benchmark: str = "benchmark") -> str:
    """DuckDB SQL: the weighted similarity of every item-sized window that shares a shingle with the item."""
    split = "list_filter(string_split_regex(lower({0}), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"
    return f"""
WITH items AS (SELECT item_id, w, len(w) AS n, least(len(w), {SHINGLE}) AS size FROM (SELECT item_id, {split.format("text")} AS w FROM {benchmark} WHERE text IS NOT NULL) WHERE len(w) > 0),
item_runs AS (SELECT item_id, n, size, array_to_string(w[i : i + size - 1], ' ') AS s FROM (SELECT *, unnest(range(1, n - size + 2)) AS i FROM items)),
item_counts AS (SELECT item_id, n, size, s, count(*) AS c FROM item_runs GROUP BY ALL),
docs AS (SELECT doc_id, {split.format("text")} AS w FROM {documents} WHERE text IS NOT NULL),
sizes AS (SELECT DISTINCT size FROM items),
runs AS (SELECT doc_id, long, size, i - 1 AS pos, array_to_string(w[i : i + size - 1], ' ') AS s
         FROM (SELECT doc_id, w, len(w) AS long, size, unnest(range(1, len(w) - size + 2)) AS i FROM docs, sizes)),
hits AS (SELECT DISTINCT doc_id, long, r.size, pos, item_id, n FROM runs r JOIN item_counts c ON r.size = c.size AND r.s = c.s),
places AS (SELECT DISTINCT doc_id, size, item_id, n, long,
                  unnest(range(greatest(0, pos + size - n), greatest(0, least(pos, long - n)) + 1)) AS start FROM hits),
window_counts AS (SELECT p.doc_id, p.item_id, p.n, p.size, p.start, r.s, count(*) AS c
                  FROM places p JOIN runs r ON r.doc_id = p.doc_id AND r.size = p.size AND r.pos >= p.start AND r.pos <= p.start + p.n - p.size GROUP BY ALL),
totals AS (SELECT doc_id, item_id, n, size, start, sum(c) AS total FROM window_counts GROUP BY ALL),
shared AS (SELECT w.doc_id, w.item_id, w.start, sum(least(w.c, i.c)) AS common FROM window_counts w JOIN item_counts i ON w.item_id = i.item_id AND w.s = i.s GROUP BY ALL),
scored AS (SELECT t.doc_id, t.item_id, t.start, CAST(common AS DOUBLE) / (total + n - size + 1 - common) AS similarity
           FROM totals t JOIN shared s ON t.doc_id = s.doc_id AND t.item_id = s.item_id AND t.start = s.start)
SELECT doc_id, item_id, max(similarity) AS similarity, count(DISTINCT start) AS n_windows, CAST(min(start) AS INTEGER) AS first_word
FROM scored WHERE similarity >= {SIMILARITY} GROUP BY doc_id, item_id"""
