"""Repeated passages by longest-previous-factor arrays in suffix order.

A byte is repeated if it lies in a string of LENGTH bytes that also starts elsewhere in any text. All LENGTH-byte
strings of all texts are compared, without sending all suffixes to one place:

1. Each string has an anchor, the leftmost least-hashed gram of GRAM bytes in it, so equal strings have equal anchors.
   Neighbouring strings with one anchor form a run. Anchors that occur once are left out, by a filter of FILTER_BITS
   bits (a fixed size; a false hit only costs work).
2. Runs with equal anchor and equal bytes (by hash) are collapsed: their first stands for them, the others repeat it whole.
3. Where one anchor has several distinct runs, the bytes of those that stand for others or themselves go to the anchor's
   task. It puts their suffixes in order (prefix doubling up to LENGTH bytes, ties by position), finds the previous and
   next smaller positions in that order, and from the longer of the two common prefixes the longest-previous-factor array
   (values up to LENGTH). A string whose value is LENGTH repeats an earlier one, its source, which so is repeated as well.
4. The runs of an anchor with more than GROUP distinct ones are cut again by longer anchors, of twice the bytes, and take
   steps 2 and 3 in these smaller groups; the last anchor is the string itself, so no group stays large. Texts are read
   for the first cut alone, later cuts take the bytes of the runs.

``removed`` takes every copy, or with ``keep_first`` only those after the first (in order of id, then place).

Defined results: a null text is an empty one; shorter texts have no repeats; an exact copy of a text, the same id
or not, repeats it (with ``keep_first`` one of equal rows is the first); null ids come first; columns named as an output are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessiongrid.llm.texts import Shared, text_slices
from sessiongrid.session import settle

LENGTH = 200
GRAM = 32
FILTER_BITS = 27
GROUP = 4_000
CHUNK = 1 << 19
MULTIPLIER = 0x9E3779B97F4A7C15


def in_pieces(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Smaller batches, so that what a task holds beside the texts stays small."""
    for batch in batches:
        for first in range(0, len(batch), rows):
            yield batch.slice(first, rows)


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Hash of the ``gram`` bytes from each position, as far as there are so many."""
    value, power, size = data.astype(np.uint64) + np.uint64(1), MULTIPLIER, 1
    while size < gram:
        step = min(size, gram - size)  # the last two parts overlap unless gram is a power of two
        value = value[:-step] * np.uint64(power) + value[step:] if len(value) > step else value[:0]
        power, size = power * power % (1 << 64), size + step
    value = (value ^ (value >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return value ^ (value >> np.uint64(32))


def anchored_runs(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first string, number of strings, anchor hash) of each run; places are positions in ``data``."""
    grams = gram_hashes(data, gram)
    strings = len(data) - length + 1
    if strings <= 0:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.int64),)
    wide = length - gram + 1
    key = (grams >> np.uint64(32) << np.uint64(32)) | np.arange(len(grams), dtype=np.uint64)
    padded = np.concatenate([key, np.full(-len(key) % wide, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, wide)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    place = (np.minimum(back[:strings], ahead[wide - 1 : wide - 1 + strings]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:strings]
    whole = np.arange(strings) + length <= offsets[1:][owner]
    first = whole.copy()
    first[1:] &= (place[1:] != place[:-1]) | ~whole[:-1]
    starts = np.flatnonzero(first)
    counts = np.add.reduceat(whole, starts) if len(starts) else np.zeros(0, np.int64)
    return owner[starts], starts, counts.astype(np.int64), grams[place[starts]].view(np.int64)


def _positions(anchors: np.ndarray) -> np.ndarray:
    mixed = anchors.view(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return (mixed >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def anchor_filter(docs: DataFrame, length: int) -> Shared:
    """The anchors that occur more than once, as a bit set of fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [anchored_runs(data, offsets, length)[3] for _, _, data, offsets in text_slices(batch.column("text"))]
            anchors, n = np.unique(np.concatenate(found) if found else np.zeros(0, np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(anchors), pa.array(np.minimum(n, 2).astype(np.int8))], names=["anchor", "n"])

    again = docs.select(F.coalesce(F.col("text"), F.lit("")).alias("text")).mapInArrow(run, "anchor bigint, n tinyint").groupBy("anchor").agg(F.sum("n").alias("n")).where(F.col("n") > 1)

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _positions(batch.column("anchor").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(at >> 9), pa.array(at & 511)], names=["word", "bit"])

    # 512 bits to a row: at most 2^(FILTER_BITS - 9) rows reach the driver
    word = [F.bit_or(F.when((F.col("bit") >= 64 * k) & (F.col("bit") < 64 * k + 64), F.expr(f"shiftleft(1L, cast(bit - {64 * k} as int))")).otherwise(F.lit(0).cast("long"))).alias(f"w{k}") for k in range(8)]
    table = np.zeros((1 << FILTER_BITS - 9, 8), np.int64)
    for r in again.mapInArrow(bits, "word bigint, bit bigint").groupBy("word").agg(*word).toLocalIterator():
        table[r["word"]] = r[1:]
    return Shared(docs.sparkSession, table)


RUN = ["anchor", "content", "row", "doc_id", "start", "strings"]


def contents_of(data: np.ndarray, start: np.ndarray, strings: np.ndarray, length: int) -> pa.Array:
    """A hash of the bytes of each run."""
    raw = data.tobytes()
    found = [xxhash.xxh64_intdigest(raw[a:b]) for a, b in zip(start.tolist(), (start + strings + length - 1).tolist())]
    return pa.array(np.array(found, np.uint64).view(np.int64))


def candidate_runs(docs: DataFrame, seen: Shared, length: int) -> DataFrame:
    """(anchor, content, row, doc_id, start, strings): runs whose anchor occurs more than once."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = seen.value.view(np.uint8).ravel()
        for batch in batches:
            for first, _, data, offsets in text_slices(batch.column("text")):
                owner, start, strings, anchor = anchored_runs(data, offsets, length)
                at = _positions(anchor)
                kept = np.flatnonzero(table[at >> 3] >> (at & 7).astype(np.uint8) & 1)
                owner, start, strings = owner[kept], start[kept], strings[kept]
                rows = pa.array(owner + first)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor[kept]), contents_of(data, start, strings, length), batch.column("row").take(rows), batch.column("doc_id").take(rows), pa.array((start - offsets[:-1][owner]).astype(np.int32)), pa.array(strings.astype(np.int32))],
                    names=RUN)

    return docs.mapInArrow(run, f"anchor bigint, content bigint, row bigint, doc_id {kind}, start int, strings int")


def finer_runs(pieces: DataFrame, gram: int, length: int) -> DataFrame:
    """Runs with their bytes, cut again by anchors of ``gram`` bytes below their present ones; a single string needs no bytes."""
    kind = pieces.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_pieces(batches, 2000):
            parts = batch.column("bytes").to_pylist()
            offsets = np.append(0, np.cumsum([len(x) for x in parts])).astype(np.int64)
            raw = b"".join(parts)
            data = np.frombuffer(raw, np.uint8)
            owner, start, strings, anchor = anchored_runs(data, offsets, length, gram)
            above = batch.column("anchor").to_numpy()[owner].view(np.uint64)
            below = (above * np.uint64(MULTIPLIER) ^ anchor.view(np.uint64)).view(np.int64)
            at = batch.column("start").to_numpy()[owner] + start - offsets[:-1][owner]
            rows = pa.array(owner)
            if gram == length:
                held = pa.nulls(len(owner), pa.binary())
            else:
                held = pa.array([raw[a:b] for a, b in zip(start.tolist(), (start + strings + length - 1).tolist())], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(below), contents_of(data, start, strings, length), batch.column("row").take(rows), batch.column("doc_id").take(rows), pa.array(at.astype(np.int32)), pa.array(strings.astype(np.int32)), held],
                names=[*RUN, "bytes"])

    return pieces.mapInArrow(run, f"anchor bigint, content bigint, row bigint, doc_id {kind}, start int, strings int, bytes binary")


def _ranked(key: np.ndarray) -> np.ndarray:
    order = np.argsort(key)
    ordered = key[order]
    rank = np.empty(len(key), np.uint64)
    rank[order] = np.cumsum(np.append(False, ordered[1:] != ordered[:-1])).astype(np.uint64)
    return rank


def prefix_ranks(data: np.ndarray, length: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """The eight bytes from each position as a number, and ranks by the first 8, 16, ... bytes, up to ``length``."""
    tail = np.zeros(length, np.uint8)
    padded = np.concatenate([data, tail])
    eight = np.zeros(len(padded), np.uint64)
    for k in range(8):
        eight = (eight << np.uint64(8)) | np.concatenate([padded[k:], tail[:k]])
    levels = [(8, _ranked(eight))]
    while 2 * levels[-1][0] <= length:
        size, rank = levels[-1]
        later = np.concatenate([rank[size:], np.zeros(size, np.uint64)])
        levels.append((2 * size, _ranked(rank << np.uint64(32) | later)))
    return eight, levels


def suffix_ranks(levels: list[tuple[int, np.ndarray]], length: int, starts: np.ndarray) -> np.ndarray:
    """Ranks of the suffixes from ``starts`` by their first ``length`` bytes; equal bytes have equal ranks."""
    size, rank = levels[-1]
    return _ranked(rank[starts] << np.uint64(32) | rank[starts + length - size])


def previous_smaller(value: np.ndarray) -> np.ndarray:
    """For each place the nearest place before it with a smaller value, or -1; values are distinct."""
    before = np.arange(-1, len(value) - 1)
    open_ = np.flatnonzero((before >= 0) & (value[before] > value))
    while len(open_):  # all between a place and its candidate are larger, so the candidate's own candidate is the next
        before[open_] = before[before[open_]]
        open_ = open_[before[open_] >= 0]
        open_ = open_[value[before[open_]] > value[open_]]
    return before


def common_prefix(eight: np.ndarray, levels: list[tuple[int, np.ndarray]], a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Bytes that the suffixes from ``a`` and ``b`` have in common, ``length`` at most."""
    size = np.zeros(len(a), np.int64)
    for step, rank in reversed(levels):
        size += np.where(rank[a + size] == rank[b + size], step, 0)
    differ = eight[a + size] ^ eight[b + size]
    for k in range(1, 8):
        size += differ >> np.uint64(64 - 8 * k) == 0
    return np.minimum(size, length)


def longest_previous_factor(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each start (ascending) the longest prefix, up to ``length`` bytes, that also begins at an earlier start, and which (or -1).

    Previous and next smaller positions in suffix order are the two candidates. Suffixes that agree in ``length``
    bytes lie together by position, so all but the first of them have the one before as previous smaller position;
    only the first ones are asked for both.
    """
    eight, levels = prefix_ranks(data, length)
    rank = suffix_ranks(levels, length, starts)
    order = np.lexsort((starts, rank))
    fresh = np.append(True, rank[order][1:] != rank[order][:-1])[: len(order)]
    value, source = np.full(len(starts), length, np.int64), np.full(len(starts), -1, np.int64)
    source[order[1:]] = order[:-1]
    first = order[fresh]
    value[first], source[first] = 0, -1
    many = len(first)
    after = many - 1 - previous_smaller(first[::-1])[::-1]
    for other in (previous_smaller(first), np.where(after == many, -1, after)):
        at = np.flatnonzero(other >= 0)
        own, earlier = first[at], first[other[at]]
        size = common_prefix(eight, levels, starts[own], starts[earlier], length)
        better = size > value[own]
        value[own[better]], source[own[better]] = size[better], earlier[better]
    return value, source


def _spans(hit: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each stretch of hits within runs of neighbouring places."""
    edge = np.flatnonzero(hit)
    if not len(edge):
        return edge, edge
    fresh = np.append(True, (np.diff(edge) > 1) | (np.diff(place[edge]) != 1))
    firsts = np.flatnonzero(fresh)
    return edge[firsts], edge[np.append(firsts[1:], len(edge)) - 1]


def removed(docs: DataFrame, length: int = LENGTH, keep_first: bool = False, doc_id: str = "doc_id", group: int = GROUP) -> DataFrame:
    """(doc_id, n_bytes, kept, spans): the bytes that are left of each document, and the removed spans [start, end)."""
    if length < 2 * GRAM:
        raise ValueError(f"strings have at least {2 * GRAM} bytes")
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("row", F.xxhash64("doc_id", "text"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    later = None
    if keep_first:
        times = settle(texts.groupBy("row").agg(F.count(F.lit(1)).alias("times")).where(F.col("times") > 1))
        if not times.isEmpty():  # of equal rows one is looked at, and the others repeat it from end to end
            texts = settle(texts.dropDuplicates(["row"]))
            size, whole = F.octet_length("text"), F.octet_length("text") >= length
            span = F.struct(F.lit(0).alias("start"), size.alias("end"))
            later = texts.join(times, "row").select("*", F.explode(F.sequence(F.lit(2), F.col("times")))).select(
                "doc_id", size.cast("long").alias("n_bytes"), F.when(whole, F.lit(b"")).otherwise(F.col("text").cast("binary")).alias("kept"),
                F.when(whole, F.array(span)).otherwise(F.array().cast("array<struct<start:int,end:int>>")).alias("spans"))
    names = ["anchor", "kinds", "n", "doc_id", "row", "start", "strings", "bytes"]
    id_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}.get(kind)
    if id_type is None:
        raise ValueError("ids are whole numbers or text")
    out = [pa.int64(), pa.int64(), pa.int64(), id_type, pa.int64(), pa.int32(), pa.int32(), pa.binary()]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in in_pieces(batches):
            rows, ids, found = batch.column("row").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("runs").to_pylist()
            lines = []
            for row, own_id, own_runs, text in zip(rows, ids, found, batch.column("text")):
                if row == last:  # a repeated row
                    continue
                last, raw = row, text.as_py().encode()
                lines += [(r["anchor"], r["kinds"], r["n"], own_id, row, r["start"], r["strings"], raw[r["start"] : r["start"] + r["strings"] + length - 1]) for r in own_runs]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*lines) if lines else [[]] * 8, out)], names=names)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        size = 0

        def done(table: pa.Table) -> pa.RecordBatch:
            strings = table.column("strings").to_numpy().astype(np.int64)
            held = table.column("bytes").combine_chunks().cast(pa.large_binary())
            held = held.chunk(0) if isinstance(held, pa.ChunkedArray) else held
            data = np.frombuffer(b"".join(held.to_pylist()), np.uint8)
            begins = np.cumsum(strings + length - 1) - (strings + length - 1)
            line = np.repeat(np.arange(len(strings)), strings)
            within = np.arange(len(line)) - np.repeat(np.cumsum(strings) - strings, strings)
            value, source = longest_previous_factor(data, begins[line] + within, length)
            hit = value == length
            if not keep_first:
                hit[source[hit]] = True  # a source is repeated by those that name it
                hit &= (table.column("n").to_numpy() == 1)[line]
            first, last = _spans(hit, begins[line] + within)
            start = table.column("start").to_numpy()[line[first]]
            return pa.RecordBatch.from_arrays(
                [pa.array(table.column("row").to_numpy()[line[first]]), pa.array((start + within[first]).astype(np.int32)), pa.array((start + within[last] + length).astype(np.int32))], names=["row", "start", "end"])

        for batch in batches:
            waiting.append(batch)
            size += batch.nbytes
            if size >= CHUNK:
                table = pa.Table.from_batches(waiting)
                anchors = table.column("anchor").to_numpy()
                edge = int(np.searchsorted(anchors, anchors[-1])) if anchors[0] != anchors[-1] else 0
                if edge:
                    yield from chunks(table.slice(0, edge), done)
                    table = table.slice(edge)
                waiting, size = table.to_batches(), table.nbytes
        if waiting:
            yield from chunks(pa.Table.from_batches(waiting), done)

    def chunks(table: pa.Table, done) -> Iterator[pa.RecordBatch]:
        """Pieces of about CHUNK bytes that keep an anchor's runs together."""
        anchors = table.column("anchor").to_numpy()
        edges = np.append(np.flatnonzero(np.append(True, anchors[1:] != anchors[:-1])), len(anchors))
        reach = np.append(0, np.cumsum(table.column("strings").to_numpy().astype(np.int64) + length - 1))
        first = 0
        while first < len(anchors):
            target = int(np.searchsorted(reach, reach[first] + CHUNK, "right")) - 1
            last = int(edges[max(int(np.searchsorted(edges, first, "right")), int(np.searchsorted(edges, target, "right")) - 1)])
            yield done(table.slice(first, last - first))
            first = last

    def collapsed(runs: DataFrame, *more: str) -> tuple[DataFrame, DataFrame]:
        """(anchor, kinds, n, one) of the runs whose anchor has several kinds, and the marks of runs that others repeat whole."""
        contents = settle(runs.groupBy("anchor", "content").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "start", "row", "strings", *more)).alias("one")))
        whole = runs.join(contents.where(F.col("n") > 1).select("anchor", "content", F.col("one.row").alias("one_row"), F.col("one.start").alias("one_start")), ["anchor", "content"])
        if keep_first:
            whole = whole.where((F.col("row") != F.col("one_row")) | (F.col("start") != F.col("one_start")))
        several = contents.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).where(F.col("kinds") > 1)
        kept = contents.join(several, "anchor").select("anchor", "kinds", "n", "one.*")
        return kept, whole.select("row", "start", (F.col("start") + F.col("strings") + length - 1).alias("end")).distinct()

    def compared(pieces: DataFrame) -> DataFrame:
        few = pieces.where(F.col("kinds") <= group).select("anchor", "n", "doc_id", "row", "start", "strings", "bytes")
        return few.repartition("anchor").sortWithinPartitions("anchor", F.col("doc_id").asc_nulls_first(), "start", "row").mapInArrow(compare, "row bigint, start int, end int")

    wanted, whole = collapsed(settle(candidate_runs(texts, anchor_filter(texts, length), length)))
    per_text = wanted.groupBy("row").agg(F.collect_list(F.struct("anchor", "kinds", "n", "start", "strings")).alias("runs"))
    pieces = texts.join(per_text, "row").select("row", "doc_id", "runs", "text").mapInArrow(cut, f"anchor bigint, kinds bigint, n bigint, doc_id {kind}, row bigint, start int, strings int, bytes binary")
    pieces = settle(pieces)  # at every size, so that the cost of a text does not jump with the first hot anchor
    hot = not pieces.where(F.col("kinds") > group).isEmpty()
    marks, gram = [whole, compared(pieces)], GRAM
    while hot:
        gram = min(2 * gram, length)
        pieces, whole = collapsed(settle(finer_runs(pieces.where(F.col("kinds") > group), gram, length)), "bytes")
        marks.append(whole)
        if gram == length:
            break
        marks.append(compared(pieces))
        hot = not pieces.where(F.col("kinds") > group).isEmpty()
    spans = reduce(DataFrame.union, marks).groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("marks"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_pieces(batches):
            kept, spans, sizes = [], [], []
            for text, found in zip(batch.column("text"), batch.column("marks")):
                raw = text.as_py().encode()
                sizes.append(len(raw))
                own = []
                for mark in sorted((m["start"], m["end"]) for m in (found.as_py() or ())):
                    if own and mark[0] <= own[-1][1]:
                        own[-1][1] = max(own[-1][1], mark[1])
                    else:
                        own.append(list(mark))
                spans.append([{"start": a, "end": b} for a, b in own])
                cuts = [0, *(x for span in own for x in span), len(raw)]
                kept.append(b"".join(raw[a:b] for a, b in zip(cuts[::2], cuts[1::2])))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(kept, pa.binary()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))], names=["doc_id", "n_bytes", "kept", "spans"])

    found = texts.join(spans, "row", "left").select("row", "doc_id", "marks", "text").mapInArrow(finish, f"doc_id {kind}, n_bytes bigint, kept binary, spans array<struct<start: int, end: int>>")
    return found if later is None else found.union(later)


def digest(found: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of ``removed``."""
    return found.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2(F.col("kept"), 256).alias("kept_sha256")
    )
