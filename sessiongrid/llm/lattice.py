"""LM scoring by subword lattice likelihood.

The pieces of an existing vocabulary span a lattice over each word: every way to cut it into pieces is a path,
weighed by the pieces' probabilities, and a forward recursion in log space sums all paths to a marginal
probability. No piece crosses white space, so the probability of a text is the product over its words, times its
end. Byte pieces cover what no other piece does. With ``whole_words`` (off unless asked for) a word of the training documents
is one more edge of its own lattice, from start to end, weighed by its count less DISCOUNT; what the discount takes is the
weight of all paths of pieces.

The vocabulary's own scores (merge ranks) give the pieces' first weights, 1 / (rank + RANK_OFFSET). Each of ``rounds`` rounds
then sums the expected uses of every piece over all training words, each as often as it occurs, by forward and backward sums
under the present weights, and takes the shares of these sums as the next weights; with no rounds the vocabulary's scores
weigh alone. The end is one more unit of the model, at its share of all expected units.

Words are counted over all documents, so what is gathered grows with the corpus. A word's two scores are worked
out once. Documents then meet them in two ways: the most frequent words, at most HEAD, are broadcast, all others
are joined by the 64-bit hash of the word, and partial sums are added up for each document.

Defined results: a null text is an empty one and has the end alone; without training documents no token is
known, the first weights score and the end has probability 1; repeated rows and null ids are scored like any row; columns named as an output
are replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessiongrid.llm.texts import WORD, Shared, crc_bucket, lower_ascii, text_slices
from sessiongrid.session import settle

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
RANK_OFFSET = 10.0
HEAD = 65_536
ROUNDS = 2
SMOOTHING = 0.05
DISCOUNT = 0.75
WORD_START = "▁"
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
SPREAD = np.uint64(0xD6E8FEB86659FD93)


@dataclass(frozen=True)
class Pieces:
    """Sorted hashes of the pieces by byte length, their numbers, and log weights; bytes are numbers 0 to 255."""

    lengths: list[int]
    hashes: list[np.ndarray]
    numbers: list[np.ndarray]
    filters: list[np.ndarray]
    log_weight: np.ndarray

    def reweighed(self, counts: np.ndarray) -> Pieces:
        smooth = counts + SMOOTHING
        return Pieces(self.lengths, self.hashes, self.numbers, self.filters, np.log(smooth / smooth.sum()))


def _bytes_hash(data: bytes) -> int:
    value = 0
    for b in data:
        value = (value * int(MULTIPLIER) + b + 1) % (1 << 64)
    return value


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes * SPREAD) >> np.uint64(48)


def read_pieces(path: str = VOCABULARY) -> Pieces:
    """The vocabulary with the weights that its own ranks give."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    plain = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    ranks = np.concatenate([np.full(256, float(size)), [min(float(size), -model.get_score(i)) for i in plain]])
    weight = 1 / (ranks + RANK_OFFSET)
    by_length: dict[int, list[tuple[int, int]]] = {}
    for number, i in enumerate(plain, 256):
        piece = model.id_to_piece(i).encode()
        by_length.setdefault(len(piece), []).append((_bytes_hash(piece), number))
    lengths = sorted(by_length)
    tables = [sorted(by_length[n]) for n in lengths]
    hashes = [np.array([h for h, _ in t], np.uint64) for t in tables]
    filters = []
    for h in hashes:
        seen = np.zeros(1 << 16, bool)
        seen[_slot(h)] = True
        filters.append(seen)
    return Pieces(lengths, hashes, [np.array([k for _, k in t], np.int32) for t in tables], filters, np.log(weight / weight.sum()))


class Lattice:
    """The pieces that match at each byte of some words, and the sums over their paths."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, pieces: Pieces):
        sizes = np.diff(offsets)
        self.order = np.argsort(-sizes, kind="stable")
        self.start = offsets[:-1][self.order]
        self.size = sizes[self.order]
        self.words = len(sizes)
        room = np.repeat(offsets[1:], sizes) - np.arange(len(data))
        steps, numbers = [1], [data.astype(np.int32)]
        running = np.zeros(len(data), np.uint64)
        code = data.astype(np.uint64) + np.uint64(1)
        done = 0
        longest = int(sizes.max(initial=0))
        for length, hashes, own, seen in zip(pieces.lengths, pieces.hashes, pieces.numbers, pieces.filters):
            if length > longest:
                break
            for n in range(done, length):
                shifted = np.zeros(len(data), np.uint64)
                shifted[: max(0, len(data) - n)] = code[n:]
                running = running * MULTIPLIER + shifted
            done = length
            at = np.flatnonzero(seen[_slot(running)] & (room >= length))
            place = np.minimum(np.searchsorted(hashes, running[at]), len(hashes) - 1)
            match = hashes[place] == running[at]
            if match.any():
                found = np.full(len(data), -1, np.int32)
                found[at[match]] = own[place[match]]
                steps.append(length)
                numbers.append(found)
        self.steps = np.array(steps)
        self.numbers = np.stack(numbers)
        self.log = np.where(self.numbers >= 0, pieces.log_weight[self.numbers], -np.inf)
        self.slot = offsets[:-1][self.order] + self.order  # a word has one more place than bytes

    def _sum(self, values: np.ndarray) -> np.ndarray:
        top = values.max(0)
        return top + np.log(np.exp(values - top).sum(0))

    def forward(self) -> np.ndarray:
        alpha = np.full(len(self.log[0]) + self.words, -np.inf)
        alpha[self.slot] = 0
        lines = np.arange(len(self.steps))[:, None]
        for t in range(1, int(self.size.max(initial=0)) + 1):
            many = int(np.searchsorted(-self.size, -t, "right"))
            used = int(np.searchsorted(self.steps, t, "right"))
            back = t - self.steps[:used, None]
            alpha[self.slot[:many] + t] = self._sum(alpha[self.slot[:many] + back] + self.log[lines[:used], self.start[:many] + back])
        return alpha

    def log_probability(self) -> np.ndarray:
        """The marginal log probability of each word, in the order given."""
        result = np.zeros(self.words)
        result[self.order] = self.forward()[self.slot + self.size]
        return result

    def expected(self, counts: np.ndarray, pieces: int) -> np.ndarray:
        """Expected number of uses of each piece, words weighed by ``counts``."""
        alpha = self.forward()
        beta = np.full(len(alpha), -np.inf)
        beta[self.slot + self.size] = 0
        total, times = alpha[self.slot + self.size], counts[self.order]
        lines = np.arange(len(self.steps))[:, None]
        used = np.zeros(pieces)
        for t in range(int(self.size.max(initial=0)) - 1, -1, -1):
            many = int(np.searchsorted(-self.size, -(t + 1), "right"))
            fits = t + self.steps[:, None] <= self.size[:many]
            ahead = np.minimum(t + self.steps[:, None], self.size[:many])
            onward = np.where(fits, beta[self.slot[:many] + ahead], -np.inf) + self.log[lines, self.start[:many] + t]
            beta[self.slot[:many] + t] = self._sum(onward)
            number = self.numbers[lines, self.start[:many] + t]
            share = np.exp(alpha[self.slot[:many] + t] + onward - total[:many]) * times[:many]
            real = (number >= 0) & (share > 0)
            used += np.bincount(number[real], share[real], pieces)
        return used


def lattices(words: pa.Array, pieces: Pieces) -> Iterator[tuple[int, int, Lattice]]:
    marked = pc.binary_join_element_wise(pa.scalar(WORD_START), words.cast(pa.string()), "")
    for first, last, data, offsets in text_slices(marked, 1 << 17):
        yield first, last, Lattice(data, offsets, pieces)


def word_counts(docs: DataFrame, training) -> DataFrame:
    """(word, n, c): how often each word occurs in all documents and in those where ``training`` holds.

    Each task counts the words of a batch before anything is shuffled.
    """
    pattern = re.compile(WORD.encode())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            learn = batch.column("learn").to_numpy(zero_copy_only=False)
            counts: tuple[Counter, Counter] = (Counter(), Counter())
            for first, last, data, offsets in text_slices(batch.column("text")):
                low = lower_ascii(data).tobytes()
                for i in range(last - first):
                    counts[int(learn[first + i])].update(pattern.findall(low, offsets[i], offsets[i + 1]))
            for kind, found in enumerate(counts):
                words, n = list(found), np.fromiter(found.values(), np.int64, len(found))
                for k in range(0, len(words), 50_000):
                    part = pa.array(words[k : k + 50_000], pa.binary()).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([part, pa.array(n[k : k + 50_000]), pa.array(n[k : k + 50_000] * kind)], names=["word", "n", "c"])

    texts = docs.select(F.coalesce(F.col("text"), F.lit("")).alias("text"), training.alias("learn"))
    return texts.mapInArrow(run, "word string, n bigint, c bigint").groupBy("word").agg(F.sum("n").alias("n"), F.sum("c").alias("c"))


def expected_counts(words: DataFrame, pieces: Pieces) -> np.ndarray:
    """Expected piece counts over (word, c), words c times; a row per piece and task is shuffled."""
    shared = Shared(words.sparkSession, pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        used = np.zeros(len(own.log_weight))
        for batch in batches:
            times = batch.column("c").to_numpy().astype(np.float64)
            for first, last, lattice in lattices(batch.column("word"), own):
                used += lattice.expected(times[first:last], len(used))
        there = np.flatnonzero(used)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(used[there])], names=["piece", "used"])

    found = words.select("word", "c").mapInArrow(run, "piece bigint, used double").groupBy("piece").agg(F.sum("used").alias("used"))
    counts = np.zeros(len(pieces.log_weight))
    for r in found.collect():  # at most one row per piece of the vocabulary
        counts[r["piece"]] = r["used"]
    return counts


def scored_words(words: DataFrame, pieces: Pieces, tokens: int, distinct: int) -> DataFrame:
    """(word, n, c, lattice): words with the natural log of their marginal probability."""
    shared = Shared(words.sparkSession, pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = np.zeros(len(batch))
            for first, last, lattice in lattices(batch.column("word"), shared.value):
                value[first:last] = lattice.log_probability()
            if tokens:
                whole = np.maximum(batch.column("c").to_numpy() - DISCOUNT, 0)
                with np.errstate(divide="ignore"):
                    value = np.logaddexp(np.log(whole / tokens), value + np.log(DISCOUNT * distinct / tokens))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("word", "n", "c")), pa.array(value)], names=["word", "n", "c", "lattice"])

    return words.select("word", "n", "c").mapInArrow(run, "word string, n bigint, c bigint, lattice double")


def _steps():
    """Counts on a logarithmic scale, 16 steps to a doubling."""
    return F.floor(F.log2(F.col("n").cast("double")) * 16)


def least_step(words: DataFrame, head: int) -> int:
    """The least step such that at most ``head`` words lie at or above it; about a thousand rows are read."""
    most, total = 1 << 20, 0
    for r in sorted(words.groupBy(_steps().alias("step")).count().collect(), key=lambda r: -r["step"]):
        total += r["count"]
        if total > head:
            break
        most = r["step"]
    return most


def score(docs: DataFrame, modulus: int = 7, remainder: int = 2, vocabulary: str = VOCABULARY, doc_id: str = "doc_id", head: int = HEAD, rounds: int = ROUNDS, whole_words: bool = False) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score): a row per document.

    ``base_score`` is an add-one smoothed unigram of words; both scores are log10.
    """
    session = docs.sparkSession
    training = crc_bucket(F.col(doc_id), modulus) != remainder
    words = settle(word_counts(docs, training))
    ends = docs.where(training).count()
    totals = words.agg(F.sum("c").alias("tokens"), F.count_if(F.col("c") > 0).alias("distinct")).first()
    distinct = totals["distinct"]
    tokens, kinds = (totals["tokens"] or 0) + ends, distinct + (ends > 0)
    pieces = read_pieces(vocabulary)
    learned = words.where(F.col("c") > 0)
    units = float(totals["tokens"] or 0)  # without rounds: as if each word were one piece
    if distinct:
        for _ in range(rounds):
            used = expected_counts(learned, pieces)
            pieces, units = pieces.reweighed(used), float(used.sum())
    end_share = ends / max(tokens if whole_words else ends + units, 1)
    if not whole_words and units:
        pieces = replace(pieces, log_weight=pieces.log_weight + np.log1p(-end_share))
    scored = settle(scored_words(words, pieces, tokens if whole_words else 0, distinct))
    base_of = np.log10(tokens + kinds + 1)
    frequent = scored.where(_steps() >= least_step(scored, head)).collect()
    shared = session.sparkContext.broadcast({r["word"].encode(): (r["c"] > 0, np.log10(r["c"] + 1), r["lattice"]) for r in frequent})
    pattern = re.compile(WORD.encode())
    end = (ends > 0, np.log10(ends + 1), float(np.log(end_share)) if ends else 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {w: i for i, w in enumerate(shared.value)}
        table = np.array([*shared.value.values(), (0, 0, 0)], np.float64)
        missing = len(place)
        for batch in batches:
            sums, rest, sizes = [], [], []
            for first, last, data, offsets in text_slices(batch.column("text")):
                low = lower_ascii(data).tobytes()
                for i in range(last - first):
                    found = pattern.findall(low, offsets[i], offsets[i + 1])
                    at = np.fromiter((place.get(w, missing) for w in found), np.int64, len(found))
                    others = np.flatnonzero(at == missing)
                    sums.append((len(found) + 1, *(table[at].sum(0) + end)))
                    rest += [xxhash.xxh64_intdigest(found[j], 42) for j in others.tolist()]
                    sizes.append(len(others))
            sums = np.array(sums).reshape(-1, 4)
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(np.array(rest, np.uint64).view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), batch.column("held_out"), pa.array(sums[:, 0].astype(np.int64)), pa.array(sums[:, 1].astype(np.int64)), pa.array(sums[:, 2]), pa.array(sums[:, 3]), lists],
                names=["row", "doc_id", "held_out", "n_tokens", "known", "base", "lattice", "rest"])

    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), (~training).alias("held_out"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    kind = docs.schema[doc_id].dataType.simpleString()
    parts = settle(texts.mapInArrow(run, f"row bigint, doc_id {kind}, held_out boolean, n_tokens bigint, known bigint, base double, lattice double, rest array<bigint>"))
    rest = parts.select("row", F.explode("rest").alias("hash"))
    known = scored.select(F.xxhash64("word").alias("hash"), (F.col("c") > 0).cast("bigint").alias("known"), F.log10(F.col("c") + 1).alias("base"), "lattice")
    others = rest.join(known, "hash").groupBy("row").agg(F.sum("known").alias("k"), F.sum("base").alias("b"), F.sum("lattice").alias("l"))
    joined = parts.drop("rest").join(others, "row", "left")
    return joined.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("k", F.lit(0))).alias("n_known"), F.lit(int(tokens)).alias("train_tokens"),
        (F.col("base") + F.coalesce("b", F.lit(0.0)) - F.col("n_tokens") * float(base_of)).alias("base_score"),
        ((F.col("lattice") + F.coalesce("l", F.lit(0.0))) / float(np.log(10))).alias("score"),
    )
