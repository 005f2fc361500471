"""Repeated passages and lattice scores against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from llm_fixtures import documents

from pyspark.sql import functions as F

from sessiongrid.llm import lattice, repeats


def slow_removed(texts, length, keep_first):
    """Removed spans by counting every string."""
    raw = [(t or "").encode() for t in texts]
    counts = Counter(b[k : k + length] for b in raw for k in range(len(b) - length + 1))
    seen, out = set(), []
    for b in raw:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            s = b[k : k + length]
            if s in seen if keep_first else counts[s] > 1:
                gone[k : k + length] = b"\1" * length
            seen.add(s)
        out.append((len(b), sum(gone), sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1])), hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


def passages():
    random.seed(2)
    letters = "abcdefgh éß漢"
    text = lambda n: "".join(random.choice(letters) for _ in range(n))
    shared, longer = text(150), text(400)
    made = [None, "", "a", "x" * 500, "x" * 99, "ab" * 300, text(3000), shared, longer[:190]]
    for k in range(12):
        made.append(text(random.randrange(200)) + (shared, longer, longer[60:300], longer[:70])[k % 4] + text(random.randrange(200)))
    return made + [made[6], made[6][:1500] + "!" + made[6][1500:], made[10], "tail " + longer]


@pytest.mark.parametrize("length,keep_first,group", [(100, False, 20_000), (100, True, 20_000), (100, False, 2), (100, True, 2), (64, False, 20_000), (200, False, 20_000)])
def test_removed_spans(spark, length, keep_first, group):
    texts = passages()
    docs = documents(spark, texts).withColumn("row", F.lit("mine")).withColumn("n_bytes", F.lit(0)).repartition(3)
    found = sorted(repeats.digest(repeats.removed(docs, length, keep_first, group=group)).collect())
    assert [tuple(r)[1:] for r in found] == slow_removed(texts, length, keep_first)
    assert keep_first or sum(r.n_removed for r in found) > 3000


def test_removed_odd_rows(spark, odd_texts):
    found = repeats.removed(documents(spark, odd_texts), 64).collect()
    assert len(found) == len(odd_texts)
    long = next(r for r in found if r.doc_id == 6)
    assert len(long.kept) == 0 and [tuple(s) for s in long.spans] == [(0, 50_000)]
    assert repeats.removed(documents(spark, [])).count() == 0


def test_equal_rows_keep_their_first(spark):
    """Rows with equal id and text are one after the other: the first is judged, the others repeat it."""
    random.seed(5)
    a, x = ("".join(random.choice("abcdefgh") for _ in range(n)) for n in (300, 40))
    texts = [(1, a + x + a), (1, a + x + a), (2, "short"), (2, "short"), (3, a), (None, a[::-1]), (None, a[::-1]), (4, None), (4, None), (4, None)]
    for group in (20_000, 1):
        found = repeats.removed(documents(spark, texts).repartition(3), 100, keep_first=True, group=group).collect()
        kept = sorted((str(r.doc_id), bytes(r.kept)) for r in found)
        one = (a + x).encode()
        assert kept == sorted([("1", one), ("1", b""), ("2", b"short"), ("2", b"short"), ("3", b""), ("None", a[::-1].encode()), ("None", b""), *[("4", b"")] * 3])
        assert all(len(r.kept) == r.n_bytes - sum(s.end - s.start for s in r.spans) for r in found)


def test_suffix_ranks_follow_the_bytes():
    random = np.random.default_rng(1)
    data = random.integers(97, 99, 600).astype(np.uint8)
    starts = np.arange(0, 400, 3)
    strings = [data[s : s + 100].tobytes() for s in starts]
    rank = repeats.suffix_ranks(repeats.prefix_ranks(data, 100)[1], 100, starts)
    order = {s: k for k, s in enumerate(sorted(set(strings)))}
    assert rank.tolist() == [order[s] for s in strings]


@pytest.mark.parametrize("letters,length", [(2, 64), (2, 100), (3, 200), (1, 70)])
def test_longest_previous_factors(letters, length):
    random = np.random.default_rng(letters)
    block = random.integers(97, 97 + letters, 300).astype(np.uint8)
    data = np.concatenate([block, random.integers(97, 97 + letters, 150).astype(np.uint8), block[40:], block[:150], block])
    starts = np.flatnonzero(random.random(len(data) - length) < 0.7)
    strings = [data[s : s + length].tobytes() for s in starts]
    common = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), length)
    value, source = repeats.longest_previous_factor(data, starts, length)
    assert value.tolist() == [max((common(s, t) for t in strings[:i]), default=0) for i, s in enumerate(strings)]
    assert all(j == -1 if v == 0 else j < i and common(strings[i], strings[j]) == v for i, (v, j) in enumerate(zip(value, source)))
    assert repeats.longest_previous_factor(data[:0], starts[:0], length)[0].tolist() == []


def test_previous_smaller():
    for values in ([], [3], [1, 2, 3, 4, 0], [5, 4, 3, 2, 1], list(np.random.default_rng(3).permutation(200))):
        expected = [next((j for j in range(i - 1, -1, -1) if values[j] < values[i]), -1) for i in range(len(values))]
        assert repeats.previous_smaller(np.array(values, np.int64)).tolist() == expected


@pytest.mark.parametrize("gram", [32, 64, 100, 128, 200])
def test_grams_hash_their_bytes(gram):
    data = np.random.default_rng(4).integers(97, 99, 500).astype(np.uint8)
    data = np.concatenate([data, data[100:400], data[:50]])
    found = repeats.gram_hashes(data, gram).tolist()
    assert len(found) == len(data) - gram + 1
    bytes_of = [data[k : k + gram].tobytes() for k in range(len(found))]
    assert len(set(found)) == len(set(bytes_of)) == len(set(zip(found, bytes_of)))


def pieces_of():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=lattice.VOCABULARY)
    plain = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    return {model.id_to_piece(i).encode(): k for k, i in enumerate(plain, 256)}


def slow_paths(word, numbers, weight):
    """Every segmentation of a word with its probability."""
    data = (lattice.WORD_START + word).encode()

    def walk(at):
        if at == len(data):
            yield 1.0, ()
            return
        steps = [(1, data[at])] + [(n, numbers[data[at : at + n]]) for n in range(1, len(data) - at + 1) if data[at : at + n] in numbers]
        for n, k in steps:
            for p, rest in walk(at + n):
                yield weight[k] * p, (k, *rest)

    return list(walk(0))


def test_lattice_sums_all_segmentations():
    pieces, numbers = lattice.read_pieces(), pieces_of()
    weight = np.exp(pieces.log_weight)
    words = ["the", "thorea", "ñé", "a", "漢", "idiot!!", "xq"]
    expected, used = [], np.zeros(len(weight))
    for k, w in enumerate(words):
        paths = slow_paths(w, numbers, weight)
        total = sum(p for p, _ in paths)
        expected.append(math.log(total))
        for p, path in paths:
            for piece in path:
                used[piece] += (k + 1) * p / total
    array = pa.array(words)
    found = np.concatenate([x.log_probability() for _, _, x in lattice.lattices(array, pieces)])
    assert np.allclose(found, expected)
    counts = sum(x.expected(np.arange(1.0, 8.0)[a:b], len(weight)) for a, b, x in lattice.lattices(array, pieces))
    assert np.allclose(counts, used)


def test_lattice_stays_finite_on_long_words():
    value = next(x.log_probability() for _, _, x in lattice.lattices(pa.array(["x" * 20_000, ""]), lattice.read_pieces()))
    assert np.isfinite(value).all() and value[0] < -10_000


@pytest.mark.parametrize("head", [1, 5, 65_536])
def test_scores_and_base(spark, odd_texts, head):
    random.seed(6)
    vocabulary = ["the", "The", "of", "rare%d", "é", "x,y"]
    texts = odd_texts + [(i + 100, " ".join(random.choice(vocabulary).replace("%d", str(random.randrange(50))) for _ in range(random.randrange(30)))) for i in range(60)]
    docs = documents(spark, texts).withColumn("score", F.lit("mine")).withColumn("rest", F.lit(1))
    found = lattice.score(docs, head=head).collect()
    tokens = [(i, re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))) for i, t in texts]
    held = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 7 == 2
    counts = Counter(w for i, ws in tokens if not held(i) for w in [*ws, ("end",)])
    whole, kinds = sum(counts.values()), len(counts)
    expected = sorted((str(i), held(i), len(ws) + 1, sum(counts[w] > 0 for w in [*ws, ("end",)]), whole, round(sum(math.log10((counts[w] + 1) / (whole + kinds + 1)) for w in [*ws, ("end",)]), 6)) for i, ws in tokens)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found) == expected
    assert all(r.score <= 0 and np.isfinite(r.score) for r in found)


def test_head_does_not_change_scores(spark):
    docs = documents(spark, [f"word{i % 7} and other{i} words" for i in range(80)])
    one, two = ({r.doc_id: r.score for r in lattice.score(docs, head=h).collect()} for h in (2, 10_000))
    assert all(abs(one[k] - two[k]) < 1e-9 for k in one)


def test_lattice_empty_and_unlearned(spark):
    assert lattice.score(documents(spark, [])).count() == 0
    only_held = [(i, "some words") for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2]
    rows = lattice.score(documents(spark, only_held)).collect()
    assert len(rows) == len(only_held) and all(r.n_known == 0 and r.train_tokens == 0 and r.base_score == 0 for r in rows)
