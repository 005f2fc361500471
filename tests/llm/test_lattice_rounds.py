"""Every round that fits the weights of the pieces sees every distinct training word."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from llm_fixtures import documents
from test_texts import pieces_of, slow_paths

from pyspark.sql import functions as F
from sessiongrid.llm import lattice


def test_every_round_sees_all_words(spark, monkeypatch):
    seen, expected = [], lattice.expected_counts

    def spy(words, pieces):
        seen.append(words.count())
        return expected(words, pieces)

    monkeypatch.setattr(lattice, "expected_counts", spy)
    texts = [" ".join(f"w{i}" for i in range(k * 1000, k * 1000 + 1000)) for k in range(90)]
    lattice.score(documents(spark, texts))
    assert len(seen) == lattice.ROUNDS and set(seen) == {1000 * sum(1 for k in range(90) if zlib.crc32(str(k).encode()) % 7 != 2)}
    assert seen[0] > 60_000


@pytest.mark.parametrize("rounds,whole_words", [(0, False), (1, False), (2, False), (1, True)])
def test_scores_against_all_segmentations(spark, rounds, whole_words):
    vocabulary = ["the", "ab", "ñé", "idiot", "xq", "a1b", "漢"]
    texts = {i: " ".join(vocabulary[(i * k) % 7] for k in range(1, i % 6 + 1)) for i in range(40)}
    held = {i for i in texts if zlib.crc32(str(i).encode()) % 7 == 2}
    assert held
    counts = Counter(w for i, t in texts.items() if i not in held for w in t.split())
    ends, numbers = len(texts) - len(held), pieces_of()
    weight, units = np.exp(lattice.read_pieces().log_weight), float(sum(counts.values()))
    for _ in range(rounds):
        used = np.zeros(len(weight))
        for w, c in counts.items():
            paths = slow_paths(w, numbers, weight)
            total = sum(p for p, _ in paths)
            for p, path in paths:
                for piece in path:
                    used[piece] += c * p / total
        weight, units = (used + lattice.SMOOTHING) / (used + lattice.SMOOTHING).sum(), used.sum()
    tokens = sum(counts.values()) + ends
    end = ends / tokens if whole_words else ends / (ends + units)

    def probability(word):
        if not whole_words:
            return sum(p * (1 - end) ** len(path) for p, path in slow_paths(word, numbers, weight))
        spelled = sum(p for p, _ in slow_paths(word, numbers, weight))
        return (max(counts[word] - lattice.DISCOUNT, 0) + lattice.DISCOUNT * len(counts) * spelled) / tokens

    found = lattice.score(documents(spark, list(texts.values())), rounds=rounds, whole_words=whole_words).collect()
    for r in found:
        expected = math.log10(end) + sum(math.log10(probability(w)) for w in texts[r.doc_id].split())
        assert abs(r.score - expected) < 1e-8


def test_fitted_weights_gain_on_held_out_texts(spark, real):
    docs = real[0].limit(300)
    unfitted, fitted = (lattice.score(docs, rounds=n).where("held_out").agg(F.sum("score")).first()[0] for n in (0, lattice.ROUNDS))
    assert fitted > 0.8 * unfitted  # both are below zero
