"""Near duplicates by shingle similarity against all pairs, with planted copies between 0.8 and 1."""

import random
import re

import corpus_pipeline
import numpy as np
from llm_fixtures import SF_DIR, components_of, documents

from sessiongrid.llm import simhash, similar


def slow_set(text, size=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return frozenset(" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))) if words else frozenset()


def share(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def expected_ids(rows, limit=0.8):
    """The least id of each component, nulls last."""
    sets = [slow_set(r[1]) for r in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if 10 * len(sets[i] & sets[j]) >= 10 * limit * len(sets[i] | sets[j])]
    groups = {}
    for i, root in components_of(range(len(rows)), pairs).items():
        groups.setdefault(root, []).append(rows[i][0])
    return sorted((min(g, key=lambda v: (v is None, v or 0)) for g in groups.values()), key=str)


def edited(words, changes, draw):
    own = list(words)
    for at in draw.sample(range(len(own)), changes):
        own[at] = f"changed{draw.randrange(10**9)}"
    return " ".join(own)


def test_planted_copies_between_080_and_095(spark):
    """Long documents with scattered edits: a copy at 0.8 or more goes, one below stays."""
    draw = random.Random(8)
    rows, similarities = [], []
    for k in range(120):
        words = [f"w{draw.randrange(3000)}" for _ in range(1000)]
        copy = edited(words, 5 + k % 25, draw)
        rows += [(2 * k, " ".join(words)), (2 * k + 1, copy)]
        similarities.append(share(slow_set(rows[-2][1]), slow_set(copy)))
    assert sum(0.8 <= s <= 0.95 for s in similarities) > 60 and sum(s < 0.8 for s in similarities) > 10
    kept = corpus_pipeline.drop_near_duplicates(spark, documents(spark, rows), "").collect()
    assert sorted(r.doc_id for r in kept) == sorted([2 * k for k in range(120)] + [2 * k + 1 for k, s in enumerate(similarities) if s < 0.8])


def test_equals_all_pairs(spark, odd_texts, monkeypatch):
    """Real, odd and short texts, shared boilerplate, chains of copies; any order of shingles has the same result."""
    draw = random.Random(5)
    boiler = " ".join(f"licence{i}" for i in range(40))
    rows = [*odd_texts, *((r.doc_id + 100, r.text) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect())]
    rows += [(10_000 + i, boiler + " " + " ".join(f"own{i}x{j}" for j in range(i % 14))) for i in range(60)]
    chain = [f"c{i}" for i in range(60)]
    rows += [(20_000 + i, " ".join(chain[i : i + 45])) for i in range(15)]
    base = [f"b{draw.randrange(500)}" for _ in range(200)]
    rows += [(30_000 + i, edited(base, i % 12, draw)) for i in range(80)]
    rows += [(40_000 + i, " ".join(f"s{j}" for j in range(i % 12))) for i in range(24)]
    docs = documents(spark, rows)
    expected = expected_ids(rows)
    for least in (similar.ORDER_LEAST, 2, 10**6):
        monkeypatch.setattr(similar, "ORDER_LEAST", least)
        kept = similar.deduplicated(docs)
        assert sorted((r.doc_id for r in kept.collect()), key=str) == expected and kept.columns == docs.columns
    assert similar.deduplicated(documents(spark, [])).count() == 0


def test_parity_bounds_the_difference():
    """Sets differ in at least as many shingles as their bitmaps in bits."""
    draw = np.random.default_rng(3)
    for n in (0, 1, 40, 3000):
        one = np.unique(draw.integers(-(2**63), 2**63 - 1, n))
        two = np.unique(np.append(one[n // 10 :], draw.integers(-(2**63), 2**63 - 1, n // 8)))
        bits = sum(int(v).bit_count() for v in similar.parity(one).view(np.uint64) ^ similar.parity(two).view(np.uint64))
        assert len(similar.parity(one)) == similar.PARITY_BITS // 64 and bits <= len(np.setxor1d(one, two))
        assert n != 40 or bits > 0


def test_simhash_links_come_first(spark, monkeypatch):
    """The stage meets documents by their fingerprints, a pair a document, and checks them exactly."""
    asked, met = [], []
    found, checked = simhash.fingerprint_components, similar.similar
    monkeypatch.setattr(simhash, "fingerprint_components", lambda rows, **options: asked.append(rows.count()) or found(rows, **options))
    monkeypatch.setattr(similar, "similar", lambda pairs, *rest: met.append(pairs.count()) or checked(pairs, *rest))
    draw = random.Random(4)
    base = [f"b{draw.randrange(900)}" for _ in range(400)]
    rows = [(i, edited(base, i % 3, draw)) for i in range(60)] + [(100 + i, " ".join(f"o{i}x{j}" for j in range(30))) for i in range(20)]
    kept = corpus_pipeline.drop_near_duplicates(spark, documents(spark, rows), "")
    assert sorted(r.doc_id for r in kept.collect()) == expected_ids(rows)
    assert len(asked) == 1 and 1 < met[0] < asked[0] and sum(met) < 2 * asked[0]


def test_rounds_that_join_nothing_end(spark, monkeypatch):
    """Documents that share many shingles, but too few, stay: one round of leaders joins nothing, and no further one is run."""
    called, found = [], similar.components
    monkeypatch.setattr(similar, "components", lambda *given: called.append(1) or found(*given))
    rows = [(i, " ".join(f"e{j}x{i if j % 12 == 5 else 0}" for j in range(60))) for i in range(12)]
    kept = corpus_pipeline.drop_near_duplicates(spark, documents(spark, rows), "")
    assert sorted((r.doc_id for r in kept.collect()), key=str) == expected_ids(rows) and len(expected_ids(rows)) == 12
    assert len(called) == 3
