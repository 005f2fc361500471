"""Embedding and SimHash near duplicates against brute force, with planted groups and odd rows."""

import re

import numpy as np
import pytest
import xxhash
from llm_fixtures import SF_DIR, components_of, documents

from pyspark.sql import functions as F

from sessiongrid.llm import embeddings, simhash
from sessiongrid.llm.components import components
from sessiongrid.session import settle


def slow_fingerprint(text, size=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 102), (7, 7), (200, 150)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert found == {n: r for n, r in components_of({x for e in edges for x in e}, edges).items()}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_triples_cover_four_positions():
    from itertools import combinations

    design = simhash.triples()
    assert len(set(design)) == 20
    assert all(any(set(t) <= set(four) for t in design) for four in combinations(range(8), 4))


@pytest.mark.parametrize("n", [1, 2, 3, 254, 255, 256, 511, 1000])
def test_majority(n):
    hashes = np.random.default_rng(n).integers(0, 2**64, n, dtype=np.uint64)
    expected = sum(1 << b for b in range(64) if 2 * sum(int(h) >> b & 1 for h in hashes) > n)
    assert simhash.majority(hashes) == expected


def test_links_equal_all_pairs(spark):
    """Random fingerprints and balls around some of them, at every distance near the radius."""
    random = np.random.default_rng(3)
    prints = set(random.integers(0, 2**64, 150, dtype=np.uint64).tolist())
    for centre in list(prints)[:10]:
        for _ in range(25):
            bits = random.choice(64, int(random.integers(1, 7)), replace=False)
            prints.add(centre ^ sum(1 << int(b) for b in bits))
    signed = sorted(p - (1 << 64) if p >= 1 << 63 else p for p in prints)
    expected = {(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4}
    found = simhash.links(spark.createDataFrame([(p,) for p in signed], "fingerprint long")).collect()
    assert len(found) == len(expected) and {(r.a, r.b) for r in found} == expected and len(expected) > 100


def test_simhash_on_documents(spark, odd_texts):
    real = [(r.doc_id + 100, r.text) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    docs = documents(spark, odd_texts + real).withColumn("fingerprint", F.lit("mine"))
    rows = simhash.near_duplicates(docs).select("doc_id", simhash.hex_digits(F.col("fingerprint")).alias("f"), "component_id").collect()
    texts = [(t[0], slow_fingerprint(t[1])) for t in odd_texts + real]
    prints = sorted({p for _, p in texts})
    pairs = [(a, b) for i, a in enumerate(prints) for b in prints[i + 1 :] if (a ^ b).bit_count() <= 4]
    root = components_of(prints, pairs)
    least = {}
    for i, p in texts:
        if i is not None:
            least[root[p]] = min(i, least.get(root[p], i))
    expected = sorted(((i, f"{p:016x}", least.get(root[p])) for i, p in texts), key=str)
    assert sorted(((r.doc_id, r.f, r.component_id) for r in rows), key=str) == expected
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


def test_deduplicated_keeps_one_of_each(spark, odd_texts):
    base = "one two three four five six seven eight nine ten " * 30
    texts = odd_texts + [(50, base), (51, base), (52, base + "end"), (53, "quite another text with its own words in it")]
    docs = documents(spark, texts)
    components = {}
    for r in simhash.near_duplicates(docs).collect():
        components.setdefault(r.component_id, set()).add(r.doc_id)
    kept = simhash.deduplicated(docs).collect()
    assert sorted((r.doc_id for r in kept), key=str) == sorted(components, key=str) and docs.columns == list(kept[0].asDict())


def brute_embeddings(rows, limit=0.93):
    good = [r for r in rows if r[1] and r[2] is not None and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    links = []
    for i, a in enumerate(good):
        for j in range(i + 1, len(good)):
            b = good[j]
            if a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1], float), np.array(b[1], float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= limit:
                    links.append((i, j))
    count = [sum(i in pair for pair in links) for i in range(len(good))]
    root = components_of(range(len(good)), links)
    least = {}
    for i, r in enumerate(good):
        least[root[i]] = min(r[0], least.get(root[i], r[0]))
    expected = [(r[0], count[i], least[root[i]]) for i, r in enumerate(good)]
    return sorted(expected + [(r[0], 0, r[0]) for r in rows if r not in good], key=str)


def test_embeddings_against_brute_force(spark):
    random = np.random.default_rng(5)
    rows, n = [], 0
    for group in range(12):
        centre = random.normal(size=16)
        for _ in range(12):
            noise = random.normal(size=16) * random.choice([0.0, 0.05, 0.25, 0.5])
            rows.append((n, [float(np.float32(v)) for v in (centre + noise) * random.choice([1, 3])], group % 3))
            n += 1
    rows += [(900, None, 1), (901, [], 1), (902, [0.0] * 16, 1), (903, [None] + [1.0] * 15, 1), (904, [float("nan")] * 16, 1), (905, [float("inf")] * 16, 1), (906, rows[0][1], None), (907, rows[0][1][:8], 0), (908, rows[0][1], 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("keys", F.lit(1)).withColumn("leader", F.lit("x"))
    found = embeddings.near_duplicates(table).collect()
    expected = brute_embeddings(rows)
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in found), key=str) == expected
    assert all(r.kept == (r.vec_id == r.component_id) for r in found)
    assert sum(e[1] for e in expected) > 200
    assert embeddings.near_duplicates(table.limit(0)).count() == 0


def test_embedding_recall_near_the_limit(spark):
    """Pairs just above the limit, where hashing is weakest: nearly all are found, and none below."""
    random = np.random.default_rng(9)
    rows = []
    for k in range(300):
        u, v = random.normal(size=(2, 64))
        u /= np.linalg.norm(u)
        v -= (v @ u) * u
        v /= np.linalg.norm(v)
        cos = 0.931 if k % 2 else 0.929
        rows += [(2 * k, u.tolist(), 0), (2 * k + 1, (cos * u + np.sqrt(1 - cos**2) * v).tolist(), 0)]
    found = {r.vec_id: r.n_links for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert all(found[2 * k] == 0 for k in range(0, 300, 2))
    assert np.mean([found[2 * k] == 1 for k in range(1, 300, 2)]) > 0.97


def test_doubles_of_extreme_size(spark):
    """Squares of such components vanish or overflow; their cosines are found all the same."""
    rows = [(0, [1.0, 2.0]), (1, [1e-200, 2e-200]), (2, [1e200, 2e200]), (3, [2e200, -1e200]), (4, [5e-324, 5e-324]), (5, [1.7e308, 1.7e308]), (6, [0.0, 0.0])]
    vectors = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, label int")
    found = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(vectors).collect()}
    # (1, 2) and (1, 1) meet at 0.9487
    assert found == {0: (4, 0), 1: (4, 0), 2: (4, 0), 4: (4, 0), 5: (4, 0), 3: (0, 3), 6: (0, 6)}


def test_components_of_stars_take_no_round(spark):
    """Links to a least node that has none smaller are the result; others take rounds until they are such."""
    settled = []

    def kept(table):
        settled.append(1)
        return settle(table)

    stars = spark.createDataFrame([(1, n) for n in range(2, 30)] + [(40, 41), (41, 40), (50, 50), (None, 60)], "a long, b long")
    roots = {(r.node, r.root) for r in components(stars, "a", "b", kept).collect()}
    assert roots == {(n, 1) for n in range(1, 30)} | {(40, 40), (41, 40)} and len(settled) == 1
    chain = spark.createDataFrame([(n, n + 1) for n in range(40)], "a long, b long")
    assert {(r.node, r.root) for r in components(chain, "a", "b", kept).collect()} == {(n, 0) for n in range(41)} and len(settled) > 3
    assert components(chain.limit(0), "a", "b", kept).count() == 0
