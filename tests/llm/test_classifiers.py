"""Toxicity, quality and language: held-out accuracy, planted cases, odd inputs."""

import zlib

import numpy as np
import pytest
from llm_fixtures import documents

from pyspark.sql import functions as F

from sessiongrid.llm import language, quality, toxicity

SF = "/root/testdata/sf0.01"


def crc(i, m):
    return zlib.crc32(str(i).encode()) % m


@pytest.fixture(scope="module")
def larger(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def toxic_model(larger):
    return toxicity.fit(*larger)


def planted_labels(docs, labels, column, value):
    return {r.doc_id: r[column] for r in labels.collect() if r[column] is not None and r[column] == value}


def test_toxicity_separates_held_out(larger, toxic_model):
    docs, labels = larger
    rows = toxicity.held_out(toxicity.score(docs.select("doc_id", "text"), toxic_model, keep=["doc_id"])).collect()
    truth = {r.doc_id: r.toxic for r in labels.collect() if r.toxic is not None}
    assert all(r.held_out == (crc(r.doc_id, 4) == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= toxicity.THRESHOLD) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    right = np.mean([r.predicted == truth[r.doc_id] for r in held])
    assert len(rows) == docs.count() and right > 0.9
    insults = set("loser idiot pathetic scum worthless moron trash clown disgusting stupid".split())
    marked = {r.doc_id for r in docs.collect() if len(insults & set((r.text or "").lower().split())) >= 2}
    assert np.mean([r.predicted for r in rows if r.doc_id in marked]) > 0.95


def test_toxicity_learns_nothing_from_held_out_labels(larger, toxic_model):
    docs, labels = larger
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.fit(docs, flipped)
    assert np.array_equal(again.bucket, toxic_model.bucket) and np.allclose(again.weight, toxic_model.weight)


def test_toxicity_odd_texts_and_clashing_columns(spark, toxic_model, odd_texts):
    docs = documents(spark, odd_texts).withColumn("score", F.lit("mine")).withColumn("predicted", F.lit(None).cast("string"))
    made = toxicity.score(docs, toxic_model)
    rows = made.collect()
    assert len(rows) == len(odd_texts) and made.schema["score"].dataType.simpleString() == "double"
    by_text = {}
    for r in rows:
        by_text.setdefault(r.text or "", set()).add(r.score)
    assert all(len(v) == 1 for v in by_text.values())
    assert toxicity.score(documents(spark, []), toxic_model).count() == 0


@pytest.mark.parametrize("op", [toxicity, quality])
def test_without_both_classes(spark, op):
    docs = documents(spark, ["one text", "another", None])
    label = "toxic" if op is toxicity else "quality"
    for labels, share in (([], 0.0), ([(i, 1) for i in range(3)], 1.0)):
        table = spark.createDataFrame(labels, f"doc_id long, {label} int")
        scores = {round(r.score, 6) for r in op.score(docs, op.fit(docs, table)).collect()}
        assert scores == {share}


def test_repeated_and_conflicting_labels(spark):
    docs = documents(spark, [f"plain words number {i} idiot" if i % 2 else f"plain words number {i}" for i in range(60)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] * 2 + [(None, 1), (3, None), (999, 1)], "doc_id long, toxic int")
    scores = {r.doc_id: r.predicted for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    assert np.mean([scores[i] == i % 2 for i in range(60)]) > 0.95


def slow_bucket(gram):
    """The bucket of an n-gram, a byte at a time."""
    running = 0
    for byte in gram:
        running = (running * 0x01000193 + byte + 1) % 2**32
    mixed = ((running ^ running >> 15) * 0x9E3779B1 + len(gram)) % 2**32
    return (mixed * 0x85EBCA6B) % 2**32


def slow_lower(text):
    return bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())


def slow_presence(text):
    low = slow_lower(text)
    return {slow_bucket(low[i : i + n]) >> 32 - toxicity.BITS for n in toxicity.ORDERS for i in range(len(low) - n + 1)}


def test_toxicity_scores_equal_slow_ones(larger, toxic_model):
    weight = dict(zip(toxic_model.bucket.tolist(), toxic_model.weight.tolist()))
    docs = larger[0].where("doc_id < 60")
    for r in toxicity.score(docs, toxic_model).collect():
        margin = toxic_model.intercept + sum(weight.get(b, 0.0) for b in slow_presence(r.text))
        assert r.score == pytest.approx(1 / (1 + np.exp(-margin)), abs=1e-5)


def test_toxicity_fit_equals_slow_counts(spark):
    texts = [f"plain words {i} here" + (" you scum" if i % 3 == 0 else "") + (" calm" if i % 2 else "") for i in range(60)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id long, toxic int")
    model = toxicity.fit(documents(spark, texts), labels)
    learnt = [i for i in range(60) if crc(i, 4) != 2]
    kinds = {1: [slow_presence(texts[i]) for i in learnt if i % 3 == 0], 0: [slow_presence(texts[i]) for i in learnt if i % 3]}
    every = set().union(*kinds[0], *kinds[1])
    share = {k: {b: sum(b in d for d in kinds[k]) / len(kinds[k]) for b in every} for k in kinds}
    many = len(kinds[0]) + len(kinds[1])
    chosen = {}
    for b in every:
        pooled = (share[1][b] * len(kinds[1]) + share[0][b] * len(kinds[0])) / many
        spread = np.sqrt(pooled * (1 - pooled) * (1 / len(kinds[1]) + 1 / len(kinds[0])))
        if share[1][b] != share[0][b] and abs(share[1][b] - share[0][b]) >= toxicity.SIGNIFICANT * spread:
            chosen[b] = np.log((1 + share[1][b] * many / 2) / (2**toxicity.BITS + sum(share[1].values()) * many / 2)) - np.log(
                (1 + share[0][b] * many / 2) / (2**toxicity.BITS + sum(share[0].values()) * many / 2))
    assert sorted(chosen) == model.bucket.tolist() and len(chosen) > 5
    # at the optimum the slopes of the penalised log loss vanish
    ratio = np.array([chosen[b] for b in model.bucket.tolist()])
    theta, slope, error_sum = model.weight / ratio, 0, 0
    for k, found in kinds.items():
        for d in found:
            x = np.array([b in d for b in model.bucket.tolist()]) * ratio
            error = 1 / (1 + np.exp(-(x @ theta + model.intercept))) - k
            slope, error_sum = slope + error * x / many, error_sum + error / many
    assert np.abs(slope + toxicity.PENALTY / many * theta).max() < 1e-3 and abs(error_sum) < 1e-3


def test_quality_separates_held_out(larger):
    docs, labels = larger
    rows = quality.held_out(quality.score(docs.select("doc_id", "text"), quality.fit(docs, labels), keep=["doc_id"])).collect()
    truth = {r.doc_id: r.quality for r in labels.collect() if r.quality is not None}
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (crc(r.doc_id, 5) == 0) for r in rows)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.93


def test_passages_cover_whole_texts(spark, odd_texts):
    from sessiongrid.llm.quality import PASSAGE, Model, score

    rows = score(documents(spark, odd_texts), Model(0.0)).collect()
    assert all(r.n_passages == max(1, -(-len((r.text or "").encode()) // PASSAGE)) for r in rows)


def bags(random):
    x, counts = random.random((7, 20)), np.array([3, 1, 3])
    shapes = {"encode": (20, 5), "encode_bias": (5,), "tanh": (5, 4), "gate": (5, 4), "attend": (4,), "out": (5,), "out_bias": (1,)}
    return x, counts, np.array([1.0, 0.0, 1.0]), np.array([0.2, 0.5, 0.3]), {k: random.normal(0, 0.7, s) for k, s in shapes.items()}


def test_attention_gradients():
    """The written-out gradients equal differences of the loss, for every weight."""
    x, counts, target, weight, w = bags(np.random.default_rng(0))
    firsts = np.cumsum(counts) - counts

    def loss():
        margin = quality.attend(x, firsts, counts, w)["margin"]
        return float((weight * (np.log1p(np.exp(margin)) - target * margin)).sum())

    for name, slope in quality.slopes(x, counts, target, weight, w).items():
        for at in np.ndindex(w[name].shape):
            kept = w[name][at]
            w[name][at] = kept + 1e-5
            above = loss()
            w[name][at] = kept - 1e-5
            below, w[name][at] = loss(), kept
            assert slope[at] == pytest.approx((above - below) / 2e-5, abs=1e-7), (name, at)
    a = quality.attend(x, firsts, counts, w)["a"]
    assert np.allclose(np.add.reduceat(a, firsts), 1)


def slow_quality(text, w):
    """A passage at a time, an attention unit at a time."""
    raw, kinds = (text or "").encode(), {b: k for k, members in enumerate(quality.CLASSES) for b in members}
    encoded, energies = [], []
    for at in range(0, max(1, len(raw)), quality.PASSAGE):
        own = [kinds.get(b, quality.KINDS - 1) for b in raw[at : at + quality.PASSAGE]]
        x = np.zeros(quality.KINDS**2)
        for a, b in zip(own, own[1:]):
            x[a * quality.KINDS + b] += 1
        h = np.tanh(np.sqrt(x / max(1, x.sum())) @ w["encode"] + w["encode_bias"])
        encoded.append(h)
        energies.append(sum(w["attend"][j] * np.tanh(h @ w["tanh"][:, j]) / (1 + np.exp(-h @ w["gate"][:, j])) for j in range(len(w["attend"]))))
    shares = np.exp(np.array(energies) - max(energies))
    z = sum(s * h for s, h in zip(shares / shares.sum(), encoded))
    return 1 / (1 + np.exp(-(z @ w["out"] + w["out_bias"][0])))


def test_quality_scores_equal_slow_ones(spark, larger, odd_texts):
    model = quality.fit(*larger)
    docs = larger[0].where("doc_id < 60").unionByName(documents(spark, odd_texts))
    for r in quality.score(docs, model).collect():
        assert r.score == pytest.approx(slow_quality(r.text, model.weights), abs=1e-4)


def test_language_on_held_out_and_mixed(spark, larger):
    docs, _ = larger
    model = language.fit(docs)
    rows = language.held_out(language.identify(docs.select("doc_id", "text", "lang"), model)).collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (crc(r.doc_id, 3) == 1) and 0 <= r.score <= 1 for r in rows)
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.97
    texts = {r.lang: r.text for r in sorted(rows, key=lambda r: len(r.text or "")) if 2000 < len(r.text or "") < 4000}
    a, b = sorted(texts)[:2]
    mixed = language.identify(documents(spark, [texts[a] + " " + texts[b]]), model).first()
    assert {a, b} <= set(mixed.languages) and abs(sum(mixed.proportions) - 1) < 1e-9


def test_language_odd_texts(spark, larger, odd_texts):
    model = language.fit(larger[0])
    docs = documents(spark, [*odd_texts, (20, "123 456 !!")]).withColumn("score", F.lit(5))
    for r in language.identify(docs, model).collect():
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not letters) and (letters or (r.score == 0 and r.languages == []))
    nothing = language.fit(documents(spark, []))
    assert {r.lang_pred for r in language.identify(docs, nothing).collect()} == {"und"}
    assert language.identify(documents(spark, []), model).count() == 0


def slow_mixture(words):
    """Expectation-maximisation over one text's words, a word and a language at a time; ``words`` holds log likelihoods."""
    many = len(words[0])
    tops = [max(w) for w in words]
    like = [[np.exp(v - top) for v in w] for w, top in zip(words, tops)]
    mix, best, best_value = [1 / many] * many, None, -np.inf
    for size in range(many, 0, -1):
        if size < many:
            left = sorted(range(many), key=lambda j: (-mix[j], j))[:size]
            total = sum(mix[j] for j in left)
            mix = [mix[j] / total if j in left else 0.0 for j in range(many)]
        for _ in range(language.ROUNDS if size > 1 else 0):
            sums = [0.0] * many
            for own in like:
                whole = sum(p * m for p, m in zip(own, mix))
                sums = [s + p * m / whole for s, p, m in zip(sums, own, mix)]
            mix = [s / len(words) for s in sums]
        value = sum(tops) + sum(np.log(sum(p * m for p, m in zip(own, mix))) for own in like) - 0.5 * size * np.log(len(words) + 1)
        if value > best_value:
            best, best_value = mix, value
    return best


def test_language_equals_slow_mixtures(spark, larger):
    model = language.fit(larger[0])
    plain = [r.text for r in larger[0].where("doc_id < 25").collect()]
    texts = [*plain, plain[0] + " " + plain[1], "a", "  leading blanks here", " \t ", "", None, "trailing blanks   ", "   x", "Ünïcode ß 漢字"]
    found = {r.doc_id: r for r in language.identify(documents(spark, texts).repartition(1), model).collect()}
    gap = set(b" \t\n\x0b\x0c\r")
    for i, text in enumerate(texts):
        low = slow_lower(text)
        starts = [k for k in range(len(low)) if low[k] not in gap and (k == 0 or low[k - 1] in gap)]
        words = []
        for k, end in zip(starts, [*starts[1:], len(low)]):
            grams = [slow_bucket(low[j : j + 3]) >> 32 - language.BITS for j in range(k, end) if j + 3 <= len(low)]
            words.append(language.TEMPER * (model.log_share[grams].sum(0, dtype=float) if grams else np.zeros(len(model.languages))))
        if not any(c.isalpha() for c in text or ""):
            assert found[i].lang_pred == "und"
            continue
        best = slow_mixture(words)
        assert dict(zip(found[i].languages, found[i].proportions)) == pytest.approx({k: p for k, p in zip(model.languages, best) if p > 1e-6}, abs=1e-3), text
        assert found[i].score == pytest.approx(max(best), abs=1e-3) and best[model.languages.index(found[i].lang_pred)] == pytest.approx(max(best), abs=1e-3)
