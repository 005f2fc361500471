"""Divergence of sources against sums over all terms, row by row."""

import re
from collections import Counter

import pytest
from llm_fixtures import SF_DIR, documents

from pyspark.sql import functions as F

from sessiongrid.llm import divergence


def slow_audit(rows, least, top):
    """rows: (text, lang, source)."""
    rows = [tuple("" if v is None else v for v in r) for r in rows]
    lower = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    terms = [[t.translate(lower) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)] for text, _, _ in rows]
    out = set()
    for lang in {r[1] for r in rows}:
        own = [(r[2], t) for r, t in zip(rows, terms) if r[1] == lang]
        df = Counter(t for _, ts in own for t in set(ts))
        kept = [t for t, n in df.items() if n >= least]
        counts = {s: Counter() for s, _ in own}
        for s, ts in own:
            counts[s].update(t for t in ts if df[t] >= least)
        whole = sum(counts.values(), Counter())

        def shares(count):
            total = count.total() + 5 * len(kept)
            return [1 + 10**9 * (count[t] + 5) // total for t in kept]

        of, all_of = {s: shares(count) for s, count in counts.items()}, shares(whole)
        for s in counts:
            pairs = [(-sum(abs(p - q) for p, q in zip(of[s], of[o])), o.encode(), o) for o in counts if o != s]
            rich = [(q - p, t.encode(), t) for t, p, q in zip(kept, of[s], all_of) if counts[s][t] and p > q]
            out |= {(lang, s, "pair", o, -v, i + 1) for i, (v, _, o) in enumerate(sorted(pairs))}
            out |= {(lang, s, "term", t, -v, i + 1) for i, (v, _, t) in enumerate(sorted(rich)[:top])}
    return out


def made(docs, **options):
    found = [tuple(r) for r in divergence.audit(docs, **options).collect()]
    assert len(found) == len(set(found))
    return set(found)


@pytest.fixture(scope="module")
def rows(spark):
    own = [(r.text, r.lang, r.source) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("text", "lang", "source").collect()]
    odd = [None, "", " \n\t ", "a", "word " * 30_000, "x" * 50_000, "Same text here", "same TEXT here", "Ünïcode ß 漢字 🙂", "a1b2_c3", "no\x00nul\x7f"]
    own += [(t, lang, source) for i, t in enumerate(odd) for lang, source in (("en", "src1"), (None, None), ("xx", f"s{i % 3}"), ("xx", "s0"))]
    own += [("copy of a copy", "xx", s) for s in ("s1", "s1", "s2", "only")] + [("nothing kept 1", "lonely", "a"), ("", "lonely", "b"), ("Ä ä É é", "ties", "a"), ("Ä ä É é", "ties", "b")]
    return own


@pytest.mark.parametrize("options", [{"least": 2, "top": 5}, {"least": 2, "top": 5, "block": 3, "bucket_terms": 20}, {"least": 30, "top": 50}])
def test_equals_all_terms(spark, rows, options):
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    for name in ("term", "n", "zero", "h1", "count", "place", "total"):  # names that the operator uses itself
        docs = docs.withColumn(name, F.lit("extra"))
    assert made(docs, **options) == slow_audit(rows, options["least"], options["top"])


def test_copies_count_like_rows(spark):
    """Batches given out early, and a text with copies in several sources."""
    rows = [(f"alpha beta w{i} " * 3, "en", f"s{i % 4}") for i in range(40)] * 3 + [("alpha alpha gamma", "en", f"s{i % 5}") for i in range(200)]
    held = divergence.HELD
    try:
        divergence.HELD = 10
        assert made(spark.createDataFrame(rows, "text string, lang string, source string"), least=3) == slow_audit(rows, 3, 50)
    finally:
        divergence.HELD = held


def test_empty_table(spark):
    assert made(documents(spark, [])) == set()
