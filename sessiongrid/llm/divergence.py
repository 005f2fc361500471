"""How far the sources of a language diverge in their terms.

Documents with one text in a language are collapsed first: the text is kept once, beside it the number of its documents
in each source. Each text left is cut into terms once, and its counts and its document frequency go to each of its
sources, weighted by that number, so copies cost no work. A language keeps the terms of at least ``least`` of its documents. With
smoothed shares p in units of 10^-9, the distance of two sources is the sum of abs(p - q) over all kept terms, also
those that neither has. It is worked out on the counts above zero alone: with z the share of an absent term,

    sum abs(p - q) = V abs(z - z') + D(p, z') + D(q, z) + sum over shared terms of [abs(p - q) - abs(p - z') - abs(z - q) + abs(z - z')],

D(p, z') being the sum of abs(p - z') - abs(z - z') over the terms of p. D needs how often each count occurs in a source; the
last sum is taken block by block of sources over buckets of terms, and only its totals are shuffled.

Distribution: texts move once, told apart by 128 bits of hashes (with n texts a collision has a probability of about n^2 / 2^129);
terms are summed in each task before they move. No group of copies or documents of a source is collected; a bucket holds
shares of at most BLOCK sources a side. Lists of sources and languages and the pairs of sources are as many as the result has rows.

Defined results: null text, lang and source are empty text; groups without terms take part; a language without kept terms has distance 0
for all its pairs; ties go to the smaller item in UTF-8 order; repeated rows count each; other columns of the
documents are not looked at. An empty table has no rows.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sessiongrid.session import settle

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
LEAST = 30
TOP = 50
SCALE = 1_000_000_000
#: counts of a task are given out when so many are held
HELD = 500_000
#: sources a side of a block of pairs, and kept terms a bucket
BLOCK = 64
BUCKET_TERMS = 16_384


def text_key(text: Column) -> list[Column]:
    """Two 64-bit hashes of a text."""
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("second"), text).alias("h2")]


def collapsed(docs: DataFrame) -> DataFrame:
    """(lang, text, copies): each text of a language once, with an array of (source, n)."""
    own = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    keyed = own.select("lang", "source", "text", *text_key(F.col("text")))
    copies = keyed.groupBy("lang", "h1", "h2", "source").agg(F.count(F.lit(1)).alias("n"))
    copies = copies.groupBy("lang", "h1", "h2").agg(F.collect_list(F.struct("source", "n")).alias("copies"))
    texts = keyed.groupBy("lang", "h1", "h2").agg(F.first("text").alias("text"))
    return texts.join(copies, ["lang", "h1", "h2"]).select("lang", "text", "copies")


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, count, df): occurrences and documents of each term in each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(TERM.encode()).findall
        counts: dict[tuple, Counter] = defaultdict(Counter)
        dfs: dict[tuple, Counter] = defaultdict(Counter)

        def emptied() -> Iterator[pa.RecordBatch]:
            for (lang, source), own in counts.items():
                rows = dfs[lang, source]
                terms = [t.decode("utf-8", "replace") for t in own]
                columns = [pa.array([lang] * len(own), pa.string()), pa.array([source] * len(own), pa.string()), pa.array(terms, pa.string()), pa.array(list(own.values()), pa.int64()), pa.array([rows[t] for t in own], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "count", "df"])
            counts.clear()
            dfs.clear()

        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary())
            for lang, text, copies in zip(batch.column("lang").to_pylist(), texts, batch.column("copies").to_pylist()):
                # an upper-case letter is an ASCII one here, as in bytes.lower
                terms = find(text.as_buffer().to_pybytes().lower())
                if len(copies) == 1 and copies[0]["n"] == 1:
                    group = lang, copies[0]["source"]
                    counts[group].update(terms)
                    dfs[group].update(set(terms))
                else:
                    own = Counter(terms)
                    for copy in copies:
                        group, n = (lang, copy["source"]), copy["n"]
                        to, seen = counts[group], dfs[group]
                        for term, count in own.items():
                            to[term] += n * count
                            seen[term] += n
                if sum(map(len, counts.values())) > HELD:
                    yield from emptied()
        yield from emptied()

    found = collapsed(docs).mapInArrow(run, "lang string, source string, term string, count long, df long")
    return found.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("df").alias("df"))


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE (count + 5) / (total + 5 terms)), in exact decimals; null without terms."""
    top = F.lit(SCALE).cast("decimal(10,0)") * (count.cast("decimal(19,0)") + F.lit(5).cast("decimal(1,0)"))
    bottom = total.cast("decimal(19,0)") + F.lit(5).cast("decimal(1,0)") * terms.cast("decimal(18,0)")
    return F.when(terms > 0, F.call_function("div", top.cast("decimal(30,0)"), F.when(terms > 0, bottom)) + 1)


def kept_terms(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, source, term, count, all, head): counts above zero of the terms in ``least`` documents of the language.

    ``all`` is the count in the language, ``head`` true in one row of each of its terms.
    """
    of_term = W.partitionBy("lang", "term")
    counts = term_counts(docs)
    counts = counts.select("lang", "source", "term", "count", F.sum("df").over(of_term).alias("df"), F.sum("count").over(of_term).alias("all"), (F.row_number().over(of_term.orderBy("source")) == 1).alias("head"))
    return counts.where(F.col("df") >= least).drop("df")


def groups_of(docs: DataFrame, kept: DataFrame, block: int = BLOCK, bucket_terms: int = BUCKET_TERMS) -> DataFrame:
    """One row for each (lang, source) of the documents, with its number in the language and what shares need."""
    seen = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    own = kept.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    whole = kept.where("head").groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("all").alias("lang_total"))
    joined = seen.join(own, ["lang", "source"], "left").join(whole, "lang", "left").fillna(0, ["total", "terms", "lang_total"])
    in_lang = W.partitionBy("lang")
    return joined.select(
        "lang", "source", "total", "terms", "lang_total", (F.row_number().over(in_lang.orderBy("source")) - 1).alias("place"),
        share(F.lit(0), F.col("total"), F.col("terms")).alias("zero"),
        F.ceil(F.count(F.lit(1)).over(in_lang) / F.lit(block)).cast("int").alias("blocks"),
        F.greatest(F.lit(1), F.ceil(F.col("terms") / F.lit(bucket_terms))).cast("int").alias("buckets"),
    )


def block_distances(left: np.ndarray, right: np.ndarray, zero: dict[int, int], place: np.ndarray, term: np.ndarray, p: np.ndarray) -> np.ndarray:
    """For the sources ``left`` and ``right`` the sum over terms in either of abs(p - q) - abs(z - z'), q or p being z where absent."""
    zl, zr = (np.array([zero[s] for s in side.tolist()], np.int64) for side in (left, right))
    gap = np.abs(zl[:, None] - zr[None, :])
    n_terms = int(term.max()) + 1 if len(term) else 0
    dense, here = np.zeros((n_terms, len(right)), np.int64), np.zeros((n_terms, len(right)), bool)
    at = np.searchsorted(right, place)
    own = (at < len(right)) & (right[np.minimum(at, len(right) - 1)] == place)
    dense[term[own], at[own]] = p[own]
    here[term[own], at[own]] = True
    out = np.zeros(gap.shape, np.int64)
    for j in range(len(right)):  # terms of the right against an absent left
        q = dense[here[:, j], j]
        out[:, j] += np.abs(q[None, :] - zl[:, None]).sum(1) - len(q) * gap[:, j]
    for i, source in enumerate(left.tolist()):
        mine = place == source
        t, mp = term[mine], p[mine][:, None]
        q, both = dense[t], here[t]
        absent = np.abs(mp - zr[None, :])
        shared = np.abs(mp - q) - absent - np.abs(zl[i] - q) + gap[i][None, :]
        out[i] += (absent - gap[i][None, :]).sum(0) + np.where(both, shared, 0).sum(0)
    return out


def pair_distances(kept: DataFrame, groups: DataFrame, block: int = BLOCK) -> DataFrame:
    """(lang, source, item, value) for every two different sources of a language."""
    rows = kept.join(groups, ["lang", "source"]).select(
        "lang", "place", "blocks", "term", share(F.col("count"), F.col("total"), F.col("terms")).alias("p"),
        F.pmod(F.xxhash64("term"), F.col("buckets")).cast("int").alias("bucket"),
    )
    # each block of sources is told the sources without terms as well
    named = groups.select("lang", "place", "blocks", F.lit(None).cast("string").alias("term"), F.coalesce("zero", F.lit(0)).alias("p"), F.explode(F.sequence(F.lit(0), F.col("buckets") - 1)).alias("bucket"))
    own = F.floor(F.col("place") / block).cast("int")
    spread = rows.unionByName(named).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.select("lang", F.least(own, "other").alias("low"), F.greatest(own, "other").alias("high"), "bucket", "place", "term", "p")

    def run(key: tuple, table: pa.Table) -> pa.Table:
        lang, low, high, _ = (k.as_py() for k in key)
        place, p = (table.column(c).to_numpy().astype(np.int64) for c in ("place", "p"))
        term = table.column("term").combine_chunks()
        head = np.asarray(term.is_null())
        zero = dict(zip(place[head].tolist(), p[head].tolist()))
        left, right = (np.array(sorted(s for s in zero if s // block == b), np.int64) for b in (low, high))
        number = np.asarray(term.filter(pa.array(~head)).dictionary_encode().indices).astype(np.int64)
        found = block_distances(left, right, zero, place[~head], number, p[~head])
        i, j = np.nonzero(left[:, None] < right[None, :])
        columns = [pa.array([lang] * len(i), pa.string()), pa.array(left[i]), pa.array(right[j]), pa.array(found[i, j])]
        return pa.Table.from_arrays(columns, names=["lang", "a", "b", "extra"])

    parts = spread.groupBy("lang", "low", "high", "bucket").applyInArrow(run, "lang string, a long, b long, extra long")
    total = parts.groupBy("lang", "a", "b").agg(F.sum("extra").alias("extra"))
    names = groups.select("lang", "place", "source", "zero", "terms")
    first = names.select("lang", F.col("place").alias("a"), F.col("source").alias("one"), F.col("zero").alias("z1"), "terms")
    second = names.select("lang", F.col("place").alias("b"), F.col("source").alias("two"), F.col("zero").alias("z2"))
    value = F.coalesce(F.col("terms") * F.abs(F.col("z1") - F.col("z2")), F.lit(0)) + F.col("extra")
    pairs = total.join(first, ["lang", "a"]).join(second, ["lang", "b"]).select("lang", "one", "two", value.alias("value"))
    both = F.array(F.struct(F.col("one").alias("source"), F.col("two").alias("item")), F.struct(F.col("two").alias("source"), F.col("one").alias("item")))
    return pairs.select("lang", F.explode(both).alias("s"), "value").select("lang", "s.source", "s.item", "value")


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP, block: int = BLOCK, bucket_terms: int = BUCKET_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): distances to the other sources, and the terms a source is richest in.

    Part ``pair`` has each other source of the language with the distance, part ``term`` the ``top`` terms whose share in the
    source exceeds that in the language, with the difference; ranks go down the values.
    """
    kept = settle(kept_terms(docs, least))
    groups = settle(groups_of(docs, kept, block, bucket_terms))
    rich = kept.join(groups, ["lang", "source"]).select(
        "lang", "source", F.col("term").alias("item"),
        (share(F.col("count"), F.col("total"), F.col("terms")) - share(F.col("all"), F.col("lang_total"), F.col("terms"))).alias("value"),
    ).where(F.col("value") > 0)
    order = W.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    parts = [rich.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).withColumn("part", F.lit("term"))]
    parts.append(pair_distances(kept, groups, block).withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit("pair")))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return parts[0].select(columns).union(parts[1].select(columns))


def audit_sql(least: int = LEAST, top: int = TOP) -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

    def p(count: str, total: str) -> str:
        return f"(1 + ({SCALE}::HUGEINT * ({count} + 5)) // ({total} + 5 * v.terms))"

    return f"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS (SELECT row, lang, source, translate(unnest(regexp_extract_all(text, '{TERM}')), '{upper}', '{upper.lower()}') AS term FROM d),
k AS (SELECT lang, term, count(*) AS whole FROM t GROUP BY lang, term HAVING count(DISTINCT row) >= {least}),
v AS (SELECT lang, count(*) AS terms, sum(whole) AS whole FROM k GROUP BY lang),
c AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN k ON k.lang = t.lang AND k.term = t.term GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
s AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS total FROM g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY ALL),
p AS (SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, {p("coalesce(c.n, 0)", "s.total")} AS p, {p("k.whole", "v.whole")} AS q
      FROM s JOIN k ON k.lang = s.lang JOIN v ON v.lang = s.lang LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
      FROM p a JOIN p b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
      FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
      UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q),
o AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM r)
SELECT lang, source, part, item, value, rank FROM o WHERE part = 'pair' OR rank <= {top}"""
