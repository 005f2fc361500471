"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

A source's weight (the square root of its size, or a given number) sets its share of the mixture, and with the
mixture as large as the input in bytes, the mean number of times its documents are repeated: the rate. Each
document draws its count by inverting the Poisson distribution at a number hashed from a seed, its id and its
text, so counts are the same on any cluster. Copies are exploded and sent to partitions by a hash of their own,
then ordered by it within each partition: a global shuffle without sampling or a range.

A rate above MOST_RATE is drawn as a sum of several draws of an equal part of it, so tables of the distribution
stay short for every rate. Sizes are combined before they are shuffled; no source meets in one task.

Defined results: a null text is an empty one; a document counts one byte more than its text, so no source has
size zero; null is a source of its own; sources without a given weight get weight zero, and with no positive weight
nothing is left; equal rows draw equal counts; an empty table stays empty; columns named as an output are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEED = 20240607
MOST_RATE = 16.0
#: counts above this many times have a probability below 1e-17 at MOST_RATE
MOST_COUNT = 64


def unit(*parts: Column) -> Column:
    """A number in [0, 1) with 52 bits from the md5 of the parts."""
    text = F.concat_ws("|", *parts)
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / float(1 << 52)


def rates(docs: DataFrame, weights: dict[str, float] | None = None, source: str = "source") -> DataFrame:
    """(source, n_docs, n_bytes, weight, rate): the mean repetition of each source's documents."""
    sizes = docs.groupBy(F.col(source).alias("source")).agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("n_bytes")
    )
    if weights is None:
        weighed = sizes.withColumn("weight", F.sqrt(F.col("n_bytes").cast("double")))
    else:
        given = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "s string, weight double")
        weighed = sizes.join(given, F.col("source").eqNullSafe(F.col("s")), "left").drop("s").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    whole = weighed.agg(F.sum("weight").alias("all_weight"), F.sum("n_bytes").alias("all_bytes"))
    share = F.when(F.col("all_weight") > 0, F.col("weight") / F.col("all_weight")).otherwise(0.0)
    # the totals are one row
    return weighed.join(F.broadcast(whole)).select("source", "n_docs", "n_bytes", "weight", (share * F.col("all_bytes") / F.col("n_bytes")).alias("rate"))


def with_distribution(table: DataFrame) -> DataFrame:
    """Rates with ``draws`` and the array ``below``: the chance of at most 0, 1, 2 ... in one draw."""
    drawn = table.withColumn("draws", F.greatest(F.ceil(F.col("rate") / MOST_RATE), F.lit(1)).cast("int")).withColumn("part", F.col("rate") / F.col("draws"))
    step = F.struct(F.exp(-F.col("part")).alias("p"), F.array(F.exp(-F.col("part"))).alias("below"))
    kind = drawn.select(step.alias("s")).schema["s"].dataType
    kind = T.StructType([T.StructField("p", T.DoubleType()), T.StructField("below", T.ArrayType(T.DoubleType()))]) if kind is None else kind
    built = F.aggregate(
        F.sequence(F.lit(1), F.lit(MOST_COUNT)), step.cast(kind),
        lambda s, k: F.struct((s["p"] * F.col("part") / k).alias("p"), F.concat(s["below"], F.array(F.element_at(s["below"], -1) + s["p"] * F.col("part") / k)).alias("below")),
    )
    return drawn.select("source", "rate", "draws", built["below"].alias("below"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, seed: int = SEED, source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """The replicated documents with ``copy`` (from 0) and ``position`` (the number they are shuffled by)."""
    table = with_distribution(rates(docs, weights, source)).select(F.col("source").alias("__source"), "draws", "below")
    # the document is one value on the way, so its columns may have any names
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("copy", "position")]).alias("__doc")
    kept = ["__doc"]
    own = [F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))]
    packed = docs.select(whole, F.col(source).alias("__from"), F.md5(F.concat_ws("|", F.lit(str(seed)), *own)).alias("__own"))
    drawn = packed.join(table, F.col("__from").eqNullSafe(F.col("__source")))
    count = F.aggregate(
        F.sequence(F.lit(1), F.col("draws")), F.lit(0),
        lambda n, k: n + F.aggregate(F.transform("below", lambda b: (b < unit(F.col("__own"), k.cast("string"))).cast("int")), F.lit(0), lambda x, y: x + y),
    )
    copies = drawn.select(*kept, "__own", count.alias("__count")).where(F.col("__count") > 0)
    copies = copies.select(*kept, "__own", F.explode(F.sequence(F.lit(0), F.col("__count") - 1)).alias("copy"))
    placed = copies.select(*kept, "copy", unit(F.col("__own"), F.lit("copy"), F.col("copy").cast("string")).alias("position"))
    return placed.repartition("position").sortWithinPartitions("position").select("__doc.*", "copy", "position")


def mix_sql(documents: str = "documents") -> str:
    """DuckDB SQL of ``mix`` with the default weights."""
    u = "CAST(('0x' || substr(md5({0}), 1, 13)) AS BIGINT) / 4503599627370496.0"
    return f"""
WITH sizes AS (SELECT source, CAST(sum(coalesce(strlen(text), 0) + 1) AS BIGINT) AS n_bytes FROM {documents} GROUP BY source),
rated AS (SELECT source, sqrt(CAST(n_bytes AS DOUBLE)) / sum(sqrt(CAST(n_bytes AS DOUBLE))) OVER () * sum(n_bytes) OVER () / n_bytes AS rate FROM sizes),
parts AS (SELECT source, CAST(greatest(ceil(rate / {MOST_RATE}), 1) AS INTEGER) AS draws, rate / greatest(ceil(rate / {MOST_RATE}), 1) AS part FROM rated),
chance AS (SELECT source, draws, k, exp(k * ln(part) - part - lgamma(k + 1)) AS p FROM parts, range(0, {MOST_COUNT + 1}) AS r(k)),
summed AS (SELECT source, draws, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM chance),
tables AS (SELECT source, draws, list(c ORDER BY k) AS below FROM summed GROUP BY source, draws),
own AS (SELECT d.*, md5('{SEED}|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')) AS own_hash, draws, below
        FROM {documents} d JOIN tables t ON d.source IS NOT DISTINCT FROM t.source),
counted AS (SELECT *, (SELECT sum(len(list_filter(below, lambda b: b < {u.format("own_hash || '|' || k")}))) FROM range(1, draws + 1) AS r(k)) AS n FROM own),
copies AS (SELECT *, unnest(range(0, CAST(n AS BIGINT))) AS copy FROM counted)
SELECT doc_id, text, lang, source, n_chars, CAST(copy AS INTEGER) AS copy, {u.format("own_hash || '|copy|' || copy")} AS position FROM copies"""
