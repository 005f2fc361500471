"""Sharding by extendible hashing: a directory of hash prefixes in which only oversized buckets split.

A document's hash is 60 bits of the md5 of its id and text. A bucket is a prefix of the hash; it splits on the
next bit while its bytes exceed the limit, so shards differ in depth. The directory is built from byte sums of
prefixes some bits deeper than the shards can be on average; buckets still too large there are refined by
further rounds over their own rows. Rows stay where they are: only (hash, bytes) sums are shuffled.

Equal rows (same id and text) share all bits. Where they alone exceed the limit, their shard overflows into
numbered parts that each fit; the numbering runs within input partitions and adds up their counts, so no such
group meets in one task.

Defined results: a null text has 0 bytes; a document larger than the limit is a shard of its own, the only kind above
the limit; an empty table has no shards; columns named as an output are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessiongrid.session import settle

LIMIT = 1 << 20
BITS = 60
#: bits that the first round looks ahead of the average depth, and each later round goes on
AHEAD = 4


def _prefix(depth: int):
    return F.shiftright(F.col("hash"), BITS - depth) if depth < BITS else F.col("hash")


def _directory(hashed: DataFrame, start: int, depth: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """Shards between the depths, by prefix of length ``depth``; and prefixes that are still too large."""
    sums = settle(hashed.groupBy(_prefix(depth).alias("prefix")).agg(F.sum("n_bytes").alias("b"), F.min("hash").alias("low"), F.max("hash").alias("high")))
    levels = sums.select("*", F.explode(F.sequence(F.lit(start), F.lit(depth))).alias("depth")).withColumn("bits", F.expr(f"shiftright(prefix, {depth} - depth)"))
    buckets = settle(levels.groupBy("depth", "bits").agg(F.sum("b").alias("shard_bytes"), F.min("low").alias("low"), F.max("high").alias("high")))
    fits = buckets.where((F.col("shard_bytes") <= limit) | (F.col("low") == F.col("high"))).withColumn("one", F.col("low") == F.col("high")).select("depth", "bits", "shard_bytes", "one")
    above = fits.select((F.col("depth") + 1).alias("depth"), F.col("bits").alias("parent"))
    shards = fits.withColumn("parent", F.shiftright("bits", 1)).join(above, ["depth", "parent"], "left_anti").drop("parent")
    found = levels.select("prefix", "depth", "bits").join(shards, ["depth", "bits"])
    return settle(found), buckets.where((F.col("depth") == depth) & (F.col("shard_bytes") > limit) & (F.col("low") < F.col("high"))).select(F.col("bits").alias("prefix"))


def assign(docs: DataFrame, limit: int = LIMIT, doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with ``shard`` (its bits, and ``-part`` beyond the first), ``depth``, ``n_bytes`` and ``shard_bytes``."""
    outputs = ("shard", "depth", "n_bytes", "shard_bytes")
    # the document is one value on the way, so its columns may have any names
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in outputs]).alias("__doc")
    kept = ["__doc"]
    own = F.md5(F.concat_ws("|", F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))))
    hashed = docs.select(whole, F.conv(F.substring(own, 1, 15), 16, 10).cast("long").alias("hash"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    sizes = settle(hashed.groupBy("hash").agg(F.sum("n_bytes").alias("n_bytes"), F.count(F.lit(1)).alias("n")))
    total = sizes.agg(F.sum("n_bytes")).first()[0] or 0
    start, depth = 0, min(BITS, max(0, math.ceil(math.log2(max(1, total / limit)))) + AHEAD)
    placed, rest = hashed.select(*kept, "hash", "n_bytes"), sizes
    names = ["depth", "bits", "shard_bytes", "one"]
    first = True
    while True:
        found, large = _directory(rest, start, depth, limit)
        mapping = found.select(F.col("prefix").alias("__prefix"), *[F.col(c).alias(f"__{c}") for c in names])
        joined = placed.join(mapping, _prefix(depth) == F.col("__prefix"), "left")
        columns = [F.col(f"__{c}").alias(c) if first else F.coalesce(c, f"__{c}").alias(c) for c in names]
        placed, first = joined.select(*kept, "hash", "n_bytes", *columns), False
        large = settle(large)
        if depth == BITS or large.isEmpty():
            break
        rest = settle(rest.withColumn("prefix", _prefix(depth)).join(large, "prefix", "left_semi").drop("prefix"))
        start, depth = depth + 1, min(BITS, depth + AHEAD)
    name = F.when(F.col("depth") == 0, F.lit("")).otherwise(F.lpad(F.conv("bits", 10, 2), F.col("depth"), F.lit("0")))
    over = F.col("one") & (F.col("shard_bytes") > limit) & (F.col("shard_bytes") > F.col("n_bytes"))
    plain = placed.withColumn("shard", name)
    if sizes.where((F.col("n_bytes") > limit) & (F.col("n") > 1)).isEmpty():
        return plain.select("__doc.*", *outputs)
    # equal rows beyond the limit: numbered within partitions, offset by the counts of the partitions before
    crowd = settle(plain.where(over).withColumn("__at", F.spark_partition_id()))
    counts = crowd.groupBy("hash", "__at").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.select("hash", "__at", (F.sum("__n").over(Window.partitionBy("hash").orderBy("__at")) - F.col("__n")).alias("__before"), F.sum("__n").over(Window.partitionBy("hash")).alias("__all"))
    number = F.row_number().over(Window.partitionBy("hash", "__at").orderBy("n_bytes")) - 1
    each = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.col("n_bytes"))).cast("long")
    numbered = crowd.withColumn("__number", number).join(before, ["hash", "__at"]).withColumn("__row", F.col("__number") + F.col("__before")).withColumn("__part", F.floor(F.col("__row") / each))
    parts = numbered.withColumn("shard", F.when(F.col("__part") > 0, F.concat("shard", F.lit("-"), F.col("__part").cast("string"))).otherwise(F.col("shard")))
    parts = parts.withColumn("shard_bytes", (F.least(each, F.col("__all") - F.col("__part") * each) * F.col("n_bytes")).cast("long"))
    return plain.where(~over).select("__doc.*", *outputs).union(parts.select("__doc.*", *outputs))


def write(docs: DataFrame, path: str, limit: int = LIMIT, doc_id: str = "doc_id") -> DataFrame:
    """Write every shard as one Parquet file in the folder ``shard=s<its bits>`` of ``path``; returns (shard, documents, n_bytes) as read back.

    A shard goes to one task, which its limit bounds; a task takes neighbouring shards by ranges of their names. ``path`` is
    a folder that all executors reach. The column ``shard`` of the files' rows is the folder's.
    """
    named = assign(docs, limit, doc_id).withColumn("shard", F.concat(F.lit("s"), F.col("shard")))
    named.repartitionByRange("shard").sortWithinPartitions("shard").write.partitionBy("shard").parquet(path)
    written = docs.sparkSession.read.option("basePath", path).schema(named.schema).parquet(path)
    return written.groupBy("shard").agg(F.count(F.lit(1)).alias("documents"), F.sum("n_bytes").alias("n_bytes"))


def assign_sql(documents: str = "documents", limit: int = LIMIT) -> str:
    """DuckDB SQL of ``assign``: every depth of every hash, and the first that fits."""
    return f"""
WITH hashed AS (SELECT doc_id, CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')), 1, 15)) AS BIGINT) AS hash,
                       CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes FROM {documents}),
levels AS (SELECT d, hash >> ({BITS} - d) AS bits, CAST(sum(n_bytes) AS BIGINT) AS b, min(hash) = max(hash) AS one FROM hashed, range(0, {BITS + 1}) AS r(d) GROUP BY ALL),
fits AS (SELECT * FROM levels WHERE b <= {limit} OR one),
shards AS (SELECT * FROM fits f WHERE NOT EXISTS (SELECT 1 FROM fits p WHERE p.d = f.d - 1 AND p.bits = f.bits >> 1)),
placed AS (SELECT doc_id, n_bytes, hash, CAST(d AS INTEGER) AS depth, b, CASE WHEN d = 0 THEN '' ELSE lpad(bin(bits), CAST(d AS INTEGER), '0') END AS shard,
                  one AND b > {limit} AND b > n_bytes AS over, greatest(1, {limit} // greatest(n_bytes, 1)) AS each
           FROM hashed JOIN shards ON shards.bits = hash >> ({BITS} - d)),
numbered AS (SELECT *, CASE WHEN over THEN (row_number() OVER (PARTITION BY hash) - 1) // each ELSE 0 END AS part, count(*) OVER (PARTITION BY hash) AS n FROM placed)
SELECT doc_id, CASE WHEN part > 0 THEN shard || '-' || part ELSE shard END AS shard, depth, n_bytes,
       CAST(CASE WHEN over THEN least(each, n - part * each) * n_bytes ELSE b END AS BIGINT) AS shard_bytes FROM numbered"""
