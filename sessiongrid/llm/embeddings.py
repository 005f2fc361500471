"""Near-duplicate embeddings by Euclidean p-stable hashing, with an exact cosine check.

Normalised vectors are hashed in TABLES tables by PROJECTIONS quantised random projections of width WIDTH
(Gaussian, hence 2-stable). Only vectors with equal labels meet; they are told apart by a 64-bit hash of label and components. At cosine 0.93 a pair meets in some table
with a probability above 0.995, at 0.98 above 0.9999; every pair that meets is checked by exact cosine, so
no link lies below the limit.

Groups of near copies stay linear. Equal vectors are collapsed first. Then, in LEADER_ROUNDS tables, vectors
within half of the limit's angle of their bucket's leader join its clique: by the triangle inequality of angles
the members are linked with each other, so they are counted and not paired. Cliques that meet in a bucket are compared
by leaders and radii: all members linked, none, or, in between, member by member.

Defined results: a vector that is null, empty, zero, holds a null or non-finite component or has a null label
has no links and is its own component; vectors of different lengths are never linked; repeated ids count as
one vector each, and share a component if equal; doubles of extreme size are divided by their largest before they are squared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessiongrid.llm.components import components
from sessiongrid.session import settle

LIMIT = 0.93
TABLES = 48
PROJECTIONS = 10
WIDTH = 1.5
LEADER_ROUNDS = 3
SEED = 11


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def _bucket_keys(tables: int, projections: int, width: float, seed: int):
    """Bucket keys of each vector: a hash of the quantised projections, per table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixers = np.random.default_rng(seed).integers(1, 1 << 62, projections, np.int64) | 1
        planes: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            column = batch.column("vector")
            sizes = column.value_lengths().to_numpy(zero_copy_only=False)
            keys = np.zeros((len(batch), tables), np.int64)
            for size in np.unique(sizes).tolist():
                if size not in planes:
                    random = np.random.default_rng((seed, size))
                    planes[size] = random.normal(size=(size, tables * projections)), random.uniform(0, width, tables * projections)
                rows = np.flatnonzero(sizes == size)
                x = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                plane, shift = planes[size]
                cell = np.floor((x @ plane + shift) / width).astype(np.int64).reshape(-1, tables, projections)
                keys[rows] = (cell * mixers).sum(2)
            flat = pa.array(keys.ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1, dtype=np.int32) * tables), flat)
            kept = [batch.column(c) for c in ("rid", "label", "vector", "copies")]
            yield pa.RecordBatch.from_arrays([*kept, lists], names=["rid", "label", "vector", "copies", "keys"])

    return run


def cliques(vectors: DataFrame, limit: float, rounds: int) -> DataFrame:
    """``vectors`` with ``leader`` (a row id, its own for a leader or a vector alone) and ``angle`` to it."""
    half = float(np.cos(np.arccos(limit) / 2))
    state = vectors.select("rid", "label", "vector", "copies", "keys", F.col("rid").alias("leader"), F.lit(0.0).alias("angle"), F.lit(False).alias("fixed"))
    for table in range(rounds):
        bucket = [F.col("label"), F.size("vector").alias("size"), F.get("keys", F.lit(table)).alias("key")]
        heads = state.where(F.col("leader") == F.col("rid")).groupBy(*bucket).agg(F.min(F.struct(~F.col("fixed"), F.col("rid"), F.col("vector"))).alias("head"))
        near = state.select("*", *bucket[1:]).join(heads, ["label", "size", "key"], "left").withColumn(
            "near", F.when(~F.col("fixed") & (F.col("head.rid") != F.col("rid")), cosine(F.col("vector"), F.col("head.vector")))
        )
        joins = F.coalesce(F.col("near") >= half, F.lit(False))
        moved = settle(near.select(
            "rid", "label", "vector", "copies", "keys", F.when(joins, F.col("head.rid")).otherwise(F.col("leader")).alias("leader"),
            F.when(joins, F.acos(F.least(F.col("near"), F.lit(1.0)))).otherwise(F.col("angle")).alias("angle"), (F.col("fixed") | joins).alias("fixed"),
        ))
        leading = moved.where(F.col("leader") != F.col("rid")).select(F.col("leader").alias("rid"), F.lit(True).alias("leads")).distinct()
        state = moved.join(leading, "rid", "left").withColumn("fixed", F.col("fixed") | F.coalesce("leads", F.lit(False))).drop("leads")
    return settle(state.drop("fixed"))


def near_duplicates(vectors: DataFrame, limit: float = LIMIT, tables: int = TABLES, projections: int = PROJECTIONS, width: float = WIDTH, rounds: int = LEADER_ROUNDS, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept): a row per vector."""
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("vector"), F.col(label).alias("label")).withColumn("rid", F.xxhash64("label", "vector"))
    usable = F.coalesce(
        F.col("label").isNotNull() & (F.size("vector") > 0) & F.col("vec_id").isNotNull()
        & F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("vector", lambda v: v != 0), F.lit(False))
    distinct = rows.where(usable).groupBy("rid").agg(F.any_value("label").alias("label"), F.any_value("vector").alias("vector"), F.count(F.lit(1)).alias("copies"))
    if dict(distinct.dtypes)["vector"] == "array<double>":  # squares of other types neither vanish nor overflow
        most = F.array_max(F.transform("vector", F.abs))
        distinct = distinct.withColumn("vector", F.when(most.between(1e-100, 1e100), F.col("vector")).otherwise(F.transform("vector", lambda v: v / most)))
    kinds = dict(distinct.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("rid", "label", "vector", "copies")) + ", keys array<bigint>"
    keyed = settle(distinct.mapInArrow(_bucket_keys(tables, projections, width, SEED), schema))
    state = cliques(keyed, limit, rounds)
    groups = settle(state.groupBy("leader").agg(F.sum("copies").alias("size"), F.max("angle").alias("radius"), F.count(F.lit(1)).alias("members")))
    buckets = state.select("label", F.size("vector").alias("dims"), "leader", F.posexplode("keys").alias("table", "key")).distinct()
    meet = buckets.alias("x").join(buckets.alias("y"), (F.col("x.label") == F.col("y.label")) & (F.col("x.dims") == F.col("y.dims")) & (F.col("x.table") == F.col("y.table")) & (F.col("x.key") == F.col("y.key")) & (F.col("x.leader") < F.col("y.leader")))
    meet = meet.select(F.col("x.leader").alias("a"), F.col("y.leader").alias("b")).distinct()
    heads = state.where(F.col("leader") == F.col("rid")).join(groups, "leader").select("leader", "vector", "size", "radius", "members")
    a, b = (heads.select(*[F.col(c).alias(f"{side}_{c}") for c in heads.columns]) for side in "ab")
    alpha = float(np.arccos(limit))
    pairs = meet.join(a, F.col("a") == F.col("a_leader")).join(b, F.col("b") == F.col("b_leader")).withColumn("near", cosine(F.col("a_vector"), F.col("b_vector")))
    apart = F.acos(F.greatest(F.least(F.col("near"), F.lit(1.0)), F.lit(-1.0)))
    spread = F.col("a_radius") + F.col("b_radius")
    single = (F.col("a_members") == 1) & (F.col("b_members") == 1)
    slack = 1e-9
    whole = F.when(single, F.col("near") >= limit).otherwise(apart + spread <= alpha - slack)
    split = ~single & ~whole & (apart - spread <= alpha + slack)
    pairs = settle(pairs.where(whole | split).select("a", "b", "a_size", "b_size", whole.alias("whole")))
    full = pairs.where("whole")
    doubtful = pairs.where("not whole").select("a", "b")
    members = state.select("rid", "leader", "vector", "copies")
    x, y = (members.select(*[F.col(c).alias(f"{side}_{c}") for c in members.columns]) for side in "xy")
    checked = settle(
        doubtful.join(x, F.col("a") == F.col("x_leader")).join(y, F.col("b") == F.col("y_leader"))
        .where(cosine(F.col("x_vector"), F.col("y_vector")) >= limit).select("a", "b", "x_rid", "y_rid", "x_copies", "y_copies")
    )
    between = full.select(F.col("a").alias("leader"), F.col("b_size").alias("n")).union(full.select(F.col("b").alias("leader"), F.col("a_size").alias("n"))).groupBy("leader").agg(F.sum("n").alias("n_full"))
    single_links = checked.select(F.col("x_rid").alias("rid"), F.col("y_copies").alias("n")).union(checked.select(F.col("y_rid").alias("rid"), F.col("x_copies").alias("n"))).groupBy("rid").agg(F.sum("n").alias("n_checked"))
    roots = components(full.select("a", "b").union(checked.select("a", "b")), "a", "b")
    found = (
        state.select("rid", "leader").join(groups.select("leader", "size"), "leader").join(between, "leader", "left").join(single_links, "rid", "left")
        .join(roots, F.col("leader") == F.col("node"), "left")
        .select("rid", F.coalesce("root", "leader").alias("root"), (F.col("size") - 1 + F.coalesce("n_full", F.lit(0)) + F.coalesce("n_checked", F.lit(0))).alias("n_links"))
    )
    linked = settle(rows.where(usable).select("vec_id", "rid").join(found, "rid").select("vec_id", "root", "n_links"))
    named = linked.join(linked.groupBy("root").agg(F.min("vec_id").alias("component_id")), "root").select("vec_id", "n_links", "component_id")
    alone = rows.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return named.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
