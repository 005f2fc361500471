"""Synthetic minority rows between a row and one of its nearest neighbours.

The neighbours are exact. A few hundred rows serve as pivots; every row belongs to the cell of its
nearest pivot. Pivots are rows themselves, so the (k+1)-th nearest pivot bounds how far a row's k
neighbours can be, and the triangle inequality then rules out most cells. A row visits the cells
left. Cells are packed into pieces of bounded size, a large one into several; a row goes once to each
piece with a cell it visits. The rows that go to a piece are cut as well, each pair of pieces is one group,
and a group returns only the k best per row. In many dimensions a row visits nearly all cells, so the pieces
are few and as large as a task holds: it is their number that multiplies what is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessiongrid.operators.ordered import column, hash_order
from sessiongrid.operators.sampling import class_sizes, hash_ranked

MAX_PIVOTS = 1024
#: rows of a piece: at least, and as many bytes of vectors at most
PIECE = 5_000
PIECE_BYTES = 32 << 20
#: pieces that a class is cut to while they are below PIECE_BYTES: of its rows, and of those that visit one
PIECES, VISITS = 2, 12


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    squares = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(squares, 0.0))


def _near_pivots(pivots: np.ndarray):
    """Cell and distance to its pivot."""

    @F.pandas_udf("cell int, reach double")
    def near(vectors: pd.Series) -> pd.DataFrame:
        away = _distances(np.stack(vectors.to_numpy()), pivots)
        cell = away.argmin(axis=1)
        return pd.DataFrame({"cell": cell.astype("int32"), "reach": away[np.arange(len(away)), cell]})

    return near


def _pieces_to_visit(pivots: np.ndarray, radius: np.ndarray, k: int, first: np.ndarray, parts: np.ndarray):
    """Pieces of the cells that may hold one of a row's k nearest neighbours."""

    @F.pandas_udf("array<int>")
    def visit(vectors: pd.Series) -> pd.Series:
        away = _distances(np.stack(vectors.to_numpy()), pivots)
        if len(pivots) > k:
            bound = np.partition(away, k, axis=1)[:, k]
        else:
            bound = np.full(len(away), np.inf)
        # a little slack for rounding: one cell more is only more work
        open_cells = (radius >= 0) & (away - bound[:, None] <= radius + 1e-6 * (1.0 + away))
        cells = map(np.flatnonzero, open_cells)
        return pd.Series([sorted({p for c in row for p in range(first[c], first[c] + parts[c])}) for row in cells])

    return visit


def _pack(sizes: np.ndarray, pivots: np.ndarray, piece: int) -> tuple[np.ndarray, np.ndarray]:
    """First piece and number of pieces of each cell: neighbouring cells share one up to ``piece`` rows, larger ones have several."""
    spread = pivots - pivots.mean(axis=0)
    along = spread @ spread[(spread * spread).sum(axis=1).argmax()]
    first, parts, at, held = np.zeros(len(sizes), dtype=int), np.ones(len(sizes), dtype=int), 0, 0
    for c in np.argsort(along, kind="stable"):
        if held and held + sizes[c] > piece:
            at, held = at + 1, 0
        first[c], held = at, held + sizes[c]
        if held > piece:
            parts[c] = math.ceil(sizes[c] / piece)
            at, held = at + int(parts[c]), 0
    return first, parts


def nearest_neighbours(rows: DataFrame, k: int, pivots: int | None = None, piece: int | None = None) -> DataFrame:
    """From ``_id, _v`` (unique text, vector) to ``_id, near``: the k nearest vectors, nearest first.

    Ties go to the smaller id. Only the pivots and two numbers per pivot and piece reach the driver. A piece has ``piece`` rows, by
    default what a task holds.
    """
    n = rows.count()
    if n <= k:
        raise ValueError(f"{n} rows cannot have {k} neighbours each")
    wanted = pivots or min(MAX_PIVOTS, max(1, math.ceil(n / (piece or PIECE)) * 4))
    chosen = rows.orderBy(F.md5("_id"), "_id").limit(wanted).select("_v").collect()
    centres = np.array([r[0] for r in chosen])
    held = max(1, PIECE_BYTES // (8 * max(1, centres.shape[1])))
    size, visitors = piece or min(held, max(PIECE, math.ceil(n / PIECES))), piece or min(held, max(PIECE, math.ceil(n / VISITS)))
    celled = rows.withColumn("_near", _near_pivots(centres)("_v"))
    stats = celled.groupBy(F.col("_near.cell").alias("cell")).agg(F.max("_near.reach").alias("far"), F.count(F.lit(1)).alias("n"))
    radius, sizes = np.full(len(centres), -1.0), np.zeros(len(centres), dtype=int)
    for r in stats.collect():
        radius[r.cell], sizes[r.cell] = r.far, r.n
    first, parts = _pack(sizes, centres, size)

    probes = rows.select("_id", "_v", F.explode(_pieces_to_visit(centres, radius, k, first, parts)("_v")).alias("other"))
    visits = np.zeros(int((first + parts).max()), dtype=int)
    for r in probes.groupBy("other").agg(F.count(F.lit(1)).alias("n")).collect():
        visits[r.other] = r.n

    def listed(numbers: np.ndarray, i: Column) -> Column:
        return F.get(F.array(*map(F.lit, numbers.tolist())), i)

    place = F.abs(F.xxhash64("_id") % 2**40)
    cuts = np.maximum(1, np.ceil(visits / visitors)).astype(int)
    probe_pieces = probes.select("_id", "_v", "other", (place % listed(cuts, F.col("other"))).cast("int").alias("mine"))
    cell = F.col("_near.cell")
    members = celled.select("_id", "_v", (listed(first, cell) + place % listed(parts, cell)).cast("int").alias("other"))
    member_pieces = members.select("_id", "_v", "other", F.explode(F.sequence(F.lit(0), (listed(cuts, F.col("other")) - 1).cast("int"))).alias("mine"))

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(left) and len(right):
            right = right.sort_values("_id")
            ids, vectors = right["_id"].to_numpy(), np.stack(right["_v"].to_numpy())
            step = max(1, (1 << 22) // len(ids))
            for start in range(0, len(left), step):
                part = left.iloc[start : start + step]
                away = _distances(np.stack(part["_v"].to_numpy()), vectors)
                own = part["_id"].to_numpy()
                for row, low, high in zip(away, np.searchsorted(ids, own, "left"), np.searchsorted(ids, own, "right")):
                    row[low:high] = np.inf
                for probe, row in zip(own, away):
                    # all rows as near as the k-th, then the smaller ids among them
                    limit = np.partition(row, k - 1)[k - 1] if len(row) > k else np.inf
                    close = np.flatnonzero((row <= limit) & np.isfinite(row))
                    for j in close[np.argsort(row[close], kind="stable")][:k]:
                        found.append((probe, float(row[j]), ids[j], vectors[j]))
        return pd.DataFrame(found, columns=["_id", "far", "other_id", "other"])

    paired = probe_pieces.groupBy("mine", "other").cogroup(member_pieces.groupBy("mine", "other"))
    picked = paired.applyInPandas(best, "_id string, far double, other_id string, other array<double>")
    ordered = F.slice(F.sort_array(F.collect_list(F.struct("far", "other_id", "other"))), 1, k)
    return picked.groupBy("_id").agg(ordered.alias("_n")).select("_id", F.col("_n.other").alias("near"))


def smote(
    df: DataFrame, features: Sequence[str], label: str, ids: Sequence[str], k: int = 5, seed: int = 42,
    pivots: int | None = None,
) -> DataFrame:
    """Original rows and synthetic ones, so that every class is as large as the largest.

    A synthetic row lies between a row of its class and one of that row's ``k`` nearest rows of
    the class, at a share given by a hash of the row and the copy number. Returns
    ``features…, label, synthetic``.
    """
    sizes = class_sizes(df, label)
    largest = max(sizes.values())
    result = df.select(*map(column, features), column(label), F.lit(False).alias("synthetic"))
    for value, n in sizes.items():
        if n == largest:
            continue
        own = df.where(column(label) == F.lit(value)).select(
            F.concat_ws("|", *map(column, ids)).alias("_id"),
            F.array(*[column(f).cast("double") for f in features]).alias("_v"),
        )
        near = nearest_neighbours(own, k, pivots)
        more = largest - n
        ranked = hash_ranked(own, [], ["_id"], seed, "_pos")
        wanted = F.lit(more // n) + F.when(F.col("_pos") < more % n, 1).otherwise(0)
        copies = (
            ranked.withColumn("_copies", wanted)
            .where("_copies > 0")
            .join(near, "_id")
            .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
            .withColumn("_hash", hash_order(seed, "_id", "_copy"))
        )
        number = lambda start: F.conv(F.substring("_hash", start, 8), 16, 10).cast("long")
        other = F.get(F.col("near"), (number(1) % k).cast("int"))
        share = number(9) / F.lit(float(2**32))
        mixed = F.zip_with(F.col("_v"), other, lambda a, b: a + (b - a) * share)
        made = copies.select(mixed.alias("_m")).select(
            *[F.get("_m", i).alias(f) for i, f in enumerate(features)], F.lit(value).alias(label), F.lit(True).alias("synthetic")
        )
        result = result.unionByName(made)
    return result
