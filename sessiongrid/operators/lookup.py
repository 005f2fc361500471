"""Lookups in a small table of steps that every task holds: rows look up where they lie and are never shuffled.

A step is what holds from a time on. The steps of an entity become one row with sorted arrays; if all of them
take at most INDEX_BYTES they are broadcast, and each row finds its step by binary search. A larger table of steps
is for the ordered passes of :mod:`sessiongrid.operators.ordered`.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessiongrid.operators.ordered import column

#: measured size up to which a table of steps is broadcast
INDEX_BYTES = 64 << 20


def value_bytes(kind: T.DataType, value: Column) -> Column:
    """About how many bytes a value takes in memory."""
    if isinstance(kind, T.StringType):
        size = F.octet_length(value) + 8
    elif isinstance(kind, T.BinaryType):
        size = F.length(value) + 8
    elif isinstance(kind, T.StructType):
        size = sum((value_bytes(f.dataType, value[f.name]) for f in kind.fields), F.lit(8))
    elif isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.StringType, T.BinaryType, T.StructType, T.ArrayType, T.MapType)):
            size = F.aggregate(value, F.lit(8).cast("long"), lambda n, v: n + value_bytes(kind.elementType, v))
        else:
            size = F.size(value) * 8 + 8
    elif isinstance(kind, T.MapType):
        size = value_bytes(T.ArrayType(kind.keyType), F.map_keys(value)) + value_bytes(T.ArrayType(kind.valueType), F.map_values(value))
    elif isinstance(kind, T.DecimalType):
        size = F.lit(16)
    else:
        size = F.lit(8)
    return F.coalesce(size.cast("long"), F.lit(8).cast("long"))


def fits(df: DataFrame, names: Sequence[str], most: int | None = None) -> bool:
    """Whether the named columns of all rows take at most ``most`` bytes (INDEX_BYTES): one sum."""
    size = sum((value_bytes(df.schema[n].dataType, column(n)) for n in names), F.lit(16).cast("long"))
    total = df.agg(F.sum(size)).first()[0]
    return (total or 0) <= (INDEX_BYTES if most is None else most)


def step_index(steps: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """One row for each entity: its ``_times``, ``_sides`` and ``_hits`` in order, and the jumps of a binary search.

    Steps have ``_time``, ``_side``, ``_hit`` and the further ``order`` columns; those without a time are left out.
    """
    by = ["_time", "_side", *order, "_hit"]
    sorted_steps = F.sort_array(F.collect_list(F.struct(*[column(c) for c in by])))
    grouped = steps.where(F.col("_time").isNotNull()).groupBy(*[column(k).alias(f"_key{i}") for i, k in enumerate(keys)]).agg(sorted_steps.alias("_steps"))
    highest = F.floor(F.log2(F.size("_steps").cast("double"))).cast("int")
    jumps = F.transform(F.sequence(highest, F.lit(0), F.lit(-1)), lambda bit: F.call_function("shiftleft", F.lit(1), bit))
    return grouped.select(
        *[f"_key{i}" for i in range(len(keys))], F.col("_steps")["_time"].alias("_times"), F.col("_steps")["_side"].alias("_sides"),
        F.col("_steps")["_hit"].alias("_hits"), jumps.alias("_jumps"),
    )


def look_up(
    points: DataFrame, steps: DataFrame, keys: Sequence[str], time: str, name: str = "_hit", side: int | None = None,
    forward: bool = False, order: Sequence[str] = (),
) -> DataFrame:
    """Each point with the hit of the last step at or before its time, or of the first one after it, else null.

    A point lies between the sides 0 and 2 of its time. ``side`` says that all steps have this one. Null keys meet
    null keys, a point without a time finds nothing.
    """
    index = step_index(steps, keys, order)
    t = column(time)

    def reached(i: Column) -> Column:
        at = F.get("_times", i)
        if side is not None:
            return at < t if side > 1 else at <= t
        return (at < t) | ((at == t) & (F.get("_sides", i) < 1))

    place = F.aggregate("_jumps", F.lit(0), lambda found, jump: F.when(reached(found + jump - 1), found + jump).otherwise(found))
    hit = F.when(t.isNotNull(), F.get("_hits", place if forward else place - 1))
    same = [column(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)]
    condition = same[0]
    for more in same[1:]:
        condition = condition & more
    joined = points.join(F.broadcast(index), condition, "left")
    return joined.select(*[column(c) for c in points.columns if c != name], hit.alias(name))


def winners(
    intervals: DataFrame, keys: Sequence[str], start: str, end: str, priority: str, take: Sequence[str], pick: str = "last"
) -> DataFrame:
    """Steps ``keys, _time, _side, _hit`` of "which interval wins", both ends included; one entity is swept in one task.

    For intervals that fit into an index. Side 0 rules at the time, side 2 just after it; a null hit is no interval.
    Of the intervals that hold a time the one with the greatest ``priority`` wins, or the least; without one it never does.
    """
    bounds = F.array(column(start), column(end))
    rows = intervals.where((column(start) <= column(end)) & column(priority).isNotNull()).select(
        *[column(k) for k in keys], bounds[0].alias("_time"), bounds[1].alias("_end"), column(priority).alias("_p"),
        F.struct(*[column(c) for c in take]).alias("_hit"),
    )
    fields = {f.name: f for f in rows.schema.fields}
    schema = T.StructType([fields[k] for k in keys] + [fields["_time"], T.StructField("_side", T.IntegerType()), T.StructField("_hit", fields["_hit"].dataType)])
    names, sign = list(keys), 1 if pick == "first" else -1

    def sweep(table: pa.Table) -> pa.Table:
        opens, ends, priorities = (table.column(c).to_pylist() for c in ("_time", "_end", "_p"))
        rank = {row: sign * i for i, row in enumerate(sorted(range(len(opens)), key=priorities.__getitem__))}
        waiting = sorted(range(len(opens)), key=opens.__getitem__, reverse=True)
        held: list[tuple[int, int]] = []
        places, times, sides, hits, last = [], [], [], [], None
        bounds = sorted({(t, row) for values in (opens, ends) for row, t in enumerate(values)}, key=lambda b: b[0])
        for i, (at, _) in enumerate(bounds):
            if i and bounds[i - 1][0] == at:
                continue
            while waiting and opens[waiting[-1]] == at:
                row = waiting.pop()
                heapq.heappush(held, (rank[row], row))
            for side in (0, 2):
                while held and (ends[held[0][1]] < at or (side and ends[held[0][1]] == at)):
                    heapq.heappop(held)
                winner = held[0][1] if held else None
                if winner != last:
                    times.append(at)
                    sides.append(side)
                    hits.append(winner)
                    last = winner
        places = pa.array([0] * len(times), pa.int64())
        columns = [table.column(k).take(places) for k in names]
        columns += [pa.array(times, table.schema.field("_time").type), pa.array(sides, pa.int32()), table.column("_hit").take(pa.array(hits, pa.int64()))]
        return pa.Table.from_arrays(columns, names=[*names, "_time", "_side", "_hit"])

    return rows.groupBy(*[column(k) for k in keys]).applyInArrow(sweep, schema)
