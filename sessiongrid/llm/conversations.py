"""Repair of the structure of conversations at least cost, with an audit of the edits.

A conversation is sound if the initials of its roles are ``(s?(ua)+)?``. Every turn becomes one letter, its signature: ``x`` for a turn
that must go (blank, or with role and text of an earlier turn), else the initial of its role (``o`` for any other), upper
case if the text is cut off before a full stop. Keeping a turn is free, a new role costs REROLE, deleting DELETE, inserting an
empty turn INSERT, and a turn that is cut off and stays CUT_OFF more. Of the cheapest lists of edits the one whose initials (K, R, D, I) come first in ASCII
is taken; it fixes the repaired conversation, as the roles follow from the place.

Equal signatures are solved once. The different ones are sorted from their ends, so that signatures with a common rest
follow each other and share the nodes of an automaton of suffixes: a stack holds the nodes of the present signature, and only
the letters before the common rest add nodes. A node knows for each state of the grammar the cost to go and the first edits of
the best audit of its rest. Nodes that agree in costs, up to a constant, and in the order of their audits behave alike
for all letters before them; they are one, so a letter is worked out once for each of the few kinds of nodes.

Distribution: a conversation's turns are read in order by one task, as a stream: memory is bounded by its letters and its audit, not by its
texts, so a huge conversation costs time but no memory (its digest is one pass over its text by nature). Copies of a turn are
counted before. Signatures are dealt by ranges of their reversed text. No node is kept beyond the stack.

Defined results: null role and text are one space; turns follow ``turn`` (nulls first), then role and text; equal turns of one
number follow each other, and all but the first are duplicates; blank, duplicate, cut off: the first that holds counts; a null conv_id is a conversation; one
without turns has zeros, no edits and the hash of an empty text; gaps above 2^63 - 1 are that; further columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessiongrid.session import settle

REROLE, DELETE, INSERT, CUT_OFF = 3, 4, 3, 3
BLANKS = " \t\n\x0b\f\r"
DAMAGES = 20
ROLES = {"s": "system", "u": "user", "a": "assistant"}
#: states of the grammar: nothing yet, after s, after u, after a; the first and the last may end
STEPS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
INSERTED = (2, 2, 3, 2)
ROWS_OUT = 10_000


def damaged(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after planted damage, by crc32 of ``conv_id:turn``.

    Of 20 remainders 0 drops the turn, 1 empties its text, 2 removes full stops, question and exclamation marks, 3 repeats it, 4 gives it
    to the user. Nulls are read as one space, also in the key.
    """
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = turns.select("conv_id", "turn", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")], (F.crc32(key) % DAMAGES).alias("draw"))
    text = F.when(F.col("draw") == 1, "").when(F.col("draw") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("draw") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.where(F.col("draw") != 0).select(
        "conv_id", "turn", F.when(F.col("draw") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy"),
    ).drop("copy")


def marked(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, n, fault, initial): equal turns of one number once, with their faults.

    ``fault`` is that of the first of the ``n``: blank, duplicate, truncated or null.
    """
    own = turns.select("conv_id", "turn", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])
    counted = own.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("n"))
    hashes = [F.xxhash64("role", "text").alias("h1"), F.xxhash64("text", "role", F.lit("second")).alias("h2")]
    order = F.struct(F.col("turn").isNotNull().alias("numbered"), F.col("turn").alias("turn"))
    counted = settle(counted.withColumns({h: c for h, c in zip(("h1", "h2"), hashes)}))
    again = counted.groupBy("conv_id", "h1", "h2").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("places")).where(F.col("places") > 1)
    c, d = counted.alias("c"), again.alias("d")
    same = F.col("c.conv_id").eqNullSafe(F.col("d.conv_id")) & (F.col("c.h1") == F.col("d.h1")) & (F.col("c.h2") == F.col("d.h2"))
    joined = c.join(d, same, "left").select("c.*", "first")
    left = F.rtrim(F.col("text"), F.lit(BLANKS))
    seen = F.coalesce(order != F.col("first"), F.lit(False))
    fault = F.when(left == "", "blank").when(seen, "duplicate").when(~F.right(left, F.lit(1)).isin(".", "!", "?"), "truncated")
    return joined.select("conv_id", "turn", "role", "text", "n", fault.alias("fault"), F.left("role", F.lit(1)).alias("initial"))


def in_order(rows: DataFrame, *first: str | Column) -> DataFrame:
    """Each conversation in one partition, its turns in order."""
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *first, F.col("turn").asc_nulls_first(), "role", "text")


def letter(fault: str | None, initial: str) -> str:
    if fault in ("blank", "duplicate"):
        return "x"
    own = initial if initial in ROLES else "o"
    return own.upper() if fault == "truncated" else own


def signatures(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, signature) from marked turns."""
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal"]
    schema = T.StructType([rows.schema["conv_id"], *[T.StructField(c, T.LongType()) for c in counts], T.StructField("signature", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        now: Any = None

        def out() -> pa.RecordBatch:
            columns = [list(c) for c in zip(*done)] or [[] for _ in range(7)]
            done.clear()
            types = [id_type, *[pa.int64()] * 5, pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["conv_id", *counts, "signature"])

        def end() -> None:
            if now is not None:
                low, high, numbers = now["low"], now["high"], now["numbers"]
                gaps = 0 if low is None else min(high - low + 1 - numbers, 2**63 - 1)
                done.append((now["id"], gaps, now["blank"], now["duplicate"], now["truncated"], now["illegal"], now["letters"].decode()))

        id_type = None
        for batch in batches:
            id_type = batch.schema.field("conv_id").type
            for conv, turn, n, fault, initial in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "turn", "n", "fault", "initial")]):
                if now is None or now["id"] != conv:
                    end()
                    if len(done) >= ROWS_OUT:
                        yield out()
                    now = {"id": conv, "low": None, "high": None, "numbers": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "letters": bytearray(), "last": None}
                if turn is not None and turn != now["high"]:
                    now["low"] = turn if now["low"] is None else now["low"]
                    now["high"] = turn
                    now["numbers"] += 1
                if now["last"] is not None:
                    now["illegal"] += now["last"] + initial not in ("su", "ua", "au")
                now["illegal"] += n - 1
                now["last"] = initial
                if fault == "blank":
                    now["blank"] += n
                else:
                    now["duplicate"] += n - (fault != "duplicate")
                    now["truncated"] += fault == "truncated"
                now["letters"] += letter(fault, initial).encode() + b"x" * (n - 1)
        end()
        if id_type is not None:
            yield out()

    return in_order(rows).select("conv_id", "turn", "n", "fault", "initial").mapInArrow(run, schema)


# the automaton: a kind of node is (costs less the least one, order of the audits) for the four states
END = ((0, 2 * INSERT, INSERT, 0), (0, 2, 1, 0))


def before(kind: tuple, symbol: str) -> tuple[tuple, int, tuple]:
    """The kind of node one letter further to the front, its least cost above that of ``kind``, and for each state (first edits, next state)."""
    costs, ranks = kind
    found = []
    for state in range(4):
        options = []
        at = state
        for inserts in range(3):
            edits = [("D", at, DELETE)]
            if symbol != "x":
                more = CUT_OFF if symbol.isupper() else 0
                edits += [("R", to, REROLE + more) for initial, to in STEPS[at].items() if initial != "s"]
                if symbol.lower() in STEPS[at]:
                    edits.append(("K", STEPS[at][symbol.lower()], more))
            options += [(inserts * INSERT + cost + costs[to], "I" * inserts + edit, ranks[to], to) for edit, to, cost in edits]
            at = INSERTED[at]
        found.append(min(options))
    least = min(f[0] for f in found)
    order = sorted({f[1:3] for f in found})
    return (tuple(f[0] - least for f in found), tuple(order.index(f[1:3]) for f in found)), least, tuple((f[1], f[3]) for f in found)


def solved(signatures: DataFrame) -> DataFrame:
    """(signature, cost, audit) of each different signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, tuple] = {}
        path, stack = "", [(END, 0, None)]  # a node: its kind, the least cost to go, the first edits of each state
        for batch in batches:
            costs, audits = [], []
            for reverse in batch.column("reverse").to_pylist():
                shared = common_start(path, reverse)
                del stack[shared + 1 :]
                for symbol in reverse[shared:]:
                    kind, cost, _ = stack[-1]
                    step = known.get((kind, symbol))
                    if step is None:
                        step = known[kind, symbol] = before(kind, symbol)
                    stack.append((step[0], cost + step[1], step[2]))
                path = reverse
                kind, cost, _ = stack[-1]
                costs.append(cost + kind[0][0])
                state, audit = 0, []
                for _, _, edits in stack[:0:-1]:
                    edit, state = edits[state]
                    audit.append(edit)
                audits.append("".join(audit) + ("", "II", "I", "")[state])
            yield pa.RecordBatch.from_arrays([batch.column("signature"), pa.array(costs, pa.int64()), pa.array(audits, pa.string())], names=["signature", "cost", "audit"])

    different = settle(signatures.select("signature").distinct().withColumn("reverse", F.reverse("signature")))
    return different.repartitionByRange("reverse").sortWithinPartitions("reverse").mapInArrow(run, "signature string, cost long, audit string")


def common_start(a: str, b: str) -> int:
    """How many letters two texts begin with in common."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def reports(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """One row for each conversation of ``ids``: conv_id, counts of its faults, cost and audit."""
    found = settle(signatures(rows))
    whole = found.join(solved(found), "signature").drop("signature")
    i, w = ids.select("conv_id").distinct().alias("i"), whole.alias("w")
    joined = i.join(w, F.col("i.conv_id").eqNullSafe(F.col("w.conv_id")), "left")
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return joined.select("i.conv_id", *[F.coalesce(F.col(n), F.lit(0)).alias(n) for n in numbers], F.coalesce("audit", F.lit("")).alias("audit"))


def edited(audit: str, turns: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """The repaired (role, text) of a conversation's turns; turns are taken from the iterator as the edits ask for them."""
    size = len(audit) - audit.count("D")
    place = 0 if size % 2 else 1  # place 0 is the system's, odd ones are the user's
    for edit in audit:
        role = ROLES["s" if place == 0 else "u" if place % 2 else "a"]
        if edit == "I":
            yield role, ""
        else:
            own, text = next(turns)
            if edit == "D":
                continue
            yield own if edit == "K" else role, text
        place += 1


def streamed(rows: DataFrame, reports: DataFrame) -> DataFrame:
    """Reports and turns of each conversation in one partition, the report first."""
    told = reports.select("conv_id", F.struct("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit").alias("report"))
    both = told.unionByName(rows.select("conv_id", "turn", "role", "text", "n"), allowMissingColumns=True)
    return in_order(both, F.col("report").isNull())


def conversations_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Any, dict, Iterator[tuple[str, str]]]]:
    """(id, report, turns) of each conversation of a stream; turns must be read before the next conversation."""

    def every() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*[batch.column(c).to_pylist() for c in ("conv_id", "report", "role", "text", "n")])

    stream = every()
    waiting = next(stream, None)

    def turns() -> Iterator[tuple[str, str]]:
        nonlocal waiting
        while (waiting := next(stream, None)) is not None and waiting[1] is None:
            for _ in range(waiting[4]):
                yield waiting[2], waiting[3]

    while waiting is not None:
        conv, report = waiting[0], waiting[1]
        own = turns()
        yield conv, report, own
        for _ in own:  # to the next report
            pass


def repaired(turns: DataFrame, ids: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The reports of the conversations of ``ids`` (all in ``turns``) and their repaired turns: conv_id, place from 0, role, text."""
    rows = settle(marked(turns))
    told = settle(reports(rows, turns if ids is None else ids))
    schema = T.StructType([turns.schema["conv_id"], T.StructField("place", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        id_type, done = first.schema.field("conv_id").type, []

        def out() -> pa.RecordBatch:
            columns = [list(c) for c in zip(*done)]
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [id_type, pa.int64(), pa.string(), pa.string()])], names=["conv_id", "place", "role", "text"])

        size = 0
        for conv, report, own in conversations_of(chain_first(first, batches)):
            for place, (role, text) in enumerate(edited(report["audit"], own)):
                done.append((conv, place, role, text))
                size += len(text)
                if len(done) >= ROWS_OUT or size > 1 << 24:
                    yield out()
                    size = 0
        if done:
            yield out()

    return told, streamed(rows, told).select("conv_id", "report", "role", "text", "n").mapInArrow(run, schema)


def chain_first(first: pa.RecordBatch, rest: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield first
    yield from rest


def digest(turns: DataFrame, told: DataFrame) -> DataFrame:
    """The reports with ``repaired_sha256``: the hash of the repaired ``role:text``, joined by newlines.

    The turns of a conversation are hashed as they come; those of its place order lie in one partition.
    """
    both = told.withColumn("place", F.lit(-1).cast("long")).unionByName(turns, allowMissingColumns=True)
    ordered = both.repartition("conv_id").sortWithinPartitions("conv_id", "place")
    schema = T.StructType([*told.schema.fields, T.StructField("repaired_sha256", T.StringType())])
    names = told.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, done, hashed, kinds = None, [], None, None

        def out() -> pa.RecordBatch:
            columns = [list(c) for c in zip(*done)]
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [*kinds, pa.string()])], names=[*names, "repaired_sha256"])

        for batch in batches:
            kinds = [batch.schema.field(n).type for n in names]
            reports_in = list(zip(*[batch.column(n).to_pylist() for n in names]))
            for report, place, role, text in zip(reports_in, *[batch.column(c).to_pylist() for c in ("place", "role", "text")]):
                if place < 0:
                    if head is not None:
                        done.append((*head, hashed.hexdigest()))
                    if len(done) >= ROWS_OUT:
                        yield out()
                    head, hashed = report, hashlib.sha256()
                else:
                    hashed.update(f"{chr(10) if place else ''}{role}:{text}".encode())
        if head is not None:
            done.append((*head, hashed.hexdigest()))
            yield out()

    return ordered.mapInArrow(run, schema)
