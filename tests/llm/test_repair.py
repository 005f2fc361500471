"""Repair of conversations against a search over all edits, and against rows read one by one."""

import hashlib
import heapq
import re
import zlib

import pytest
from llm_fixtures import SF_DIR

from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessiongrid.llm import conversations
from sessiongrid.llm.queries import QUERIES

TURN = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
BLANK = re.compile(r"[^\x20\x09-\x0D]")
SOUND = re.compile(r"(s?(ua)+)?")


def slow_damage(rows):
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        draw = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text
        role = "user" if draw == 4 else role
        yield from [(conv, turn, role, text)] * (0 if draw == 0 else 2 if draw == 3 else 1)


def slow_faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        found = BLANK.findall(text)
        fault = "blank" if not found else "duplicate" if (role, text) in seen else "truncated" if found[-1] not in ".!?" else None
        seen.add((role, text))
        out.append(fault)
    return out


def slow_repair(rows, faults):
    """Cheapest edits by Dijkstra over (turns read, role initials as far as the grammar sees them), ASCII-least among equals.

    The queue is ordered by cost, then by the audit; every prefix is kept, so nothing rests on the sharing of suffixes.
    """
    queue, best = [(0, "", 0, "", ())], None
    seen = set()
    while queue:
        cost, audit, at, roles, out = heapq.heappop(queue)
        if best is not None and (cost, audit) >= best[:2]:
            continue
        if at == len(rows) and SOUND.fullmatch(roles) and (best is None or (cost, audit) < best[:2]):
            best = (cost, audit, out)
        # with the same turns read, cost, audit and a grammar state that lets the same rests follow, one way is enough
        state = (at, cost, audit, roles[-1:], len(roles) > 1)
        if state in seen or len(audit) > len(rows) + 4:
            continue
        seen.add(state)

        def go(more, edit, step, role=None, text=None):
            now = roles + (role[:1] if role else "")
            if role and not re.fullmatch(r"s|s?(ua)*u?", now):
                return
            heapq.heappush(queue, (cost + more, audit + edit, at + step, now, out + ((role, text),) if role else out))

        for role in ("user", "assistant"):
            go(3, "I", 0, role, "")
        if at < len(rows):
            role, text, fault = *rows[at][2:], faults[at]
            go(4, "D", 1)
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                if role:
                    go(more, "K", 1, role, text)
                for new in ("user", "assistant"):
                    go(3 + more, "R", 1, new, text)
    return best


def slow_digest(original):
    groups = {}
    for row in original:
        groups.setdefault(row[0], [])
    for row in slow_damage(original):
        groups[row[0]].append(row)
    out = {}
    for conv, rows in groups.items():
        rows.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        faults = slow_faults(rows)
        cost, audit, left = slow_repair(rows, faults)
        turns = [r[1] for r in rows if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        whole = "\n".join(f"{role}:{text}" for role, text in left)
        out[conv] = (gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256(whole.encode()).hexdigest())
    return out


def found(spark, rows):
    original = spark.createDataFrame(rows, TURN).withColumn("n", F.lit("extra")).withColumn("report", F.lit(1))
    told, turns = conversations.repaired(conversations.damaged(original), original)
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    out = conversations.digest(turns, told).collect()
    assert len(out) == len({r.conv_id for r in out})
    return {r.conv_id: tuple(r[n] for n in names) for r in out}, turns


def test_query_equals_search(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/conversations.parquet").collect()]
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    made = {r.conv_id: tuple(r[n] for n in names) for r in QUERIES["op12_conversation_repair"](spark, SF_DIR).collect()}
    assert made == slow_digest(rows)


def test_odd_conversations(spark):
    """Nulls, ties, repeated rows, other roles, turns that all go, and random short conversations."""
    import random

    draw = random.Random(3)
    rows = [(None, 1, "user", "Hello."), (None, None, None, None), (None, 2, "assistant", "Well. "), (5, None, "user", "No number."), (5, None, "user", "No number.")]
    rows += [(6, t, "tool", "Some output!") for t in range(4)] + [(7, -(2**63), "user", "Early."), (7, 2**63 - 1, "", "Late?")]
    rows += [(8, 3, "user", "Tie."), (8, 3, "assistant", "Tie."), (8, 3, "assistant", "Tie."), (8, 3, "Ärger", "ß.")]
    texts = ["Yes.", "No!", "Why?", "", "  \n", "cut off", "Yes.  ", "漢字。", "end.\n", "tail ."]
    for conv in range(100, 220):
        rows += [(conv, t + t // 3 * draw.randrange(2), draw.choice(["system", "user", "user", "assistant", "assistant", "tool"]), draw.choice(texts) + draw.choice(["", f" {draw.randrange(99)}."])) for t in range(draw.randrange(1, 8))]
    rows += [(conv, t, "user", "Drop") for conv in range(300, 340) for t in range(1)]
    made, turns = found(spark, rows)
    expected = slow_digest(rows)
    expected[7] = (2**63 - 1, *expected[7][1:])
    assert made == expected
    assert any(not v[6] and v[7] == hashlib.sha256(b"").hexdigest() for v in made.values())
    order = {}
    for r in sorted(turns.collect(), key=lambda r: (r.conv_id is None, r.conv_id or 0, r.place)):
        order[r.conv_id] = order.get(r.conv_id, "") + r.role[:1]
    assert order and all(SOUND.fullmatch(v) for v in order.values())


def test_empty_table_and_long_conversation(spark):
    made, turns = found(spark, [])
    assert made == {} and turns.count() == 0
    rows = [(1, t, ("user", "assistant")[t % 2], f"Turn {t}. " + "long " * 2000 + ".") for t in range(3000)] + [(2, 0, "user", "x" * 2_000_000 + ".")]
    made, _ = found(spark, rows)
    kept = [r for r in slow_damage(rows) if r[0] == 1]
    assert len(made[1][6].replace("I", "")) == len(kept) and made[1][0] == sum(zlib.crc32(f"1:{t}".encode()) % 20 == 0 for t in range(3000))


@pytest.mark.parametrize("a, b, n", [("", "", 0), ("abc", "abd", 2), ("abc", "abc", 3), ("ab", "abc", 2), ("x", "y", 0), ("a" * 1000 + "b", "a" * 1000 + "c", 1000)])
def test_common_start(a, b, n):
    assert conversations.common_start(a, b) == n
