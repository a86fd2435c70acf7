"""Repairs against a dynamic programme over all prefixes, and across chunks."""

from __future__ import annotations

import hashlib
import os
import random
import re
import sys
import zlib
from functools import cache

import pytest

from velograde.llm import conversations

sys.setrecursionlimit(20_000)
FIELDS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
DATA = "/root/testdata/sf0.001"


def by_hand(rows):
    """Straight from the rules: no lattice, all ways tried with their roles, the least (cost, audit) kept."""
    out, found = [], {}
    for conv, turn, role, text in rows:
        found.setdefault(conv, [])
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        found[conv] += [(turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    for conv, own in found.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        faults, seen = [], set()
        for _, role, text in own:
            solid = re.sub(r"[\x20\x09-\x0D]", "", text)
            faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for t, *_ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))

        @cache
        def rest(i, state, inserts):
            """Least (cost, audit, turns) for the rows from i on; ``state``: the last initial."""
            ways = []
            good = lambda c: bool(c) and (state, c) in {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}
            if i == len(own) and state in ("", "a"):
                ways.append((0, "", ()))
            if inserts < 3:
                for name in ("user", "assistant"):
                    if good(name[0]) and (more := rest(i, name[0], inserts + 1)):
                        ways.append((3 + more[0], "I" + more[1], (f"{name}:", *more[2])))
            if i < len(own):
                role, text = own[i][1:]
                if more := rest(i + 1, state, 0):
                    ways.append((4 + more[0], "D" + more[1], more[2]))
                if faults[i] not in ("blank", "duplicate"):
                    extra = 3 * (faults[i] == "truncated")
                    for name, letter, cost in ((role, "K", 0), ("user", "R", 3), ("assistant", "R", 3)):
                        if good(name[:1]) and (more := rest(i + 1, name[:1], 0)):
                            ways.append((cost + extra + more[0], letter + more[1], (f"{name}:{text}", *more[2])))
            return min(ways, default=None)

        cost, audit, repaired = rest(0, "", 0)
        out.append((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(repaired).encode()).hexdigest()))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r[f] for f in FIELDS) for r in df.collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, chunk string")


def rows_of(rng, count, longest):
    texts = ["Yes.", "No!", "And so on", "", " \t", None, "What? ", "Well.\x0b", "ok…", "a.b", "Yes. "]
    roles = ["user", "assistant", "user", "assistant", "system", None, "", "tool", "unknown"]
    out = []
    for conv in range(count):
        for turn in range(rng.randrange(longest)):
            out.append((conv if conv else None, rng.choice([turn, turn, turn, turn + 1, None, -turn]), rng.choice(roles), f"{turn} {x}" if (x := rng.choice(texts)) and rng.random() < 0.6 else x))
    return out


@pytest.mark.parametrize(("seed", "size", "parts"), [(1, 256, 2), (2, 3, 5), (3, 1, 3)])
def test_same_as_by_hand(spark, seed, size, parts):
    rows = rows_of(random.Random(seed), 120, 14)
    assert result(conversations.repair(frame(spark, rows).repartition(parts), size)) == by_hand(rows)


def test_a_conversation_longer_than_partitions(spark):
    rng = random.Random(4)
    rows = rows_of(rng, 6, 6) + [(99, t, rng.choice(["user", "assistant", "system"]), rng.choice([f"text {t}.", f"text {t}", "again.", ""])) for t in range(150)]
    assert result(conversations.repair(frame(spark, rows), 16)) == by_hand(rows)


def test_many_equal_rows_and_dropped_conversations(spark):
    dropped = [next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)]
    rows = [(5, 1, "user", "Hi.")] * 300 + [(dropped[0], 0, "user", "gone")]
    got = result(conversations.repair(frame(spark, rows), 256))
    assert got == by_hand(rows)
    assert (dropped[0], 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) in got


def test_empty_table(spark):
    assert conversations.repair(frame(spark, [(1, 1, "user", "x")]).limit(0)).collect() == []


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_the_given_table(spark):
    rows = spark.read.parquet(f"{DATA}/conversations.parquet")
    assert result(conversations.repair(rows)) == by_hand([(r.conv_id, r.turn, r.role, r.text) for r in rows.collect()])
