"""Repair of damaged conversations: the cheapest edits that give an allowed order of roles.

The rows of a conversation and the states of the grammar ``(s?(ua)+)?`` span a lattice: a node is (rows
read, state). Keeping, reroling or deleting a row leads one row on, inserting an empty turn stays at the row. Dijkstra's
search over this lattice, which is never built, takes nodes by (cost, audit so far) and stops at the first accepting
node behind the last row. An audit's letters fix its cost, so two audits of one cost that lead to one node are never
one the beginning of the other; the order of audits therefore holds however they go on.

Equal rows are one row with a count before any shuffle of whole conversations. Rows are range-partitioned and sorted by (conversation,
turn, role, text). A conversation that lies inside a partition and has at most ``CHUNK`` rows is solved there. Others
are cut into chunks: repeats across chunks are found by a grouping, each chunk is searched from each state to each
state, and a pass over the chunks' results joins these to the cheapest way. So a conversation with a third of all rows is
spread over all tasks; what passes through one task are its chunks' results (sixteen audits each) and, as a stream for the
digest, its repaired texts chunk by chunk, for SHA-256 is sequential. The audit of a conversation is one cell, which bounds it at 2**31 edits.

Defined cases: nulls are one space (role, text, and id and turn in the checksum); rows of null id are one conversation; null turns come first; equal turns
are ordered by role, then text, both after damage; repeated rows are repeats; an empty role has no initial and can't be kept; a conversation without rows after damage has
zeros, an empty audit and the empty digest; empty tables yield no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velograde.llm.workdir import drop, table
from velograde.shipping import ship

CHUNK, CHUNK_BYTES = 256, 4_000_000
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
SOME = re.compile(r"[^\x20\x09-\x0D]")

#: States: nothing yet, after system, after user, after assistant; where an initial leads.
STATES = range(4)
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
ACCEPTING = (0, 3)
LEGAL = ("su", "ua", "au")


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, n): the rows after damage, equal ones as one with their number; dropped ones keep n = 0."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20
    text = F.when(fault <= 1, "").when(fault == 2, F.regexp_replace(blank("text"), "[.!?]", "")).otherwise(blank("text"))
    role = F.when(fault == 0, "").when(fault == 4, "user").otherwise(blank("role"))
    n = F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1)
    each = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), n.alias("n"))
    return each.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))


class Step:
    """A row in the lattice: its initial, whether it must go, whether it is truncated, and how many copies go with it."""

    __slots__ = ("copies", "gone", "initial", "role", "text", "truncated")

    def __init__(self, role: str, text: str, copies: int, gone: bool, truncated: bool):
        self.role, self.text, self.initial, self.copies, self.gone, self.truncated = role, text, role[:1], copies, gone, truncated


def steps(rows: list[tuple], seen: set[int] | None = None) -> tuple[list[Step], dict[str, int]]:
    """Rows (turn, role, text, n) as steps with their counts of faults; ``seen``: rows that an earlier chunk holds."""
    known: set[tuple[str, str]] = set()
    out, counts = [], {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "turns": 0}
    before, turn_before = None, None
    for i, (turn, role, text, n) in enumerate(rows):
        blank = SOME.search(text) is None
        repeated = not blank and ((role, text) in known or (seen is not None and i in seen))
        known.add((role, text))
        truncated = not blank and not repeated and text.rstrip(BLANKS)[-1] not in ".!?"
        counts["blank"] += n if blank else 0
        counts["duplicate"] += 0 if blank else n if repeated else n - 1
        counts["truncated"] += truncated
        counts["illegal"] += n - 1 + (before is not None and before + role[:1] not in LEGAL)
        counts["turns"] += turn is not None and turn != turn_before
        before, turn_before = role[:1], turn if turn is not None else turn_before
        out.append(Step(role, text, n - 1, blank or repeated, truncated))
    return out, counts


def search(of: list[Step], start: int, ends: tuple[int, ...], all_ends: bool = False) -> dict[int, tuple[int, str]]:
    """Cheapest (cost, audit) from a state before the first step to states behind the last: the first of ``ends`` reached, or all."""
    heap: list[tuple[int, str, int, int]] = [(0, "", 0, start)]
    done: set[tuple[int, int]] = set()
    found: dict[int, tuple[int, str]] = {}
    last = len(of)
    while heap:
        cost, audit, i, state = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == last and state in ends:
            found[state] = (cost, audit)
            if not all_ends or len(found) == len(ends):
                return found
        own = NEXT.get((state, "u")), NEXT.get((state, "a"))
        for to in own:
            if to is not None and (i, to) not in done:
                heapq.heappush(heap, (cost + INSERT, audit + "I", i, to))
        if i == last:
            continue
        step = of[i]
        tail, spent = "D" * step.copies, cost + DELETE * step.copies
        if (i + 1, state) not in done:
            heapq.heappush(heap, (spent + DELETE, audit + "D" + tail, i + 1, state))
        if step.gone:
            continue
        spent += TRUNCATED * step.truncated
        to = NEXT.get((state, step.initial))
        if to is not None and (i + 1, to) not in done:
            heapq.heappush(heap, (spent + KEEP, audit + "K" + tail, i + 1, to))
        for to in own:
            if to is not None and (i + 1, to) not in done:
                heapq.heappush(heap, (spent + REROLE, audit + "R" + tail, i + 1, to))
    return found


def rendered(of: list[Step], audit: str, state: int = 0) -> list[str]:
    """The turns (``role:text``) that an audit makes of the steps."""
    out, i, copies = [], 0, 0
    for letter in audit:
        if letter == "D":
            if copies:
                copies -= 1
            else:
                copies, i = of[i].copies, i + 1
            continue
        role, text = ("assistant" if state == 2 else "user"), ""
        if letter != "I":
            step = of[i]
            role, text, copies, i = (step.role if letter == "K" else role), step.text, step.copies, i + 1
        out.append(f"{role}:{text}")
        state = NEXT[state, role[:1]]
    return out


RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
ROWS = "array<struct<turn: bigint, role: string, text: string, n: bigint>>"
SORTED = f"{RESULT}, chunk long, rows {ROWS}"
_ROWS = pa.list_(pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("n", pa.int64())]))
_LONGS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_RESULT = [("conv_id", pa.int64()), *[(c, pa.int64()) for c in _LONGS], ("audit", pa.string()), ("repaired_sha256", pa.string())]


def _gaps(first: int | None, last: int | None, turns: int) -> int:
    return last - first + 1 - turns if first is not None else 0


def solved(conv_id: int | None, rows: list[tuple]) -> dict:
    """The result of a whole conversation."""
    of, counts = steps(rows)
    cost, audit = next(iter(search(of, 0, ACCEPTING).values()))
    turns = [t for t, *_ in rows if t is not None]
    text = "\n".join(rendered(of, audit))
    gaps = _gaps(turns[0] if turns else None, turns[-1] if turns else None, counts.pop("turns"))
    return {"conv_id": conv_id, "gaps": gaps, **counts, "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256(text.encode()).hexdigest()}


def sorted_conversations(size: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a partition's sorted rows, results of the conversations inside it, and chunks of the first, the last and longer ones."""
    from pyspark import TaskContext

    chunk = TaskContext.get().partitionId() << 40
    schema = pa.schema([*_RESULT, ("chunk", pa.int64()), ("rows", _ROWS)])
    out: list[dict] = []
    now, rows, held, split = None, [], 0, True  # the first conversation may begin in another partition

    def cut() -> None:
        nonlocal chunk, rows, held
        out.append({"conv_id": now[0], "chunk": chunk, "rows": [dict(zip(("turn", "role", "text", "n"), r, strict=True)) for r in rows]})
        chunk, rows, held = chunk + 1, [], 0

    for batch in batches:
        for conv_id, turn, role, text, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now is not None and now[0] != conv_id:
                if split:
                    cut()
                else:
                    out.append(solved(now[0], rows))
                rows, held, split = [], 0, False
            now = (conv_id,)
            if n:
                if len(rows) >= size or held > CHUNK_BYTES:
                    split = True
                    cut()
                rows.append((turn, role, text, n))
                held += len(text)
            if len(out) >= 1000:
                yield pa.RecordBatch.from_pylist(out, schema)
                out.clear()
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)
            out.clear()
    if now is not None:
        cut()
        yield pa.RecordBatch.from_pylist(out, schema)


WAYS = "array<struct<start: int, stop: int, cost: bigint, audit: string>>"
CHUNKS = f"conv_id long, chunk long, blank long, duplicate long, truncated long, illegal long, turns long, first_turn long, last_turn long, first_role string, last_role string, ways {WAYS}"
_WAYS = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))


def _tuples(rows: list[dict]) -> list[tuple]:
    return [(r["turn"], r["role"], r["text"], r["n"]) for r in rows]


def chunk_ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (conv_id, chunk, rows, seen): a chunk's counts, ends, and cheapest way from each state to each."""
    counted = ("blank", "duplicate", "truncated", "illegal", "turns")
    schema = pa.schema([("conv_id", pa.int64()), ("chunk", pa.int64()), *[(c, pa.int64()) for c in (*counted, "first_turn", "last_turn")], ("first_role", pa.string()), ("last_role", pa.string()), ("ways", _WAYS)])
    for batch in batches:
        for conv_id, chunk, packed, seen in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            rows = _tuples(packed)
            of, counts = steps(rows, set(seen or ()))
            turns = [t for t, *_ in rows if t is not None]
            ways = [{"start": a, "stop": b, "cost": cost, "audit": audit} for a in STATES for b, (cost, audit) in search(of, a, tuple(STATES), True).items()]
            ends = {"first_turn": turns[0], "last_turn": turns[-1]} if turns else {}
            roles = {"first_role": of[0].initial, "last_role": of[-1].initial} if of else {}
            yield pa.RecordBatch.from_pylist([{"conv_id": conv_id, "chunk": chunk, **counts, **ends, **roles, "ways": ways}], schema)


def ranked(tails: dict[int, tuple[int, str]]) -> dict[int, tuple[int, str]]:
    """The same costs with short audits that compare as the long ones do, whatever follows.

    Audits up to one row differ at some letter, or one is the other and inserts behind it.
    """
    names: dict[str, str] = {}
    out, base = {}, None
    for audit in sorted({audit for _, audit in tails.values()}):
        if base is None or not (audit.startswith(base) and set(audit[len(base) :]) <= {"I"}):
            base = audit
            letter = chr(ord("a") + len(names))
        names[audit] = letter + audit[len(base) :]
    for state, (cost, audit) in tails.items():
        out[state] = (cost, names[audit])
    return out


PATHS = "chunk long, conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, start int, piece string"


def joined(chunks: pa.Table) -> pa.Table:
    """The cheapest way through the chunks of one conversation: for each where it starts and its piece of the audit; the totals."""
    chunks = chunks.sort_by("chunk")
    totals = {c: sum(chunks[c].to_pylist()) for c in ("blank", "duplicate", "truncated", "illegal")}
    turns, first, last, role = 0, None, None, None
    for t, a, b, x, y in zip(*(chunks[c].to_pylist() for c in ("turns", "first_turn", "last_turn", "first_role", "last_role")), strict=True):
        if a is not None:
            turns += t - (last == a)
            first, last = (a if first is None else first), b
        if x is not None:
            totals["illegal"] += role is not None and role + x not in LEGAL
            role = y
    best, back = {0: (0, "")}, []
    for i in range(chunks.num_rows):
        reached: dict[int, tuple[int, str]] = {}
        came: dict[int, tuple[int, str]] = {}
        for way in chunks["ways"][i].as_py():
            if way["start"] in best:
                cost, audit = best[way["start"]]
                offer = (cost + way["cost"], audit + way["audit"])
                if way["stop"] not in reached or offer < reached[way["stop"]]:
                    reached[way["stop"]], came[way["stop"]] = offer, (way["start"], way["audit"])
        best = ranked(reached)
        back.append(came)
    state = min((s for s in ACCEPTING if s in best), key=lambda s: best[s])
    cost, path = best[state][0], []
    for came in reversed(back):
        state, piece = came[state]
        path.append((state, piece))
    path.reverse()
    n = chunks.num_rows
    gaps = _gaps(first, last, turns)
    same = {"gaps": gaps, **totals, "cost": cost}
    starts, pieces = zip(*path, strict=True)
    return pa.table({"chunk": chunks["chunk"], "conv_id": chunks["conv_id"], **{c: pa.array([same[c]] * n, pa.int64()) for c in _LONGS}, "start": pa.array(starts, pa.int32()), "piece": pa.array(pieces, pa.string())})


def rendered_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (rows, seen, start, piece, ...): the others and the chunk's repaired text, null without a turn."""
    for batch in batches:
        texts = []
        for packed, seen, start, piece in zip(*(batch.column(c).to_pylist() for c in ("rows", "seen", "start", "piece")), strict=True):
            turns = rendered(steps(_tuples(packed), set(seen or ()))[0], piece, start)
            texts.append("\n".join(turns) if turns else None)
        names = ["conv_id", "chunk", *_LONGS, "piece"]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(texts, pa.string())], names=[*names, "text"])


def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of conversations whose chunks come in order."""
    schema = pa.schema(_RESULT)
    now, digest, begun, audit = None, None, False, []

    def result() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{**now, "audit": "".join(audit), "repaired_sha256": digest.hexdigest()}], schema)

    for batch in batches:
        for row in batch.to_pylist():
            if now is None or now["conv_id"] != row["conv_id"]:
                if now is not None:
                    yield result()
                now, digest, begun, audit = {c: row[c] for c in ("conv_id", *_LONGS)}, hashlib.sha256(), False, []
            audit.append(row["piece"])
            if row["text"] is not None:
                digest.update(("\n" if begun else "").encode() + row["text"].encode())
                begun = True
    if now is not None:
        yield result()


def repair(rows: DataFrame, size: int = CHUNK) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), one row per conversation of (conv_id, turn, role, text)."""
    ship(rows.sparkSession)
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first()]
    # Bounds of ranges hold beginnings of texts only; rows are sorted by the whole.
    short = [F.substring(c, 1, 64) for c in ("role", "text")]
    spread = damaged(rows).repartitionByRange(*order, *short).sortWithinPartitions(*order, "role", "text")
    passed = table(spread.mapInArrow(lambda batches: sorted_conversations(size, batches), SORTED), "conversations", "zstd")
    names = [c.split(" ")[0] for c in RESULT.split(", ")]
    whole = passed.where("chunk is null").select(*names)
    open_ = passed.where("chunk is not null").select("conv_id", "chunk", "rows")
    # Repeats across chunks: a chunk holds each (role, text) once here.
    each = open_.select("conv_id", "chunk", F.posexplode("rows").alias("i", "r")).groupBy("conv_id", "chunk", "r.role", "r.text").agg(F.min("i").alias("i"))
    first = each.groupBy("conv_id", "role", "text").agg(F.min("chunk").alias("first")).withColumnRenamed("conv_id", "conv")
    same = F.col("conv_id").eqNullSafe(F.col("conv"))
    seen = each.join(first, ["role", "text"]).where(same & (F.col("chunk") > F.col("first"))).groupBy("chunk").agg(F.collect_list("i").alias("seen"))
    chunks = table(open_.join(seen, "chunk", "left").select("conv_id", "chunk", "rows", "seen"), "conversation-chunks", "zstd")
    paths = chunks.mapInArrow(chunk_ways, CHUNKS).groupBy("conv_id").applyInArrow(joined, PATHS).drop("conv_id")
    turned = chunks.join(paths, "chunk").select("rows", "seen", "start", "piece", "conv_id", "chunk", *_LONGS)
    texts = turned.mapInArrow(rendered_chunks, f"conv_id long, chunk long, {', '.join(f'{c} long' for c in _LONGS)}, piece string, text string")
    streamed = texts.repartition("conv_id").sortWithinPartitions("conv_id", "chunk").mapInArrow(digested, RESULT)
    return whole.union(streamed.select(*names))
