"""Repair of conversation structure by least cost, with the least audit by prefix doubling.

A repaired conversation has role initials ``(s?(ua)+)?``.  Keeping a row costs 0, giving it another role 2, deleting it 3,
inserting an empty row 2, and a truncated row that stays 1; blank rows and repeats have to go.  A node is (rows consumed,
state of the pattern).  The cost table is filled from the end; arcs that lie on cheapest repairs are kept.  Nodes are then
ranked by their audits of 1, 2, 4, ... letters: a rank is the rank of the first half and that of the node where it ends.  Arcs
out of a node bear different letters, so that node is one.  Ranks choose each node's arc, and the path from the start is read
off the doubled pointers.

Rows of one conversation that are equal are one row with a number, counted before any shuffle.  Rows are then dealt by
*ranges* of (conversation, turn, role, text), so a conversation of any size is spread over tasks.  A task cuts its rows into
pieces of at most ``PIECE_STEPS`` rows.  A piece that may go on in another task, or was cut for its size, is passed on with
the cheapest costs between states; a conversation's pieces are joined from the end through these four by four tables, solved
for every state they may be entered in, and read in order as a stream.  Only the hash of a repaired conversation, which is
sequential by definition, and its audit, which is one cell, see a conversation as a whole.

Edge cases: null roles and texts are one space, before any damage; null turns come first and are no part of gaps; rows with
equal turns are ordered by role, then text (by bytes); rows without ``conv_id`` are one conversation; a conversation
without rows after damage has zeros, an empty audit and the hash of nothing; other columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.session import materialize

KEEP, RENAME, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: A piece is closed at this many rows or characters.
PIECE_STEPS, PIECE_CHARS = 4096, 4_000_000
#: Letters of an audit in their order.
LETTERS = b"\0DIKR"
_ROLE = {"s": 1, "u": 2, "a": 3}
#: States: nothing yet, after s, after u, after a.  Where a kept row of role other, s, u, a leads from each; -1: nowhere.
_KEPT = np.array([[-1, -1, -1, -1], [1, -1, -1, -1], [2, 2, -1, 2], [-1, -1, 3, -1]])
#: Where a new or renamed row leads.
_MADE = np.array([2, 2, 3, 2])
_ACCEPT = (0.0, math.inf, math.inf, 0.0)
_LEGAL = np.zeros((4, 4), bool)
_LEGAL[[1, 2, 3], [2, 3, 2]] = True
_WORD = re.compile(r"[^\x20\x09-\x0D]")
_PIECE = ("conv_id long, pid int, k int, edge boolean, steps binary, roles array<string>, texts array<string>, first_turn long, last_turn long, "
          "low long, turns long")
_RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows after damage, equal ones as one row with ``copies``; a dropped row stays with 0, for its conversation's sake."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    conv, turn = F.col("conv_id").cast("long"), F.col("turn").cast("long")
    named = F.concat(F.coalesce(conv.cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(turn.cast("string"), F.lit(" ")))
    rows = conversations.select(conv.alias("conv_id"), turn.alias("turn"), role.alias("role"), text.alias("text"), F.pmod(F.crc32(named.cast("binary")), F.lit(20)).alias("kind"))
    kind = F.col("kind")
    return (rows.select(
        "conv_id", F.when(kind != 0, F.col("turn")).alias("turn"),
        F.when(kind == 0, "").when(kind == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(kind.isin(0, 1), "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("copies"))
        .groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies")))


def _marked(rows: DataFrame) -> DataFrame:
    """``new``: role and text are not those of a row of an earlier turn."""
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    digest = F.sha2("text", 256)
    again = (rows.where("copies > 0").groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), digest.alias("d"))
             .agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1").drop("times"))
    return (rows.join(again, F.col("c").eqNullSafe(F.col("conv_id")) & (F.col("r") == F.col("role")) & (F.col("d") == digest), "left")
            .select("conv_id", "turn", "role", "text", "copies", (F.col("first").isNull() | F.col("first").eqNullSafe(place)).alias("new")))


def _steps(role: str, text: str, copies: int, new: bool) -> Iterator[tuple[int, int]]:
    """(code, times): role in the two low bits, then 0 sound, 1 blank, 2 duplicate, 3 truncated."""
    code = _ROLE.get(role[:1], 0)
    if not _WORD.search(text):
        yield code | 4, copies
        return
    if new and copies:
        last = next(c for c in reversed(text) if _WORD.match(c))
        yield code | (0 if last in ".!?" else 12), 1
        copies -= 1
    yield code | 8, copies


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pid, k, opening = TaskContext.get().partitionId(), 0, True
    conv: object = batches  # no conversation's id
    out: list[tuple] = []
    steps, roles, texts, turns, held = bytearray(), [], [], [], 0

    def close(cut: bool) -> None:
        nonlocal k, steps, roles, texts, turns, held
        known = [t for t in turns if t is not None]
        out.append((conv, pid, k, cut, bytes(steps), roles, texts, turns[0] if turns else None, turns[-1] if turns else None, known[0] if known else None, len(known)))
        k += 1
        steps, roles, texts, turns, held = bytearray(), [], [], turns[-1:] if cut else [], 0

    def batch() -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.string())] + [pa.int64()] * 4
        made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], [f.split()[0] for f in _PIECE.split(", ")])
        out.clear()
        return made

    for rows in batches:
        for c, turn, role, text, copies, new in zip(*(col.to_pylist() for col in rows.columns), strict=True):
            if c != conv:
                if conv is not batches:
                    close(opening)
                    opening = False
                conv, turns = c, []
            if copies and (not turns or turns[-1] != turn):
                turns.append(turn)
            for code, times in _steps(role, text, copies, new):
                while times:
                    some = min(times, PIECE_STEPS - len(steps))
                    steps += bytes([code]) * some
                    times -= some
                    if not code & 4 and not code & 8 or code & 12 == 12:
                        roles.append(role)
                        texts.append(text)
                        held += len(text)
                    if len(steps) >= PIECE_STEPS or held >= PIECE_CHARS:
                        close(True)
                        opening = True
            if len(out) >= 512 or held >= PIECE_CHARS // 4 and out:
                yield batch()
    if conv is not batches:
        close(True)
    if out:
        yield batch()


def _costs(steps: bytes, ahead: tuple[float, ...]) -> np.ndarray:
    """Cheapest cost from each (row, state) on; ``ahead`` is that behind the last row."""
    table = np.empty((len(steps) + 1, 4))
    a0, a1, a2, a3 = map(float, ahead)
    table[-1] = a0, a1, a2, a3
    for i in range(len(steps) - 1, -1, -1):
        code = steps[i]
        role, fault = code & 3, code >> 2
        b0, b1, b2, b3 = a0 + DELETE, a1 + DELETE, a2 + DELETE, a3 + DELETE
        if fault in (0, 3):
            extra = TRUNCATED if fault else 0
            made_u, made_a = a2 + RENAME + extra, a3 + RENAME + extra
            b0, b1, b2, b3 = min(b0, made_u), min(b1, made_u), min(b2, made_a), min(b3, made_u)
            if role == 1:
                b0 = min(b0, a1 + extra)
            elif role == 2:
                kept = a2 + extra
                b0, b1, b3 = min(b0, kept), min(b1, kept), min(b3, kept)
            elif role == 3:
                b2 = min(b2, a3 + extra)
        a0, a1, a2, a3 = _inserted(b0, b1, b2, b3)
        table[i] = a0, a1, a2, a3
    return table


def _inserted(b0: float, b1: float, b2: float, b3: float) -> tuple[float, float, float, float]:
    b2, b3 = min(b2, b3 + INSERT), min(b3, b2 + INSERT)
    return min(b0, b2 + INSERT), min(b1, b2 + INSERT), b2, b3


_END = _inserted(*_ACCEPT)


def _least_paths(pieces: list[tuple[bytes, tuple | None, tuple[int, ...]]]) -> list[list[tuple[np.ndarray, int]]]:
    """For each (steps, costs behind or None at the end, entry states): per entry the nodes' letters with states, and the cost.

    Returns per piece and entry an array of (row, state, letter) and the cost of that way through the piece.
    """
    tables = [_costs(steps, _END if ahead is None else ahead) for steps, ahead, _ in pieces]
    starts = np.concatenate([[0], np.cumsum([4 * len(t) for t in tables])])[:-1]
    cost = np.concatenate([t.ravel() for t in tables])
    n = len(cost)
    node = np.arange(n)
    state = node & 3
    code = np.concatenate([np.repeat(np.frombuffer(steps + b"\x10", np.uint8), 4) for steps, *_ in pieces]).astype(np.int64)
    role, fault, behind = code & 3, (code >> 2) & 3, code == 16
    ended = np.zeros(n, bool)
    for s, t, (_, ahead, _) in zip(starts, tables, pieces, strict=True):
        last = int(s) + 4 * (len(t) - 1)
        if ahead is None:
            ended[[last, last + 3]] = True
        else:
            ended[last:last + 4] = True
    soft = ~behind & ((fault == 0) | (fault == 3))
    extra = np.where(fault == 3, TRUNCATED, 0)
    base, kept, made = node - state, _KEPT[role, state], _MADE[state]
    arcs = np.stack([  # D, I, K, R: cost of each arc and where it leads
        np.where(behind, math.inf, DELETE), np.where(ended, math.inf, INSERT),
        np.where(soft & (kept >= 0), KEEP + extra, math.inf), np.where(soft, RENAME + extra, math.inf)])
    target = np.minimum(np.stack([base + 4 + state, base + made, base + 4 + np.maximum(kept, 0), base + 4 + made]), n - 1)
    best = (arcs + cost[target] == cost) & np.isfinite(cost) & ~ended & np.isfinite(arcs)
    none = ~best.any(axis=0)
    letter = np.where(none, 0, best.argmax(axis=0) + 1)
    step = np.where(none, node, target[letter - 1, node])
    rank, jump = letter.copy(), step
    while (letter[jump] > 0).any():  # audits of twice the letters
        rank = np.unique(rank * n + rank[jump], return_inverse=True)[1] if len(rank) else rank
        jump = jump[jump]
    order = np.where(best, (np.arange(4)[:, None] + 1) * (n + 1) + rank[target], 6 * (n + 1))
    letter = np.where(none, 0, order.argmin(axis=0) + 1)
    step = np.where(none, node, target[letter - 1, node])
    jumps, lengths = [step], [(letter > 0).astype(np.int64)]
    while (letter[jumps[-1]] > 0).any():
        j, size = jumps[-1], lengths[-1]
        jumps.append(j[j])
        lengths.append(size + size[j])
    out = []
    for s, (_, _, entries) in zip(starts, pieces, strict=True):
        ways = []
        for e in entries:
            root = int(s) + e
            size = int(lengths[-1][root])
            at, place = np.full(size + 1, root), np.arange(size + 1)
            for b, j in enumerate(jumps):
                go = (place >> b) & 1 == 1
                at[go] = j[at[go]]
            end = int(at[-1])
            way = np.stack([(at - s) >> 2, at & 3, letter[at]])
            ways.append((way, cost[root] - cost[end] if np.isfinite(cost[root]) else math.inf))
        out.append(ways)
    return out


def _told(way: np.ndarray, steps: bytes, roles: list[str], texts: list[str]) -> tuple[str, list[str], int]:
    """Audit, repaired lines and final state."""
    place = np.cumsum([c >> 2 in (0, 3) for c in steps]) - 1 if steps else np.zeros(0, np.int64)
    lines = []
    for row, state, letter in way[:, :-1].T.tolist():
        if letter == 2:
            lines.append(("assistant" if state == 2 else "user") + ":")
        elif letter == 3:
            lines.append(f"{roles[place[row]]}:{texts[place[row]]}")
        elif letter == 4:
            lines.append(f"{'assistant' if state == 2 else 'user'}:{texts[place[row]]}")
    audit = np.frombuffer(LETTERS, np.uint8)[way[2, :-1]].tobytes().decode()
    return audit, lines, int(way[1, -1])


def _counts(steps: bytes) -> tuple[int, int, int, int]:
    code = np.frombuffer(steps, np.uint8)
    fault, role = code >> 2, code & 3
    return (*(int((fault == f).sum()) for f in (1, 2, 3)), int((~_LEGAL[role[:-1], role[1:]]).sum()))


def _columns(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}
    fields = [f.split(" ") for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], [f for f, _ in fields])


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.to_pylist()
        for at in range(0, len(rows), 256):
            some, made = rows[at:at + 256], []
            for r, ((way, cost),) in zip(some, _least_paths([(r["steps"], None, (0,)) for r in some]), strict=True):
                audit, lines, _ = _told(way, r["steps"], r["roles"], r["texts"])
                gaps = r["last_turn"] - r["low"] + 1 - r["turns"] if r["turns"] else 0
                made.append((r["conv_id"], gaps, *_counts(r["steps"]), int(cost), audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
            yield _columns(_RESULT, made)


_TABLE = "conv_id long, pid int, k int, costs array<double>"
_AHEAD = "p int, j int, ahead array<double>"


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each piece the cheapest cost from every state before it to every state behind it."""
    for batch in batches:
        rows = [(r["conv_id"], r["pid"], r["k"], np.stack([_costs(r["steps"], tuple(0.0 if s == t else math.inf for s in range(4)))[0] for t in range(4)], axis=1).ravel().tolist())
                for r in batch.to_pylist()]
        if rows:
            yield _columns(_TABLE, rows)


def _behind(pieces: pa.Table) -> pa.Table:
    """Costs behind each piece of one conversation, from its end; null behind the last."""
    rows = sorted(pieces.to_pylist(), key=lambda r: (r["pid"], r["k"]), reverse=True)
    out, ahead = [], None
    for r in rows:
        out.append((r["pid"], r["k"], ahead))
        ahead = (np.array(r["costs"]).reshape(4, 4) + np.array(_END if ahead is None else ahead)).min(axis=1).tolist()
    return pa.Table.from_batches([_columns(_AHEAD, out)])


_WAYS = ("conv_id long, pid int, k int, entry int, exit int, cost double, audit string, lines long, repaired string, blank long, duplicate long, "
         "truncated long, illegal long, first_role int, last_role int, first_turn long, last_turn long, low long, turns long")


def _ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            made = []
            (ways,) = _least_paths([(r["steps"], r["ahead"], (0, 1, 2, 3))])
            for entry, (way, cost) in enumerate(ways):
                audit, lines, out = _told(way, r["steps"], r["roles"], r["texts"])
                ends = (r["steps"][0] & 3, r["steps"][-1] & 3) if r["steps"] else (None, None)
                made.append((r["conv_id"], r["pid"], r["k"], entry, out, cost, audit, len(lines), "\n".join(lines), *_counts(r["steps"]), *ends,
                             r["first_turn"], r["last_turn"], r["low"], r["turns"]))
            yield _columns(_WAYS, made)


def _followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The way through a conversation's pieces, which come in order, four rows each."""
    conv: object = batches
    state, piece, audit, digest, lines, sums, cost, role = 0, None, [], None, 0, [0] * 4, 0, None
    low = high = last_turn = None
    turns, met = 0, False

    def told() -> pa.RecordBatch:
        gaps = high - low + 1 - turns if turns else 0
        return _columns(_RESULT, [(conv, gaps, *sums, cost, "".join(audit), digest.hexdigest())])

    for batch in batches:
        for r in batch.to_pylist():
            if r["conv_id"] != conv:
                if conv is not batches:
                    yield told()
                conv, state, piece, audit, digest, lines, sums, cost, role = r["conv_id"], 0, None, [], hashlib.sha256(), 0, [0] * 4, 0, None
                low = high = last_turn = None
                turns, met = 0, False
            if (r["pid"], r["k"]) == piece or r["entry"] != state:
                continue
            piece, state = (r["pid"], r["k"]), r["exit"]
            audit.append(r["audit"])
            if r["lines"]:
                digest.update((("\n" if lines else "") + r["repaired"]).encode())
                lines += r["lines"]
            cost += int(r["cost"])
            sums = [a + r[c] for a, c in zip(sums, ("blank", "duplicate", "truncated", "illegal"), strict=True)]
            if r["first_role"] is not None:
                sums[3] += role is not None and not _LEGAL[role, r["first_role"]]
                role = r["last_role"]
            if r["turns"]:
                turns += r["turns"] - (met and last_turn == r["low"])
                low = r["low"] if low is None else low
                high = last_turn = r["last_turn"]
                met = True
    if conv is not batches:
        yield told()


def repair(conversations: DataFrame) -> DataFrame:
    """A row for each conversation: faults after damage, cost, audit and the hash of what the repair makes of it."""
    rows = _marked(materialize(damaged(conversations), "damaged"))
    order = ["conv_id", "turn", "role", "text"]
    pieces = materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_pieces, _PIECE), "pieces")
    whole, edge = pieces.where("not edge"), pieces.where("edge")
    behind = edge.mapInArrow(_tables, _TABLE).groupBy("conv_id").applyInArrow(_behind, _AHEAD)
    ways = edge.join(behind, (F.col("pid") == F.col("p")) & (F.col("k") == F.col("j"))).drop("p", "j").mapInArrow(_ways, _WAYS)
    joined = ways.repartition("conv_id").sortWithinPartitions("conv_id", "pid", "k", "entry").mapInArrow(_followed, _RESULT)
    return whole.mapInArrow(_whole, _RESULT).unionByName(joined)
