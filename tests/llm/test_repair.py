import functools
import hashlib
import os
import random
import re
import sys
import zlib

sys.path.insert(0, os.path.dirname(__file__))

from riskloom.llm import conversation_repair as cr  # noqa: E402

SCHEMA = "conv_id long, turn long, role string, text string, k int, steps string"
sys.setrecursionlimit(20_000)
NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}


def damage(rows):
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)
        for _ in range({0: 0, 3: 2}.get(kind, 1)):
            yield c, t, "user" if kind == 4 else role, text


def plain(rows):
    out = {c: (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest()) for c, *_ in rows}
    kept = list(damage(rows))
    for conv in {c for c, *_ in kept}:
        mine = sorted((r for r in kept if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        seen, faults = set(), []
        for _, _, role, text in mine:
            words = re.sub(r"[\x20\x09-\x0D]", "", text)
            faults.append("blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [r[1] for r in mine if r[1] is not None]

        @functools.cache
        def best(i, state, inserts):
            ways = [(0, "", ())] if i == len(mine) and state in ("", "a") else []

            def go(cost, letter, line, then):
                if then is not None:
                    c, a, lines = then
                    ways.append((cost + c, letter + a, ((line,) if line is not None else ()) + lines))

            made = "a" if state == "u" else "u"
            name = {"u": "user", "a": "assistant"}[made]
            if inserts:
                go(2, "I", name + ":", best(i, made, inserts - 1))
            if i < len(mine):
                go(3, "D", None, best(i + 1, state, 3))
                if faults[i] in ("", "truncated"):
                    extra = faults[i] == "truncated"
                    role, text = mine[i][2:]
                    if (state, role[:1]) in NEXT:
                        go(extra, "K", f"{role}:{text}", best(i + 1, role[:1], 3))
                    go(2 + extra, "R", f"{name}:{text}", best(i + 1, made, 3))
            return min(ways) if ways else None

        cost, audit, lines = best(0, "", 3)
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
                     sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:])), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def cases(seed=3, convs=60):
    rng, rows = random.Random(seed), []
    for c in range(convs):
        for t in range(rng.randint(1, 12)):
            role = rng.choice(("user", "assistant", "user", "assistant", "system", "tool", "", "USER", "sage", None))
            text = rng.choice(("Yes.", "No!", "What?", "cut off", " \n", "", "é ß.", "a\nb.", "Yes. ", None, f"turn {t}."))
            rows.append((c, rng.choice((t, t, t, t + 2, None)), role, text))
    rows += [(None, None, None, None), (None, 1, "user", "x."), (None, 2, "assistant", "y."), rows[0], rows[5], rows[5]]
    hot = [(-1, t, rng.choice(("user", "assistant", "system")), rng.choice(("Well.", "So", "Good!")) + (str(t) + "." if t % 3 else "")) for t in range(300)]
    return rows + hot


def found(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    return {r.conv_id: tuple(r)[1:] for r in cr.repair(df.repartition(3)).collect()}


def test_against_plain_version(spark):
    rows = cases()
    assert found(spark, rows) == plain(rows)


def test_pieces_and_tasks_do_not_matter(spark, monkeypatch):
    rows = [r for r in cases(9, 10) if r[0] is None or r[0] < 4] + [(2, 5, "user", "Again.")] * 40
    want = plain(rows)
    real = cr._pieces

    def small(batches):
        cr.PIECE_STEPS, cr.PIECE_CHARS = 7, 60
        try:
            yield from real(batches)
        finally:
            cr.PIECE_STEPS, cr.PIECE_CHARS = 4096, 4_000_000

    monkeypatch.setattr(cr, "_pieces", small)
    assert found(spark, rows) == want


def test_order_of_results_is_one_row_each(spark):
    assert cr.repair(spark.createDataFrame([], SCHEMA)).count() == 0
    dropped = next((c, t) for c in range(100) for t in range(100) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)
    assert found(spark, [(*dropped, "user", "x.")]) == {dropped[0]: (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())}
    long = [(1, t, "user" if t % 2 == 0 else "assistant", "x" * 200_000 + f"{t}.") for t in range(4)]
    assert found(spark, long) == plain(long)
