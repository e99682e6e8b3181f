"""Plain versions of what the operators compute, for small fixtures."""

import hashlib
import math
import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, row string, size int, `key` string, token array<int>, hot boolean"


def frame(spark, rows):
    """Documents from (doc_id, text, source), with extra columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 7, "r", 1, "k", [1], True) for i, t, s in rows], SCHEMA)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text, width=5):
    words = WORD.findall(lower(text))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + width]) for i in range(len(words) - width + 1)) if len(words) >= width else frozenset([tuple(words)])


def components(rows):
    sets = [(i, shingles(t)) for i, t, *_ in rows]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, x in sets:
        for b, y in sets:
            if a < b and x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: (len(s), find(i)) for i, s in sets}


def sizes(text):
    return len(WORD.findall(text or ""))


def mix(rows):
    """taken words per document id, and source -> target."""
    order = sorted({s for _, _, s in rows if s is not None}) + ([None] if any(s is None for *_, s in rows) else [])
    size = {s: sum(sizes(t) for _, t, u in rows if u == s) for s in order}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    left, capped = 1.5 * sum(size.values()), {}
    while True:
        free = [s for s in order if s not in capped]
        level = (1.5 * sum(size.values()) - sum(capped.values())) / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if level * weight[s] > 2 * size[s]]
        if not over:
            break
        capped |= {s: 2 * size[s] for s in over}
    target = {s: capped.get(s, level * weight[s]) for s in order}
    taken = {}
    for s in order:
        keyed = []
        for i, t, u in rows:
            if u == s:
                n, chars = sizes(t), len(t or "")
                w = 1.0 if n >= 20 and 3 * n <= chars <= 12 * n else 0.25
                u01 = (2 * int(hashlib.md5(str(i).encode()).hexdigest()[:13], 16) + 1) / 2 ** 53
                keyed.append((-math.log(u01) / w, i, n))
        epochs = int(target[s] // size[s]) if size[s] else 0
        rest = round(target[s] - epochs * size[s])
        for _, i, n in sorted(keyed):
            taken[i] = epochs * n + max(0, min(n, rest))
            rest -= n
    return taken, target


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8))) for _ in range(n))


def documents(seed=5, groups=12):
    """Originals, exact copies, near copies, short and odd texts; (doc_id, text, source)."""
    rng, rows = random.Random(seed), []
    for g in range(groups):
        words = prose(rng, rng.randint(25, 160)).split()
        for _ in range(rng.choice((1, 1, 3, 9))):
            copy = list(words)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = prose(rng, 1)
            rows.append(" ".join(copy))
        rows.append(" ".join(words).upper())
    rows += [None, "", " \n\t ", "one", "One", "one two three", "a b c d", "a b c d e", "a b c d e f", "é ü ß"]
    rng.shuffle(rows)
    return [(10 + 3 * k, t, rng.choice(("s1", "s1", "s1", "s2", "s3", None))) for k, t in enumerate(rows)]
