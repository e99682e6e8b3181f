"""Similarity join on word shingles by vertical partitioning of the shingle order.

Two documents link when ``100 * |A & B| >= 80 * |A | B|`` for their sets of distinct shingles.  The result is exact.

1. *Sets.*  Each text becomes a sorted array of 64-bit shingle hashes.  Documents with equal sets form a class; the
   smallest ``doc_id`` stands for it, so exact copies cost one row each from here on.
2. *Fragments.*  The global shingle order is cut into ranges.  Every set is cut at the same places and its pieces are
   sent to their fragments (packed, a few bytes per shingle).  Within a fragment the shingles that only one document has
   fall out at once.  The few thousand most frequent shingles skip this step: they are known to be shared, and no
   fragment grows with them.
3. *Prefixes.*  A document links to nothing if more than a fifth of its set is its own.  Of the others only the
   rarest shared shingles, as many as a linked pair cannot all miss, become index rows.
4. *Candidates.*  Index rows of one shingle meet in blocks of bounded size.  A block keeps the pairs that a bitmap of
   both sets cannot rule out, and hands on only a minimum spanning forest of them: a group of n near copies makes
   fewer than n pairs per block.  Up to 1,024 classes of a shingle are one block; beyond that each index row is laid in
   ceil(n / 512) slices and every block has its own forest, so laid rows and pairs grow with the square of n too.
5. *Counts.*  For each candidate pair both whole sets of shared shingles are joined into one row, and the sizes of four
   intersections, one per quarter of the order, are added there.  This equals one intersection of the whole sets: it is
   not a count per fragment with a grouped sum, which it was before.  Long sets are carried whole once per candidate
   pair.  Linked pairs are merged into components by a star contraction.
6. *Rest.*  Pairs of one shingle that are still in different components and pass sharper tests are counted the same
   way, so no link is lost; by the spanning forest they are few.

Edge cases: a null or blank text has an empty set and stands alone; a text of fewer words than the width has one shingle;
rows that repeat a ``doc_id`` must repeat its text and give one result row each; a row without ``doc_id`` has no
component.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.wordhash import blocks, mix, shingle_sets
from riskloom.session import materialize

#: Shingles a fragment should hold; its task keeps about 30 bytes for each.
FRAGMENT_SHINGLES = 1_000_000
#: Shingles that a map task packs at a time.
CHUNK_SHINGLES = 1_000_000
#: So many of the most frequent shingles go round the fragments (8 bytes each in every task's closure).
HOT_SHINGLES = 8192
#: Index rows of one shingle that are compared in one go.
BLOCK_ROWS = 1024
BITMAP_WORDS = 32
#: Sets of up to this size are compared by 32-bit shingles in the last step, larger ones by a bitmap alone.
SMALL_SET = 2048


def _linked_least(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    """Shingles that a linked partner shares at least with a set of n."""
    return -(-percent * n // 100)


def _fingerprints(sets: list[np.ndarray]) -> tuple[list[int], list[int]]:
    one, two = [], []
    for s in sets:
        with np.errstate(over="ignore"):
            one.append(int(s.sum(dtype=np.uint64).view(np.int64)))
            two.append(int(np.bitwise_xor.reduce(mix(s)).view(np.int64)) if len(s) else 0)
    return one, two


def _set_rows(width: int):
    """(doc_id, n, f1, f2) per text; with doc_id and n null, (f1, f2) is a locally frequent shingle and its count."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("hot", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for block in blocks(batch.column("text")):
                sets = list(shingle_sets(block, width))
                one, two = _fingerprints(sets)
                ids = batch.column("doc_id").slice(at, len(sets)).cast(pa.int64())
                at += len(sets)
                yield pa.RecordBatch.from_arrays([ids, pa.array(list(map(len, sets)), pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(np.zeros(len(sets), bool))], schema=schema)
                if len(sets) < 64:
                    continue
                seen, counts = np.unique(np.concatenate(sets), return_counts=True)
                often = np.flatnonzero(counts >= max(8, len(sets) // 64))
                often = often[np.argsort(-counts[often], kind="stable")][:HOT_SHINGLES // 4]
                none = pa.nulls(len(often), pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, pa.array(seen[often].view(np.int64)), pa.array(counts[often], pa.int64()), pa.array(np.ones(len(often), bool))], schema=schema)

    return run


def _pack(tokens: np.ndarray, ids: np.ndarray) -> bytes:
    """Tokens in ascending order as differences, both columns as byte planes, compressed."""
    steps = np.diff(tokens, prepend=np.uint64(0))
    planes = np.concatenate([steps.view(np.uint8).reshape(-1, 8).T.ravel(), ids.view(np.uint8).reshape(-1, 8).T.ravel()])
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    n = len(planes) // 16
    steps, ids = (planes[k * 8 * n:(k + 1) * 8 * n].reshape(8, n).T.copy().view(np.uint64).ravel() for k in (0, 1))
    return np.cumsum(steps, dtype=np.uint64), ids.view(np.int64)


def _fragment_rows(width: int, fragments: int, hot: np.ndarray):
    """(fragment, blob) for ordinary shingles; (-1, blob) for those that are known to be frequent."""
    schema = pa.schema([("fragment", pa.int32()), ("blob", pa.binary())])
    step = (1 << 64) // fragments + 1

    def flush(ids: list[int], sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        one, two = _fingerprints(sets)
        first: dict[tuple, int] = {}
        for i in sorted(range(len(ids)), key=ids.__getitem__):
            first.setdefault((len(sets[i]), one[i], two[i]), i)
        keep = list(first.values())
        tokens = np.concatenate([sets[i] for i in keep])
        owner = np.repeat(np.array([ids[i] for i in keep], np.int64), [len(sets[i]) for i in keep])
        order = np.argsort(tokens, kind="stable")
        tokens, owner = tokens[order], owner[order]
        names, blobs = [], []
        if len(hot):
            at = np.searchsorted(hot, tokens)
            known = hot[np.minimum(at, len(hot) - 1)] == tokens
            if known.any():
                names.append(-1)
                blobs.append(_pack(tokens[known], owner[known]))
                tokens, owner = tokens[~known], owner[~known]
        cuts = np.searchsorted(tokens, np.array([min(k * step, (1 << 64) - 1) for k in range(fragments)], np.uint64))
        for k, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(tokens)], strict=True)):
            if b > a:
                names.append(k)
                blobs.append(_pack(tokens[a:b], owner[a:b]))
        for a in range(0, len(names), 64):
            yield pa.RecordBatch.from_arrays([pa.array(names[a:a + 64], pa.int32()), pa.array(blobs[a:a + 64], pa.binary())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sets, held = [], [], 0
        for batch in batches:
            names, at = batch.column("doc_id").to_pylist(), 0
            for block in blocks(batch.column("text")):
                for s in shingle_sets(block, width):
                    if len(s) and names[at] is not None:
                        ids.append(int(names[at]))
                        sets.append(s)
                        held += len(s)
                    at += 1
                if held >= CHUNK_SHINGLES:
                    yield from flush(ids, sets)
                    ids, sets, held = [], [], 0
        if ids:
            yield from flush(ids, sets)

    return run


def _shared_rows(hot: np.ndarray, hot_rank: np.ndarray):
    """(doc_id, token, rank) of the shingles that at least two documents have; rank orders them, rarest first."""
    schema = pa.schema([("doc_id", pa.int64()), ("token", pa.int64()), ("rank", pa.int64())])

    def emit(owner, token, rank) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(owner), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(owner[a:a + 100_000]), pa.array(token[a:a + 100_000].view(np.int64)), pa.array(rank[a:a + 100_000])], schema=schema)

    def close(parts: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        tokens, owner = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(tokens, kind="stable")
        tokens, owner = tokens[order], owner[order]
        begin = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
        times = np.repeat(np.diff(begin, append=len(tokens)), np.diff(begin, append=len(tokens)))
        shared = times > 1
        yield from emit(owner[shared], tokens[shared], times[shared].astype(np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []
        for batch in batches:
            for fragment, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                tokens, owner = _unpack(blob.as_buffer().to_pybytes())
                if fragment < 0:
                    yield from emit(owner, tokens, hot_rank[np.searchsorted(hot, tokens)])
                    continue
                if fragment != now and parts:
                    yield from close(parts)
                    parts = []
                now = fragment
                parts.append((tokens, owner))
        if parts:
            yield from close(parts)

    return run


def _survivor_rows(percent: int):
    """One row for each class that can still link, out of rows sorted by doc_id and rank (-1: the set's size)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("bitmap", pa.list_(pa.int64())), ("prefix", pa.list_(pa.int64())), ("tokens", pa.list_(pa.int64())),
                        ("coarse", pa.list_(pa.int64())), ("short", pa.list_(pa.int32())), ("merged", pa.int64())])

    def one(doc: int, token: np.ndarray, rank: np.ndarray):
        if rank[0] != -1:
            return None  # not the representative of its class
        n = int(token[0])
        token, rank = token[1:], rank[1:]
        if len(token) > 1 and (token[1:] == token[:-1]).any():  # the row is there more than once
            fresh = np.concatenate([[True], (token[1:] != token[:-1]) | (rank[1:] != rank[:-1])])
            token, rank = token[fresh & (rank != -1)], rank[fresh & (rank != -1)]
        need = _linked_least(n, percent)
        own = n - len(token)
        if len(token) < need or not len(token):
            return None
        bits = np.zeros(BITMAP_WORDS * 64, np.uint8)
        bits[mix(token.view(np.uint64)) % np.uint64(len(bits))] = 1
        bitmap = np.packbits(bits).view(np.int64)
        short = np.unique(token.astype(np.int32)) if n <= SMALL_SET else None
        return (doc, n, bitmap, token[:n - need + 1 - own], np.sort(token), np.bitwise_or.reduce(bitmap.reshape(-1, BITMAP_WORDS // 2)), short,
                0 if short is None else len(token) - len(short))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[tuple[int, np.ndarray, np.ndarray]] = []
        for batch in batches:
            ids, tokens, ranks = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            begin = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])) if len(ids) else []
            done = []
            for a, b in zip(begin, [*begin[1:], len(ids)], strict=True):
                if rest and rest[0][0] != ids[a]:
                    done.append((rest[0][0], *(np.concatenate(x) for x in list(zip(*rest, strict=True))[1:])))
                    rest = []
                rest.append((int(ids[a]), tokens[a:b].copy() if b == len(ids) else tokens[a:b], ranks[a:b].copy() if b == len(ids) else ranks[a:b]))
            yield from rows(done)
        if rest:
            yield from rows([(rest[0][0], *(np.concatenate(x) for x in list(zip(*rest, strict=True))[1:]))])

    def rows(done) -> Iterator[pa.RecordBatch]:
        kept = [x for x in (one(*d) for d in done) if x]
        if kept:
            cols = list(zip(*kept, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, schema, strict=True)], schema=schema)

    return run


def _forest_rows(percent: int):
    """Edges (a, b) of a minimum spanning forest of each block's possible pairs, out of rows sorted by block."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def edges(ids: np.ndarray, n: np.ndarray, maps: np.ndarray) -> Iterator[tuple[int, int]]:
        if len(ids) < 2:
            return
        # Prim's algorithm on the distances that are small enough; far means no edge
        far = np.iinfo(np.int64).max
        best, link = np.full(len(ids), far), np.full(len(ids), -1)
        left = np.ones(len(ids), bool)
        i = 0
        while True:
            left[i] = False
            if link[i] >= 0:
                yield tuple(sorted((int(ids[i]), int(ids[link[i]]))))
            rest = np.flatnonzero(left)
            if not len(rest):
                return
            apart = np.bitwise_count(maps[rest] ^ maps[i]).sum(axis=1, dtype=np.int64)
            both = n[rest] + n[i]
            near = (apart * (100 + percent) <= (100 - percent) * both) & (100 * np.minimum(n[rest], n[i]) >= percent * np.maximum(n[rest], n[i]))
            shorter = near & (apart < best[rest])
            best[rest[shorter]], link[rest[shorter]] = apart[shorter], i
            i = rest[np.argmin(best[rest])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        key, held = None, []

        def close() -> list[tuple[int, int]]:
            ids = np.concatenate([h[0] for h in held])
            ids, at = np.unique(ids, return_index=True)
            members = ids.tobytes()
            if members in seen:
                return []
            if len(seen) < 100_000:
                seen.add(members)
            n, maps = (np.concatenate([h[k] for h in held])[at] for k in (1, 2))
            return list(edges(ids, n, maps))

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(5)]
            maps = batch.column(5).flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, BITMAP_WORDS)
            change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols[:3]], axis=0)) + 1
            out = []
            for a, b in zip([0, *change], [*change, batch.num_rows], strict=True):
                name = tuple(int(c[a]) for c in cols[:3])
                if name != key and held:
                    out += close()
                    held = []
                key = name
                held.append((cols[3][a:b].copy(), cols[4][a:b].copy(), maps[a:b]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], schema=schema)
        if held and (out := close()):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], schema=schema)

    return run


def _linked(pairs: DataFrame, survivors: DataFrame, percent: int) -> DataFrame:
    """Those of the distinct pairs (a, b) that link: overlaps are counted per quarter of the order and summed."""
    def cut(k: int):
        return F.filter("tokens", lambda t: F.shiftrightunsigned(t, 62) == k)

    pieces = survivors.select("doc_id", "n", F.array(*map(cut, range(4))).alias("pieces"))
    left = pieces.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("pieces").alias("pa"))
    right = pieces.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("pieces").alias("pb"))
    partial = F.zip_with("pa", "pb", lambda x, y: F.size(F.array_intersect(x, y)))
    total = (pairs.join(left, "a").join(right, "b")
             .select("a", "b", "na", "nb", F.aggregate(partial, F.lit(0).cast("long"), lambda s, c: s + c).alias("common")))
    return total.where(100 * F.col("common") >= percent * (F.col("na") + F.col("nb") - F.col("common"))).select("a", "b")


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node of the undirected links (a, b); root is the smallest node that it reaches.

    Alternating star contraction; each round is written to the shared folder, so a lost executor repeats one round only.
    The number of rounds grows with the logarithm of the longest chain.
    """
    def stored(pairs: DataFrame) -> tuple[DataFrame, tuple]:
        table = materialize(pairs.distinct(), name)
        return table, tuple(table.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head())

    edges, now = stored(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    before = None
    while now != before:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        pulled = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before = now
        edges, now = stored(pulled.unionByName(low.select("u", F.col("m").alias("v"))))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def similarity_components(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: ``doc_id``, ``n_shingles`` and ``component_id`` (smallest doc_id reachable by links).

    Runs Spark jobs while it is called: sizes are needed to cut the fragments, and components need rounds.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = materialize(texts.mapInArrow(_set_rows(width), "doc_id long, n long, f1 long, f2 long, hot boolean"), "sets")
    sets = found.where("not hot").drop("hot")
    named = sets.where("doc_id is not null and n > 0")
    total = named.agg(F.sum("n")).head()[0] or 0
    hot = (found.where("hot").groupBy(F.col("f1").alias("token")).agg(F.sum("f2").alias("times"))
           .orderBy(F.desc("times"), "token").limit(HOT_SHINGLES).collect())
    hot_token = np.array([r["token"] for r in hot], np.int64).view(np.uint64)
    order = np.argsort(hot_token)
    hot_token, hot_rank = hot_token[order], np.array([r["times"] for r in hot], np.int64)[order] + (1 << 40)

    classes = named.groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("rep"))
    width_of = int(spark.conf.get("spark.sql.shuffle.partitions"))
    fragments = max(2 * width_of, -(-total // FRAGMENT_SHINGLES))
    parts = max(width_of, -(-total // (4 * FRAGMENT_SHINGLES)))
    shared = (texts.mapInArrow(_fragment_rows(width, fragments, hot_token), "fragment int, blob binary")
              .withColumn("spread", F.when(F.col("fragment") < 0, F.xxhash64("blob")).otherwise(0))
              .repartition(parts, "fragment", "spread").sortWithinPartitions("fragment").drop("spread")
              .mapInArrow(_shared_rows(hot_token, hot_rank), "doc_id long, token long, rank long"))
    sizes = classes.select(F.col("rep").alias("doc_id"), F.col("n").alias("token"), F.lit(-1).cast("long").alias("rank"))
    survivors = materialize(
        shared.unionByName(sizes).repartition(parts, "doc_id").sortWithinPartitions("doc_id", "rank", "token")
        .mapInArrow(_survivor_rows(percent), "doc_id long, n long, bitmap array<long>, prefix array<long>, tokens array<long>, coarse array<long>, short array<int>, merged long"),
        "survivors")

    index = survivors.select("doc_id", F.explode("prefix").alias("token"))
    many = index.groupBy("token").agg(F.count("*").alias("rows")).where("rows > 1")
    index = materialize(index.join(many, "token"), "index")  # slim rows; bitmaps join them only where they are compared
    slices = F.when(F.col("rows") <= BLOCK_ROWS, 1).otherwise(F.ceil(F.col("rows") / (BLOCK_ROWS // 2)).cast("int"))
    laid = (index.withColumn("slices", slices).withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("slices")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
            .select("token", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "doc_id")
            .join(survivors.select("doc_id", "n", "bitmap"), "doc_id")
            .select("token", "low", "high", "doc_id", "n", "bitmap"))
    forest = materialize(
        laid.repartition(width_of, "token", "low", "high").sortWithinPartitions("token", "low", "high")
        .mapInArrow(_forest_rows(percent), "a long, b long").distinct(), "forest")
    links = _linked(forest, survivors, percent)
    first = materialize(components(links, "stars"), "components")

    held = index.join(first, F.col("doc_id") == F.col("node"), "left").select("token", "doc_id", F.coalesce("root", "doc_id").alias("root"))
    mixed = held.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("token")
    held = held.join(mixed, "token", "left_semi").join(survivors.select("doc_id", "n", "coarse", "prefix", "short", "merged"), "doc_id")
    x, y = (held.select(*[F.col(c).alias(f"{side}_{c}") for c in held.columns]) for side in "xy")
    both = F.col("x_n") + F.col("y_n")
    common = F.size(F.array_intersect("x_short", "y_short")) + F.col("x_merged") + F.col("y_merged")  # never less than it is
    possible = ((F.col("x_token") == F.col("y_token")) & (F.col("x_doc_id") < F.col("y_doc_id")) & (F.col("x_root") != F.col("y_root"))
                & (100 * F.least("x_n", "y_n") >= percent * F.greatest("x_n", "y_n"))
                & (_bits_apart(F.col("x_coarse"), F.col("y_coarse")) * (100 + percent) <= (100 - percent) * both)
                & (F.col("x_short").isNull() | F.col("y_short").isNull() | (common * (100 + percent) >= percent * both))
                & (F.array_min(F.array_intersect("x_prefix", "y_prefix")) == F.col("x_token")))  # each pair once
    rest = materialize(x.join(y, possible).select(F.col("x_doc_id").alias("a"), F.col("y_doc_id").alias("b"))
                       .join(forest, ["a", "b"], "left_anti"), "rest")
    late = materialize(_linked(rest, survivors, percent), "late")
    if late.limit(1).count():
        first = materialize(components(first.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(late), "stars"), "components")

    rooted = classes.join(first, F.col("rep") == F.col("node"), "left").select("n", "f1", "f2", F.coalesce("root", "rep").alias("root"))
    return (sets.join(rooted, ["n", "f1", "f2"], "left")
            .select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.when(F.col("doc_id").isNotNull(), F.col("root"))).otherwise(F.col("doc_id")).alias("component_id")))


def one_of_each_group(docs: DataFrame, broadcast_ids: int = 1_000_000, **settings) -> DataFrame:
    """The documents without those that a document of smaller id stands for; rows of one ``doc_id`` count as one.

    Only the ids to leave out meet the texts.  Up to ``broadcast_ids`` of them (8 bytes each) are broadcast after they
    were counted; beyond that the join is left to the engine.
    """
    found = materialize(similarity_components(docs, **settings), "groups")
    extra = materialize(found.where("component_id <> doc_id").select("doc_id").distinct(), "left-out")
    if extra.count() <= broadcast_ids:
        extra = F.broadcast(extra)
    kept = docs.join(extra, "doc_id", "left_anti").select(*docs.columns)
    again = materialize(found.where("component_id = doc_id").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    if again.limit(1).count():
        kept = kept.join(again, "doc_id", "left_anti").unionByName(kept.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    return kept.select(*docs.columns)


def _bits_apart(x, y):
    """Bits in which two bitmaps differ."""
    return sum((F.bit_count(x[k].bitwiseXOR(y[k])) for k in range(1, BITMAP_WORDS // 2)), F.bit_count(x[0].bitwiseXOR(y[0])))
