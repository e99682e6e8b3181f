"""Approximate nearest neighbours by inner product: one robust-pruned directed graph per shard.

Every usable vector is dealt to a shard by a hash of its id.  A shard builds its graph in batches: greedy searches from a
central vector propose neighbours, relaxed distance pruning keeps diverse edges, and reverse edges are added and pruned
alike.  Queries are beam-searched in each shard, the candidates are scored in double precision on the original vectors,
and the best of all shards are merged.  Inner product becomes a distance by one more coordinate that makes all lengths
of a shard equal.

Shards and blocks of queries are bounded, so no task holds a table whole; a shard's graph is stored once in the shared
folder and met by each block of queries.  Equal vectors of a shard are one node with a list of ids.

Edge cases: vectors that are null, zero, or hold null or non-finite components take no part, as candidates or queries,
nor do those of another length than most have; ties go to the smaller ``vec_id``; with fewer candidates than wanted all
are returned; rows that repeat a ``vec_id`` count once; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.session import materialize

#: Vectors of a shard; its task holds about 3 KB for each while it builds.
SHARD_ROWS = 8192
#: Queries that are searched in a shard by one task.
QUERY_ROWS = 4096
DEGREE = 40
BUILD_BEAM = 64
BEAM = 192
RELAX = 1.2
#: Vectors and queries that are handled at a time.
BATCH = 256
#: Nodes that a search opens in each step.
OPEN = 4
EVERY = 20
WANTED = 20


def _beam(points: np.ndarray, graph: np.ndarray, start: int, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query the ``beam`` best nodes found and their products, best first; -1 where there are fewer."""
    q, n = len(queries), len(points)
    seen = np.zeros((q, n + 1), bool)
    seen[:, [start, n]] = True
    best = np.full((q, beam), n)
    score = np.full((q, beam), -np.inf, np.float32)
    opened = np.zeros((q, beam), bool)
    best[:, 0], score[:, 0] = start, queries @ points[start]
    active = np.arange(q)
    while len(active):
        closed = opened[active] | (best[active] == n)
        places = np.argsort(closed, axis=1, kind="stable")[:, :OPEN]
        nodes = np.take_along_axis(best[active], places, 1)
        nodes[np.take_along_axis(closed, places, 1)] = n
        opened[active[:, None], places] = True
        around = np.where((nodes < n)[:, :, None], graph[np.minimum(nodes, n - 1)], n).reshape(len(active), -1)
        around[around < 0] = n
        around.sort(axis=1)
        around[:, 1:][around[:, 1:] == around[:, :-1]] = n
        around[seen[active[:, None], around]] = n
        seen[active[:, None], around] = True
        gain = np.einsum("qrd,qd->qr", points[np.minimum(around, n - 1)], queries[active])
        gain[around == n] = -np.inf
        allv, alls = np.concatenate([best[active], around], 1), np.concatenate([score[active], gain], 1)
        allo = np.concatenate([opened[active], np.zeros(around.shape, bool)], 1)
        order = np.argsort(-alls, axis=1, kind="stable")[:, :beam]
        best[active], score[active] = np.take_along_axis(allv, order, 1), np.take_along_axis(alls, order, 1)
        opened[active] = np.take_along_axis(allo, order, 1)
        active = active[(~opened[active] & (best[active] < n)).any(axis=1)]
    return np.where(best == n, -1, best), score


def _prune(points: np.ndarray, square: float, own: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """DEGREE edges for each of ``own`` out of its candidates (-1: none).

    The nearest candidate becomes an edge and strikes out those that are much nearer to it than to the vector itself.
    """
    near = points[np.maximum(candidates, 0)]
    apart = np.maximum(2 * square - 2 * np.einsum("bcd,bd->bc", near, points[own]), 0)
    apart[(candidates < 0) | (candidates == own[:, None])] = np.inf
    order = np.argsort(apart, axis=1, kind="stable")
    candidates, apart = np.take_along_axis(candidates, order, 1), np.take_along_axis(apart, order, 1)
    again = np.zeros(candidates.shape, bool)
    ranked = np.argsort(candidates, axis=1, kind="stable")
    sorted_ids = np.take_along_axis(candidates, ranked, 1)
    repeat = np.zeros(candidates.shape, bool)
    repeat[:, 1:] = sorted_ids[:, 1:] == sorted_ids[:, :-1]
    np.put_along_axis(again, ranked, repeat, 1)
    apart[again] = np.inf
    near = np.take_along_axis(near, order[:, :, None], 1)
    between = np.maximum(2 * square - 2 * np.matmul(near, near.transpose(0, 2, 1)), 0)
    out = np.full((len(own), DEGREE), -1, np.int32)
    live = apart.copy()
    every = np.arange(len(own))
    for k in range(DEGREE):
        pick = np.argmin(live, axis=1)
        there = np.isfinite(live[every, pick])
        if not there.any():
            break
        out[there, k] = candidates[every, pick][there]
        live[RELAX * RELAX * between[every, pick] <= apart] = np.inf
        live[every, pick] = np.inf
    return out


def build(vectors: np.ndarray) -> tuple[np.ndarray, int]:
    """(edges, start) of the graph over distinct vectors."""
    n = len(vectors)
    lengths = (vectors * vectors).sum(axis=1)
    square = float(lengths.max())
    points = np.concatenate([vectors, np.sqrt(np.maximum(square - lengths, 0))[:, None]], 1).astype(np.float32)
    start = int(np.argmax(points @ points.mean(axis=0)))
    graph = np.full((n, DEGREE), -1, np.int32)
    order = np.random.default_rng(n).permutation(n)
    order = np.concatenate([[start], order[order != start]])
    done = 1
    while done < n:
        batch = order[done:done + min(BATCH, max(1, done))]
        found, _ = _beam(points, graph, start, points[batch], BUILD_BEAM)
        graph[batch] = _prune(points, square, batch, found)
        source = np.repeat(batch, DEGREE)
        target = graph[batch].ravel()
        source, target = source[target >= 0], target[target >= 0]
        by = np.argsort(target, kind="stable")
        source, target = source[by], target[by]
        heads, first, counts = np.unique(target, return_index=True, return_counts=True)
        wide = int(counts.max()) if len(counts) else 0
        come = np.full((len(heads), wide), -1, np.int32)
        come[np.repeat(np.arange(len(heads)), counts), np.arange(len(target)) - np.repeat(first, counts)] = source
        held = (graph[heads] >= 0).sum(axis=1)
        fits = held + counts <= DEGREE
        for h, c, k, m in zip(heads[fits], come[fits], held[fits], counts[fits], strict=True):
            graph[h, k:k + m] = c[:m]
        full = np.flatnonzero(~fits)
        for a in range(0, len(full), BATCH):
            some = full[a:a + BATCH]
            for b in range(0, wide, 2 * DEGREE):  # a node that many name is pruned in steps
                part = come[some, b:b + 2 * DEGREE]
                graph[heads[some]] = _prune(points, square, heads[some], np.concatenate([graph[heads[some]], part], 1))
        done += len(batch)
    return graph, start


def search(vectors: np.ndarray, graph: np.ndarray, start: int, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per query the nodes found (-1: none) and their exact inner products."""
    points = vectors.astype(np.float32)
    nodes, scores = [], []
    for a in range(0, len(queries), BATCH):
        some = queries[a:a + BATCH]
        found, _ = _beam(points, graph, start, some.astype(np.float32), min(BEAM, len(vectors)))
        exact = np.einsum("qrd,qd->qr", vectors[np.maximum(found, 0)], some)
        nodes.append(found)
        scores.append(np.where(found < 0, -np.inf, exact))
    return np.concatenate(nodes), np.concatenate(scores)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _build_group(table: pa.Table) -> pa.Table:
    ids, rows = table.column("vec_id").to_numpy(), _matrix(table.column("v"))
    order = np.argsort(ids, kind="stable")
    ids, rows = ids[order], rows[order]
    vectors, node = np.unique(rows, axis=0, return_inverse=True)
    order = np.argsort(node.ravel(), kind="stable")
    bounds = np.searchsorted(node.ravel()[order], np.arange(len(vectors) + 1))
    graph, start = build(vectors)
    return pa.table({"shard": table.column("shard")[:1], "start": pa.array([start], pa.int32()), "vectors": pa.array([vectors.tobytes()], pa.binary()),
                     "graph": pa.array([graph.tobytes()], pa.binary()), "ids": pa.array([ids[order].tobytes()], pa.binary()), "bounds": pa.array([bounds.astype(np.int64).tobytes()], pa.binary())})


def _search_group(shard: pa.Table, queries: pa.Table) -> pa.Table:
    if not shard.num_rows or not queries.num_rows:
        return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
    wanted, ask = queries.column("query_id").to_numpy(), _matrix(queries.column("v"))
    vectors = np.frombuffer(shard.column("vectors")[0].as_buffer(), np.float64).reshape(-1, ask.shape[1])
    graph = np.frombuffer(shard.column("graph")[0].as_buffer(), np.int32).reshape(len(vectors), -1)
    ids, bounds = (np.frombuffer(shard.column(c)[0].as_buffer(), np.int64) for c in ("ids", "bounds"))
    out: list[list] = [[], [], []]
    nodes, scores = search(vectors, graph, shard.column("start")[0].as_py(), ask)
    for q, found, score in zip(wanted.tolist(), nodes, scores, strict=True):
        good = found >= 0
        found, score = found[good], score[good]
        counts = np.minimum(bounds[found + 1] - bounds[found], WANTED + 1)
        at = np.repeat(bounds[found], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        name, value = ids[at], np.repeat(score, counts)
        keep = name != q
        name, value = name[keep], value[keep]
        top = np.lexsort((name, -value))[:WANTED]
        out[0] += [q] * len(top)
        out[1] += name[top].tolist()
        out[2] += value[top].tolist()
    return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], ["query_id", "vec_id", "score"])


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of the vectors that take part, v in double precision."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = v.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~bad & F.exists("v", lambda x: x != 0)).dropDuplicates(["vec_id"])
    size = v.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").select("d").head()
    return v.where(F.size("v") == (size["d"] if size else 0))


def nearest(vectors: DataFrame, every: int = EVERY, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """For each vector whose id is divisible by ``every`` its WANTED nearest others by inner product."""
    v = materialize(usable(vectors), "vectors")
    total = v.count()
    shards = max(1, -(-total // shard_rows))
    blocks = max(1, -(-total // (every * QUERY_ROWS)))
    built = materialize(
        v.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")).groupBy("shard")
        .applyInArrow(_build_group, "shard int, start int, vectors binary, graph binary, ids binary, bounds binary"), "graphs")
    laid = built.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = (v.where(F.pmod("vec_id", F.lit(every)) == 0).withColumnRenamed("vec_id", "query_id")
             .withColumn("block", F.pmod(F.xxhash64("query_id", F.lit(1)), F.lit(blocks)).cast("int"))
             .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))))
    found = (laid.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block"))
             .applyInArrow(_search_group, "query_id long, vec_id long, score double"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= WANTED).select("query_id", "rank", "vec_id", "score")
