"""Removal of repeated passages with a suffix array that is sorted deep-shallow.

A byte goes when a string of ``SPAN`` bytes covers it that starts anywhere else too.  Suffixes are sorted by their first
``SPAN`` bytes only: by the first word, then by multikey quicksort (ternary, a word at a time) to a shallow depth; groups
that are still together have long common prefixes and go through blind tries, of which only the places of branching and the
branching bytes are looked at.  Suffixes that end up in one leaf are repeated.

Not every suffix is sorted.  Each string of ``SPAN`` bytes has an anchor: the least hash among its ``GRAM``-byte grams, which
equal strings share.  Anchors are counted first, combined in each task; strings whose anchor occurs once are unique.  The
others are dealt by anchor, as runs of neighbouring strings with one anchor, so equal strings meet in one bucket.  Which
anchors repeat is told to the tasks by a bitmap of at most ``MOST_BITS``; where it fills up, more unique strings are sorted,
and results stay the same.  Anchors with more than ``HOT`` places (or a millionth of all, whichever is more) are salted:
each salt sorts its share, and what it found once, with one string of each group that it found repeated, is dealt by the
string's own digest and counted again.  No task holds the places of a frequent anchor.

Equal texts are one text with a number, combined in each task.  Texts are dealt once, by digest, and kept in buckets, so they
are not shuffled again when spans come back.

Edge cases: null counts as empty; texts of fewer than ``SPAN`` bytes keep all; rows that repeat a ``doc_id`` are separate
rows, and equal texts, whatever their ids, lose everything; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.session import materialize, scratch_path

SPAN = 200
GRAM = 32
_REACH = SPAN - GRAM + 1
#: Bytes that multikey quicksort looks at before blind tries take over; a multiple of eight.
SHALLOW = 32
#: Strings that are looked at together, and in one run.
CHUNK, RUN = 1 << 20, 4096
BUCKET_BYTES = 4 << 20
MOST_BITS = 28
HOT = 1024
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_LETTER = np.random.default_rng(12).integers(1, 1 << 63, 256, np.uint64)
_FOUND = "key binary, start long, stop long, digest binary"
_RESULT = "key binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


# anchors

def _sliding(values: np.ndarray, width: int, choose: np.ufunc) -> np.ndarray:
    """Least or greatest of each ``width`` neighbours, by doubling."""
    size = 1
    while 2 * size <= width:
        values = choose(values[:-size], values[size:])
        size *= 2
    return choose(values[:len(values) - (width - size)], values[width - size:]) if size < width else values


def _grams(raw: np.ndarray) -> np.ndarray:
    """A well mixed hash of the gram at each byte."""
    h, size, factor = _LETTER[raw], 1, _FACTOR
    with np.errstate(over="ignore"):
        while size < GRAM:
            h = h[:-size] * factor + h[size:]
            size, factor = 2 * size, factor * factor
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(27)
    return h


def _chunks(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, first byte of each text, its row, its place in the row's text); long texts overlap by what strings need."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    held, parts = 0, []

    def together():
        sizes = np.array([to - at for _, at, to in parts])
        rows = np.array([r for r, *_ in parts])
        places = np.array([at - offsets[r] for r, at, _ in parts])
        return np.concatenate([raw[at:to] for _, at, to in parts]), np.concatenate([[0], np.cumsum(sizes)]), rows, places

    for row, (at, end) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        while end - at >= SPAN:
            to = min(end, at + CHUNK + SPAN - 1)
            parts.append((row, at, to))
            held += to - at
            at = to - SPAN + 1
            if held >= CHUNK:
                yield together()
                held, parts = 0, []
    if parts:
        yield together()


def _anchors(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of every gram, least hash of every string, and which strings lie inside a text."""
    grams = _grams(raw)
    least = _sliding(grams, _REACH, np.minimum)
    inside = np.ones(len(least), bool)
    for end in bounds[1:-1].tolist():
        inside[max(0, end - SPAN + 1):end] = False
    return grams, least, inside


def _anchor_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for raw, bounds, *_ in _chunks(batch.column("text")):
            grams, least, inside = _anchors(raw, bounds)
            around = np.zeros(len(grams) + _REACH - 1, np.uint64)
            around[_REACH - 1:_REACH - 1 + len(least)] = np.where(inside, least, 0)
            taken = _sliding(around, _REACH, np.maximum) == grams
            hashes, counts = np.unique(grams[taken], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(counts.astype(np.int64))], ["anchor", "n"])


def _bitmap(repeated: DataFrame, bits: int) -> np.ndarray:
    """One bit for each anchor that occurs more than once, told by its low bits."""
    slot = F.pmod("anchor", F.lit(1 << bits).cast("long")) + 1
    rows = (repeated.select(F.bitmap_bucket_number(slot).alias("part"), F.bitmap_bit_position(slot).alias("bit"))
            .groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits")).toLocalIterator())
    out = np.zeros(max(4096, (1 << bits) // 8), np.uint8)
    for r in rows:
        out[4096 * (r["part"] - 1):4096 * r["part"]] = np.frombuffer(r["bits"], np.uint8)
    return out


def _runs(told, bits: int, buckets: int):
    """Runs of neighbouring strings that share an anchor which may be repeated, with the bucket they go to."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, hot, salts = told.value
        for batch in batches:
            keys, whole = batch.column("key"), batch.column("whole").to_numpy(zero_copy_only=False)
            for raw, bounds, rows, places in _chunks(batch.column("text")):
                _, least, inside = _anchors(raw, bounds)
                slot = (least & np.uint64((1 << bits) - 1)).astype(np.int64)
                inside &= (bitmap[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1
                at = np.flatnonzero(inside)
                if not len(at):
                    continue
                new = np.ones(len(at), bool)
                new[1:] = (at[1:] != at[:-1] + 1) | (least[at[1:]] != least[at[:-1]])
                first = np.flatnonzero(new)
                sizes = np.diff(np.append(first, len(at)))
                pieces = -(-sizes // RUN)  # long runs are cut
                nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = at[np.repeat(first, pieces)] + nth * RUN
                size = np.minimum(np.repeat(sizes, pieces) - nth * RUN, RUN)
                anchor = least[start]
                text = np.searchsorted(bounds, start, "right") - 1
                place = places[text] + start - bounds[text]
                row = rows[text]
                known = np.minimum(np.searchsorted(hot, anchor), max(0, len(hot) - 1))
                is_hot = hot[known] == anchor if len(hot) else np.zeros(len(anchor), bool)
                with np.errstate(over="ignore"):
                    mixed = anchor * _FACTOR
                    if is_hot.any():
                        lot = (place[is_hot].astype(np.uint64) * np.uint64(31) + raw[start[is_hot]] + np.arange(is_hot.sum(), dtype=np.uint64)) * _FACTOR >> np.uint64(33)
                        mixed[is_hot] += (lot % salts[known[is_hot]]) * np.uint64(0xBF58476D1CE4E5B9)
                bucket = ((mixed >> np.uint64(33)) % np.uint64(buckets)).astype(np.int32)
                view = memoryview(raw)
                blobs = pa.array([view[s:s + n + SPAN - 1].tobytes() for s, n in zip(start.tolist(), size.tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(bucket), keys.take(pa.array(row)), pa.array(place), pa.array(whole[row]), pa.array(is_hot), blobs],
                                                 ["bucket", "key", "start", "whole", "hot", "run"])

    return run


# sorting

def _heads(keys: np.ndarray) -> np.ndarray:
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    return new


def _grouped(slots: np.ndarray, keys: np.ndarray, least: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted keys: the slots in groups of at least so many, the groups' numbers, and which places stay."""
    new = _heads(keys)
    number = np.cumsum(new) - 1
    stay = np.bincount(number)[number] >= least
    return slots[stay], np.cumsum(_heads(number[stay])) - 1 if stay.any() else number[:0], stay


def deep_shallow(raw: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``places`` in the order of the ``SPAN`` bytes that begin there, and the leaf of each; equal strings share one."""
    raw = np.concatenate([raw, np.zeros(8, np.uint8)])
    words = np.ndarray(len(raw) - 7, ">u8", raw, strides=(1,))
    first = words[places].astype(np.uint64)
    order = np.argsort(first, kind="stable")
    suffix = places[order]
    leaf = np.arange(len(suffix))
    slots, group, _ = _grouped(leaf.copy(), first[order])
    for depth in range(8, SHALLOW, 8):  # multikey quicksort
        below: list[tuple[np.ndarray, np.ndarray]] = []
        while len(slots):
            word = words[suffix[slots] + depth].astype(np.uint64)
            sizes = np.bincount(group)
            begins = np.cumsum(sizes) - sizes
            pivot = word[begins + sizes // 2][group]
            side = (word > pivot) * 2 + (word == pivot)
            key = 3 * group + side
            if (np.diff(key) < 0).any():
                turn = np.argsort(key, kind="stable")
                suffix[slots], key = suffix[slots][turn], key[turn]
            equal = key % 3 == 1
            some, _, stay = _grouped(slots[equal], key[equal])
            below.append((some, slots[equal][np.maximum.accumulate(np.where(_heads(key[equal]), np.arange(equal.sum()), 0))][stay] if equal.any() else some))
            slots, group, _ = _grouped(slots[~equal], key[~equal])
        slots, begin = (np.concatenate(c) for c in zip(*below, strict=True)) if below else (slots, slots)
        turn = np.argsort(slots, kind="stable")
        slots, begin = slots[turn], begin[turn]
        group = np.cumsum(_heads(begin)) - 1 if len(begin) else begin
    depths = np.full(int(group[-1]) + 1 if len(group) else 0, SHALLOW)
    while len(slots):  # blind tries, a level of leaves at a time
        sizes = np.bincount(group)
        begins = np.cumsum(sizes) - sizes
        lead = suffix[slots][begins][group]
        mine = suffix[slots]
        common = np.full(len(slots), SPAN)
        byte = np.zeros(len(slots), np.int64)
        less = np.zeros(len(slots), bool)
        word_at = (depths // 8)[group]
        open_ = np.flatnonzero(mine != lead)
        for w in range(int(word_at.min()), SPAN // 8):
            if not len(open_):
                break
            a, b = words[mine[open_] + 8 * w], words[lead[open_] + 8 * w]
            apart = a != b
            if apart.any():
                hit = open_[apart]
                x, y = a[apart].astype(np.uint64), b[apart].astype(np.uint64)
                shift = ((x ^ y).astype(np.float64)).view(np.int64)  # the exponent tells the first bit that differs
                top = np.minimum((shift >> 52) - 1023, 63)
                top = np.where((x ^ y) >> np.minimum(top, 63).astype(np.uint64) == 0, top - 1, top)
                common[hit] = 8 * w + 7 - top // 8
                byte[hit] = raw[mine[hit] + common[hit]]
                less[hit] = x < y
                open_ = open_[~apart]
        same = common == SPAN
        rank = np.where(same, SPAN * 256, np.where(less, common * 256 + byte, (2 * SPAN - common) * 256 + byte))
        key = group * (256 * (2 * SPAN + 1)) + rank
        turn = np.argsort(key, kind="stable")
        suffix[slots], key, common, same, depth_of = mine[turn], key[turn], common[turn], same[turn], depths[group][turn]
        head = slots[np.maximum.accumulate(np.where(_heads(key), np.arange(len(key)), 0))]
        leaf[slots[same]] = head[same]
        slots, group, stay = _grouped(slots[~same], key[~same])
        if len(slots):
            deeper = np.maximum(common[~same][stay] + 1, depth_of[~same][stay])
            depths = deeper[_heads(group)]
    return suffix, leaf


def _sorted_bucket(table: pa.Table) -> pa.Table:
    runs = table.column("run").combine_chunks()
    runs = runs.chunk(0) if isinstance(runs, pa.ChunkedArray) else runs
    runs = runs.cast(pa.large_binary())
    ends = np.frombuffer(runs.buffers()[1], np.int64)[runs.offset:runs.offset + len(runs) + 1]
    raw, ends = np.frombuffer(runs.buffers()[2], np.uint8)[ends[0]:ends[-1]], ends - ends[0]
    sizes = np.diff(ends) - SPAN + 1
    of = np.repeat(np.arange(len(sizes)), sizes)
    places = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + ends[:-1][of]
    suffix, leaf = deep_shallow(raw, places)
    times = np.bincount(leaf, minlength=len(leaf))
    again = np.zeros(len(raw), bool)
    again[suffix[times[leaf] > 1]] = True
    start = table.column("start").to_numpy()
    whole, hot = (table.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("whole", "hot"))
    keys = table.column("key").combine_chunks()
    # neighbouring repeated strings of a run make one span
    flag = again[places] & ~whole[of]
    on = np.flatnonzero(flag)
    new = np.ones(len(on), bool)
    new[1:] = (on[1:] != on[:-1] + 1) | (of[on[1:]] != of[on[:-1]])
    first, last = on[new], on[np.append(new[1:], True)] if len(on) else on
    at = start[of] + places - ends[:-1][of]
    spans = _found(keys, of[first], at[first], at[last] + SPAN, None)
    if not hot.any():
        return pa.Table.from_batches([spans])
    run_of = np.searchsorted(ends, suffix, "right") - 1
    lone = hot[run_of] & ((times[leaf] == 1) | (leaf == np.arange(len(leaf))))
    pick, owner = suffix[lone], run_of[lone]
    view = memoryview(raw)
    digests = pa.array([hashlib.blake2b(view[p:p + SPAN], digest_size=16).digest() for p in pick.tolist()], pa.binary())
    place = start[owner] + pick - ends[:-1][owner]
    told = (times[leaf[lone]] > 1) | whole[owner]  # stands for others only
    rest = _found(keys, owner, place, place + SPAN, digests, told, (times[leaf[lone]] > 1).astype(np.int64))
    return pa.Table.from_batches([spans, rest])


def _found(keys, rows, start, stop, digests, told=None, more=None) -> pa.RecordBatch:
    taken = keys.take(pa.array(rows))
    taken = taken.combine_chunks() if isinstance(taken, pa.ChunkedArray) else taken
    start = pa.array(start.astype(np.int64))
    if digests is None:
        digests = pa.nulls(len(start), pa.binary())
    else:
        taken = pc.if_else(pa.array(told), pa.scalar(None, pa.binary()), taken)
        start = pc.if_else(pa.array(more == 1), pa.scalar(None, pa.int64()), start)  # null: found twice already
    return pa.RecordBatch.from_arrays([taken, start, pa.array(stop.astype(np.int64)), digests], ["key", "start", "stop", "digest"])


# results

def _outcome(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = []
        for key, text, whole, spans in zip(*(batch.column(c) for c in ("key", "text", "whole", "spans")), strict=True):
            raw = text.as_buffer()
            n = raw.size
            if whole.as_py() and n >= SPAN:
                made.append((key.as_py(), n, n, 1, hashlib.sha256().hexdigest()))
                continue
            digest, removed, runs, at = hashlib.sha256(), 0, 0, 0
            view = memoryview(raw)
            if spans.is_valid:
                pairs = np.array(sorted((s["start"], s["stop"]) for s in spans.as_py()), np.int64)
                reach = np.maximum.accumulate(pairs[:, 1])
                new = np.append(True, pairs[1:, 0] > reach[:-1])
                for start, stop in zip(pairs[new, 0].tolist(), reach[np.append(new[1:], True)].tolist(), strict=True):
                    digest.update(view[at:start])
                    removed, runs, at = removed + stop - start, runs + 1, stop
            digest.update(view[at:])
            made.append((key.as_py(), n, removed, runs, digest.hexdigest()))
        if made:
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made, strict=True), kinds, strict=True)], [f.split()[0] for f in _RESULT.split(", ")])


def repeated_spans(texts: DataFrame) -> DataFrame:
    """``key``, ``start``, ``stop`` of the passages of ``texts`` (``key``, ``text``, ``whole``) that start elsewhere too.

    Rows marked ``whole`` take part, but no spans are told of them.
    """
    spark = texts.sparkSession
    counts = texts.select("text").mapInArrow(_anchor_counts, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1")
    repeated = materialize(counts, "anchors")
    rows, places = repeated.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    most = max(HOT, places // 1_000_000)
    hot = {r["anchor"]: r["n"] for r in repeated.where(F.col("n") > most).collect()}  # at most a million, as each has a millionth
    names = np.array(sorted(np.array(list(hot), np.int64).view(np.uint64).tolist()), np.uint64)
    salts = np.array([-(-2 * hot[int(a)] // most) for a in names.view(np.int64)], np.uint64)
    bits = min(MOST_BITS, max(15, (32 * rows).bit_length()))
    told = spark.sparkContext.broadcast((_bitmap(repeated, bits), names, salts))
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), places * (SPAN + _REACH // 2) // BUCKET_BYTES + 1)
    runs = texts.mapInArrow(_runs(told, bits, min(buckets, 1 << 30)), "bucket int, key binary, start long, whole boolean, hot boolean, run binary")
    found = materialize(runs.groupBy("bucket").applyInArrow(_sorted_bucket, _FOUND), "repeated")
    spans = found.where("digest is null").select("key", "start", "stop")
    if not hot:
        return spans
    # each salt sent a string at most once, so a digest has no more rows than its anchor has salts
    met = (found.where("digest is not null").groupBy("digest")
           .agg(F.count(F.lit(1)).alias("n"), F.max(F.col("start").isNull()).alias("more"),
                F.collect_list(F.when(F.col("key").isNotNull(), F.struct("key", "start", "stop"))).alias("places"))
           .where("n > 1 or more").select(F.explode("places").alias("p")).select("p.*"))
    return spans.unionByName(met)


def deduplicate(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: sizes, removed bytes and runs, and the digest of what stays."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("key", F.unhex(F.substring(F.sha2("text", 256), 1, 32)))
    name = f"suffix_texts_{uuid.uuid4().hex}"
    (keyed.groupBy("key").agg(F.first("text").alias("text"), (F.count(F.lit(1)) > 1).alias("whole"))
     .write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "key").option("path", scratch_path(spark, "texts")).saveAsTable(name))
    texts = spark.table(name)
    spans = repeated_spans(texts).groupBy("key").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    done = materialize(texts.join(spans, "key", "left").select("key", "text", "whole", "spans").mapInArrow(_outcome, _RESULT), "outcomes")
    spark.sql(f"DROP TABLE {name}")  # the catalog's entry; files stay with the scratch folder
    return keyed.select("doc_id", "key").join(done, "key").drop("key")
