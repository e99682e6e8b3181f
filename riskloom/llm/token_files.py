"""Token ids as Parquet files in ascending document order, and what is read back from them.

Texts are dealt by ranges of ``doc_id`` and sorted, then encoded, so a file holds a range of documents and file and row
order are document order; only the texts are shuffled, never the ids, which are more bytes.  ``ids`` is a list column with
dictionary encoding (differences where the dictionary is full), in row groups and pages of set size with page indexes:
a reader of some documents, or of ``n_tokens`` alone, touches those pages only.

Encoding is done by the tokenizers library.  Vocabularies that drop white space encode each word by itself, so distinct
chunks are numbered by array operations, those that a worker has not met lately are cut into words, new words alone are
encoded, and the ids of both are kept in arrays of bounded length; others are encoded text by text.

Edge cases: null and empty texts have the end id alone; rows that repeat a ``doc_id`` are written each, next to each
other; rows without ``doc_id`` come first; other columns are not written.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.llm.bpe_index import BATCH_CHARS, Chunks, Vocabulary, _bytes, slices, vocabulary
from riskloom.session import materialize, scratch_path

END_ID = 1
#: Words that go to the library as one text.
WORDS_PER_TEXT = 500
#: Chunks, and words, whose ids a worker keeps (about 50 bytes each).
REMEMBERED = 300_000
#: Bytes of text in a file, at most about.
FILE_BYTES = 512 << 20
FILE_OPTIONS = {
    "compression": "zstd",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary": "true",
    "parquet.block.size": str(16 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
}

_library: dict = {}
_known: dict[str, KnownChunks] = {}


def _tokenizer(path: str):
    if path not in _library:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        _library[path] = Tokenizer.from_file(path)
        _library[path].no_truncation()
        _library[path].no_padding()
    return _library[path]


def _ids(text: str, path: str) -> bytes:
    return np.array(_tokenizer(path).encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def _word_coder(path: str) -> Callable[[list[str]], pa.Array]:
    """Ids of distinct words by the library.  Many words go to it as one text, cut again where a token ends a word."""
    vocab = vocabulary(path)
    ends = np.array([t.endswith(vocab.end) for t in vocab.tokens])

    def coded(words: list[str]) -> pa.Array:
        parts, cuts, before = [np.zeros(0, "<u4")], [np.zeros(1, np.int64)], 0
        for start in range(0, len(words), WORDS_PER_TEXT):
            some = words[start:start + WORDS_PER_TEXT]
            (found,) = _tokenizer(path).encode_batch_fast([" ".join(some)], add_special_tokens=False)
            ids = np.array(found.ids, "<u4")
            cut = np.flatnonzero(ends[ids]) + 1
            if len(cut) != len(some):
                raise ValueError("the vocabulary does not end every word")
            parts.append(ids)
            cuts.append(before + cut)
            before += len(ids)
        return _binary(4 * np.concatenate(cuts), pa.py_buffer(np.concatenate(parts)))

    return coded


def _binary(ends: np.ndarray, data: pa.Buffer) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(np.ascontiguousarray(ends)), data])


class Remembered:
    """Strings with their ids, in arrays from one batch to the next.

    The known strings are numbered before those of a batch, so only what stands behind them is new to ``code``.  Of more
    than ``most`` those stay that were met last.
    """

    def __init__(self, code: Callable[[pa.Array], pa.Array], most: int) -> None:
        self.code, self.most = code, most
        self.known, self.ids = pa.array([], pa.large_string()), pa.array([], pa.large_binary())
        self.met, self.batch = np.zeros(0, np.int64), 0

    def ids_of(self, values: pa.Array) -> pa.Array:
        n = len(self.known)
        numbered = pa.concat_arrays([self.known, values]).dictionary_encode()
        ids = pa.concat_arrays([self.ids, self.code(numbered.dictionary.slice(n))])
        at = numbered.indices.slice(n)
        self._keep(numbered.dictionary, ids, at.to_numpy())
        return ids.take(at)

    def _keep(self, strings: pa.Array, ids: pa.Array, at: np.ndarray) -> None:
        self.batch += 1
        met = np.concatenate([self.met, np.zeros(len(strings) - len(self.met), np.int64)])
        met[at] = self.batch
        if len(met) > self.most:
            last = np.sort(np.argpartition(met, -self.most)[-self.most:])
            strings, ids, met = strings.take(pa.array(last)), ids.take(pa.array(last)), met[last]
        self.known, self.ids, self.met = strings, ids, met


class KnownChunks(Chunks):
    """Chunks whose ids are remembered, and the ids of their words."""

    def __init__(self, vocab: Vocabulary, code: Callable[[list[str]], pa.Array], whole: Callable[[str], tuple[bytes]], remembered: int | None = None) -> None:
        super().__init__(vocab, code, 1, whole, remembered or REMEMBERED)
        self.known = Remembered(self._chunk_ids, self.remembered)
        self.known_words = Remembered(lambda words: self._word_ids(words.to_pylist()), self.remembered)

    def _word_ids(self, words: list[str]) -> pa.Array:
        odd = [k for k, w in enumerate(words) if not w or w[0] in " \n"]
        if not odd:
            return self.code(words)
        apart = set(odd)
        plain = [k for k in range(len(words)) if k not in apart]
        told = self._coded([words[k] for k in odd])
        both = pa.concat_arrays([self.code([words[k] for k in plain]), pa.array([told[words[k]][0] for k in odd], pa.large_binary())])
        return both.take(pa.array(np.argsort(np.array(plain + odd))))

    def _chunk_ids(self, chunks: pa.Array) -> pa.Array:
        cut = self._cut(chunks)
        data, ends = _bytes(self.known_words.ids_of(cut.values))
        return _binary(ends[cut.offsets.to_numpy()], data)

    def gathered(self, texts: pa.Array) -> list[tuple[memoryview, np.ndarray]]:
        lists = self._lists(texts)
        data, ends = _bytes(self.known.ids_of(lists.values))
        return [(memoryview(data), ends[lists.offsets.to_numpy()])]


def _chunks(path: str) -> KnownChunks:
    """The chunks that a worker knows; it keeps them from one task to the next."""
    if path not in _known:
        _known[path] = KnownChunks(vocabulary(path), _word_coder(path), lambda chunk: (_ids(chunk, path),))
    return _known[path]


def _encode_rows(path: str, by_word: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = _chunks(path) if by_word else None
        for batch in batches:
            at = 0
            for texts in slices(batch.column("text"), BATCH_CHARS // 2):
                if chunks:
                    ((raw, ends),) = chunks.gathered(texts)
                else:
                    parts = [_ids(t, path) for t in texts.to_pylist()]
                    raw, ends = memoryview(b"".join(parts)), np.concatenate([[0], np.cumsum(list(map(len, parts)))])
                ends = ends // 4
                values = np.insert(np.frombuffer(raw, "<u4")[:ends[-1]], ends[1:], END_ID).astype(np.int32)
                ends = ends + np.arange(len(ends))
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(texts)), pa.array(np.diff(ends)), lists], ["doc_id", "n_tokens", "ids"])
                at += len(texts)
        pa.default_memory_pool().release_unused()

    return run


def write_tokens(docs: DataFrame, vocabulary_path: str, target: str, files: int | None = None, by_word: bool = False) -> None:
    """Writes ``doc_id``, ``n_tokens`` and ``ids`` below ``target``, in ascending order of ``doc_id``.

    ``by_word`` is for vocabularies that drop white space.
    """
    spark = docs.sparkSession
    if files is None:
        held = docs.agg(F.coalesce(F.sum(F.octet_length(F.col("text").cast("string"))), F.lit(0))).first()[0]
        files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), held // FILE_BYTES + 1)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    (texts.repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id")
     .mapInArrow(_encode_rows(vocabulary_path, by_word), "doc_id long, n_tokens long, ids array<int>")
     .write.mode("overwrite").options(**FILE_OPTIONS).parquet(target))


def read_tokens(spark: SparkSession, target: str) -> DataFrame:
    """The rows of token files; filters on ``doc_id`` and a choice of columns reach the pages."""
    return spark.read.schema("doc_id long, n_tokens long, ids array<int>").parquet(target)


def _crc_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("ids")
        ends, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype("<u4").view(np.uint8)
        sums = [zlib.crc32(values[4 * a:4 * b]) for a, b in zip(ends, ends[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("file"), batch.column("row_index"), pa.array(np.diff(ends).astype(np.int64)), pa.array(sums, pa.int64())],
                                         ["doc_id", "file", "row_index", "n_tokens", "ids_crc32"])


def token_index(spark: SparkSession, target: str) -> DataFrame:
    """Per document, from the files: ``start`` (ids of all documents before it), ``n_tokens`` and ``ids_crc32``.

    Running totals go over one row per file, then over the rows of each file.
    """
    rows = read_tokens(spark, target).select("doc_id", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row_index"), "ids")
    sums = materialize(rows.mapInArrow(_crc_rows, "doc_id long, file string, row_index long, n_tokens long, ids_crc32 long"), "token-sums")
    totals = sums.groupBy("file").agg(F.sum("n_tokens").alias("words"), F.min("doc_id").alias("first"))
    ranked = Window.orderBy("first", "file")
    before = totals.select("file", (F.sum("words").over(ranked) - F.col("words")).alias("before"))
    inside = Window.partitionBy("file").orderBy("row_index").rowsBetween(Window.unboundedPreceding, 0)
    return (sums.join(before, "file").withColumn("start", F.col("before") + F.sum("n_tokens").over(inside) - F.col("n_tokens"))
            .select("doc_id", "start", "n_tokens", "ids_crc32"))


def written_and_indexed(docs: DataFrame, vocabulary_path: str, by_word: bool = False) -> DataFrame:
    """Writes token files to the shared folder and returns their index."""
    target = scratch_path(docs.sparkSession, "tokens")
    write_tokens(docs, vocabulary_path, target, by_word=by_word)
    return token_index(docs.sparkSession, target)
