"""Token ids of a corpus as flat binary files with 64-bit document offsets."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from segspark.llm.bpe import LETTERS, MARKS, splits_words, tokenizer_path
from segspark.llm.common import BoundedDict, documents, pieces, store, worker_cache
from segspark.session import scratch_dir

TOKENIZER, END = "word_bpe_49k.json", 1
#: Tokens that a reader hands on at once, at least a document.
BLOCK = 1 << 20
#: Texts whose new words are encoded together; pieces that a worker remembers.
TEXTS, KNOWN = 64, 1_500_000
NO_KEY = np.iinfo(np.int64).min
#: Characters of a text that its range is chosen by, beside its key.
HEAD = 64


def _filesystem(path: str):
    """The file system of ``path`` and the path in it; ``file:/x`` and plain paths are a (shared) mount."""
    from pyarrow import fs

    local = re.fullmatch(r"(?:file:)?/*(/.*)", path)
    return (fs.LocalFileSystem(), local[1]) if local else fs.FileSystem.from_uri(path)


class _Pieces(BoundedDict):
    """Ids of a piece of text, as the bytes that go to the file.

    Where white space ends every token (see ``splits_words``), a text's ids are those of its pieces; a plain word is
    then encoded once for either case, and final marks after it apart, as the tokenizer cuts there. Other tokenizers
    get whole texts.
    """

    def __init__(self, file: str, dtype: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.dtype = Tokenizer.from_file(file), dtype
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        with open(file) as f:
            self.splits = splits_words(json.load(f))
        self.plain, self.marked = re.compile(LETTERS), re.compile(f"({LETTERS})({MARKS})")
        ends = [t.endswith("</w>") for t, _ in sorted(self.tokenizer.get_vocab().items(), key=lambda x: x[1])]
        self.ends = np.array(ends)
        super().__init__(self.encode, KNOWN)

    def prepare(self, rows: list[list[str]]) -> None:
        """Encodes the plain words of ``rows`` that are not known yet in one call; each is cut off at its word-end id."""
        if len(self) >= self.most:
            self.clear()
        words = set()
        for piece in set().union(*rows):
            if piece not in self:
                word = found[1] if (found := self.marked.fullmatch(piece)) else piece
                if len(word) <= 64 and self.plain.fullmatch(word):
                    words.add(word.lower())
        words = [w for w in words if w not in self]
        if words:
            ids = np.array(self.tokenizer.encode(" ".join(words), add_special_tokens=False).ids, self.dtype)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(words):
                data, size, start = ids.tobytes(), ids.itemsize, 0
                for word, end in zip(words, (cuts * size).tolist()):
                    self[word] = data[start:end]
                    start = end

    def encode(self, piece: str) -> bytes:
        if not piece:
            return b""
        if self.splits:
            if found := self.marked.fullmatch(piece):
                return self[found[1]] + self[found[2]]
            if self.plain.fullmatch(piece) and (lower := piece.lower()) != piece:
                return self[lower]
        return np.array(self.tokenizer.encode(piece, add_special_tokens=False).ids, self.dtype).tobytes()


def write_tokens(
    docs: DataFrame, path: str, tokenizer: str, end_id: int = END, key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Writes the ids of all texts to ``path`` in ascending key order; returns the index, one row per part.

    A part holds a range of keys in three flat files: ``.ids`` (unsigned 16- or 32-bit little-endian, by
    vocabulary size), ``.offsets`` (unsigned 64-bit, the place of each document's first id in the part, and the
    end) and ``.keys`` (signed 64-bit; the least number stands for null). The index adds ``base``, the ids in all parts before it:
    a prefix sum over parts in the order of their ranges, so no document passes through the driver. Each attempt of a task writes files of
    a new name and only the attempt that Spark commits is in the index: a lost executor leaves nothing wrong.

    Null text is empty; each document ends with ``end_id``. Null keys come first; documents of one key (or none) follow each
    other in text order, and may fill several parts. No rows: an empty index.
    """
    from tokenizers import Tokenizer

    loaded = Tokenizer.from_file(tokenizer)
    dtype = "<u2" if max(loaded.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = worker_cache(f"pieces {tokenizer} {dtype}", lambda: _Pieces(tokenizer, dtype))
        ids, cut = known.__getitem__, pieces if known.splits else lambda x: [x or ""]
        system, base = _filesystem(path)
        part, keys, offsets, end = uuid.uuid4().hex, [], [np.zeros(1, "<u8")], np.array([end_id], dtype).tobytes()
        at, out = 0, None
        for batch in batches:
            if out is None:
                out = system.open_output_stream(f"{base}/{part}.ids")
            lengths = np.empty(batch.num_rows, "<u8")
            for first in range(0, batch.num_rows, TEXTS):
                rows = [cut(value.as_py()) for value in batch.column(1).slice(first, TEXTS)]
                if known.splits:
                    known.prepare(rows)
                for i, row in enumerate(rows, first):
                    row = b"".join(map(ids, row)) + end
                    lengths[i] = len(row) // len(end)
                    out.write(row)
            offsets.append(at + np.cumsum(lengths, dtype="<u8"))
            at = int(offsets[-1][-1]) if len(lengths) else at
            keys.append(batch.column(0).fill_null(NO_KEY).to_numpy(zero_copy_only=False).astype("<i8"))
        if out is None:
            return
        out.close()
        keys = np.concatenate(keys)
        for name, array in (("offsets", np.concatenate(offsets)), ("keys", keys)):
            with system.open_output_stream(f"{base}/{part}.{name}") as f:
                f.write(array.tobytes())
        if len(keys):
            yield pa.RecordBatch.from_pydict(
                {"part": [part], "place": [TaskContext.get().partitionId()], "first_key": [int(keys[0])], "n_docs": [len(keys)], "n_tokens": [at]})

    system, base = _filesystem(path)
    system.create_dir(base, recursive=True)
    # Ranges of key and how the text begins, which agrees with text order: many documents of one key are no single task.
    first = F.col("key").asc_nulls_first()
    ordered = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).repartitionByRange(
        first, F.substring("text", 1, HEAD).asc_nulls_first()).sortWithinPartitions(first, F.col("text").asc_nulls_first())
    parts = store(ordered.mapInArrow(write, "part string, place long, first_key long, n_docs long, n_tokens long"), "parts")
    before = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    index = parts.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).withColumn("dtype", F.lit(dtype))
    index.write.parquet(f"{path}/index")
    return docs.sparkSession.read.parquet(f"{path}/index")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Documents of token files: ``key``, ``start`` (ids before it), ``n_tokens``, ``ids`` (32-bit little-endian).

    Parts are read side by side, memory-mapped where the folder is a mount, in blocks of whole documents.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _filesystem(path)
        for batch in batches:
            for row in batch.to_pylist():
                name = f"{base}/{row['part']}"
                if type(system).__name__ == "LocalFileSystem":
                    ids, offsets, keys = (np.memmap(f"{name}.{x}", kind, "r") for x, kind in (
                        ("ids", row["dtype"]), ("offsets", "<u8"), ("keys", "<i8")))
                else:
                    ids, offsets, keys = (np.frombuffer(system.open_input_file(f"{name}.{x}").readall(), kind) for x, kind in (
                        ("ids", row["dtype"]), ("offsets", "<u8"), ("keys", "<i8")))
                a = 0
                while a < len(keys):
                    b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + BLOCK, "right")) - 1)
                    b = min(b, len(keys))
                    own = offsets[a:b + 1].astype("i8")
                    data = ids[own[0]:own[-1]].astype("<u4").tobytes()
                    block = pa.Array.from_buffers(pa.binary(), b - a, [
                        None, pa.py_buffer(((own - own[0]) * 4).astype("<i4").tobytes()), pa.py_buffer(data)])
                    yield pa.RecordBatch.from_arrays([
                        pa.array(keys[a:b], mask=np.asarray(keys[a:b] == NO_KEY)), pa.array(own[:-1] + row["base"]),
                        pa.array(np.diff(own)), block], ["key", "start", "n_tokens", "ids"])
                    a = b

    index = spark.read.parquet(f"{path}/index")
    return index.repartition(max(1, index.count())).mapInArrow(
        read, "key long, start long, n_tokens long, ids binary")


def q_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "tokens")
    write_tokens(documents(spark, sf_dir), path, tokenizer_path(TOKENIZER))
    return read_tokens(spark, path).select(
        F.col("key").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


QUERIES = {"op1_token_files": (q_token_files, None)}
