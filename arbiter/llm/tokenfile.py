"""Token ids in Arrow files of fixed-size-list batches.

Layout. The ids of all documents, in ascending doc_id order and each ended by
`end_id`, are cut into sequences of `length`. A shard `part-*.arrow` is an
Arrow IPC file (the IPC stream with a footer of batch offsets) with columns

  input_ids  fixed_size_list<uint16 or uint32>[length]
  mask       fixed_size_list<bool>[length], false for padding

in record batches of `rows` sequences (the last may have fewer). Sequence k of
a shard is row k % rows of batch k // rows, so a memory-mapped shard gives any
sequence and its mask without copying (`Shard.sequence`). Padding is only at a
shard's end. uint16 is used when the vocabulary allows it.

Documents are range-partitioned by id, one shard a partition. A task writes to
a name of its own attempt and reports each document's place; only reported
files count, so lost or repeated tasks leave nothing behind but unread files.
The report is the index: (shard, path, doc_id, offset, n_tokens), a Parquet
table beside the shards. A shard's place among all ids comes from the sums of
the shards before it; that list is as long as there are partitions.

Encoding is done by the tokenizers library. Texts of plain Latin letters are
cut into pre-tokens many at a time (`pretokens`), and the library's model gets
each distinct one that no cache holds. Other texts are cut at ASCII white
space, across which no pre-token reaches, and normalised and cut by the library.

Defined results
  null or empty text  only the end id
  null doc_id         stands first
  equal doc_ids       all are written, in the order of the texts' hashes
  empty table         no shard rows, empty result
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arbiter.llm.bpe import VOCABULARY, Generations, byte_alphabet, chunks_of, pre_tokens
from arbiter.llm.common import materialise, partitions, scratch
from arbiter.llm.pretokens import BatchEncoder

END_ID = 1
LENGTH = 2048
ROWS = 256
STEP = 2048  # documents encoded together
CACHE = 400_000  # entries in a generation of a cache


class LibraryEncoder:
    """The tokenizers library behind caches of chunks and pre-tokens."""

    def __init__(self, path: str = VOCABULARY):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.cut_special = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        self.size = self.library.get_vocab_size(with_added_tokens=True)
        self.chunks = Generations(self._chunk, CACHE)
        self.model, self.alphabet = self.library.model, byte_alphabet()
        self.words = Generations(self._word, CACHE)
        self.batches = BatchEncoder(self.words.__getitem__, self._text, self.cut_special)

    def _one(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def _word(self, text: str) -> bytes:
        """Ids of a pre-token, by the library's model alone."""
        return array("I", [t.id for t in self.model.tokenize(text if text.isascii() and text.isprintable() else "".join([self.alphabet[b] for b in text.encode()]))]).tobytes()

    def _chunk(self, text: str) -> bytes:
        if any(t in text for t in self.special):
            return self._one(text)
        return b"".join(map(self.words.__getitem__, pre_tokens(self.library, text)))

    def _text(self, text: str) -> bytes:
        return b"".join(map(self.chunks.__getitem__, chunks_of(text)))

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text."""
        return self.batches.encode(texts)


@lru_cache(maxsize=2)
def library_encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


class ShardWriter:
    """Appends ids and writes full batches as they come; holds one batch at most."""

    def __init__(self, fs: pafs.FileSystem, path: str, dtype: np.dtype, length: int = LENGTH, rows: int = ROWS):
        self.dtype, self.length, self.rows = np.dtype(dtype), length, rows
        self.schema = pa.schema([("input_ids", pa.list_(pa.from_numpy_dtype(self.dtype), length)), ("mask", pa.list_(pa.bool_(), length))])
        self.out = fs.open_output_stream(path)
        self.writer = pa.ipc.new_file(self.out, self.schema)
        self.held, self.n_held, self.n = [], 0, 0

    def append(self, ids: np.ndarray) -> None:
        self.held.append(ids.astype(self.dtype))
        self.n_held += len(ids)
        self.n += len(ids)
        full = self.length * self.rows
        if self.n_held >= full:
            flat = np.concatenate(self.held)
            for k in range(0, len(flat) - full + 1, full):
                self._write(flat[k : k + full], full)
            rest = flat[len(flat) // full * full :].copy()
            self.held, self.n_held = [rest], len(rest)

    def _write(self, flat: np.ndarray, real: int) -> None:
        mask = np.zeros(len(flat), bool)
        mask[:real] = True
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (flat, mask)]
        self.writer.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))

    def close(self) -> None:
        if self.n_held:
            flat = np.concatenate(self.held)
            padded = np.zeros(-(-len(flat) // self.length) * self.length, self.dtype)
            padded[: len(flat)] = flat
            self._write(padded, len(flat))
        self.writer.close()
        self.out.close()


class Shard:
    """Random access to the sequences of one shard; a local file is memory-mapped."""

    def __init__(self, uri: str):
        fs, path = pafs.FileSystem.from_uri(uri)
        self.source = pa.memory_map(path) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(path)
        self.file = pa.ipc.open_file(self.source)
        self.length = self.file.schema.field("input_ids").type.list_size
        self.rows = self.file.get_batch(0).num_rows if self.file.num_record_batches else 0
        self._held: tuple[int, np.ndarray] = (-1, np.empty(0))

    def __len__(self) -> int:
        n = self.file.num_record_batches
        return (n - 1) * self.rows + self.file.get_batch(n - 1).num_rows if n else 0

    def sequence(self, k: int) -> tuple[np.ndarray, pa.Array]:
        """Sequence k as a view of the file's memory, and its mask."""
        batch, row = self.file.get_batch(k // self.rows), k % self.rows
        return batch.column(0).values.to_numpy(zero_copy_only=True)[row * self.length : (row + 1) * self.length], batch.column(1)[row].values

    def ids(self, start: int, n: int) -> np.ndarray:
        """The n ids from place `start` of the shard."""
        full, out = self.length * self.rows, []
        while n > 0:
            b, at = divmod(start, full)
            if self._held[0] != b:
                self._held = (b, self.file.get_batch(b).column(0).values.to_numpy(zero_copy_only=True))
            part = self._held[1][at : at + n]
            if not len(part):
                raise ValueError(f"the shard ends before place {start}")
            out.append(part)
            start, n = start + len(part), n - len(part)
        return np.concatenate(out) if len(out) != 1 else out[0]

    def close(self) -> None:
        self.source.close()


def write_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY, folder: str | None = None, end_id: int = END_ID, length: int = LENGTH, rows: int = ROWS, shards: int | None = None) -> DataFrame:
    """Write the shards and their index; the index as (shard, path, doc_id, offset, n_tokens)."""
    spark = docs.sparkSession
    root = folder or scratch(spark, "tokens")
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    # Ranges are by id and hash: rows that all have one id are dealt out too.
    sorted_texts = texts.repartitionByRange(shards or partitions(spark), *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = library_encoder(path)
        dtype = np.uint16 if max(e.size - 1, end_id) < 1 << 16 else np.uint32
        task = TaskContext.get()
        shard = task.partitionId()
        uri = f"{root}/part-{shard:06d}-{task.taskAttemptId()}.arrow"
        out = None
        end = np.array([end_id], "<u4")
        for b in batches:
            if not b.num_rows:
                continue
            if out is None:
                fs, where = pafs.FileSystem.from_uri(uri)
                fs.create_dir(os.path.dirname(where), recursive=True)
                out = ShardWriter(fs, where, dtype, length, rows)
            offsets, counts = [], []
            for lo in range(0, b.num_rows, STEP):
                for ids in e.encode_batch(b.column(1).slice(lo, STEP).to_pylist()):
                    offsets.append(out.n)
                    out.append(ids)
                    out.append(end)
                    counts.append(out.n - offsets[-1])
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([shard] * n, pa.int32()), pa.array([uri] * n), b.column(0), pa.array(offsets, pa.int64()), pa.array(counts, pa.int64())], ["shard", "path", "doc_id", "offset", "n_tokens"])
        if out is not None:
            out.close()

    index = sorted_texts.mapInArrow(run, f"shard int, path string, doc_id {kind}, offset long, n_tokens long")
    return materialise(index, "token-index") if folder is None else _save(index, f"{folder}/index")


def _save(index: DataFrame, path: str) -> DataFrame:
    index.write.parquet(path)
    return index.sparkSession.read.schema(index.schema).parquet(path)


def read_tokens(index: DataFrame, ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read back from the shards; with `ids` also the ids themselves."""
    kind = index.schema["doc_id"].dataType.simpleString()
    totals = index.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    bases = totals.select("shard", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    placed = index.join(F.broadcast(bases), "shard")  # one row a shard
    placed = placed.select("shard", "path", "doc_id", "offset", "n_tokens", (F.col("base") + F.col("offset")).alias("start"))
    placed = placed.repartition(partitions(index.sparkSession), "shard").sortWithinPartitions("shard", "offset")
    schema = f"doc_id {kind}, start long, n_tokens long, ids_crc32 long" + ", ids binary" * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, uri = None, None
        for b in batches:
            crc, raw = [], []
            for path, at, n in zip(b.column(1).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist()):
                if path != uri:
                    if shard is not None:
                        shard.close()
                    shard, uri = Shard(path), path
                data = shard.ids(at, n).astype("<u4").tobytes()
                crc.append(zlib.crc32(data))
                if ids:
                    raw.append(data)
            columns = [b.column(2), b.column(5), b.column(4), pa.array(crc, pa.int64())]
            names = ["doc_id", "start", "n_tokens", "ids_crc32"]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(raw, pa.binary())] * ids, names + ["ids"] * ids)

    return placed.mapInArrow(run, schema)
