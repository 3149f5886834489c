"""Token ids of documents as Arrow files of equal-length sequences.

File format, a pair for each part of the ordered corpus:

- ``part-NNNNN-*.arrow``: an Arrow IPC file, not compressed. Columns ``ids``, fixed-size lists of LENGTH unsigned
  integers, and ``mask``, fixed-size lists of LENGTH bits: true where an id is real, false in the padding that fills a
  part's last sequence. Every record batch but the last holds BATCH sequences, so sequence i is row i % BATCH of batch
  i // BATCH: a mapped file gives any sequence and mask without a copy.
- ``part-NNNNN-*.index.arrow``: (doc_id, offset, n_tokens) of each document; the offset counts ids within the part.

Documents lie one after another in ascending doc_id order within a part, and parts are in ascending order too.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm._encode import encoder as cached
from feedloom.llm._encode import tokenizer_path
from feedloom.llm._shared import doc_chunks, exchange_parts, new_dir, range_ids, release, ship, text_of, utf8

END = 2
LENGTH = 2048
#: Sequences in a record batch: what a writer or reader holds at once.
BATCH = 64
#: Bytes of text encoded at once, or one longer text.
CHUNK = 4_000_000


def open_fs(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pyarrow.fs.LocalFileSystem(), path)


def _uri(path: str) -> str:
    return "file://" + path.removeprefix("file:") if path.startswith("file:/") and not path.startswith("file://") else path


class SequenceWriter:
    """Writes ids in sequences of equal length; ``add`` may be called with any number of ids."""

    def __init__(self, path: str, dtype: np.dtype, length: int, batch: int):
        self.length, self.batch, self.dtype = length, batch, dtype
        kind = pa.uint16() if dtype.itemsize == 2 else pa.uint32()
        self.schema = pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        fs, at = open_fs(path)
        self.sink = fs.open_output_stream(at)
        self.file = pa.ipc.new_file(self.sink, self.schema)
        self.parts: list[np.ndarray] = []
        self.held = 0

    def _write(self, ids: np.ndarray, real: int) -> None:
        lists = pa.FixedSizeListArray.from_arrays(pa.array(ids), type=self.schema.field("ids").type)
        mask = pa.FixedSizeListArray.from_arrays(pa.array(np.arange(len(ids)) < real), type=self.schema.field("mask").type)
        self.file.write_batch(pa.RecordBatch.from_arrays([lists, mask], schema=self.schema))

    def add(self, ids: np.ndarray) -> None:
        self.parts.append(ids)
        self.held += len(ids)
        full = self.length * self.batch
        if self.held >= full:
            flat = np.concatenate(self.parts)
            done = len(flat) // full * full
            for i in range(0, done, full):
                self._write(flat[i : i + full], full)
            self.parts, self.held = [flat[done:]], len(flat) - done

    def close(self) -> None:
        if self.held:
            flat = np.concatenate(self.parts)
            padded = np.zeros(-(-len(flat) // self.length) * self.length, self.dtype)
            padded[: len(flat)] = flat
            self._write(padded, len(flat))
        self.file.close()
        self.sink.close()


class SequenceReader:
    """Random access to a part: ids by offset, sequences and masks by number."""

    def __init__(self, path: str):
        fs, at = open_fs(path)
        local = isinstance(fs, pyarrow.fs.LocalFileSystem)
        self.file = pa.ipc.open_file(pa.memory_map(at) if local else fs.open_input_file(at))
        self.length = self.file.schema.field("ids").type.list_size
        self.batch = self.file.get_batch(0).num_rows if self.file.num_record_batches else 1
        self._last: tuple[int, pa.RecordBatch | None] = (-1, None)

    def _get(self, k: int) -> pa.RecordBatch:
        if self._last[0] != k:
            self._last = (k, self.file.get_batch(k))
        return self._last[1]

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        batch, row = self._get(i // self.batch), i % self.batch
        at = slice(row * self.length, (row + 1) * self.length)
        return batch.column(0).values.to_numpy()[at], batch.column(1).values.to_numpy(zero_copy_only=False)[at]

    def ids(self, offset: int, n: int) -> Iterator[np.ndarray]:
        """The ids from an offset on, in pieces that share the file's memory."""
        full = self.length * self.batch
        while n > 0:
            k, at = divmod(offset, full)
            piece = self._get(k).column(0).values.to_numpy()[at : at + n]
            yield piece
            offset, n = offset + len(piece), n - len(piece)


def write_tokens(docs: DataFrame, folder: str, id_col: str = "doc_id", text: str = "text", tokenizer: str | None = None, end: int = END, length: int = LENGTH) -> DataFrame:
    """Encode all ``docs`` into ``folder``; (part, path, docs, tokens, start), one row for each pair of files.

    One exchange deals the documents into ranges of ``id_col``. A task that runs again writes a file of another name;
    only names that successful tasks returned are listed. The list, a row for each part, passes the driver, which adds
    ``start``: the ids in all parts before. Null texts are empty and so only the end id; rows with a null id come first;
    rows that repeat an id lie in the order of a hash of their texts, so that one id's rows can fill many parts; an empty
    table makes no files. Ids may be numbers, strings or times.
    """
    spark = docs.sparkSession
    ship(spark)
    folder, tokenizer = _uri(folder), tokenizer or tokenizer_path()
    fs, at = open_fs(folder)
    fs.create_dir(at)
    kind = docs.schema[id_col].dataType.simpleString()
    n = exchange_parts(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text).alias("text"))
    dealt, firsts = range_ids(rows, "doc_id", n, F.xxhash64("text"))
    n = max([n, *(part + 1 for part, _ in firsts)])
    dealt = dealt.repartitionById(n, "_part").sortWithinPartitions("_part", "doc_id", F.xxhash64("text"), "text")

    def write(batches):
        encoder, writer, path, part = None, None, "", -1
        offset, rows = 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                encoder, part = cached(tokenizer), batch.column(2)[0].as_py()
                path = f"{folder}/part-{part:05d}-{uuid.uuid4().hex}"
                writer = SequenceWriter(f"{path}.arrow", encoder.dtype, length, BATCH)
                schema = pa.schema([("doc_id", batch.column(0).type), ("offset", pa.int64()), ("n_tokens", pa.int64())])
                ifs, iat = open_fs(f"{path}.index.arrow")
                sink = ifs.open_output_stream(iat)
                index = pa.ipc.new_file(sink, schema)
            for i, j in doc_chunks(utf8(batch.column(1))[1], CHUNK):
                ids, sizes = encoder.encode(batch.column(1).slice(i, j - i))
                writer.add(np.insert(ids, np.cumsum(sizes), end))
                sizes += 1
                ends = offset + np.cumsum(sizes)
                index.write_batch(pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(ends - sizes), pa.array(sizes)], schema=schema))
                offset, rows = int(ends[-1]), rows + j - i
        if writer is not None:
            writer.close()
            index.close()
            sink.close()
            release()
            yield pa.RecordBatch.from_pylist([{"part": part, "path": path, "docs": rows, "tokens": offset}], schema=pa.schema([("part", pa.int32()), ("path", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64())]))

    made = sorted(tuple(r) for r in dealt.mapInArrow(write, "part int, path string, docs long, tokens long").collect())
    rows, start = [], 0
    for part, path, count, tokens in made:
        rows.append((part, path, count, tokens, start))
        start += tokens
    return spark.createDataFrame(rows, f"part int, path string, docs long, tokens long, start long").withColumn("kind", F.lit(kind))


def read_tokens(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read back from the files that ``write_tokens`` listed."""
    first = files.select("kind").first()
    kind = first[0] if first else "bigint"
    ship(files.sparkSession)

    def read(batches):
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                reader = SequenceReader(f"{path}.arrow")
                fs, at = open_fs(f"{path}.index.arrow")
                with fs.open_input_file(at) as source:
                    index = pa.ipc.open_file(source)
                    for k in range(index.num_record_batches):
                        docs = index.get_batch(k)
                        offsets, sizes = docs.column(1).to_numpy(), docs.column(2).to_numpy()
                        sums = np.empty(len(sizes), np.int64)
                        for i, (o, n) in enumerate(zip(offsets.tolist(), sizes.tolist(), strict=True)):
                            crc = 0
                            for piece in reader.ids(o, n):
                                crc = zlib.crc32(piece.astype("<u4").data, crc)
                            sums[i] = crc
                        yield pa.RecordBatch.from_arrays([docs.column(0), pa.array(start + offsets), docs.column(2), pa.array(sums)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    n = max(1, files.count())
    return files.select("path", "start").repartition(n).mapInArrow(read, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def token_table(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Write ``docs`` to a fresh folder of the shared one and read the result back."""
    return read_tokens(write_tokens(docs, new_dir(docs.sparkSession, "tokens"), id_col, text))
