"""Token ids in files of fixed-width bit-packed blocks.

A file holds the ids of whole documents, on end, in ascending order of the documents' ids:

    blocks   each of ``block`` ids (the last of the rest), every id in ``bits`` bits, lowest bit
             first, padded to whole bytes
    index    int64 doc_id, int64 number of ids, for each document; uint64 offset of each block
    trailer  magic, bits, block, documents, ids, blocks: six uint64

All widths are fixed, so any id is found by its number: block ``i // block`` begins at its offset and
unpacks by numpy alone. Files are named by their place in the order; a file that a task has begun
counts only once it is renamed, so that tasks may be run again.

Null texts are empty and hold the end id alone; repeated rows are written each; equal doc_ids
follow in the order of their texts' hashes; a null doc_id comes first. An empty table gives no file.
Columns other than the id and the text are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import let_go, ready, slices, text_of
from cairn.llm.tokens import encoder
from cairn.plans.shared import filesystem, shared_path

MAGIC = int.from_bytes(b"BITTOK01", "little")
BLOCK = 1 << 16
NO_ID = -(1 << 63)


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """Ids below 2 ** bits, each in ``bits`` bits, lowest first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    each = (ids.astype(np.uint64)[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(each.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack_bits(data: bytes, bits: int, n: int) -> np.ndarray:
    """The first n ids of packed bytes, as uint32."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint32)
    each = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return (each.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(1, dtype=np.uint32)


class Writer:
    """Writes a file to a stream, a block at a time."""

    def __init__(self, out, bits: int, block: int = BLOCK):
        self.out, self.bits, self.block = out, bits, block
        self.rest, self.ids, self.at = np.zeros(0, np.uint32), 0, 0
        self.docs: list[np.ndarray] = []
        self.offsets: list[int] = []

    def add(self, doc_ids: np.ndarray, lens: np.ndarray, ids: np.ndarray) -> None:
        self.docs.append(np.stack([doc_ids, lens]).astype("<i8"))
        self.ids += len(ids)
        rest = np.concatenate([self.rest, ids])
        whole = len(rest) // self.block * self.block
        for i in range(0, whole, self.block):
            self._put(rest[i : i + self.block])
        self.rest = rest[whole:]

    def _put(self, ids: np.ndarray) -> None:
        self.offsets.append(self.at)
        self.at += self.out.write(data := pack_bits(ids, self.bits)) or len(data)

    def close(self) -> None:
        if len(self.rest):
            self._put(self.rest)
        docs = np.concatenate(self.docs, axis=1) if self.docs else np.zeros((2, 0), "<i8")
        self.out.write(docs[0].tobytes() + docs[1].tobytes() + np.array(self.offsets, "<u8").tobytes())
        self.out.write(np.array([MAGIC, self.bits, self.block, docs.shape[1], self.ids, len(self.offsets)], "<u8").tobytes())
        self.out.close()


class Reader:
    """Random access to a file: an Arrow file that can seek."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        magic, self.bits, self.block, docs, self.n_ids, blocks = map(int, np.frombuffer(file.read_at(48, size - 48), "<u8"))
        if magic != MAGIC:
            raise ValueError("not a token file")
        index = 16 * docs + 8 * blocks
        data = file.read_at(index, size - 48 - index)
        self.doc_ids, self.lens = np.frombuffer(data, "<i8", docs), np.frombuffer(data, "<i8", docs, 8 * docs)
        self.offsets = np.frombuffer(data, "<u8", blocks, 16 * docs)
        self.starts = np.concatenate([[0], np.cumsum(self.lens)])

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids number start to stop of the file."""
        if stop <= start:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (stop - 1) // self.block
        parts = []
        for k in range(first, last + 1):
            n = min(self.block, self.n_ids - k * self.block)
            parts.append(unpack_bits(self.file.read_at((n * self.bits + 7) // 8, int(self.offsets[k])), self.bits, n))
        return np.concatenate(parts)[start - first * self.block : stop - first * self.block]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.starts[i + 1]))


def _write(batches: Iterator[pa.RecordBatch], path: str, tokenizer: str, kind: str, end: int) -> Iterator[pa.RecordBatch]:
    task = TaskContext.get()
    files, root = filesystem(path)
    files.create_dir(root, recursive=True)
    part = task.partitionId()
    draft, name = f"{root}/_draft-{part:08d}-{task.taskAttemptId()}", f"{root}/ids-{part:08d}.bin"
    enc = encoder(tokenizer, kind)
    bits = max(1, (max(enc.tok.get_vocab_size() - 1, end)).bit_length())
    writer = None
    for b in slices(batches, most=8 << 20, work="tokens"):
        ids, ends = enc.encode(text_of(b.column("text")))
        ids = np.insert(ids, ends[1:], end)
        if writer is None:
            writer = Writer(files.open_output_stream(draft), bits)
        writer.add(b.column("doc_id").fill_null(NO_ID).to_numpy(), np.diff(ends) + 1, ids)
    if writer is not None:
        writer.close()
        if files.get_file_info(name).is_file:  # of an earlier run of this task: the same
            files.delete_file(draft)
        else:
            files.move(draft, name)
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([writer.ids], pa.int64())], ["part", "n"])


def _read(batches: Iterator[pa.RecordBatch], path: str, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    let_go()
    files, root = filesystem(path)
    for b in batches:
        for part, base in zip(b.column("part").to_pylist(), b.column("base").to_pylist()):
            with files.open_input_file(f"{root}/ids-{part:08d}.bin") as f:
                r = Reader(f)
                at = 0
                while at < len(r.lens):
                    to = max(at + 1, int(np.searchsorted(r.starts, r.starts[at] + most, side="right")) - 1)
                    ids = r.ids(int(r.starts[at]), int(r.starts[to])).astype("<u4")
                    off = ((r.starts[at : to + 1] - r.starts[at]) * 4).astype("<i4")
                    data = pa.Array.from_buffers(pa.binary(), to - at, [None, pa.py_buffer(off), pa.py_buffer(ids)])
                    keys = r.doc_ids[at:to]
                    yield pa.RecordBatch.from_arrays([pa.array(keys, mask=keys == NO_ID), pa.array(base + r.starts[at:to]), pa.array(r.lens[at:to]), data], ["doc_id", "start", "n_tokens", "ids"])
                    at = to


def write_ids(docs: DataFrame, path: str, tokenizer: str, kind: str = "byte", end: int = 0, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[int, int]]:
    """Writes the documents' ids to files in ``path``; returns (part, ids) of each file, in order."""
    ready(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    tie = F.xxhash64("text")
    ranged = rows.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie)
    out = ranged.mapInArrow(partial(_write, path=path, tokenizer=tokenizer, kind=kind, end=end), "part long, n long").collect()  # a row a file
    return sorted((r["part"], r["n"]) for r in out)


def read_ids(spark: SparkSession, path: str, parts: list[tuple[int, int]]) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids (little-endian uint32) of each document."""
    ready(spark)
    bases = np.concatenate([[0], np.cumsum([n for _, n in parts])]).astype(int).tolist()
    files = spark.createDataFrame([(p, b) for (p, _), b in zip(parts, bases)], "part long, base long")
    return files.repartition(max(len(parts), 1), "part").mapInArrow(partial(_read, path=path), "doc_id long, start long, n_tokens long, ids binary")


def roundtrip(docs: DataFrame, tokenizer: str, **how) -> DataFrame:
    """Writes the documents' ids to new files in the shared folder and reads them back."""
    path = shared_path(docs.sparkSession, "ids")
    return read_ids(docs.sparkSession, path, write_ids(docs, path, tokenizer, **how))
