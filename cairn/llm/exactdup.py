"""Exact deduplication by an extendible-hash index on shared files.

Every text, without the characters of ``[\\x20\\x09-\\x0D]``, gets a 64-bit key, its SHA-256 and its
length. Tasks first collapse the copies among the texts that they hold together, comparing bytes, so
that a text of a third of all rows is one entry for so many megabytes. The keys' upper bits name the
owner task of an entry. Owners insert the entries, with the packed bytes of their texts, into an
extendible-hash index: a directory over buckets of a bounded size, in which an overfull bucket splits,
and the directory doubles when their depths are equal. Entries with the same key chain in their
bucket; one whose bytes are those of a chained entry is added to it, which counts its rows and knows
the best of them. So the chains hold the result, and owners write them, without the texts, as one file
each. Rows then look their texts up in those files, in the chain of their key by SHA-256 and length,
which owners have checked to be different for different bytes. As the files are shared, rows of one
owner needn't stay in one task, and the hot ones are rebalanced over several.

Null counts as empty; empty texts are copies of each other. Of equal texts the row with the most
code points in the original stays, then that of the smallest doc_id (null last); of rows repeated
with both the same, one. An empty table gives no rows. Other columns of the input play no part,
whatever their names and types.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from functools import partial
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from cairn.llm.common import SPACE, by_id, fresh, join_hot, ready, slices, text_of
from cairn.plans.shared import filesystem, shared_path, written

#: Entries of a bucket before it splits; about so many entries and packed bytes of an owner; bytes that a task collapses together.
BUCKET, OWNER, OWNER_BYTES, TOGETHER = 32, 200_000, 16 << 20, 16 << 20
ENTRY = np.dtype([("h", "<u8"), ("sha", "V32"), ("n_bytes", "<i8"), ("tag", "<i8"), ("keep", "<i8"), ("known", "?"), ("n", "<i8")])


class ExtendibleIndex:
    """An extendible-hash index: entries by key, in buckets that a directory of 2 ** depth slots finds."""

    def __init__(self, bucket: int = BUCKET, deepest: int = 40):
        self.bucket, self.deepest, self.depth = bucket, deepest, 0
        self.buckets: list[tuple[int, list[int], list[int]]] = [(0, [], [])]  # depth, keys, entries
        self.directory = [0]

    def chain(self, key: int) -> list[int]:
        """The entries with this key."""
        _, keys, entries = self.buckets[self.directory[key & ((1 << self.depth) - 1)]]
        return [e for k, e in zip(keys, entries) if k == key]

    def insert(self, key: int, entry: int) -> None:
        while True:
            at = self.directory[key & ((1 << self.depth) - 1)]
            depth, keys, entries = self.buckets[at]
            if len(keys) < self.bucket or depth == self.deepest or all(k == key for k in keys):
                keys.append(key)
                entries.append(entry)
                return
            self._split(at)

    def _split(self, at: int) -> None:
        depth, keys, entries = self.buckets[at]
        if depth == self.depth:
            self.directory += self.directory
            self.depth += 1
        low, high = (depth + 1, [], []), (depth + 1, [], [])
        for k, e in zip(keys, entries):
            side = high if k >> depth & 1 else low
            side[1].append(k)
            side[2].append(e)
        self.buckets[at] = low
        self.buckets.append(high)
        first = next(s for s in range(1 << depth) if self.directory[s] == at)
        for s in range(first | 1 << depth, len(self.directory), 1 << (depth + 1)):
            self.directory[s] = len(self.buckets) - 1

    def tobytes(self, entries: np.ndarray) -> bytes:
        out = io.BytesIO()
        order = np.array([e for _, _, es in self.buckets for e in es], dtype=np.int64)
        starts = np.concatenate([[0], np.cumsum([len(b[1]) for b in self.buckets])])
        np.savez(out, directory=np.array(self.directory, np.int64), starts=starts, entries=entries[order].view(np.uint8))
        return out.getvalue()


class StoredIndex:
    """Lookups in the bytes of an index."""

    def __init__(self, data: bytes):
        with np.load(io.BytesIO(data)) as z:
            self.directory, self.starts, self.entries = z["directory"], z["starts"], z["entries"].view(ENTRY)

    def find(self, keys: np.ndarray, sha: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
        """The place of each key's entry; -1 where there is none."""
        bucket = self.directory[(keys & np.uint64(len(self.directory) - 1)).astype(np.int64)]
        at, end = self.starts[bucket], self.starts[bucket + 1]
        found = np.full(len(keys), -1)
        left = np.flatnonzero(at < end)
        step = 0
        while len(left):
            here = at[left] + step
            e = self.entries[here]
            same = (e["h"] == keys[left]) & (e["n_bytes"] == n_bytes[left])
            same[same] = e["sha"][same] == sha[left][same]
            found[left[same]] = here[same]
            left = left[~same]
            step += 1
            left = left[at[left] + step < end[left]]
        return found


class Chains:
    """Texts in an extendible-hash index; equal ones are one entry, which counts their rows and knows the best of them."""

    def __init__(self):
        self.index = ExtendibleIndex()
        self.packed: list[bytes] = []
        self.digests: list[tuple[bytes, int]] = []  # SHA-256, length
        self.keys: list[int] = []
        self.n: list[int] = []
        self.best: list[tuple] = []  # fewer code points (negative), null id, id, tag

    def add(self, key: int, sha: bytes, n_bytes: int, packed: bytes, n: int, best: tuple) -> None:
        for e in self.index.chain(key):
            if self._same(e, sha, n_bytes, packed):
                self.n[e] += n
                self.best[e] = min(self.best[e], best)
                return
        self.index.insert(key, len(self.keys))
        self.keys.append(key)
        self.digests.append((sha, n_bytes))
        self.packed.append(packed)
        self.n.append(n)
        self.best.append(best)

    def _same(self, e: int, sha: bytes, n_bytes: int, packed: bytes) -> bool:
        if self.packed[e] == packed:
            return True
        if self.digests[e] != (sha, n_bytes):
            return False
        unpack = zstandard.ZstdDecompressor().decompress  # other bytes may still be the same text's, packed elsewhere
        if unpack(self.packed[e]) != unpack(packed):
            raise RuntimeError("two texts have the same SHA-256 and length")
        return True

    def entries(self) -> np.ndarray:
        out = np.zeros(len(self.keys), ENTRY)
        out["h"] = np.array(self.keys, np.uint64)
        out["sha"] = np.frombuffer(b"".join(s for s, _ in self.digests), "V32")
        out["n_bytes"] = [n for _, n in self.digests]
        out["n"] = self.n
        out["known"] = [not b[1] for b in self.best]
        out["keep"] = [b[2] for b in self.best]
        out["tag"] = [b[3] for b in self.best]
        return out


_ROWS = "doc_id long, tag long, h long, sha binary, n_bytes long, n long, best_chars long, best_id long, best_tag long, packed binary"


def _keys(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """A row a document: its key, digest and length. The first of equal texts among those that the task holds
    together has the number and the best of them too, and the packed bytes."""
    pack = zstandard.ZstdCompressor(level=1).compress
    mask = (1 << width) - 1
    for b in slices(batches, most=TOGETHER):
        text = pc.fill_null(text_of(b.column("text")), "")
        chars, ids, tags = pc.utf8_length(text).to_pylist(), b.column("doc_id").to_pylist(), b.column("tag").to_pylist()
        first: dict[bytes, int] = {}
        of, best, n = [], [], [0] * b.num_rows
        for i, x in enumerate(text.cast(pa.binary()).to_pylist()):
            at = first.setdefault(x.translate(None, SPACE), i)  # compares bytes
            of.append(at)
            n[at] += 1
            best.append((-chars[i], ids[i] is None, ids[i] or 0, tags[i]))
            if at != i:
                best[at] = min(best[at], best[i])
        known = {i: (xxh64_intdigest(x) & mask, sha256(x).digest(), len(x), pack(x)) for x, i in first.items()}
        h = np.array([known[i][0] for i in of], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [
                b.column("doc_id"), b.column("tag"), pa.array(h), pa.array([known[i][1] for i in of], pa.binary()), pa.array([known[i][2] for i in of], pa.int64()),
                pa.array(n, pa.int64()), pa.array([x[0] for x in best], pa.int64()), pa.array([None if x[1] else x[2] for x in best], pa.int64()), pa.array([x[3] for x in best], pa.int64()),
                pa.array([known[i][3] if i in known else None for i in range(b.num_rows)], pa.binary()),
            ],
            [c.split()[0] for c in _ROWS.split(", ")],
        )


def _build(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Inserts the entries of each owner, whose rows follow each other, and writes its file."""
    files, root = filesystem(path)
    files.create_dir(root, recursive=True)

    def store(owner: int, chains: Chains) -> pa.RecordBatch:
        with files.open_output_stream(f"{root}/owner-{owner:08d}.ehx") as out:
            out.write(chains.index.tobytes(chains.entries()))
        return pa.RecordBatch.from_arrays([pa.array([owner], pa.int64()), pa.array([len(chains.keys)], pa.int64())], ["owner", "n"])

    last, chains = None, Chains()
    for b in batches:
        owners = b.column("owner").to_numpy()
        keys = b.column("h").to_numpy().view(np.uint64).tolist()
        cols = [b.column(c).to_pylist() for c in ("sha", "n_bytes", "packed", "n", "best_chars", "best_id", "best_tag")]
        for lo, hi in _runs(owners):
            if owners[lo] != last and last is not None:
                yield store(int(last), chains)
                chains = Chains()
            last = owners[lo]
            for k, sha, n_bytes, packed, n, c, i, t in zip(keys[lo:hi], *(x[lo:hi] for x in cols)):
                chains.add(k, sha, n_bytes, packed, n, (c, i is None, i or 0, t))
    if last is not None:
        yield store(int(last), chains)


def _runs(x: np.ndarray) -> list[tuple[int, int]]:
    """Where equal neighbours begin and end."""
    cuts = np.flatnonzero(np.diff(x)) + 1
    return [*zip([0, *cuts.tolist()], [*cuts.tolist(), len(x)])] if len(x) else []


def _look_up(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    files, root = filesystem(path)
    open_: dict[int, StoredIndex] = {}
    for b in batches:
        owners = b.column("owner").to_numpy()
        keys = b.column("h").to_numpy().view(np.uint64)
        sha = np.frombuffer(b"".join(b.column("sha").to_pylist()), "V32")
        n_bytes = b.column("n_bytes").to_numpy()
        out = np.zeros(len(b), ENTRY)
        for o in np.unique(owners).tolist():
            if o not in open_:
                if len(open_) >= 8:
                    open_.pop(next(iter(open_)))
                with files.open_input_file(f"{root}/owner-{o:08d}.ehx") as f:
                    open_[o] = StoredIndex(f.read())
            rows = np.flatnonzero(owners == o)
            at = open_[o].find(keys[rows], sha[rows], n_bytes[rows])
            if (at < 0).any():
                raise RuntimeError("a text isn't in the index of its owner")
            out[rows] = open_[o].entries[at]
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), pa.array(out["keep"], mask=~out["known"]), pa.array(out["n"]), pa.array(out["tag"] == b.column("tag").to_numpy()), pa.array([x.tobytes().hex() for x in sha])],
            ["doc_id", "keep_id", "group_size", "kept", "text_sha256"],
        )


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key_bits: int = 64) -> DataFrame:
    """One row for each document: doc_id, keep_id, group_size, kept, text_sha256.

    ``key_bits`` narrows the index's keys, so that tests meet collisions.
    """
    spark = docs.sparkSession
    ready(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("tag"))
    keys = written(spark, rows.mapInArrow(partial(_keys, width=key_bits), _ROWS), "exact-keys")
    entries = keys.where("packed is not null")
    n, size = entries.agg(F.count("*"), F.sum(F.octet_length("packed"))).first()
    bits = max(5, (n // OWNER).bit_length(), ((size or 0) // OWNER_BYTES).bit_length())
    owner = F.shiftrightunsigned("h", max(key_bits - bits, 0)).cast("long").alias("owner")
    path = shared_path(spark, "exact-index")
    sent = entries.select(owner, "h", "sha", "n_bytes", "n", "best_chars", "best_id", "best_tag", "packed")
    sent.repartitionById(1 << bits, F.col("owner").cast("int")).sortWithinPartitions("owner").mapInArrow(partial(_build, path=path), "owner long, n long").agg(F.sum("n")).collect()
    keys = keys.select("doc_id", "tag", "h", "sha", "n_bytes")
    spread = spark.sql("SELECT /*+ REBALANCE(owner) */ * FROM {k}", k=keys.select("*", owner))
    return spread.mapInArrow(partial(_look_up, path=path), "doc_id long, keep_id long, group_size long, kept boolean, text_sha256 string")


def bare_sha(text) -> "F.Column":
    """SHA-256 (hex) of a text without its white space; null is as empty."""
    return F.sha2(F.translate(F.coalesce(text, F.lit("")), SPACE.decode(), "").cast("binary"), 256)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without those that copy one that stays; columns and kept rows as they were.

    Rows are found again by their ids, which grow with the documents and are never broadcast. Rows that
    share an id, or have none, are written with a number and told apart by their texts too.
    """
    spark = docs.sparkSession
    id_, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    groups = exact_groups(docs, id_col, text_col).where("kept").select("keep_id", F.col("text_sha256").alias("sha"), "group_size")
    groups = written(spark, groups, "exact-kept")
    once, some, tag = by_id(docs, id_col)
    key = fresh(docs.columns, "kept")
    stay = once.join(groups.where("keep_id is not null").select(F.col("keep_id").alias(key)).hint("merge"), id_.cast("long") == F.col(key), "left_semi")
    own = written(spark, some.select(F.col(tag).alias("tag"), id_.cast("long").alias("id"), bare_sha(text).alias("sha"), F.coalesce(F.length(text), F.lit(0)).alias("n_chars")), "exact-repeated")
    placed = join_hot(own, groups, "sha", "group_size", own.count()).where("id <=> keep_id")
    chosen = placed.groupBy("sha").agg(F.min(F.struct(-F.col("n_chars"), "tag")).alias("m")).select(F.col("m.tag").alias(key))
    return stay.unionByName(some.join(written(spark, chosen, "exact-chosen"), F.col(tag) == F.col(key), "left_semi").drop(tag))
