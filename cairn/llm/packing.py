"""Packing of documents into training sequences by lexical retrieval.

The documents' ids are written once, with the number of documents that hold each id, which is at
most one number an id of the vocabulary. Documents are then brought together by what they hold: a
range shuffle orders all of them by their three rarest ids that another document holds too, so that
like documents meet whatever file they come from; rows with equal keys are parted by a number of
their own, so no group of copies is bound to one task. Every task cuts its range into shards of a bounded
number of ids, each with a BM25 inverted index over its own documents but weighted by the counts
and the mean length over all documents. A window is filled from a seed: the rest of the document
that the last window cut, or the next unused one. Queried with all distinct ids of the seed, the
index returns its unused neighbours, best first, which fill the window; the last is cut, and its
rest seeds the next window.
Where the index knows no unused neighbour, the next unused document in the same order follows, so
all are packed. A seed's neighbours are those of its shard: the search is exact there, and the order
by rarest ids decides which documents these are.

Windows run on over a task's shards. At a task's end the ids left over make sequences with lengths
that are powers of two, which need no padding.

Null and empty texts hold the end id alone. Repeated rows are packed each. An empty table gives no
rows. Columns of the input other than the id and the text are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cairn.llm.common import let_go, ready, slices, text_of
from cairn.llm.tokens import encoder
from cairn.plans.shared import written

#: Ids of a shard, and neighbours that one query returns (a seed that needs more is queried again).
SHARD_IDS, NEIGHBOURS = 2_000_000, 16
#: Ranges are of two shards' ids, until there are so many of them; rows of a range that are sampled for its bounds.
RANGES, SAMPLED = 50_000, 64
K1, B = 1.2, 0.75


def id_type(vocabulary: int) -> np.dtype:
    return np.dtype("<u2" if vocabulary <= 1 << 16 else "<u4")


def _encode(batches: Iterator[pa.RecordBatch], path: str, kind: str, end: int, names: tuple[str, str]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, ids, n, null), and at the end one row (null, null, -1, documents by id) of the task."""
    enc = encoder(path, kind)
    df = np.zeros(enc.tok.get_vocab_size() + 1, np.int64)
    width = id_type(len(df))
    key, text = names
    for b in slices(batches, text, most=4 << 20, work="tokens"):
        ids, ends = enc.encode(text_of(b.column(text)))
        n = b.num_rows
        with_end = np.insert(ids.astype(width), ends[1:], end)
        ends = ends + np.arange(n + 1)
        for lo in range(0, n, 16_384):  # so many rows that a row and an id fit in 32 bits
            hi = min(lo + 16_384, n)
            some = np.sort(np.repeat(np.arange(hi - lo, dtype=np.uint32), np.diff(ends[lo : hi + 1])) * np.uint32(len(df)) + with_end[ends[lo] : ends[hi]])
            new = np.ones(len(some), bool)
            new[1:] = some[1:] != some[:-1]
            df += np.bincount(some[new] % len(df), minlength=len(df))
        data = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((ends * width.itemsize).astype("<i4")), pa.py_buffer(with_end)])
        yield pa.RecordBatch.from_arrays([b.column(key).cast(pa.int64()), data, pa.array(np.diff(ends)), pa.nulls(n, pa.binary())], ["doc_id", "ids", "n", "df"])
    yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([None], pa.binary()), pa.array([-1], pa.int64()), pa.array([df.astype("<i8").tobytes()], pa.binary())], ["doc_id", "ids", "n", "df"])


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for b in batches:
        for x in b.column("df"):
            v = np.frombuffer(x.as_buffer(), "<i8")
            total = v if total is None else total + v
    if total is not None:
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["id", "n"])


def rarity(df: np.ndarray) -> np.ndarray:
    """Of each id its rank by the documents that hold it, from the rarest up; ids of one document come last, as nothing shares them."""
    out = np.zeros(len(df), np.int32)
    out[np.lexsort((np.arange(len(df)), np.where(df < 2, np.inf, df)))] = np.arange(len(df), dtype=np.int32)
    return out


def rarest(flat: np.ndarray, ends: np.ndarray, rank: np.ndarray, keys: int = 3) -> list[np.ndarray]:
    """The ranks of each document's rarest distinct ids, ascending; a document with fewer repeats a value past all ranks."""
    past = np.int32(len(rank))
    r = rank[flat]
    starts, lens = ends[:-1], np.diff(ends)
    out = []
    for k in range(keys):
        out.append(np.minimum.reduceat(r, starts))
        if k + 1 < keys:
            r[r == np.repeat(out[-1], lens)] = past
    return out


def _keyed(batches: Iterator[pa.RecordBatch], rank: np.ndarray, width: np.dtype, bounds: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Rows with the keys that bring like documents together: for ``bounds`` None the keys and the size alone, else with
    the number of their range."""
    for b in slices(batches, "ids"):
        ids, n = b.column("ids"), b.column("n").to_numpy()
        keys = rarest(np.frombuffer(b"".join(ids.to_pylist()), width), np.concatenate([[0], np.cumsum(n)]), rank)
        both = keys[0].astype(np.int64) << 32 | keys[1]
        if bounds is None:
            yield pa.RecordBatch.from_arrays([pa.array(both), pa.array(keys[2]), b.column("salt"), b.column("n")], ["k", "k2", "salt", "n"])
            continue
        mine = np.zeros(len(n), PLACE)
        mine["k"], mine["k2"], mine["salt"] = both, keys[2], b.column("salt").to_numpy()
        every = np.concatenate([bounds, mine])
        order = np.lexsort((np.arange(len(every)), every["salt"], every["k2"], every["k"]))
        part = np.zeros(len(every), np.int32)
        part[order] = np.cumsum(order < len(bounds))
        part = part[len(bounds) :]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), ids, pa.array(both), pa.array(keys[2]), b.column("salt"), pa.array(part)], ["doc_id", "ids", "k", "k2", "salt", "part"])


#: A document's place in the order: its two rarest ids, the third, and a number of the row for those that share all.
PLACE = np.dtype([("k", "<i8"), ("k2", "<i4"), ("salt", "<i4")])


def _bounds(sample: pa.Table, ranges: int) -> np.ndarray:
    """The places that part the sampled rows in ranges of about equal numbers of ids."""
    place = np.zeros(sample.num_rows, PLACE)
    for c in PLACE.names:
        place[c] = sample[c].to_numpy()
    order = np.lexsort((place["salt"], place["k2"], place["k"]))
    upto = np.cumsum(sample["n"].to_numpy()[order])
    if not len(upto):
        return place
    return place[order][np.minimum(np.searchsorted(upto, upto[-1] / ranges * np.arange(1, ranges)), len(upto) - 1)]


def order(docs: list[np.ndarray], idf: np.ndarray, mean: float, window: int, filled: int = 0) -> list[int]:
    """The order in which a shard's documents follow each other; ``filled``: ids in the window so far."""
    n, lens = len(docs), np.array([len(d) for d in docs])
    pairs, tf = np.unique(np.repeat(np.arange(n, dtype=np.int64), lens) * len(idf) + np.concatenate(docs), return_counts=True)
    row, term = np.divmod(pairs, len(idf))
    weight = (idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lens[row] / mean))).astype(np.float32)
    first = np.searchsorted(row, np.arange(n + 1))
    per_term = np.bincount(term, minlength=len(idf))
    # ids of more than an eighth of the documents have a dense row, at most eight numbers a posting; the others a list
    common = np.flatnonzero(per_term * 8 > n)
    slot = np.full(len(idf), -1)
    slot[common] = np.arange(len(common))
    dense = np.zeros((len(common), n), np.float32)
    often = slot[term] >= 0
    dense[slot[term[often]], row[often]] = weight[often]
    rest = np.flatnonzero(~often)
    by_term = rest[np.argsort(term[rest], kind="stable")]
    post_row, post_weight = row[by_term], weight[by_term].astype(np.float64)  # as bincount takes them, without a copy
    starts = np.searchsorted(term[by_term], np.arange(len(idf) + 1))
    unused = np.ones(n, bool)
    out: list[int] = []
    nxt = 0
    held = np.arange(n)  # documents with postings

    def neighbours(seed: int) -> np.ndarray:
        nonlocal post_row, post_weight, starts, held, dense
        if len(out) == n:
            return none
        if n - len(out) <= len(held) * 3 // 4:  # so that used documents' postings are read no more
            left = unused[held]
            keep = left[post_row]
            starts = np.concatenate([[0], np.cumsum(keep)])[starts]
            post_row, post_weight = (np.cumsum(left) - 1)[post_row[keep]], post_weight[keep]
            dense, held = np.ascontiguousarray(dense[:, left]), held[left]
        terms = term[first[seed] : first[seed + 1]]
        at = slot[terms]
        spans = [slice(starts[t], starts[t + 1]) for t in terms[at < 0]]
        score = np.bincount(np.concatenate([none, *(post_row[s] for s in spans)]), np.concatenate([zero, *(post_weight[s] for s in spans)]), len(held))
        score = score + dense[at[at >= 0]].sum(0)
        score *= unused[held]
        k = min(NEIGHBOURS, len(held))
        best = np.argpartition(-score, k - 1)[:k]
        best = best[score[best] > 0]
        return held[best[np.lexsort((best, -score[best]))]]

    none, zero = np.zeros(0, np.int64), np.zeros(0)
    seed = -1
    while len(out) < n:
        if seed < 0:
            while not unused[nxt]:
                nxt += 1
            seed = nxt
            unused[seed] = False
            out.append(seed)
            filled += int(lens[seed])
        if filled >= window:
            filled %= window
            if filled == 0:
                seed = -1
                continue
        found = 0
        for d in neighbours(seed):
            found += 1
            unused[d] = False
            out.append(int(d))
            filled += int(lens[d])
            if filled >= window:
                filled %= window
                seed = int(d) if filled else -1
                break
        else:
            if not found:
                seed = -1
    return out


def _pack(batches: Iterator[pa.RecordBatch], idf: np.ndarray, mean: float, window: int, shard_ids: int, width: np.dtype) -> Iterator[pa.RecordBatch]:
    let_go()
    task = TaskContext.get()
    base = (task.partitionId() if task else 0) << 40
    state = {"sequence": 0, "left": []}  # left: pieces (doc_id, start, ids, doc_tokens) of the window that isn't full

    def shard(keys: list, docs: list[np.ndarray], last: bool) -> pa.RecordBatch | None:
        left = state["left"]
        filled = sum(len(x[2]) for x in left)
        at = order(docs, idf, mean, window, filled) if docs else []
        pieces = left + [(keys[i], 0, docs[i], len(docs[i])) for i in at]
        total = sum(len(p[2]) for p in pieces)
        cuts = [window] * (total // window)
        rest = total % window
        if last:
            cuts += [1 << k for k in reversed(range(window.bit_length())) if rest >> k & 1]
            rest = 0
        out: list[tuple] = []
        i = done = 0
        for c in cuts:
            offset = 0
            while offset < c:
                key, start, ids, size = pieces[i]
                take = min(c - offset, len(ids) - done)
                out.append((key, start + done, take, ids[done : done + take], size, base + state["sequence"], offset))
                offset += take
                done += take
                if done == len(ids):
                    i, done = i + 1, 0
            state["sequence"] += 1
        state["left"] = [(k, s + done * (j == 0), x[done:] if j == 0 else x, z) for j, (k, s, x, z) in enumerate(pieces[i:])]
        if not out:
            return None
        key, start, take, ids, size, seq, offset = zip(*out)
        flat = np.concatenate(ids).astype("<u4")
        data = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(take)]).astype("<i4") * np.int32(4)), pa.py_buffer(flat)])
        return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), *(pa.array(x, pa.int64()) for x in (start, take)), data, *(pa.array(x, pa.int64()) for x in (size, seq, offset))], ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    keys: list = []
    docs: list[np.ndarray] = []
    size = 0
    for b in batches:
        for k, x in zip(b.column("doc_id").to_pylist(), b.column("ids")):
            keys.append(k)
            docs.append(np.frombuffer(x.as_buffer(), width))
            size += len(docs[-1])
            if size >= shard_ids:
                if (r := shard(keys, docs, False)) is not None:
                    yield r
                keys, docs, size = [], [], 0
    if (r := shard(keys, docs, True)) is not None:
        yield r


def pack(docs: DataFrame, tokenizer: str, kind: str = "word", end: int = 1, window: int = 2048, shard_ids: int = SHARD_IDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece of a document in a sequence.

    doc_id, start (the document's ids before the piece), length, ids (the piece's, as little-endian
    unsigned 32-bit numbers), doc_tokens (with the end id), sequence_id, offset (ids before the
    piece in its sequence). ``window`` is a power of two.
    """
    if window < 1 or window & (window - 1):
        raise ValueError(f"window is a power of two, not {window}")
    spark = docs.sparkSession
    ready(spark)
    encoded = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col)).mapInArrow(partial(_encode, path=tokenizer, kind=kind, end=end, names=(id_col, text_col)), "doc_id long, ids binary, n long, df binary")
    ids = written(spark, encoded, "pack-ids")
    rows = ids.where("n >= 0").select("doc_id", "ids", "n")
    total, tokens = ids.where("n >= 0").agg(F.count("*"), F.sum("n")).first()
    counts = ids.where("n < 0").select("df").mapInArrow(_document_counts, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()  # at most one row an id of the vocabulary
    size = Tokenizer.from_file(tokenizer).get_vocab_size() + 1
    df = np.zeros(size)
    for r in counts:
        df[r["id"]] = r["n"]
    width = id_type(size)
    idf = np.log1p((total - df + 0.5) / (df + 0.5)).astype(np.float32)
    rows = rows.withColumn("salt", F.shiftright(F.xxhash64(F.monotonically_increasing_id()), 33).cast("int"))
    ranges = min((tokens or 0) // (2 * shard_ids) + 1, RANGES)
    rank = rarity(df)
    one_in = max(1, total // (SAMPLED * ranges))  # bounds come from a sample of a bounded size, the ranges hold all rows
    sample = rows.where(F.pmod("salt", F.lit(one_in)) == 0).mapInArrow(partial(_keyed, rank=rank, width=width, bounds=None), "k long, k2 int, salt int, n long").toArrow()
    bounds = _bounds(sample, ranges)
    keyed = rows.mapInArrow(partial(_keyed, rank=rank, width=width, bounds=bounds), "doc_id long, ids binary, k long, k2 int, salt int, part int")
    ranged = keyed.repartitionById(ranges, "part").sortWithinPartitions("k", "k2", "salt").select("doc_id", "ids")
    return ranged.mapInArrow(partial(_pack, idf=idf, mean=(tokens or 0) / max(total, 1), window=window, shard_ids=shard_ids, width=width), "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
