"""Nearest neighbours: of each query the ``k`` least distances to all vectors, exactly; or, if asked, by an index.

Every query is compared with every vector, so that what is found depends on no number of vectors, buckets
or probes. The queries go to a file in the shared folder, which each task reads past chunks of its
vectors: neither vectors nor pairs are shuffled, only a chunk's best ``k`` of each query. Products in
single precision, with a bound of their error, tell which groups of vectors can hold one of the
best; those groups' distances are computed in double precision on the original vectors, and these alone
decide. The work is the number of queries times that of vectors.

With ``probes``, an index by cross-polytope hashing compares fewer, and misses some: a pseudo-rotation
(three rounds of random signs and a fast Hadamard transform, on vectors padded to a power of two) turns
unit vectors; each hashes to its nearest signed axis. A table has ``hashes`` of them side by side. All
vectors go once to their bucket of each table; a query goes to its own and to the next best ``probes``.
Buckets with the same first axis meet in one place, in blocks of a bounded size: a query brings there the
list of its buckets' other axes and is compared with those buckets' vectors only. Only each query's best
``k`` leave the block, so no pair of candidates is ever shuffled and a bucket of a third of all rows is just
more blocks. A query's lists are then merged; a query that met fewer than ``k`` is compared with all
vectors, as above.

Vectors that are null, zero, or hold null or other than finite components, or have another length
than the first of all (the most frequent; of those, the longest) take no part. Ties go to the smaller
id. Rows with a null id are candidates like others, after all ids in ties, and found as null. Rows that
repeat an id are candidates each, and a query of its own each, but never of themselves.
An empty table gives no rows. Other columns than the id and the vector play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow.fs import FileSelector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import ready
from cairn.plans.shared import filesystem, shared_path, written

#: Tables, axes hashed for a table, vectors of a block, queries compared together.
TABLES, HASHES, BLOCK, TOGETHER = 6, 2, 8192, 256
#: Results that a task holds before it merges them.
MERGE = 200_000
#: Bytes of vectors that a task compares with all queries at once, vectors of one product, vectors of a group.
CHUNK, TILE, GROUP = 64 << 20, 2048, 16
#: Squared norms from which a product in single precision may overflow.
PRECISE = 1e37
#: Of a table's buckets one in so many is probed among so many vectors, and fewer by this power among more.
SHARE, AMONG, POWER = 24, 50_000, 0.2
NO_ID = (1 << 63) - 1


def probes_of(n: int, buckets: int) -> int:
    """Probes to ask of the index for distances that grow with the 0.8th power of n; what is found then depends on n, so
    only callers who say so get them."""
    return max(1, min(buckets, round(buckets / SHARE * (AMONG / max(n, 1)) ** POWER)))


def hadamard(x: np.ndarray) -> np.ndarray:
    """The orthonormal Walsh-Hadamard transform of each row; a power of two columns."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.concatenate([x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]], 2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def rotated(x: np.ndarray, seed: int) -> np.ndarray:
    d = 1 << (x.shape[1] - 1).bit_length()
    rng = np.random.default_rng(seed)
    x = np.pad(x, ((0, 0), (0, d - x.shape[1])))
    for _ in range(3):
        x = hadamard(x * rng.choice([-1.0, 1.0], d))
    return x


def codes(x: np.ndarray, table: int, hashes: int, probes: int, seed: int = 0) -> np.ndarray:
    """The buckets of each row in a table, best first: rows x probes."""
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    axes, scores = [], []
    for h in range(hashes):
        y = rotated(unit, seed * 1_000_003 + table * 101 + h)
        both = np.concatenate([y, -y], 1)
        m = min(probes, both.shape[1])
        at = np.argsort(-both, axis=1, kind="stable")[:, :m] if m > 1 else both.argmax(1)[:, None]
        axes.append(at)
        scores.append(np.take_along_axis(both, at, 1))
    width = 2 * (1 << (x.shape[1] - 1).bit_length())
    if hashes == 1:
        return axes[0]
    # the best combinations are among those whose ranks multiply to at most ``probes``
    ranks = [r for r in product(range(axes[0].shape[1]), repeat=hashes) if np.prod([i + 1 for i in r]) <= probes]
    total = np.stack([sum(scores[h][:, r[h]] for h in range(hashes)) for r in ranks], 1)
    code = np.stack([sum(axes[h][:, r[h]].astype(np.int64) * width**h for h in range(hashes)) for r in ranks], 1)
    return np.take_along_axis(code, np.argsort(-total, axis=1, kind="stable")[:, :probes], 1)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


_PLACED = ["bucket", "side", "id", "row", "sub", "vector"]
_FOUND = ["query_id", "query_row", "vec_id", "vec_row", "score"]
_FOUND_TYPES = "query_id long, query_row long, vec_id long, vec_row long, score double"


def _route(batches: Iterator[pa.RecordBatch], tables: int, hashes: int, probes: int) -> Iterator[pa.RecordBatch]:
    """(bucket, side, id, row, sub, vector): side 0 of every vector, side 1 of queries; ``bucket`` is the table and
    the first axis, ``sub`` the other axes' number of a vector, and of all the buckets there that a query probes."""
    for b in batches:
        if not b.num_rows:
            continue
        x, query = _matrix(b.column("vector")), b.column("query").to_numpy(zero_copy_only=False)
        width = 2 * (1 << (x.shape[1] - 1).bit_length())
        raw = pa.array([v.tobytes() for v in x], pa.binary())
        for t in range(tables):
            sub, axis = np.divmod(codes(x, t, hashes, 1)[:, 0].astype(np.int64), width)
            yield pa.RecordBatch.from_arrays([pa.array(axis * tables + t), pa.array(np.zeros(len(x), np.int32)), b.column("id"), b.column("row"), pa.array([v.tobytes() for v in sub.astype("<i8")], pa.binary()), raw], _PLACED)
            for at in np.array_split(every := np.flatnonzero(query), len(every) // 1024 + 1):
                if not len(at):
                    continue
                c = codes(x[at], t, hashes, probes).astype(np.int64)
                who = np.repeat(np.arange(len(at)), c.shape[1])
                sub, axis = np.divmod(c.ravel(), width)
                order = np.lexsort((sub, axis, who))
                who, axis, sub = who[order], axis[order], sub[order].astype("<i8")
                first = np.flatnonzero(np.append(True, (who[1:] != who[:-1]) | (axis[1:] != axis[:-1])))
                lists = pa.array([sub[i:j].tobytes() for i, j in zip(first, np.append(first[1:], len(sub)))], pa.binary())
                rows = pa.array(at[who[first]])
                yield pa.RecordBatch.from_arrays([pa.array(axis[first] * tables + t), pa.array(np.ones(len(first), np.int32)), b.column("id").take(rows), b.column("row").take(rows), lists, raw.take(rows)], _PLACED)


def _every(batches: Iterator[pa.RecordBatch], path: str, k: int) -> Iterator[pa.RecordBatch]:
    """Of each chunk of vectors, the best k of every query in the files of ``path``."""
    files, root = filesystem(path)
    names = sorted(f.path for f in files.get_file_info(FileSelector(root)) if f.path.endswith(".parquet"))

    def search(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.Table.from_batches([b.select(["id", "row"]) for b in parts]).combine_chunks().to_batches()[0]
        row, null = known.column("row").to_numpy(), known.column("id").is_null().to_numpy(zero_copy_only=False)
        ids = known.column("id").fill_null(NO_ID).to_numpy()
        n, d = len(row), len(parts[0].column("vector")[0])
        x = np.zeros((-(-n // TILE) * TILE, d))
        np.concatenate([_matrix(b.column("vector")) for b in parts], out=x[:n])
        norm = (x**2).sum(1)
        # a product is off by less than ``error`` times the sum of both squared norms, and a tiny number where it underflows
        error = 4 * (d + 4) * 2.0**-24
        flat = np.empty((len(x), d + 1), np.float32)
        flat[:, :d], flat[:, d] = x, norm * (1 + error)
        flat[n:, d] = np.inf
        most = norm.reshape(-1, GROUP).max(1)
        loose = np.where(most < PRECISE, 2 * error * most, np.inf)
        groups = x.reshape(-1, GROUP, d)
        by_row = np.argsort(row)

        def best(j: np.ndarray, o: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, ...]:
            order = np.lexsort((row[o], ids[o], null[o], score, j))
            order = order[np.arange(len(j)) - np.searchsorted(j[order], j[order]) < k]
            return j[order], o[order], score[order]

        for b in (b for name in names for b in _read(files, name)):
            y, asked, m = _matrix(b.column("vector")), b.column("row").to_numpy(), b.num_rows
            own_norm = (y**2).sum(1)
            right = np.concatenate([-2 * y, np.ones((m, 1))], 1).astype(np.float32).T
            own = by_row[np.minimum(np.searchsorted(row, asked, sorter=by_row), n - 1)]
            own = np.where(row[own] == asked, own, -1)
            near, least = np.empty((TILE, m), np.float32), np.empty((len(groups), m), np.float32)
            for i in range(0, len(x), TILE):
                np.matmul(flat[i : i + TILE], right, out=near)
                here = np.flatnonzero((own >= i) & (own < i + TILE))
                near[own[here] - i, here] = np.inf
                near.reshape(-1, GROUP, m).min(1, out=least[i // GROUP : (i + TILE) // GROUP])
            least = np.ascontiguousarray(least.T)
            # k groups have a vector within the limit each; what isn't a number is looked at
            limit = np.partition(least, k - 1, 1)[:, k - 1].astype(np.float64) if k <= len(groups) else np.full(m, np.inf)
            limit = np.where(own_norm < PRECISE, limit + 2 * error * own_norm + 1e-30, np.inf)
            j, g = np.nonzero(~(least > limit[:, None] + loose))
            found = []
            for lo in range(0, len(j), step := max(1, (1 << 21) // (d * GROUP))):
                q, near = j[lo : lo + step], groups[g[lo : lo + step]]
                near -= y[q][:, None]
                near *= near
                score = np.sqrt(near.sum(2))
                o = g[lo : lo + step, None] * GROUP + np.arange(GROUP)
                real = (o < n) & (o != own[q][:, None]) & ~(score**2 - own_norm[q][:, None] > limit[q][:, None])
                found.append(best(np.broadcast_to(q[:, None], o.shape)[real], o[real], score[real]))
            if found:
                j, o, score = best(*(np.concatenate(c) for c in zip(*found)))
                yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(j)), pa.array(asked[j]), known.column("id").take(pa.array(o)), pa.array(row[o]), pa.array(score)], _FOUND)

    parts, size = [], 0
    with np.errstate(over="ignore", invalid="ignore"):
        for b in batches:
            if b.num_rows:
                parts.append(b)
                size += len(b.column("vector").flatten()) * 8
            if size >= CHUNK:
                yield from search(parts)
                parts, size = [], 0
        if parts:
            yield from search(parts)


def _read(files, name: str) -> Iterator[pa.RecordBatch]:
    with files.open_input_file(name) as f:
        yield from pq.ParquetFile(f).iter_batches(TOGETHER, columns=["id", "row", "vector"], use_threads=False)


def _best(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Of each bucket's block, every query's best k; rows of a block follow each other. Lists of one query are merged
    as long as a task holds them."""

    def merged(found: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(found).combine_chunks()
        q, v, score = (t[c].to_numpy() for c in ("query_row", "vec_row", "score"))
        order = np.lexsort((v, t["vec_id"].fill_null(NO_ID).to_numpy(), score, q))
        q, v = q[order], v[order]
        new = np.append(True, (q[1:] != q[:-1]) | (v[1:] != v[:-1]))  # the same pair has the same score
        order, q = order[new], q[new]
        return t.take(pa.array(order[np.arange(len(q)) - np.searchsorted(q, q) < k])).combine_chunks().to_batches()[0]

    def search(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(parts).combine_chunks()
        side = t["side"].to_numpy()
        ids, row = t["id"].fill_null(NO_ID).to_numpy(), t["row"].to_numpy()
        x = np.frombuffer(b"".join(t["vector"].to_pylist()), np.float64).reshape(len(side), -1)
        lists = [np.frombuffer(v.as_buffer(), "<i8") for v in t["sub"].chunk(0)] if len(side) else []
        q, c = np.flatnonzero(side == 1), np.flatnonzero(side == 0)
        if not len(q) or not len(c):
            return
        sub = np.array([lists[i][0] for i in c])
        c = c[np.argsort(sub, kind="stable")]
        sub = np.sort(sub)
        xc, nc = x[c], (x[c] ** 2).sum(1)
        slack = 1e-9 * (1 + nc.max())
        for i in range(0, len(q), TOGETHER):
            part = q[i : i + TOGETHER]
            near = np.full((len(part), len(c)), np.inf)
            wants = np.concatenate([lists[r] for r in part])
            who = np.repeat(np.arange(len(part)), [len(lists[r]) for r in part])
            order = np.argsort(wants, kind="stable")
            wants, who = wants[order], who[order]
            starts = np.flatnonzero(np.append(True, wants[1:] != wants[:-1]))
            for lo, hi in zip(starts, np.append(starts[1:], len(wants))):
                a, z = np.searchsorted(sub, wants[lo], "left"), np.searchsorted(sub, wants[lo], "right")
                if a < z:
                    near[who[lo:hi], a:z] = nc[a:z] - 2 * x[part[who[lo:hi]]] @ xc[a:z].T  # ranks as the distance does, but for rounding
            near[row[part][:, None] == row[c][None, :]] = np.inf
            limit = np.partition(near, min(k, len(c)) - 1, axis=1)[:, min(k, len(c)) - 1]
            j, o = np.nonzero((near <= limit[:, None] + slack) & np.isfinite(near))
            if not len(j):
                continue
            exact = np.sqrt(((xc[o] - x[part[j]]) ** 2).sum(1))
            order = np.lexsort((row[c[o]], ids[c[o]], exact, j))
            j, o, exact = j[order], o[order], exact[order]
            ranked = np.arange(len(j)) - np.searchsorted(j, j) < k
            j, o, exact = part[j[ranked]], c[o[ranked]], exact[ranked]
            yield pa.RecordBatch.from_arrays([pa.array(ids[j], mask=ids[j] == NO_ID), pa.array(row[j]), pa.array(ids[o], mask=ids[o] == NO_ID), pa.array(row[o]), pa.array(exact)], _FOUND)

    def blocks() -> Iterator[list[pa.RecordBatch]]:
        last, parts = None, []
        for b in batches:
            keys = np.stack([b.column("bucket").to_numpy(), b.column("block").to_numpy()], 1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                if last is not None and tuple(keys[lo]) != last and parts:
                    yield parts
                    parts = []
                last = tuple(keys[lo])
                parts.append(b.slice(lo, hi - lo))
        if parts:
            yield parts

    found: list[pa.RecordBatch] = []
    for parts in blocks():
        found += search(parts)
        if sum(map(len, found)) > MERGE:
            found = [merged(found)]
            if len(found[0]) > MERGE // 2:
                yield found.pop()
    if found:
        yield merged(found)


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, tables: int = TABLES, probes: int | None = None, hashes: int = HASHES, block: int = BLOCK, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: of each query the ``k`` nearest of all; with ``probes``, buckets of a table of the index, the ``k`` nearest met there."""
    spark = vectors.sparkSession
    ready(spark)
    v = F.col("vector")
    good = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf")))) & F.exists(v, lambda e: e != 0)
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("query"), F.monotonically_increasing_id().alias("row")).where(good)
    rows = written(spark, rows, "ann-vectors")
    usual = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    n = 0
    if usual is not None:
        rows, n = rows.where(F.size("vector") == usual["d"]), usual["count"]
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy("score", F.col("vec_id").asc_nulls_last(), "vec_row"))
    found = _exact(rows, rows.where("query"), k) if probes is None else _indexed(rows, n, k, tables, probes, hashes, block)
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _exact(rows: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """The best k of each chunk of ``rows``, of every query asked."""
    path = shared_path(rows.sparkSession, "ann-queries")
    asked.select("id", "row", "vector").write.parquet(path)
    return rows.select("id", "row", "vector").mapInArrow(partial(_every, path=path, k=k), _FOUND_TYPES)


def _indexed(rows: DataFrame, n: int, k: int, tables: int, probes: int, hashes: int, block: int) -> DataFrame:
    """The best k that each query meets in its buckets, of n rows; of those that meet fewer, the best of all."""
    spark = rows.sparkSession
    placed = "bucket long, side int, id long, row long, sub binary, vector binary"
    routed = rows.mapInArrow(partial(_route, tables=tables, hashes=hashes, probes=probes or 1), placed)
    counts = rows.mapInArrow(partial(_own, tables=tables), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    blocks = written(spark, counts.select(F.col("bucket").alias("_b"), (F.floor((F.col("n") - 1) / block) + 1).cast("int").alias("blocks")), "ann-blocks")
    # vectors fall into one of their bucket's blocks, queries go to all
    spread = F.explode(F.when(F.col("side") == 1, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))))
    found = written(spark, _search(routed.join(F.broadcast(blocks), F.col("bucket") == F.col("_b")).withColumn("block", spread), k).dropDuplicates(["query_row", "vec_row"]), "ann-found")  # a row a table and axis
    # queries with too few: against all vectors
    got = found.groupBy("query_row").count()
    short = rows.where("query").join(got, F.col("row") == F.col("query_row"), "left").where(F.coalesce("count", F.lit(0)) < min(k, n - 1)).select("row", "id", "vector")
    if short.take(1):
        found = found.unionByName(_exact(rows, short, k)).dropDuplicates(["query_row", "vec_row"])
    return found


def _search(placed: DataFrame, k: int) -> DataFrame:
    placed = placed.select("bucket", F.col("block").cast("long").alias("block"), "side", "id", "row", "sub", "vector")
    return placed.repartition("bucket", "block").sortWithinPartitions("bucket", "block").mapInArrow(partial(_best, k=k), _FOUND_TYPES)


def _own(batches: Iterator[pa.RecordBatch], tables: int) -> Iterator[pa.RecordBatch]:
    """Vectors by table and first axis."""
    for b in batches:
        if b.num_rows:
            x = _matrix(b.column("vector"))
            for t in range(tables):
                bucket, n = np.unique(codes(x, t, 1, 1)[:, 0].astype(np.int64) * tables + t, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(n)], ["bucket", "n"])
