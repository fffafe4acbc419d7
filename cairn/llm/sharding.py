"""Sharding by Karmarkar-Karp differencing.

Groups of equal texts are indivisible. Groups of more than a 1/(256 k) part of all bytes, of which
there are fewer than 256 k, stand alone; the others are gathered, where their hashes put them, into
bundles of about that size. So differencing sees at most about 512 k items (and one a task) whatever
the number of documents. It keeps a partial partition of k sums for each item, and again and
again combines the two with the largest spread, the largest sum of one with the smallest of the other.

Texts that are null have no bytes and make one group; empty ones another. Repeated rows each get a
slot. An empty table gives no rows. Of the input's columns only the id and the text play a part.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import join_hot, ready
from cairn.plans.shared import written

#: Items of about equal size a shard that differencing works with; tasks that gather bundles; rows numbered together.
FINE, TASKS, NUMBERED = 256, 1024, 100_000


def differencing(sizes: list[int], k: int) -> list[int]:
    """The shard, 0 to k - 1, of each item."""
    if not sizes:
        return []
    # a partial partition: spread, order, sums ascending, and for each sum a tree of items
    heap = [(-s, i, [0] * (k - 1) + [s], [None] * (k - 1) + [i]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    n = len(sizes)
    while len(heap) > 1:
        _, _, a, ta = heapq.heappop(heap)
        _, _, b, tb = heapq.heappop(heap)
        merged = sorted(
            ((x + y, j, t if u is None else u if t is None else (t, u)) for j, (x, y, t, u) in enumerate(zip(a, reversed(b), ta, reversed(tb)))),
            key=lambda m: m[:2],
        )
        low = merged[0][0]
        heapq.heappush(heap, (low - merged[-1][0], n, [m[0] - low for m in merged], [m[2] for m in merged]))
        n += 1
    out = [0] * len(sizes)
    for shard, tree in enumerate(heap[0][3]):
        stack = [tree]
        while stack:
            t = stack.pop()
            if isinstance(t, tuple):
                stack += t
            elif t is not None:
                out[t] = shard
    return out


def _bundle(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    task = TaskContext.get()
    at = (task.partitionId() if task else 0) << 32
    held = most
    for b in batches:
        ids = []
        for s in b.column("bytes").to_pylist():
            if held + s > most:
                at, held = at + 1, 0
            held += s
            ids.append(at)
        yield pa.RecordBatch.from_arrays([b.column("sha"), b.column("n"), b.column("bytes"), pa.array(ids, pa.int64())], ["sha", "n", "bytes", "bundle"])


def shard(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, size (bytes of the text, and 1), text_crc32, shard, slot."""
    if shards < 1:
        raise ValueError("shards is 1 at least")
    spark = docs.sparkSession
    ready(spark)
    text = F.col(text_col).cast("binary")
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.coalesce(F.sha2(text, 256), F.lit("null")).alias("sha"), F.monotonically_increasing_id().alias("tag"))
    keys = written(spark, rows, "shard-keys")
    total, n = keys.agg(F.sum("size"), F.count("*")).first()
    most = max(1, (total or 0) // (FINE * shards))
    groups = keys.groupBy("sha").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    tasks = min(TASKS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    bundled = written(spark, groups.repartition(tasks, "sha").sortWithinPartitions(F.desc("bytes"), "sha").mapInArrow(partial(_bundle, most=most), "sha string, n long, bytes long, bundle long"), "shard-bundles")
    items = sorted((-r["s"], r["bundle"]) for r in bundled.groupBy("bundle").agg(F.sum("bytes").alias("s")).collect())  # at most 2 * FINE * shards + TASKS
    where = differencing([-s for s, _ in items], shards)
    places = spark.createDataFrame([(b, w) for (_, b), w in zip(items, where)], "bundle long, shard int")
    placed = join_hot(keys, bundled.join(F.broadcast(places), "bundle").select("sha", "n", "shard"), "sha", "n", n)
    placed = written(spark, placed.withColumn("part", F.pmod(F.xxhash64("tag"), F.lit(n // NUMBERED + 1))), "shard-placed")
    counts = placed.groupBy("shard", "part").count()
    base = counts.withColumn("base", F.sum("count").over(Window.partitionBy("shard").orderBy("part")) - F.col("count")).drop("count")
    slot = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "tag")) - 1
    return placed.withColumn("_row", slot).join(base, ["shard", "part"]).select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("_row")).cast("long").alias("slot"))
