"""Connected components of an edge table, by stars."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import ready
from cairn.plans.shared import written


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of a task, a bounded number at a time, as stars around the least node of each component."""
    for b in batches:
        up: dict[int, int] = {}

        def find(x: int) -> int:
            root = x
            while (r := up.get(root, root)) != root:
                root = r
            while (r := up.get(x, x)) != root:
                up[x], x = root, r
            return root

        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            u, v = find(u), find(v)
            if u != v:
                u, v = min(u, v), max(u, v)
                up[v] = u
        nodes = list(up)
        yield pa.RecordBatch.from_arrays([pa.array([find(x) for x in nodes], pa.int64()), pa.array(nodes, pa.int64())], ["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root): of each node in ``edges`` (a, b: long), the least node of its component.

    Alternates large and small stars (each node hands its larger or smaller neighbours to the least
    one), on edges that tasks have contracted first, until nothing changes. A node's neighbours are
    never gathered: the least is a partial aggregation, and it is joined back.
    """
    spark = edges.sparkSession
    ready(spark)
    e = written(spark, edges.where("a <> b").mapInArrow(_contract, "a long, b long"), "edges")
    state = None
    while True:  # about the logarithm of the longest chain
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("n")).agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("n")).select(F.col("m").alias("a"), "b")
        down = written(spark, large.where("a <> b").distinct(), "large-star")
        least = down.groupBy(F.col("b").alias("n")).agg(F.min("a").alias("m"))
        small = down.join(least, F.col("b") == F.col("n"))
        small = small.select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).where("a <> b").distinct()
        e = written(spark, small, "small-star")
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == state:
            return e.select(F.col("b").alias("node"), F.col("a").alias("root"))
        state = now
