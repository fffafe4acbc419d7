"""Call graph and scope: callee resolution, function features, line owners, blended ranks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.operators.graph import strong_components
from cairn.operators.panel import global_rank01, rank01
from cairn.plans.shared import ship_package, written


def last_segment(c):
    return F.regexp_extract(c, "([^.:]*)$", 1)


def resolved(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """``calls`` (fn, file, callee, ...) with callee_fn and rung, of ``functions`` (fn, file, name).

    Same file first: an exact name, unique; only without any exact one, a last segment, unique. What
    stays unresolved there, for want or for ambiguity, is looked up in the same way among all. Names
    are aggregated before they meet the calls, so every join is by key and finds one row at most.
    """
    f = functions.select("fn", "file", "name", last_segment(F.col("name")).alias("seg"))

    def names(key: str, *by: str, at: str) -> DataFrame:
        return f.groupBy(*by, key).agg(F.count("*").alias(f"n_{at}"), F.min("fn").alias(f"f_{at}"))

    out = calls.withColumn("_seg", last_segment(F.col("callee")))
    for key, by, at in (("name", ("file",), "ef"), ("seg", ("file",), "sf"), ("name", (), "eg"), ("seg", (), "sg")):
        dim = names(key, *by, at=at).withColumnRenamed(key, f"k_{at}")
        on = (F.col("callee") if key == "name" else F.col("_seg")) == F.col(f"k_{at}")
        if by:
            dim = dim.withColumnRenamed("file", f"file_{at}")
            on = on & (F.col("file") == F.col(f"file_{at}"))
        out = out.join(dim, on, "left").drop(f"k_{at}", f"file_{at}")

    def tier(e: str, s: str):
        exact = F.when(F.col(f"n_{e}") == 1, F.col(f"f_{e}"))
        suffix = F.when((F.col("_seg") != "") & (F.col(f"n_{s}") == 1), F.col(f"f_{s}"))
        return F.when(F.col(f"n_{e}").isNotNull(), exact).otherwise(suffix)

    near, far = tier("ef", "sf"), tier("eg", "sg")
    rung = F.when(near.isNotNull(), F.when(F.col("n_ef").isNotNull(), "file exact").otherwise("file suffix")).when(far.isNotNull(), F.when(F.col("n_eg").isNotNull(), "exact").otherwise("suffix"))
    return out.withColumn("callee_fn", F.coalesce(near, far)).withColumn("rung", rung).select(*calls.columns, "callee_fn", "rung")


def call_edges(nodes: DataFrame, functions: DataFrame, *by: str) -> DataFrame:
    """Distinct (fn, callee_fn) of resolved calls. With ``by`` only functions that share those columns are seen."""
    calls = nodes.where((F.col("kind") == "call") & F.col("callee").isNotNull()).select("fn", "file", "callee").distinct()
    found = resolved(calls, functions).where("callee_fn is not null")
    if by:
        found = found.join(functions.select(F.col("fn").alias("callee_fn"), *(F.col(b).alias(f"_{b}") for b in by)), "callee_fn")
        for b in by:
            found = found.where(F.col(b) == F.col(f"_{b}"))
    return found.select("fn", "callee_fn").distinct()


def fan_in(edges: DataFrame, functions: DataFrame) -> DataFrame:
    """(fn, fan_in): the number of other functions that call it."""
    n = edges.where("fn <> callee_fn").groupBy(F.col("callee_fn").alias("fn")).agg(F.countDistinct("fn").alias("fan_in"))
    return functions.select("fn").join(n, "fn", "left").select("fn", F.coalesce("fan_in", F.lit(0)).alias("fan_in"))


def _depths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(fn, depth) of each packed group of functions and its calls."""
    for b in batches:
        for fns, srcs, dsts in zip(*(b.column(c).to_pylist() for c in ("fns", "srcs", "dsts"))):
            at = {f: i for i, f in enumerate(sorted(fns))}
            calls = [[] for _ in at]
            for s, d in zip(srcs or (), dsts or ()):
                if s != d and s in at and d in at:
                    calls[at[s]].append(at[d])
            level = [0.0] * len(at)
            of, comps = strong_components(calls)
            for c, members in enumerate(comps):
                below = [level[u] for v in members for u in calls[v] if of[u] != c]
                for v in members:
                    level[v] = 1.0 + max(below) if below else 1.0
            yield pa.RecordBatch.from_arrays([pa.array(list(at), pa.int64()), pa.array(level, pa.float64())], ["fn", "depth"])


#: Functions and calls that are packed into one row, in which depths take one pass.
PACKED = 1_000_000


def call_depth(edges: DataFrame, functions: DataFrame, packed: int = PACKED) -> DataFrame:
    """(fn, depth): 1 for a function without calls, else 1 more than its deepest callee outside its cycle.

    A call graph of at most ``packed`` functions and calls meets in one row. In a larger one, components of
    mutual recursion are found by forward and backward minima, the depths by taking off what calls nothing that is left,
    round by round: both work on edge tables, however large, in as many rounds as the longest path has calls.
    """
    spark = edges.sparkSession
    ship_package(spark)
    e = written(spark, edges.where("fn <> callee_fn").select(F.col("fn").alias("s"), F.col("callee_fn").alias("d")), "calls")
    if e.count() + functions.count() <= packed:
        fns = functions.agg(F.collect_list("fn").alias("fns"))
        es = e.agg(F.collect_list("s").alias("srcs"), F.collect_list("d").alias("dsts"))
        return fns.join(es, F.lit(True)).mapInArrow(_depths, "fn bigint, depth double")  # one row by one row
    cyclic = _mutual(e)
    c = cyclic.select(F.col("fn").alias("s"), F.col("comp").alias("_cs")), cyclic.select(F.col("fn").alias("d"), F.col("comp").alias("_cd"))
    outer = e.join(c[0], "s", "left").join(c[1], "d", "left").select(F.coalesce("_cs", "s").alias("cs"), F.coalesce("_cd", "d").alias("cd")).where("cs <> cd")
    # round by round only calls of what calls something itself are left: a component is as deep as the last round that has it
    left, deep, depth = written(spark, outer.distinct(), "condensed"), None, 2.0
    while left.limit(1).count():
        callers = left.select(F.col("cs").alias("comp")).distinct()
        here = callers.withColumn("depth", F.lit(depth))
        deep = here if deep is None else deep.unionByName(here)
        if depth % 50 == 0:  # a long chain's union is gathered now and then
            deep = written(spark, deep.groupBy("comp").agg(F.max("depth").alias("depth")), "depths")
        left = written(spark, left.join(callers.select(F.col("comp").alias("cd")), "cd", "left_semi").select("cs", "cd"), "condensed")
        depth += 1
    every = functions.select("fn").join(cyclic, "fn", "left").select("fn", F.coalesce("comp", "fn").alias("comp"))
    if deep is None:
        return every.select("fn", F.lit(1.0).alias("depth"))
    level = deep.groupBy("comp").agg(F.max("depth").alias("depth"))
    return every.join(level, "comp", "left").select("fn", F.coalesce("depth", F.lit(1.0)).alias("depth"))


def _mutual(e: DataFrame) -> DataFrame:
    """(fn, comp) of the functions on cycles: the least function of the component.

    Functions without a call in or out, again and again, are taken off. Of what is left, the forward and
    the backward least labels that agree make a component; its edges to others go, and the rest repeats.
    """
    spark = e.sparkSession
    done = []
    left = e
    while True:
        while True:  # trim what lies on no cycle
            n = left.count()
            heads, tails = left.select(F.col("d").alias("s")).distinct(), left.select(F.col("s").alias("d")).distinct()
            left = written(spark, left.join(heads, "s", "left_semi").join(tails, "d", "left_semi").select("s", "d"), "cyclic")
            if left.count() == n:
                break
        if not left.limit(1).count():
            break
        fwd, bwd = _least_label(left, "s", "d"), _least_label(left, "d", "s")
        same = written(spark, fwd.join(bwd.withColumnRenamed("label", "back"), "node").where("label = back").select(F.col("node").alias("fn"), F.col("label").alias("comp")), "component")
        done.append(same)
        gone = same.select(F.col("fn").alias("s"))
        left = written(spark, left.join(gone, "s", "left_anti").join(gone.withColumnRenamed("s", "d"), "d", "left_anti").select("s", "d"), "cyclic")
    found = done[0] if done else e.limit(0).select(F.col("s").alias("fn"), F.col("d").alias("comp"))
    for d in done[1:]:
        found = found.unionByName(d)
    return found


def _least_label(e: DataFrame, a: str, b: str) -> DataFrame:
    """(node, label): the least node that reaches it along a -> b, itself included."""
    spark = e.sparkSession
    label = e.select(F.col("s").alias("node")).union(e.select("d")).distinct().withColumn("label", F.col("node"))
    while True:
        step = e.join(label, F.col(a) == F.col("node")).groupBy(F.col(b).alias("n")).agg(F.min("label").alias("l"))
        new = written(spark, label.join(step, F.col("node") == F.col("n"), "left").select("node", F.least("label", F.coalesce("l", "label")).alias("label"), (F.coalesce("l", "label") < F.col("label")).alias("moved")), "label")
        label = new.drop("moved")
        if not new.where("moved").limit(1).count():
            return label


def boundary_density(lines: DataFrame, functions: DataFrame) -> DataFrame:
    """(fn, size, boundary_density) from scored lines (fn, line, tier); 0 for functions without any."""
    d = lines.groupBy("fn").agg(F.count("*").alias("size"), F.avg(F.when(F.col("tier") == 2, 1.0).otherwise(0.0)).alias("boundary_density"))
    return functions.select("fn").join(d, "fn", "left").select("fn", F.coalesce("size", F.lit(0)).alias("size"), F.coalesce("boundary_density", F.lit(0.0)).alias("boundary_density"))


def densities(facts: DataFrame, *keys: str) -> DataFrame:
    """(keys, size, boundary_density) of every function of the facts (with structural and tier): ``boundary_density`` of
    their scored lines in one pass, in which functions without any stay."""
    keys = keys or ("fn",)
    scored = F.col("line").isNotNull() & ~F.col("structural")
    lines = facts.repartition(*keys).groupBy(*keys, "line").agg(F.max(F.when(scored, F.col("tier"))).alias("tier"))
    share = F.avg(F.when(F.col("tier").isNotNull(), F.when(F.col("tier") == 2, 1.0).otherwise(0.0)))
    return lines.groupBy(*keys).agg(F.count("tier").alias("size"), F.coalesce(share, F.lit(0.0)).alias("boundary_density"))


def function_features(nodes: DataFrame, lines: DataFrame, functions: DataFrame, *by: str) -> DataFrame:
    """(fn, by, trophic, fan_in, size_share, boundary_density, weight): four ranks and their mean.

    With ``by`` = ("file",) ranks and calls are those within files; without, over the whole repository.
    """
    spark = nodes.sparkSession
    functions = written(spark, functions, "functions")  # these and the edges are read again and again
    edges = written(spark, call_edges(nodes, functions, *by), "call-edges")
    if by:
        depth = _packed_depth(edges, functions, *by)
    else:
        depth = call_depth(edges, functions)
    t = functions.select("fn", *by).join(depth, "fn").join(fan_in(edges, functions), "fn").join(boundary_density(lines, functions), "fn")
    names = (("depth", "trophic"), ("fan_in", "fan_in"), ("size", "size_share"), ("boundary_density", "boundary_density"))
    if by:
        ranked = t.select("fn", *by, *(rank01(F.col(c), *by).alias(a) for c, a in names))
    else:
        ranked = written(t.sparkSession, t.select("fn", *(F.col(c).cast("double").alias(f"_{c}") for c, _ in names)), "features")
        for c, a in names:
            ranked = global_rank01(ranked, f"_{c}", a)
        ranked = ranked.drop(*(f"_{c}" for c, _ in names))
    return ranked.withColumn("weight", (F.col("trophic") + F.col("fan_in") + F.col("size_share") + F.col("boundary_density")) / 4)


def _packed_depth(edges: DataFrame, functions: DataFrame, *by: str) -> DataFrame:
    """Call depths where calls stay within a file: a file's functions and calls meet in one row."""
    fns = functions.groupBy(*by).agg(F.collect_list("fn").alias("fns"))
    es = edges.join(functions.select("fn", *by), "fn").groupBy(*by).agg(F.collect_list("fn").alias("srcs"), F.collect_list("callee_fn").alias("dsts"))
    ship_package(edges.sparkSession)
    return fns.join(es, [*by], "left").select("fns", "srcs", "dsts").mapInArrow(_depths, "fn bigint, depth double")


def line_owners(lines: DataFrame) -> DataFrame:
    """(file, line, fn): the function with the narrowest extent over its scored lines; of equals, the first.

    ``lines``: (file, fn, line, ...).
    """
    w = Window.partitionBy("file", "fn")
    wide = lines.withColumn("width", F.max("line").over(w) - F.min("line").over(w))
    return wide.groupBy("file", "line").agg(F.min_by("fn", F.struct("width", "fn")).alias("fn"))


def blended(lines: DataFrame, features: DataFrame, *by: str) -> DataFrame:
    """(file, line, fn, score): an owner's line scores times its weight, ranked within ``by`` (or over all)."""
    owned = line_owners(lines).join(lines.select("file", "fn", "line", F.col("score").alias("raw")), ["file", "fn", "line"])
    owned = owned.join(features.select("fn", "weight"), "fn").withColumn("raw", F.col("raw") * F.col("weight"))
    if by:
        return owned.select("file", "line", "fn", rank01(F.col("raw"), *by).alias("score"))
    owned = written(owned.sparkSession, owned.select("file", "line", "fn", "raw"), "owned")
    return global_rank01(owned, "raw", "score").select("file", "line", "fn", "score")
