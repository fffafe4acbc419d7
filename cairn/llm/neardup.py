"""Near-duplicates by min-max hashing.

Each distinct shingle set (a class of copies) keeps the minimum and the maximum of its hashes under
each of 64 permutations: 128 values for 64 evaluations, each agreeing with the probability of the
sets' Jaccard index. Bands of as many values as the threshold allows put sets in buckets: for 0.75,
32 bands of 4, in all of which two such sets miss each other with a probability of 5e-6. Bytes of the
128 values are kept as a sketch.

Buckets aren't expanded into pairs. First every member meets only its bucket's least one. Links that
the full sets confirm are joined to components. The classes of the buckets that still hold several
components meet again by a prefix filter, which is exact: in the order of how many of these classes
hold a shingle, rarest first, two sets of the wanted index share a shingle among the first
n - ceil(2 t n / (1 + t)) + 1 of the smaller and the first m - ceil(t m) + 1 of the larger, and where
they first do, enough is left of both. So pages of one template that aren't similar enough to be
linked meet in none of the template's shingles, and cost no pairs, however many they are. Pairs whose
sketches agree in too few values (for 0.75, in 0.55, which a link misses with a probability below
1e-6) are dropped, the others confirmed on full sets. A shingle with many classes is met in blocks.

In sets of at most 32 shingles a minimum and a maximum depend on each other, so bands and sketches miss
more; all such sets meet by the prefix filter alone.

Documents without words are linked with nothing. A null doc_id is never a component's; a component
of null ids alone is null. Rows that repeat a doc_id are rows of their own, linked by their sets. An
empty table gives no rows. Other columns than the id and the text play no part, whatever their names
and types.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from cairn.llm.common import by_id, fresh, join_hot, ready, slices, text_of
from cairn.llm.components import components
from cairn.llm.shingles import band_hashes, shingle_sets, signatures
from cairn.plans.shared import written

PERMUTATIONS = 64
#: Most likely miss of all bands that their width may cost; members of a block; sets that are too short for bands.
MISS, BLOCK, SHORT = 1e-5, 4000, 32
#: Rows of one key above which it may be a hub, and the copies of its set that these are spread over.
HUB, SALTS = 1000, 64


def band_rows(percent: int, values: int) -> int:
    """The most values of a band with which two sets at the threshold miss each other in all bands with at most MISS."""
    j = percent / 100
    fit = [r for r in range(1, 17) if (1 - j**r) ** (values // r) <= MISS]
    if not fit:
        raise ValueError(f"{values} values don't find links of {percent} %; use more permutations")
    return max(fit)


def least_agreement(percent: int, values: int) -> float:
    """What the estimate of a pair at the threshold falls below with a probability under 1e-6."""
    j = percent / 100
    return max(0.0, j - 5.2 * (j * (1 - j) / values) ** 0.5)


def _keys(batches: Iterator[pa.RecordBatch], permutations: int, rows: int) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, most=4 << 20):
        sets, off = shingle_sets(text_of(b.column("text")))
        sig = signatures(sets, off, permutations)
        bands = band_hashes(sig, rows)
        sketch = (sig >> np.uint64(24)).astype(np.uint8)
        n, k = bands.shape
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("tag"), pa.array(np.diff(off)), pa.array([xxh3_128_digest(sets[a:z]) for a, z in zip(off, off[1:])], pa.binary()), pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * k), pa.array(bands.ravel().view(np.int64))), pa.array([x.tobytes() for x in sketch], pa.binary())],
            ["doc_id", "tag", "n_shingles", "set_key", "bands", "sketch"],
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, most=4 << 20):
        sets, off = shingle_sets(text_of(b.column("text")))
        yield pa.RecordBatch.from_arrays([pa.array([xxh3_128_digest(sets[a:z]) for a, z in zip(off, off[1:])], pa.binary()), pa.array([sets[a:z].tobytes() for a, z in zip(off, off[1:])], pa.binary())], ["set_key", "set"])


def _links(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep = []
        for x, y in zip(b.column("set_a"), b.column("set_b")):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            at = np.searchsorted(x, y)
            at[at == len(x)] = 0
            both = int((x[at] == y).sum())
            keep.append(100 * both >= percent * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _sketch_matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def agreeing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The estimated Jaccard index of pairs of sketches; chance agreement of bytes taken off."""
    return ((a == b).mean(-1) - 1 / 256) / (1 - 1 / 256)


def _likely(batches: Iterator[pa.RecordBatch], percent: int, agree: float, short: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if not b.num_rows:
            continue
        na, nb = b.column("n_shingles_a").to_numpy(), b.column("n_shingles_b").to_numpy()
        ok = agreeing(_sketch_matrix(b.column("sketch_a")), _sketch_matrix(b.column("sketch_b"))) >= agree
        ok = (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)) & (ok | (np.maximum(na, nb) <= short))
        yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(ok))


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, shingle): the sets' elements."""
    for b in slices(batches, "set", most=4 << 20):
        n = pc.binary_length(b.column("set")).to_numpy() // 8
        flat = np.frombuffer(b"".join(b.column("set").to_pylist()), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column("node").to_numpy(), n)), pa.array(flat)], ["node", "shingle"])


def _meet(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) that pass the prefix filter, of lists whose rows follow each other."""
    names = ("shingle", "pair", "side", "node", "root", "n", "pos", "index")
    held: list[np.ndarray] | None = None

    def pairs(c: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        shingle, pair, side, node, root, n, pos, index = c
        new = np.ones(len(node), bool)
        new[1:] = (shingle[1:] != shingle[:-1]) | (pair[1:] != pair[:-1])
        starts = np.flatnonzero(new)
        left = np.repeat(np.append(starts[1:], len(node)), np.diff(np.append(starts, len(node)))) - np.arange(len(node)) - 1  # rows of the list after each
        at, d = np.flatnonzero(left > 0), 1
        while len(at):
            i, j = at, at + d
            swap = (n[i] > n[j]) | ((n[i] == n[j]) & (node[i] > node[j]))
            x, y = np.where(swap, j, i), np.where(swap, i, j)
            need = -(-percent * (n[x] + n[y]) // (100 + percent))
            ok = index[x] & (root[x] != root[y]) & ((side[x] == 2) | (side[x] != side[y])) & (100 * n[x] >= percent * n[y]) & (np.minimum(n[x] - pos[x], n[y] - pos[y]) >= need)
            if ok.any():
                x, y = node[x[ok]], node[y[ok]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])
            d += 1
            at = at[left[at] >= d]

    for b in batches:
        c = [b.column(k).to_numpy(zero_copy_only=False) for k in names]
        if held is not None:
            c = [np.concatenate(x) for x in zip(held, c)]
        same = (c[0] == c[0][-1]) & (c[1] == c[1][-1]) if len(c[0]) else np.zeros(0, bool)
        cut = int(np.argmax(same)) if len(same) else 0
        held = [x[cut:] for x in c]
        if cut:
            yield from pairs([x[:cut] for x in c])
    if held is not None and len(held[0]):
        yield from pairs(held)


def _with(pairs: DataFrame, facts: DataFrame, side: str) -> DataFrame:
    """``pairs`` (a, b, ...) with the columns of ``facts`` (node, ...) for one side, ``_side`` added to their names.

    Nodes of more than a 1/1000 part of the pairs, of which there are fewer than 1000, are salted.
    """
    other = "b" if side == "a" else "a"
    limit = max(pairs.count() // 1000, HUB)
    hubs = F.broadcast(pairs.groupBy(side).agg(F.count("*").alias("_m")).where(F.col("_m") > limit).select(F.col(side).alias("_hub")))
    left = pairs.join(hubs, F.col(side) == F.col("_hub"), "left").withColumn("_salt", F.when(F.col("_hub").isNotNull(), F.pmod(F.xxhash64(other), F.lit(SALTS)).cast("int")).otherwise(0)).drop("_hub")
    copies = F.explode(F.when(F.col("_hub").isNotNull(), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))
    right = facts.join(hubs, F.col("node") == F.col("_hub"), "left").withColumn("_salt", copies).drop("_hub")
    right = right.select(F.col("node").alias(side), "_salt", *(F.col(c).alias(f"{c}_{side}") for c in facts.columns if c != "node"))
    return left.join(right, [side, "_salt"]).drop("_salt")


@dataclass
class Classes:
    rows: DataFrame  # doc_id, tag, n_shingles, set_key of each document
    named: DataFrame  # set_key, root, component_id, n_copies of each class
    total: int


def classes(docs: DataFrame, percent: int = 75, permutations: int = PERMUTATIONS, block: int = BLOCK, short: int = SHORT, id_col: str = "doc_id", text_col: str = "text") -> Classes:
    """The classes of copies and the components that their links make."""
    if not 0 < percent <= 100:
        raise ValueError(f"percent is above 0 and at most 100, not {percent}")
    spark = docs.sparkSession
    ready(spark)
    rows, agree = band_rows(percent, 2 * permutations), least_agreement(percent, 2 * permutations)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, tag long, n_shingles long, set_key binary, bands array<long>, sketch binary"
    keys = written(spark, base.withColumn("tag", F.monotonically_increasing_id()).mapInArrow(partial(_keys, permutations=permutations, rows=rows), schema), "near-keys")
    total = keys.count()
    full = keys.where("n_shingles > 0")
    # a class of copies is a node, with its least row's number
    first = full.groupBy("set_key").agg(F.min("doc_id").alias("id"), F.count("*").alias("n_copies"), F.min(F.struct("tag", "n_shingles", "sketch", "bands")).alias("r"))
    first = written(spark, first.select("set_key", "id", "n_copies", F.col("r.tag").alias("node"), "r.n_shingles", "r.sketch", "r.bands"), "near-classes")
    spread = first.select("node", F.explode("bands").alias("band"))
    shared = written(spark, spread.groupBy("band").agg(F.count("*").alias("m"), F.min("node").alias("leader")).where("m > 1"), "near-shared")
    buckets = written(spark, join_hot(spread, shared, "band", "m", total), "near-buckets")
    sketches = first.select("node", "n_shingles", "sketch")

    star = written(spark, buckets.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct(), "near-star")

    # the sets of all that may be linked: every class in a bucket with another, and short ones
    is_short = F.col("n_shingles") <= short
    members = first.select("node", "set_key", "id").join(buckets.select("node").union(first.where(is_short).select("node")).distinct(), "node")
    members = written(spark, members, "near-members")
    wanted = members.where("id is not null").select("id").hint("merge")  # ids grow with the documents: never broadcast
    texts = base.join(wanted, F.col("doc_id") == F.col("id"), "left_semi").unionByName(base.where("doc_id is null"))
    sets = texts.select("text").mapInArrow(_sets, "set_key binary, set binary").dropDuplicates(["set_key"])
    sets = written(spark, sets.join(members, "set_key").select("node", "set"), "near-sets")

    def linked(pairs: DataFrame) -> DataFrame:
        """The pairs that full sets confirm; sketches of longer ones first."""
        both = _with(_with(pairs, sketches, "a"), sketches, "b")
        kept = written(spark, both.mapInArrow(partial(_likely, percent=percent, agree=agree, short=short), "a long, b long"), "near-likely")
        both = _with(_with(kept, sets, "a"), sets, "b")
        return written(spark, both.mapInArrow(partial(_links, percent=percent), "a long, b long"), "near-links")

    found = linked(star)
    roots = components(found)
    # classes of buckets that hold several components yet, and short ones
    placed = buckets.select("node", "band").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    open_ = placed.groupBy("band").agg(F.count("*").alias("m"), F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1")
    left = join_hot(placed, open_, "band", "m", total).select("node").union(first.where(is_short).select("node")).distinct()
    left = left.join(first.select("node", F.col("n_shingles").alias("n")), "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    left = written(spark, left, "near-left")
    elements = written(spark, sets.join(left.select("node"), "node", "left_semi").mapInArrow(_elements, "node long, shingle long"), "near-elements")
    n_elements = elements.count()
    held = written(spark, elements.groupBy("shingle").agg(F.count("*").alias("c")).where("c > 1"), "near-shingles")
    # a set's shingles that others hold too, rarest first; those before them are its own alone
    lists = join_hot(elements, held, "shingle", "c", n_elements).groupBy("node").agg(F.sort_array(F.collect_list(F.struct("c", "shingle"))).alias("by"))
    n = F.col("n")
    own = n - F.size("by")
    to_index, to_probe = (n - F.ceil(2 * percent * n / F.lit(100 + percent)) + 1), (n - F.ceil(percent * n / F.lit(100)) + 1)
    posts = lists.join(left, "node").where(to_probe > own).select("node", "root", "n", own.alias("own"), to_index.alias("to_index"), F.posexplode(F.slice("by", F.lit(1), (to_probe - own).cast("int"))).alias("k", "e"))
    posts = posts.select(F.col("e.shingle").alias("shingle"), "node", "root", "n", (F.col("own") + F.col("k")).alias("pos"), (F.col("own") + F.col("k") < F.col("to_index")).alias("index"))
    posts = written(spark, posts, "near-posts")
    listed = written(spark, posts.groupBy("shingle").agg(F.count("*").alias("m"), F.count_if("index").alias("i"), F.min("root").alias("r0"), F.max("root").alias("r1")).where("m > 1 and i > 0 and r0 <> r1").select("shingle", "m"), "near-lists")
    placed = join_hot(posts, listed, "shingle", "m", n_elements).withColumn("blocks", F.floor((F.col("m") - 1) / block).cast("int") + 1).withColumn("block", F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks")).cast("int"))
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    side = F.when(F.col("block") == F.col("other"), 2).when(F.col("block") == low, 0).otherwise(1)
    met = met.select("shingle", (low.cast("long") * F.col("blocks") + high).alias("pair"), side.alias("side"), "node", "root", "n", "pos", "index")
    cross = met.repartition("shingle", "pair").sortWithinPartitions("shingle", "pair").mapInArrow(partial(_meet, percent=percent), "a long, b long").distinct()
    more = linked(written(spark, cross, "near-cross"))
    roots = components(roots.select(F.col("root").alias("a"), F.col("node").alias("b")).unionByName(more))
    named = first.select("set_key", "id", "n_copies", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("id").alias("component_id"), F.count("*").alias("m"))
    named = written(spark, join_hot(named, least, "root", "m", total).select("set_key", "root", "component_id", "n_copies"), "near-named")
    return Classes(keys.select("doc_id", "tag", "n_shingles", "set_key"), named, total)


def near_groups(docs: DataFrame, percent: int = 75, permutations: int = PERMUTATIONS, block: int = BLOCK, short: int = SHORT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id, kept, n_copies (rows with its set)."""
    c = classes(docs, percent, permutations, block, short, id_col, text_col)
    full = c.rows.where("n_shingles > 0").select("doc_id", "n_shingles", "set_key")
    out = join_hot(full, c.named, "set_key", "n_copies", c.total).select("doc_id", "n_shingles", "component_id", "n_copies")
    alone = c.rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(1).cast("long").alias("n_copies"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def _set_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, most=4 << 20):
        sets, off = shingle_sets(text_of(b.column("text")))
        yield pa.RecordBatch.from_arrays([b.column("tag"), b.column("id"), pa.array(np.diff(off)), pa.array([xxh3_128_digest(sets[a:z]) for a, z in zip(off, off[1:])], pa.binary())], ["tag", "id", "n", "set_key"])


def near_dedup(docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component, with its own columns: that of the least id.

    Of several rows with that id in the component, and of a component of null ids alone, one stays.
    Rows without words are linked with nothing and all stay.
    """
    spark = docs.sparkSession
    c = classes(docs, percent, id_col=id_col, text_col=text_col)
    once, some, tag = by_id(docs, id_col)
    rows = c.rows.where("n_shingles > 0").select("doc_id", "set_key")
    kept = join_hot(rows, c.named, "set_key", "n_copies", c.total).where("doc_id = component_id").select("doc_id").union(c.rows.where("n_shingles = 0 and doc_id is not null").select("doc_id"))
    key = fresh(docs.columns, "kept")
    kept = written(spark, kept.distinct().withColumnRenamed("doc_id", key), "near-kept")
    stay = once.join(kept.hint("merge"), F.col(f"`{id_col}`").cast("long") == F.col(key), "left_semi")
    # rows that share an id, or have none, are told apart by their sets
    own = some.select(F.col(tag).alias("tag"), F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(_set_keys, "tag long, id long, n long, set_key binary")
    own = written(spark, own, "near-repeated")
    placed = join_hot(own.where("n > 0").select("tag", "id", "set_key"), c.named, "set_key", "n_copies", c.total)
    chosen = placed.where("id <=> component_id").groupBy("root").agg(F.min("tag").alias("tag")).select("tag").union(own.where("n = 0").select("tag"))
    chosen = written(spark, chosen.withColumnRenamed("tag", key), "near-chosen")
    return stay.unionByName(some.join(chosen, F.col(tag) == F.col(key), "left_semi").drop(tag))
