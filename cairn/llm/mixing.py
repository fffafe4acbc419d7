"""Mixing sources to target weights by hash-threshold histograms.

A source's target is its share of the mix's budget by weight, at most ``most`` times its size; what
that cuts off is shared again by weight. Every document is taken as many whole times as its source's
target holds the source's size; what remains of the target is filled by the documents whose hash lies
below a threshold. Thresholds are found without sorting: sizes are summed by source and hash bucket,
the bucket where the budget runs out is found by running sums over at most 4096 buckets a source, only
that bucket is split again by the hash's next bits, and only in the last one are single hashes summed.
The document at the threshold is taken if this brings the mix closer to the target.

A row's hash is that of its id. Rows that share an id, or have none, are hashed by id, source and text,
and those equal in all three by their number among their equals, so that no hash stands for a clump of rows.

A null source is a source of its own, the last. Null and empty texts have size 0 and follow their
hash. Of repeated rows as many are taken as their target asks for, which of them is left open. An
empty table gives no rows. Other columns of the input are left out by ``mix`` and kept by ``mixed``,
whatever their names and types.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import by_id, fresh
from cairn.plans.shared import written

WEIGHTS = (3, 1, 2)
#: Bits of the hash, and bits that one histogram tells apart; equal rows that are numbered together.
HASH_BITS, LEVEL_BITS, NUMBERED = 52, 12, 100_000


def words(text: Column) -> Column:
    """The number of runs of other than ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def hash52(key: Column) -> Column:
    """The first 52 bits of an md5, so that other engines can compute it too."""
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("long")


def id_hash(doc_id: Column, seed: int) -> Column:
    return hash52(F.concat(doc_id.cast("string"), F.lit(f":{seed}")))


def _row_hashes(rows: DataFrame, seed: int) -> DataFrame:
    """(tag, h) of rows (tag, doc_id, source, m: md5 of the text) that share ids: by all three and the number among equals."""
    spark = rows.sparkSession
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{seed}:"), F.coalesce(F.col("source").cast("string"), F.lit("")), F.lit(":"), F.col("m")).cast("binary"))
    keyed = written(spark, rows.select("tag", key.alias("key")), "mix-repeated")
    keyed = keyed.withColumn("part", F.shiftright("tag", 33).cast("long") * 1024 + F.pmod(F.floor((F.col("tag") % (1 << 33)) / NUMBERED), F.lit(1024)))  # so that a hot key is numbered in parts
    counts = keyed.groupBy("key", "part").agg(F.count("*").alias("c"))
    base = counts.withColumn("base", F.sum("c").over(Window.partitionBy("key").orderBy("part")) - F.col("c")).drop("c")
    number = F.row_number().over(Window.partitionBy("key", "part").orderBy("tag")) + F.col("base")
    numbered = keyed.join(base, ["key", "part"]).select("tag", "key", number.alias("j"))
    return written(spark, numbered.select("tag", hash52(F.concat("key", F.lit(":"), F.col("j").cast("string"))).alias("h")), "mix-row-hashes")


def targets(sizes: DataFrame, share: float, most: float, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, target) from (source, source_size): one row a source.

    Sources are filled in the order of their cap by weight: all that reach it are capped, and the
    rest share what is left.
    """
    every = Window.orderBy(F.col("source").asc_nulls_last())  # over one row a source
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(every) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("w", w.cast("double")).withColumn("cap", F.lit(most) * F.col("source_size"))
    s = s.withColumn("at", F.col("cap") / F.col("w"))
    order = Window.orderBy("at", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(0))
    s = s.withColumn("before", F.coalesce(F.sum("cap").over(order), F.lit(0.0))).withColumn("w_left", F.sum("w").over(whole) - F.coalesce(F.sum("w").over(order), F.lit(0.0)))
    s = s.withColumn("budget", F.lit(share) * F.sum("source_size").over(whole))
    s = s.withColumn("level", (F.col("budget") - F.col("before")) / F.col("w_left"))
    level = F.min(F.when(F.col("level") <= F.col("at"), F.struct("at", "level"))).over(whole)["level"]
    return s.withColumn("target", F.least(F.col("cap"), F.coalesce(level * F.col("w"), F.col("cap")))).select("source", "source_size", "target")


def _cuts(docs: DataFrame, share: float, most: float, weights: tuple[int, ...], seed: int, id_col: str, text_col: str, source_col: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, size, h) of each document, and (_s, source_size, target, whole, cut) of each source."""
    spark = docs.sparkSession
    text = F.col(f"`{text_col}`")
    sizes = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").alias("source"), words(text).alias("size"), F.md5(F.coalesce(text, F.lit("")).cast("binary")).alias("m"))
    once, some, tag = by_id(written(spark, sizes, "mix-sizes"), "doc_id")
    some = some.withColumnRenamed(tag, "tag")
    base = once.select("doc_id", "source", "size", id_hash(F.col("doc_id"), seed).alias("h"))
    base = written(spark, base.unionByName(some.join(_row_hashes(some, seed), "tag").select("doc_id", "source", "size", "h")), "mix-hashed")
    # a source is summed in at most 4096 buckets before its rows meet, so a hot one costs no more
    shifts = [HASH_BITS - LEVEL_BITS, HASH_BITS - 2 * LEVEL_BITS, 0]
    level = base.groupBy("source", F.shiftright("h", shifts[0]).alias("b")).agg(F.sum("size").alias("size")).withColumn("below", F.lit(0).cast("long"))
    per_source = targets(level.groupBy("source").agg(F.sum("size").alias("source_size")), share, most, weights)
    per_source = per_source.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    per_source = written(spark, per_source.withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size")), "mix-targets")
    named = per_source.select(F.col("source").alias("_n"), "budget")

    def boundary(hist: DataFrame) -> DataFrame:
        """(_s, at, below): the bucket of each source where its budget runs out, and the sum before it."""
        run = F.sum("size").over(Window.partitionBy("source").orderBy("b")) + F.col("below")
        h = hist.withColumn("run", run).join(named, F.col("source").eqNullSafe(F.col("_n"))).where("run >= budget")
        first = F.min(F.struct("b", (F.col("run") - F.col("size")).alias("below"), "size", "budget")).alias("m")
        return h.groupBy(F.col("source").alias("_s")).agg(first).select("_s", F.col("m.b").alias("at"), F.col("m.below").alias("below"), F.col("m.size").alias("edge_size"), F.col("m.budget").alias("budget"))

    edge = boundary(level)
    for wide, shift in zip(shifts, shifts[1:]):
        inside = base.join(edge, F.col("source").eqNullSafe(F.col("_s")) & (F.shiftright("h", wide) == F.col("at")))
        edge = boundary(inside.groupBy("source", F.shiftright("h", shift).alias("b"), "below").agg(F.sum("size").alias("size")))
    rest = F.col("budget") - F.col("below")
    cut = edge.select(F.col("_s").alias("_c"), F.when(rest >= F.col("edge_size") - rest, F.col("at")).otherwise(F.col("at") - 1).alias("cut"))
    cuts = per_source.join(cut, F.col("source").eqNullSafe(F.col("_c")), "left")
    cuts = cuts.select(F.col("source").alias("_s"), "source_size", "target", "whole", F.when(F.col("budget") > 0, F.coalesce("cut", F.lit(1 << HASH_BITS))).otherwise(F.lit(-1)).alias("cut"))
    return base, written(spark, cuts, "mix-cuts")


def _times(h: Column) -> Column:
    return F.col("whole") + F.when(h <= F.col("cut"), 1).otherwise(0)


def mix(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row for each document: doc_id, size, source_size, target, taken, copies (0, 1, ...)."""
    base, cuts = _cuts(docs, share, most, weights, seed, id_col, text_col, source_col)
    copies = _times(F.col("h")).cast("long")
    return base.join(cuts, F.col("source").eqNullSafe(F.col("_s"))).select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"))


def mixed(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents that the mix takes, as often as it takes them, with their own columns."""
    _, cuts = _cuts(docs, share, most, weights, seed, id_col, text_col, source_col)
    own: list[str] = []
    for name in ("source", "whole", "cut", "h", "copy"):
        own.append(fresh(docs.columns + own, name))
    source, whole, cut, h, copy = own
    cuts = cuts.select(F.col("_s").alias(source), F.col("whole").alias(whole), F.col("cut").alias(cut))
    id_, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    once, some, tag = by_id(docs, id_col)
    keys = some.select(F.col(tag).alias("tag"), id_.alias("doc_id"), F.col(f"`{source_col}`").alias("source"), F.md5(F.coalesce(text, F.lit("")).cast("binary")).alias("m"))
    hashes = _row_hashes(keys, seed).select(F.col("tag").alias(cut + "_tag"), F.col("h").alias(h))
    some = some.join(hashes, F.col(tag) == F.col(cut + "_tag")).drop(tag, cut + "_tag")
    rows = once.withColumn(h, id_hash(id_, seed)).unionByName(some)
    times = F.col(whole) + F.when(F.col(h) <= F.col(cut), 1).otherwise(0)
    rows = rows.join(cuts, F.col(f"`{source_col}`").eqNullSafe(F.col(source)))
    return rows.withColumn(copy, F.explode(F.array_repeat(F.lit(0), times.cast("int")))).select(*(F.col(f"`{c}`") for c in docs.columns))
