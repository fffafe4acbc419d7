"""Line features, the weighted panel, and spans: windows and aggregations over statement facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.model import FEATURES, INSTRUMENTS, PROFILES
from cairn.plans.ir import is_structural
from cairn.plans.shared import written


def average_rank(value: Column, *by: Column | str) -> Column:
    """Ranks from 1, ties sharing their mean: between a row's first rank and its last, which one window has both."""
    w = Window.partitionBy(*by)
    last = F.round(F.cume_dist().over(w.orderBy(value)) * F.count(F.lit(1)).over(w))
    return (F.rank().over(w.orderBy(value)) + last) / 2


def rank01(value: Column, *by: Column | str) -> Column:
    """Rank in [0, 1] among the rows of a partition; ties share their mean rank; alone it is 0.5."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    return F.when(n <= 1, F.lit(0.5)).otherwise((average_rank(value, *by) - 1) / (n - 1))


def global_rank01(rows: DataFrame, value: str, name: str) -> DataFrame:
    """``rows`` with ``name``: rank01 of ``value`` among all rows, without gathering them.

    Equal values are counted first. Their counts are range-partitioned by value, so that a running sum within
    a partition and the sums of the partitions before it, one row each, make up every value's rank.
    """
    counts = rows.groupBy(F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    ranged = written(rows.sparkSession, counts.repartitionByRange("_v").withColumn("_p", F.spark_partition_id()), "ranks")
    sums = ranged.groupBy("_p").agg(F.sum("_c").alias("_s"))
    every = Window.partitionBy(F.lit(0))  # one row a partition
    before = sums.select("_p", (F.sum("_s").over(every.orderBy("_p")) - F.col("_s")).alias("_before"), F.sum("_s").over(every).alias("_n"))
    first = F.col("_before") + F.sum("_c").over(Window.partitionBy("_p").orderBy("_v")) - F.col("_c")
    rank = F.when(F.col("_n") <= 1, F.lit(0.5)).otherwise((first + (F.col("_c") - 1) / 2) / (F.col("_n") - 1))
    ranks = ranged.join(F.broadcast(before), "_p").withColumn("_hot", F.col("_c") * 1000 > F.col("_n")).select("_v", "_hot", rank.alias(name))
    # a value of more than a 1/1000 part of the rows, of which there are fewer than 1000, is broadcast; the others' rows are few
    hot = ranks.where("_hot").select(F.col("_v").alias("_w"), F.col(name).alias("_r"))
    tagged = rows.join(F.broadcast(hot), F.col(value).eqNullSafe(F.col("_w")), "left")
    cold = tagged.where("_r is null").drop("_w", "_r").join(ranks.where(~F.col("_hot")), F.col(value).eqNullSafe(F.col("_v"))).drop("_v", "_hot")
    return tagged.where("_r is not null").withColumnRenamed("_r", name).drop("_w").select(cold.columns).unionByName(cold)


def scored_lines(facts: DataFrame, *keys: str, scores: tuple[str, ...] = ("score",)) -> DataFrame:
    """A line's largest tier and scores over its statements, jumps and nops left out."""
    rows = facts.where(F.col("line").isNotNull() & ~F.col("structural"))
    return rows.groupBy(*(keys or ("fn",)), "line").agg(F.max("tier").alias("tier"), *(F.max(s).alias(s) for s in scores))


def line_features(facts: DataFrame, *keys: str) -> DataFrame:
    """The seven features of each line, from facts with tier, score and the four instruments."""
    keys = keys or ("fn",)
    lines = scored_lines(facts.repartition(*keys), *keys, scores=("score", *INSTRUMENTS))  # lines and ranks share one exchange
    w = Window.partitionBy(*keys)
    m, i = F.count("*").over(w), F.row_number().over(w.orderBy("line")) - 1
    position = F.when(m == 1, F.lit(0.5)).otherwise(i / F.greatest(m - 1, F.lit(1)))
    ranks = [rank01(F.col(c), *keys).alias("current" if c == "score" else c) for c in ("score", *INSTRUMENTS)]
    return lines.select(*keys, "line", *ranks, position.alias("position"), F.when(F.col("tier") == 2, 1.0).otherwise(0.0).alias("boundary"), "tier")


def panel_score(features: DataFrame, profile: str | Column = "instruction") -> DataFrame:
    """``features`` with panel: the profile's weighted sum, between 0 and 1. A column may name each row's profile."""

    def total(name: str) -> Column:
        s = sum((F.col(f) * w for f, w in zip(FEATURES, PROFILES[name])), F.lit(0.0))
        return F.least(F.greatest(s, F.lit(0.0)), F.lit(1.0))

    if isinstance(profile, str):
        return features.withColumn("panel", total(profile))
    return features.withColumn("panel", F.when(profile == "statement", total("statement")).otherwise(total("instruction")))


def rescored(facts: DataFrame, scorer: str, profile: str = "instruction", *keys: str) -> DataFrame:
    """``facts`` with ``score`` by another scorer; inert statements stay 0, whichever it is."""
    keys = keys or ("fn",)
    if scorer == "current":
        return facts
    if scorer != "panel":
        return facts.withColumn("score", F.when(F.col("tier") == 0, 0.0).otherwise(F.col(scorer)))
    lines = panel_score(line_features(facts, *keys), profile).select(*keys, "line", "panel")
    joined = facts.join(lines, [*keys, "line"], "left")
    score = F.when((F.col("tier") == 0) | F.col("structural"), 0.0).otherwise(F.coalesce("panel", F.lit(0.0)))
    return joined.withColumn("score", score).drop("panel").select(facts.columns)


def line_table(facts: DataFrame, *keys: str) -> DataFrame:
    """(keys, line, tier, score, reasons): each line's reasons once, by tier descending, then as first met."""
    keys = keys or ("fn",)
    rows = facts.where(F.col("line").isNotNull() & ~F.col("structural"))
    met = F.sort_array(F.collect_list(F.struct("nid", "reasons")))
    texts = F.flatten(F.transform(met, lambda s: s["reasons"]))
    lines = rows.groupBy(*keys, "line").agg(F.max("tier").alias("tier"), F.greatest(F.max("score"), F.lit(0.0)).alias("score"), texts.alias("all"))
    first = F.filter("all", lambda r, i: F.array_position(F.transform("all", lambda q: q["text"]), r["text"]) == i + 1)
    by_tier = F.flatten(F.transform(F.array(*map(F.lit, (3, 2, 1, 0))), lambda t: F.filter(first, lambda r: r["tier"] == t)))
    return lines.select(*keys, "line", "tier", "score", F.transform(by_tier, lambda r: r["text"]).alias("reasons"))


def spans(lines: DataFrame, *keys: str) -> DataFrame:
    """Neighbouring lines with the same tier, and a score within 1e-9 of the span's first, as spans with ranks.

    A function's lines are bounded by its statements; they are folded in order. The rank is the share of
    the function's spans that score strictly less.
    """
    keys = keys or ("fn",)
    have_reasons = "reasons" in lines.columns
    reasons = F.col("reasons") if have_reasons else F.array().cast("array<string>")
    packed = lines.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("line", F.col("tier").cast("int").alias("tier"), F.col("score").cast("double").alias("score"), reasons.alias("reasons")))).alias("ls"))
    kind = "array<struct<start:int,end:int,tier:int,score:double,reasons:array<string>>>"

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        joins = (F.size(acc) > 0) & (last["tier"] == x["tier"]) & (last["end"] + 1 == x["line"]) & (F.abs(last["score"] - x["score"]) < 1e-9)
        longer = F.struct(last["start"].alias("start"), x["line"].cast("int").alias("end"), last["tier"].alias("tier"), last["score"].alias("score"), F.array_union(last["reasons"], x["reasons"]).alias("reasons"))
        fresh = F.struct(x["line"].cast("int").alias("start"), x["line"].cast("int").alias("end"), x["tier"].alias("tier"), x["score"].alias("score"), x["reasons"].alias("reasons"))
        return F.when(joins, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(acc, F.array(fresh))).cast(kind)

    folded = packed.select(*keys, F.explode(F.aggregate("ls", F.array().cast(kind), step)).alias("s")).select(*keys, "s.*")
    w = Window.partitionBy(*keys)
    rank = (F.rank().over(w.orderBy("score")) - 1) / F.greatest(F.count("*").over(w) - 1, F.lit(1))
    return folded.withColumn("rank", rank).select(*keys, "start", "end", "tier", "score", "rank", *(["reasons"] if have_reasons else []))


def span_lines(spans: DataFrame) -> DataFrame:
    """A row a line of each span."""
    return spans.withColumn("line", F.explode(F.sequence("start", "end")))


def structural(facts: DataFrame) -> DataFrame:
    return facts.withColumn("structural", is_structural())


def stabbed(spans: DataFrame, points: DataFrame, *keys: str, value: str = "tier") -> DataFrame:
    """``points`` (keys, line) with the largest ``value`` of the spans that hold the line; null where none does."""
    keys = keys or ("fn",)
    s = spans.select(*keys, "start", "end", F.col(value).alias("_v"))
    # equi-join on the function; the interval is a residual over its few spans
    joined = points.join(s, [*keys], "left").withColumn("_in", F.when(F.col("line").between(F.col("start"), F.col("end")), F.col("_v")))
    return joined.groupBy(*[c for c in points.columns]).agg(F.max("_in").alias(value))


def apply_scope(spans: DataFrame, line_scores: DataFrame, *keys: str, name: str = "file_score") -> DataFrame:
    """``spans`` with the largest scope score over their lines, null where no line has one."""
    scores = line_scores.select(*keys, "line", F.col("score").alias("_s"))
    joined = span_lines(spans).join(scores, [*keys, "line"], "left")
    return joined.groupBy(*spans.columns).agg(F.max("_s").alias(name))
