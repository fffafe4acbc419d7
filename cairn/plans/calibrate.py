"""Does the ranking agree with which mutants tests kill? From scored spans and outcomes to a verdict."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.model import FEATURES
from cairn.operators import panel, stats


def extents(spans: DataFrame) -> DataFrame:
    """(file, fn, name, lo, hi, lines) of each function's scored lines."""
    n = F.col("end") - F.col("start") + 1
    return spans.groupBy("file", "fn", "name").agg(F.min("start").alias("lo"), F.max("end").alias("hi"), F.sum(n).alias("lines"))


def sample(functions: DataFrame, k: int) -> DataFrame:
    """The ``k`` functions with the most lines; of equals the first by file and name. The limit is the feature."""
    return functions.orderBy(F.desc("lines"), "file", "name").limit(k)


def paired(spans: DataFrame, outcomes: DataFrame, k: int = 30, within: str = "function") -> DataFrame:
    """(file, line, killed, mutants, fn, kill_rate, null_score, panel) of lines with outcomes and a score.

    ``outcomes``: (file, line, outcome) of killed, timeout, survived or invalid mutants. Within a file or the
    repository the score is the scope's, and the null runs over the file's extent.
    """
    chosen = sample(extents(spans), k)
    p = stats.pair_lines(stats.kill_tally(outcomes, "file", "line"), chosen)
    score = "score" if within == "function" else f"{within}_score"
    lines = panel.span_lines(spans).groupBy("file", "line").agg(F.max(score).alias("panel"))
    p = p.join(lines.where("panel is not null"), ["file", "line"])
    if within == "function":
        return p
    whole = lines.where("panel is not null").groupBy("file").agg(F.min("line").alias("_lo"), F.max("line").alias("_hi"))
    null = F.when(F.col("_hi") > F.col("_lo"), 1.0 - (F.col("line") - F.col("_lo")) / F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1))).otherwise(1.0)
    return p.join(whole, "file").withColumn("null_score", null).drop("_lo", "_hi")


def judged(pairs: DataFrame, executed: int) -> DataFrame:
    """(lines, rho, null_rho, verdict, gate) over all pairs."""
    a, b = stats.spearman(pairs, "panel", "kill_rate"), stats.spearman(pairs, "null_score", "kill_rate")
    one = a.select(F.col("n").alias("lines"), "rho").join(b.select(F.col("rho").alias("null_rho")), F.lit(True))  # one row each
    one = one.withColumn("verdict", stats.verdict(F.col("rho"), F.col("null_rho"), F.col("lines"), F.lit(executed)))
    return one.withColumn("gate", stats.gate_code(F.col("verdict")))


def by_function(pairs: DataFrame, least: int = 4) -> DataFrame:
    """(file, fn, n, rho) of functions with ``least`` pairs or more."""
    return stats.spearman(pairs, "panel", "kill_rate", "file", "fn").where(F.col("n") >= least)


def dataset(pairs: DataFrame, spans: DataFrame, features: DataFrame, root: str, language: str, profile: str) -> DataFrame:
    """Rows of the calibration dataset: each paired line with its features, counts and rate."""
    names = spans.select("fn", "file", "name").distinct()
    t = pairs.join(features.drop("file", "tier"), ["fn", "line"]).join(names, ["fn", "file"])
    instruments = F.struct(*FEATURES)
    return t.select(F.lit(root).alias("root"), F.lit(language).alias("language"), F.lit(profile).alias("profile"), "file", F.col("name").alias("function"), "line", instruments.alias("instruments"), "panel", "mutants", "killed", "kill_rate")
