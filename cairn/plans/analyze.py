"""From a path to scored lines: reading, lowering, guarding, analysing, projecting, re-weighting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import paths
from cairn.functions.denylist import DEFAULT
from cairn.model import INSTRUMENTS, MAX_NODES
from cairn.operators import kernel, panel, scope
from cairn.plans.shared import written
from cairn.sources import bytecode, sinks, trees, wire

KEYS = ("fn", "file", "name")
SCOPES = ("function", "file", "repo")


def lower(spark: SparkSession, root: str, tests: bool = False) -> DataFrame:
    """(file, functions, error) of the Python sources below ``root``; one that doesn't compile has an error."""
    return bytecode.lower_python(trees.sources(spark, root, "python", tests).select(F.col("rel").alias("path"), "source"))


def named(root: str, file: Column, roots: Sequence[str]) -> Column:
    """A file's name in an analysis of ``roots``."""
    return F.concat(F.lit(root.rstrip("/") + "/"), file) if len(roots) > 1 else file


def read(spark: SparkSession, *roots: str, tests: bool = False, synthetic: bool = True) -> DataFrame:
    """Packed functions of all the ``roots`` together: folders of Python sources, and wire JSON where a path ends in .json.

    Raises where there is none. With several roots, a folder's files are named with their folder (``named``).
    """
    functions = None
    for root in roots:
        if root.endswith(".json"):
            one = wire.read_wire(spark, root)
        else:
            modules = lower(spark, root, tests)
            one = wire.packed(modules.withColumn("file", named(root, F.col("file"), roots)).withColumn("functions", F.transform("functions", lambda f: f.withField("file", F.lit("")))) if len(roots) > 1 else modules)
        functions = one if functions is None else functions.unionByName(one, allowMissingColumns=True)
    if functions is None:
        raise ValueError("no path is given")
    if not synthetic:
        functions = functions.where(~F.coalesce(paths.is_synthetic(F.col("name"), paths.language(F.col("file"))), F.lit(False)))
    if not functions.take(1):
        raise ValueError(f"no functions below {', '.join(roots)}; sources are known by {paths.supported_extensions()}")
    return functions


def guarded(functions: DataFrame, most: int = MAX_NODES) -> tuple[DataFrame, DataFrame]:
    """(functions to analyse, rejected ones with a reason)."""
    n = F.size("nodes")
    out_of_range = (F.col("entry") < 0) | (F.col("entry") >= n) | F.exists("nodes", lambda x: F.exists(x["succs"], lambda s: (s < 0) | (s >= n)))
    why = F.when(out_of_range, "out of range").when(n > most, "too large")
    t = functions.where(n > 0).withColumn("_why", why)
    return t.where("_why is null").drop("_why"), t.where("_why is not null").select("fn", "file", "name", n.alias("n"), F.col("_why").alias("error"))


def statements(functions: DataFrame, scorer: str = "panel", profile: str | None = None, patterns: tuple[str, ...] = DEFAULT) -> DataFrame:
    """Statement facts with the scorer's score. The panel's profile is the file's language's unless given."""
    if scorer not in kernel.SCORERS:
        raise ValueError(f"scorer is one of {kernel.SCORERS}")
    need = ["structural", "tier", "score", "reasons", *(INSTRUMENTS if scorer == "panel" else [scorer] if scorer != "current" else [])]
    f = kernel.facts(functions.select(*KEYS, "entry", "nodes"), *need, patterns=patterns)
    if scorer != "panel" or profile:
        return panel.rescored(f, scorer, profile or "instruction", *KEYS)
    names = F.create_map(*[F.lit(x) for kv in paths.PROFILES.items() for x in kv])
    kind = F.coalesce(F.try_element_at(names, paths.language(F.col("file"))), F.lit("instruction"))
    lines = panel.panel_score(panel.line_features(f, *KEYS).withColumn("profile", kind), F.col("profile")).select(*KEYS, "line", "panel")
    score = F.when((F.col("tier") == 0) | F.col("structural"), 0.0).otherwise(F.coalesce("panel", F.lit(0.0)))
    return f.join(lines, [*KEYS, "line"], "left").withColumn("score", score).drop("panel")


def analyse(functions: DataFrame, scorer: str = "panel", within: str = "file", profile: str | None = None, patterns: tuple[str, ...] = DEFAULT) -> DataFrame:
    """Spans (fn, file, name, start, end, tier, score, rank, reasons) and, by scope, file_score or repo_score."""
    if within not in SCOPES:
        raise ValueError(f"scope is one of {SCOPES}")
    facts = statements(functions, scorer, profile, patterns)
    spans = panel.spans(panel.line_table(facts, *KEYS), *KEYS)
    if within == "function":
        return spans
    spans = written(spans.sparkSession, spans, "spans")  # read again for lines, ranks and the join back
    lines = panel.span_lines(spans).groupBy(*KEYS, "line").agg(F.max("score").alias("score"), F.max("tier").alias("tier"))
    by = ("file",) if within == "file" else ()
    features = scope.function_features(wire.exploded(functions), lines, functions.select(*KEYS), *by)
    return panel.apply_scope(spans, scope.blended(lines, features, *by).drop("fn"), "file", name=f"{within}_score")


def report(functions: DataFrame, spans: DataFrame, sources: DataFrame | None = None, form: str = "json", tiers: tuple[str, ...] = ("core", "boundary")) -> DataFrame:
    """The run's output in one of json, sarif, text, annotate or stats."""
    if form == "json":
        return sinks.sidecars(sinks.function_records(functions, spans, sources))
    if form == "sarif":
        return sinks.sarif(sinks.results(spans, tiers))
    if form == "text":
        return sinks.report(spans)
    if form == "annotate":
        return sinks.annotated(sources, spans)
    if form == "stats":
        lines = F.col("end") - F.col("start") + 1
        t = spans.groupBy(sinks.tier_name(F.col("tier")).alias("tier")).agg(F.sum(lines).alias("lines"), F.avg("score").alias("mean_score"))
        return t
    raise ValueError(f"no such form: {form}")
