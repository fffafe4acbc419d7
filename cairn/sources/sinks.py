"""Reports: nested JSON for each file, a static-analysis log, annotated sources, text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.text import relative_uri, round2, span_text
from cairn.model import TIERS

SCHEMA, GENERATOR = "cairn.lines.v3", "cairn"
DESCRIPTIONS = {
    "core": "Carries the behaviour: decides what runs, feeds a loop back, or much depends on it",
    "boundary": "Where effects leave: returns, throws, writes to state, calls of unknown work",
    "plumbing": "Moves values along without deciding anything",
    "inert": "Logging and the like, and what only feeds it",
}


def tier_name(tier: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, TIERS)), (tier + 1).cast("int"))


def function_records(functions: DataFrame, spans: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """(file, record): a function's name, coverage, tier counts by line and spans; null fields are left out of JSON.

    ``functions`` are packed; ``spans`` have (fn, start, end, tier, score, rank, reasons) and may have file_score and
    repo_score; ``sources`` (file, source) give the spans' texts.
    """
    extra = [c for c in ("file_score", "repo_score") if c in spans.columns]
    s = spans.join(functions.select("fn", "file"), "fn")
    if sources is not None:
        s = s.join(sources.select("file", "source"), "file", "left").withColumn("text", span_text(F.col("source"), F.col("start"), F.col("end")))
    fields = [F.col("start"), F.col("end"), tier_name(F.col("tier")).alias("tier"), round2(F.col("score")).alias("function_score"), round2(F.col("rank")).alias("rank"), *(round2(F.col(c)).alias(c) for c in extra), *(["text"] if sources is not None else []), "reasons"]
    lines = F.col("end") - F.col("start") + 1
    counts = [F.sum(F.when(F.col("tier") == t, lines).otherwise(0)).alias(n) for t, n in reversed(list(enumerate(TIERS)))]
    per = s.groupBy("fn").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("spans"), *counts)
    f = functions.join(per, "fn", "left")
    have = set(functions.columns)
    coverage = F.struct(F.size("nodes").alias("instructions"), F.size(F.filter("nodes", lambda x: x["line"].isNotNull())).alias("with_line"))
    summary = F.struct(*(F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in reversed(TIERS)))
    optional = [F.nullif(F.col(c), F.lit("")).alias(c) if c == "signature" else F.col(c) for c in ("signature", "decl_line") if c in have]
    empty = F.array().cast(per.schema["spans"].dataType)
    record = F.struct("file", "name", *optional, coverage.alias("coverage"), summary.alias("summary"), F.coalesce("spans", empty).alias("spans"))
    return f.select("file", record.alias("record"))


def sidecars(records: DataFrame) -> DataFrame:
    """(file, json): one document a file, its functions by declaration line, those without first, then by name."""
    has_line = "decl_line" in records.schema["record"].dataType.fieldNames()
    key = F.struct(F.col("record.decl_line").alias("l") if has_line else F.lit(None).cast("int").alias("l"), F.col("record.name").alias("n"), F.col("record").alias("r"))
    t = records.groupBy("file").agg(F.sort_array(F.collect_list(key)).alias("rs"))
    doc = F.struct(F.lit(SCHEMA).alias("schema"), F.lit(GENERATOR).alias("generator"), "file", F.transform("rs", lambda x: x["r"]).alias("functions"))
    return t.select("file", F.to_json(doc, {"pretty": "true"}).alias("json"))


def results(spans: DataFrame, tiers: tuple[str, ...] = ("core", "boundary")) -> DataFrame:
    """(uri, line, tier, score, rule, text): a row a line of the spans (file, start, end, tier, score) of the asked tiers."""
    name = tier_name(F.col("tier"))
    t = spans.withColumn("tier", name).where(F.col("tier").isin(*tiers)).withColumn("score", round2(F.col("score"))).withColumn("line", F.explode(F.sequence("start", "end")))
    return t.select(relative_uri(F.col("file")).alias("uri"), "line", "tier", "score", F.concat(F.lit("cairn/"), "tier").alias("rule"), F.format_string("%s line (panel %.2f)", "tier", "score").alias("text"))


def sarif(results: DataFrame, tiers: tuple[str, ...] = ("core", "boundary"), version: str = "1.0") -> DataFrame:
    """(uri, json): one log a file, results by line; every result is a note."""
    place = F.struct(F.struct(F.struct(F.col("uri").alias("uri")).alias("artifactLocation"), F.struct(F.col("line").alias("startLine")).alias("region")).alias("physicalLocation"))
    result = F.struct(F.col("rule").alias("ruleId"), F.lit("note").alias("level"), F.struct("text").alias("message"), F.array(place).alias("locations"), F.struct("score", "tier").alias("properties"))
    rules = F.array(*[F.struct(F.lit(f"cairn/{t}").alias("id"), F.struct(F.lit(DESCRIPTIONS[t]).alias("text")).alias("shortDescription")) for t in reversed(TIERS) if t in tiers])
    driver = F.struct(F.lit("cairn").alias("name"), F.lit(version).alias("version"), rules.alias("rules"))
    t = results.groupBy("uri").agg(F.sort_array(F.collect_list(F.struct("line", result.alias("r")))).alias("rs"))
    run = F.struct(F.struct(driver.alias("driver")).alias("tool"), F.transform("rs", lambda x: x["r"]).alias("results"))
    log = F.struct(F.lit("https://json.schemastore.org/" + "sarif-2.1.0.json").alias("$schema"), F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))
    return t.select("uri", F.to_json(log).alias("json"))


def annotated(sources: DataFrame, spans: DataFrame) -> DataFrame:
    """(file, line, tier, score, text): every source line, with the tier and score of the span that holds it."""
    lines = sources.select("file", F.posexplode(F.split("source", "\n")).alias("i", "text")).withColumn("line", F.col("i") + 1)
    marks = spans.withColumn("line", F.explode(F.sequence("start", "end"))).groupBy("file", "line").agg(F.max("tier").alias("tier"), F.max("score").alias("score"))
    return lines.join(marks, ["file", "line"], "left").select("file", "line", tier_name(F.col("tier")).alias("tier"), "score", "text")


def report(spans: DataFrame) -> DataFrame:
    """(file, start, text): one line of text a span."""
    return spans.select("file", "start", F.format_string("%s:%d-%d %-8s %.2f %s", "file", "start", "end", tier_name(F.col("tier")), "score", F.array_join("reasons", "; ")).alias("text"))
