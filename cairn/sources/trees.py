"""Source trees: files below a folder, chosen by path before any is read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import paths

#: Larger files are no source that anyone wrote.
MOST_BYTES = 8 << 20


def files(spark: SparkSession, root: str, tests: bool = False) -> DataFrame:
    """(path, rel, language, kind, length) of the sources below ``root``, without reading contents.

    Skipped folders, tests (unless asked for), other files and those of more than 8 MiB go.
    """
    scheme = root if "://" in root or root.startswith("file:") else "file:" + root
    base = "/" + scheme.split(":", 1)[-1].strip("/") + "/"
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    rel = F.expr(f"substring_index(path, '{base.replace(chr(39), '')}', -1)")
    t = found.withColumn("rel", rel).withColumn("language", paths.language(F.col("rel"))).withColumn("kind", paths.input_kind(F.col("rel")))
    keep = F.col("kind").isNotNull() & ~paths.is_skipped(F.col("rel")) & (F.col("length") <= MOST_BYTES)
    return t.where(keep if tests else keep & ~paths.is_test(F.col("rel")))


def sources(spark: SparkSession, root: str, language: str | None = None, tests: bool = False) -> DataFrame:
    """(path, rel, language, source): the chosen files' texts, UTF-8."""
    chosen = files(spark, root, tests)
    if language:
        chosen = chosen.where(F.col("language") == language)
    content = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "content")
    return chosen.where("kind <> 'class'").join(content, "path").select("path", "rel", "language", F.decode("content", "utf-8").alias("source"))


def majority_language(files: DataFrame, weight: str | None = None) -> DataFrame:
    """(language): the one with the most files, or the most of ``weight``; of equals Python, then the first by name."""
    n = F.sum(weight) if weight else F.count("*")
    t = files.where("language is not null").groupBy("language").agg(n.alias("n"))
    return t.orderBy(F.desc("n"), F.when(F.col("language") == "python", 0).otherwise(1), "language").limit(1).select("language")
