"""Datasets of calibration runs and labels, as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.model import FEATURES

_INSTRUMENTS = ",".join(f"{f}:double" for f in FEATURES)
DATASET = f"root string, language string, profile string, file string, function string, line int, instruments struct<{_INSTRUMENTS}>, panel double, mutants int, killed int, kill_rate double, function_features struct<trophic:double,fan_in:double,size_share:double,boundary_density:double>, file_score double"
LABELS = "schema string, rater string, functions array<struct<file:string,name:string,character:string,lines:map<string,struct<importance:int,tier:string,note:string>>>>"
ORACLE = "schema string, seed int, python string, functions array<struct<file:string,name:string,start:int,end:int,inputs:int,mutants:int,covered_lines:int,lines:map<string,struct<leverage:double,leverage_no_delete:double,mutants:int,covered:boolean,kinds:array<string>>>>>"


def read_dataset(spark: SparkSession, path: str, scopes: bool = False) -> DataFrame:
    """Rows of calibration files, older ones with nulls for what they lack; those of scope runs only if asked for."""
    rows = spark.read.schema(DATASET).json(path).withColumn("_from", F.input_file_name())
    return (rows if scopes else rows.where(~F.col("_from").contains("-filescope"))).drop("_from")


def write_dataset(rows: DataFrame, path: str) -> None:
    """Sorted by file, function and line; fields without a value are left out."""
    rows.orderBy("file", "function", "line").write.json(path)


def read_labels(spark: SparkSession, path: str, least: int = 4) -> DataFrame:
    """(file, name, line, importance, tier, note) of functions with ``least`` labelled lines or more."""
    f = spark.read.schema(LABELS).option("multiLine", True).json(path).select(F.explode("functions").alias("f"))
    f = f.where(F.size("f.lines") >= least).select("f.file", "f.name", F.explode("f.lines").alias("line", "v"))
    return f.select("file", "name", F.col("line").cast("int").alias("line"), "v.*")


def read_oracle(spark: SparkSession, path: str, deletions: bool = True, least: int = 4) -> DataFrame:
    """(file, name, line, importance) of covered lines with a leverage, in functions with ``least`` of them."""
    f = spark.read.schema(ORACLE).option("multiLine", True).json(path).select(F.explode("functions").alias("f"))
    value = "leverage" if deletions else "leverage_no_delete"
    kept = F.map_filter("f.lines", lambda _, v: v["covered"] & v[value].isNotNull())
    f = f.select("f.file", "f.name", kept.alias("lines")).where(F.size("lines") >= least).select("file", "name", F.explode("lines").alias("line", "v"))
    return f.select("file", "name", F.col("line").cast("int").alias("line"), F.col(f"v.{value}").alias("importance"))
