"""Lowered functions as JSON: the representation on the wire, and rewrites of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.model import WIRE


def read_wire(spark: SparkSession, path: str) -> DataFrame:
    """One packed row a function of the modules below ``path``: fn, file, name, signature, decl_line, entry, nodes."""
    modules = spark.read.schema(WIRE).option("multiLine", True).option("recursiveFileLookup", True).json(path)
    return packed(modules)


def packed(modules: DataFrame) -> DataFrame:
    """Packed functions of rows in the wire's schema. A function without a file has its module's; empty ones go."""
    f = modules.select(F.col("file").alias("_module"), F.explode("functions").alias("f")).select("_module", "f.*").where(F.size("nodes") > 0)

    def node(x: Column, i: Column) -> Column:
        k = x["kind"]
        return F.struct(
            i.cast("int").alias("nid"), x["line"].alias("line"), k["t"].alias("kind"), k["callee"].alias("callee"), k["opacity"].alias("opacity"), k["target"].alias("target"),
            F.coalesce(x["defs"], F.array().cast("array<bigint>")).alias("defs"), F.coalesce(x["uses"], F.array().cast("array<bigint>")).alias("uses"), F.coalesce(x["succs"], F.array().cast("array<int>")).alias("succs"), x["label"].alias("label"),
        )

    file = F.when(F.coalesce("file", F.lit("")) == "", F.col("_module")).otherwise(F.col("file"))
    fn = F.xxhash64(file, "name", "signature", "decl_line")
    return f.select(fn.alias("fn"), file.alias("file"), "name", "signature", "decl_line", F.coalesce("entry", F.lit(0)).alias("entry"), F.transform("nodes", node).alias("nodes"))


def exploded(functions: DataFrame) -> DataFrame:
    """A row a statement."""
    return functions.select(*[c for c in functions.columns if c != "nodes"], F.explode("nodes").alias("n")).select(*[c for c in functions.columns if c != "nodes"], "n.*")


_NODES = "array<struct<nid:int,line:int,kind:string,callee:string,opacity:string,target:string,defs:array<bigint>,uses:array<bigint>,succs:array<int>,label:string>>"


def excise_coroutines(functions: DataFrame, marker: str = "getCOROUTINE_SUSPENDED") -> DataFrame:
    """Packed functions in which a coroutine's dispatch goes to its first arm only; what this cuts off loses its lines.

    A function is a coroutine if it calls ``marker``; its dispatch is the first branch with more than two
    successors. Others stay as they are. What can still be reached grows, in order, until nothing is added.
    """
    is_machine = F.exists("nodes", lambda x: (x["kind"] == "call") & F.coalesce(x["callee"], F.lit("")).contains(marker))
    at = F.array_min(F.transform(F.filter("nodes", lambda x: (x["kind"] == "branch") & (F.size(x["succs"]) > 2)), lambda x: x["nid"]))
    rows = functions.withColumn("_at", F.when(is_machine, at))

    def pruned(x: Column) -> Column:
        return x.withField("succs", F.when(x["nid"] == F.col("_at"), F.array(F.array_min(x["succs"]))).otherwise(x["succs"]))

    rows = rows.withColumn("nodes", F.transform("nodes", pruned))
    start = F.struct(F.array(F.lit(0)).alias("seen"), F.array(F.lit(0)).alias("new")).cast("struct<seen:array<int>,new:array<int>>")

    def grow(acc: Column, _: Column) -> Column:
        to = F.flatten(F.transform(acc["new"], lambda i: F.element_at(F.col("nodes"), i + 1)["succs"]))
        new = F.array_except(F.array_distinct(to), acc["seen"])
        return F.struct(F.concat(acc["seen"], new).alias("seen"), new.alias("new")).cast("struct<seen:array<int>,new:array<int>>")

    seen = F.aggregate("nodes", start, grow)["seen"]
    rows = rows.withColumn("_seen", F.when(F.col("_at").isNotNull(), seen))
    cut = F.transform("nodes", lambda x: x.withField("line", F.when(F.array_contains("_seen", x["nid"]), x["line"])))
    return rows.withColumn("nodes", F.when(F.col("_at").isNotNull(), cut).otherwise(F.col("nodes")).cast(_NODES)).drop("_at", "_seen")
