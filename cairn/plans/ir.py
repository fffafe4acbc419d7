"""Forms of the intermediate representation: exploded statements, packed functions, the adapter of order lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.model import MAX_NODES

_FIELDS = ("nid", "line", "kind", "callee", "opacity", "target", "defs", "uses", "succs", "label")


def pack(nodes: DataFrame, *keys: str, most: int = MAX_NODES) -> DataFrame:
    """One row a function: keys, entry and an array of its statements, which ``most`` bounds.

    Statements of larger functions are left out before they meet; ``oversized`` lists those functions.
    """
    keys = keys or ("fn",)
    n = F.count("*").over(Window.partitionBy(*keys))
    have = set(nodes.columns)
    fields = [F.col(c) if c in have else F.lit(None).cast({"callee": "string", "opacity": "string", "target": "string", "label": "string", "line": "int"}.get(c, "string")).alias(c) for c in _FIELDS]
    entry = F.max("entry") if "entry" in have else F.lit(0)
    rows = nodes.withColumn("_n", n).where(F.col("_n") <= most)
    return rows.groupBy(*keys).agg(entry.alias("entry"), F.sort_array(F.collect_list(F.struct(*fields))).alias("nodes"))


def oversized(nodes: DataFrame, *keys: str, most: int = MAX_NODES) -> DataFrame:
    """The functions that ``pack`` leaves out, with their sizes."""
    return nodes.groupBy(*(keys or ("fn",))).agg(F.count("*").alias("n")).where(F.col("n") > most)


def invalid(packed: DataFrame) -> DataFrame:
    """Functions with an entry or a successor out of range, and why."""
    n = F.size("nodes")
    bad_entry = (F.col("entry") < 0) | (F.col("entry") >= n)
    bad_succ = F.exists("nodes", lambda x: F.exists(x["succs"], lambda s: (s < 0) | (s >= n)))
    return packed.where(n > 0).where(bad_entry | bad_succ).drop("nodes").withColumn("error", F.lit("out of range"))


def is_structural() -> Column:
    return (F.col("kind") == "pure") & (F.size("defs") == 0) & (F.size("uses") == 0)


def is_hard_effect() -> Column:
    return F.col("kind").isin("return", "throw", "state_write")


def is_effect() -> Column:
    return is_hard_effect() | (F.col("kind") == "call") & (F.coalesce(F.col("opacity"), F.lit("")) != "inert")


def is_inert() -> Column:
    return (F.col("kind") == "call") & (F.coalesce(F.col("opacity"), F.lit("")) == "inert")


def edges(nodes: DataFrame) -> DataFrame:
    """Distinct control-flow edges (fn, src, dst)."""
    return nodes.select("fn", F.col("nid").alias("src"), F.explode("succs").alias("dst")).distinct()


def short_name(g: Column) -> Column:
    return F.concat(F.lit("f"), F.when(g % 3 == 0, g % 1000).otherwise(g).cast("string"))


def full_name(g: Column) -> Column:
    return F.concat(F.lit("m"), (g % 20).cast("string"), F.lit("."), short_name(g))


def from_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as statements: an order is a function, a line a statement (``ORACLE_IR`` is its SQL)."""
    src = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    w = Window.partitionBy("l_orderkey")
    order = w.orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    rows = src.withColumn("nid", F.row_number().over(order) - 1).withColumn("n", F.count("*").over(w).cast("int"))
    kind = (
        F.when(F.col("nid") == F.col("n") - 1, "return")
        .when(F.col("l_returnflag") == "R", "branch")
        .when((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "F"), "call")
        .when(F.col("l_returnflag") == "A", "state_write")
        .otherwise("pure")
    )
    rows = rows.withColumn("kind", kind)
    skip = (F.col("l_quantity").cast("int") % 3).cast("int")
    ahead = F.least(F.col("n") - 1, F.col("nid") + 2 + skip)
    back = F.greatest(F.lit(0), F.col("nid") - 1 - skip)
    nxt = F.array(F.col("nid") + 1)
    branch = F.when(F.col("l_suppkey") % 5 != 0, ahead).otherwise(back)
    succs = F.when(F.col("nid") == F.col("n") - 1, F.array().cast("array<int>")).when(F.col("kind") == "branch", F.array_distinct(F.concat(nxt, F.array(branch)))).otherwise(nxt)
    g = F.col("l_orderkey") + F.col("l_partkey") % 20
    k = F.col("l_suppkey") % 11
    callee = F.when(k == 0, "logging.info").when(k == 1, "LOG.info").when(k == 2, "mylog.info").when(k <= 5, full_name(g)).otherwise(short_name(g))
    return rows.select(
        F.col("l_orderkey").alias("fn"),
        F.concat(F.lit("file"), F.floor(F.col("l_orderkey") / 37).cast("string")).alias("file"),
        full_name(F.col("l_orderkey")).alias("name"),
        "nid",
        "n",
        F.col("l_linenumber").cast("int").alias("line"),
        "kind",
        F.when(F.col("kind") == "call", callee).alias("callee"),
        F.lit(None).cast("string").alias("opacity"),
        F.when(F.col("kind") == "state_write", F.concat(F.lit("v"), (F.col("l_partkey") % 4).cast("string"))).alias("target"),
        F.array((F.col("l_partkey") % 4)).alias("defs"),
        F.array((F.col("l_suppkey") % 4)).alias("uses"),
        succs.alias("succs"),
        F.lit(None).cast("string").alias("label"),
    )
