"""What the corpus operators share: reading columns, words of a batch, hot groups."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.plans.shared import ship_package, written

#: White space of the corpus contracts, as bytes.
SPACE = b" \t\n\x0b\x0c\r"
#: Texts are worked on in pieces of about so many bytes, to bound a worker's memory.
SLICE_BYTES = 4 << 20


def ready(spark: SparkSession) -> None:
    ship_package(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: What a worker remembers between tasks, by the kind of work; other work lets go of it.
REMEMBERED: dict[str, dict] = {}


def let_go(but: str | None = None) -> None:
    """Frees what other kinds of work have left in this worker, and returns unused memory to the system."""
    for kind in list(REMEMBERED):
        if kind != but:
            REMEMBERED.pop(kind).clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES, work: str | None = None) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the texts of each hold ``most`` bytes, or one row. ``work``: the memory to keep."""
    let_go(work)
    for b in batches:
        if not b.num_rows:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            base = size[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(size, base + most, side="right")))
            yield b.slice(at, to - at)
            at = to


class Words:
    """The words (runs of other than ASCII white space) of a column of texts.

    ``codes[offsets[i]:offsets[i + 1]]`` are row i's words as indices into ``distinct``; null has none.
    """

    def __init__(self, text: pa.Array):
        parts = pc.ascii_split_whitespace(pc.fill_null(text, ""))
        offsets = np.asarray(parts.offsets, dtype=np.int64)
        flat = parts.flatten().dictionary_encode()
        self.distinct: pa.Array = flat.dictionary
        codes = flat.indices.to_numpy(zero_copy_only=False)
        empty = pc.index(self.distinct, pa.scalar("", self.distinct.type)).as_py()
        offsets = offsets - offsets[0]
        if empty >= 0:
            kept = codes != empty
            offsets = np.concatenate([[0], np.cumsum(kept)])[offsets]
            codes = codes[kept]
        self.codes, self.offsets = codes, offsets

    @property
    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))


def text_of(arr: pa.Array) -> pa.Array:
    """A string array with 32-bit offsets, nulls kept."""
    return arr.cast(pa.string()) if not pa.types.is_string(arr.type) else arr


def word_hash(distinct: pa.Array, seed: int = 0) -> np.ndarray:
    """64-bit hashes of strings."""
    from xxhash import xxh64_intdigest as h

    return np.fromiter((h(x, seed) for x in distinct.to_pylist()), dtype=np.uint64, count=len(distinct))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit numbers."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def crc_mod(doc_id: str, n: int) -> Column:
    """crc32 of an id's decimal text, modulo n."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % n


def fresh(columns: list[str], name: str) -> str:
    """``name`` with as many underscores before it as no column has, in any case."""
    taken = {c.lower() for c in columns}
    while (name := f"_{name}").lower() in taken:
        pass
    return name


def by_id(docs: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame, str]:
    """``docs`` in two: the rows whose id no other has, and the others (null ids too), and the name of a column of
    theirs that numbers them.

    Only the others are written, so a table without repeated ids isn't copied. No column's type matters.
    """
    spark = docs.sparkSession
    own, tag = fresh(docs.columns, "id"), fresh(docs.columns, "tag")
    key = F.col(f"`{id_col}`")
    repeated = written(spark, docs.groupBy(key.alias(own)).agg(F.count("*").alias("n")).where("n > 1 or " + own + " is null").select(own), "repeated")  # of known size: no shuffle of all rows where it is small
    once = docs.where(key.isNotNull()).join(repeated, key == F.col(own), "left_anti")
    some = docs.join(repeated.where(F.col(own).isNotNull()), key == F.col(own), "left_semi").unionByName(docs.where(key.isNull()))
    return once, written(spark, some.withColumn(tag, F.monotonically_increasing_id()), "repeated-rows"), tag


def join_hot(rows: DataFrame, groups: DataFrame, key: str, count: str, total: int, how: str = "inner", share: int = 1000) -> DataFrame:
    """``rows`` joined with the one row that ``groups`` has for each key, whatever the skew.

    Keys with more than a 1/``share`` part of the ``total`` rows, of which there are fewer than
    ``share``, are broadcast; the others' groups are small and shuffle. ``count`` names the column
    of ``groups`` with the number of rows of a key.
    """
    limit = max(total // share, 1)
    hot = groups.where(F.col(count) > limit)
    keys = F.broadcast(hot.select(F.col(key).alias("_hot_key")))
    tagged = rows.join(keys, F.col(key) == F.col("_hot_key"), "left")
    cold = tagged.where(F.col("_hot_key").isNull()).drop("_hot_key")
    warm = tagged.where(F.col("_hot_key").isNotNull()).drop("_hot_key")
    return warm.join(F.broadcast(hot), key).unionByName(cold.join(groups.where(F.col(count) <= limit), key, how))
