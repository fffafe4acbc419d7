"""A quality filter by importance resampling.

Two generative models of hashed n-grams, one of target text (documents labelled good) and one of all
text, give each document a log importance weight: the mean over its n-grams of the logarithm of their
probabilities' ratio, so that long texts aren't weighed by their length. Divided by a temperature and
with Gumbel noise added, the top k are a sample without replacement by those weights; the temperature
is so low that only documents near the k-th weight are left to chance. The n-grams are words, pairs of words (a word and its own repetition make the same pair,
whatever the word), and character trigrams.

The target model is fitted on at most ``fit_rows`` labelled rows, those with the smallest hashes; the
model of all text counts every document. The k-th key is found by histograms of the keys' bits, never
by a sort of all. The noise of a document comes from its id, so reruns agree; keys are told apart to a
millionth. k defaults to the number of documents whose log weight is not below a small tolerance:
those that are about as likely under the target's model.

Texts without n-grams (null, empty, white space) have no weight and no key, count for nothing and are
never kept, not even if k is larger than the number of the others. Rows that repeat an id have the same
noise; at the last place ties are all kept. Null labels are not learnt from; without good labels all
weights are 0. An empty table gives no rows. Of the input only the id and the text play a part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import Words, mix64, ready, slices, text_of, word_hash
from cairn.plans.shared import written

FIT_ROWS, BITS = 20_000, 13
#: Weight of all text in the target's model, as a share of the target's counts; log weight an n-gram that a kept document may lack.
PRIOR, TOLERANCE = 1.0, 0.02
#: Log weight an n-gram that counts as one unit of the noise.
TEMPERATURE = 0.004
_ODD = np.uint64(0x9E3779B97F4A7C15)


class Grams:
    """Buckets of the n-grams of texts: of words (by distinct word), trigrams (too) and pairs (by place)."""

    def __init__(self, text: pa.Array, bits: int = BITS):
        w = self.words = Words(text)
        mask = np.uint64((1 << bits) - 1)
        h = word_hash(w.distinct)
        self.word = (mix64(h) & mask).astype(np.int64)
        s = "\x02" + "\x03\x02".join(w.distinct.to_pylist()) + "\x03"
        p = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        of = np.cumsum(p == 2) - 1 if len(w.distinct) else np.zeros(0, np.int64)
        if len(w.distinct) and of[-1] != len(w.distinct) - 1:  # texts that hold the marks themselves
            lens = np.array([len(x) + 2 for x in w.distinct.to_pylist()])
            of = np.repeat(np.arange(len(lens)), lens)
        three = (p[:-2] * np.uint64(0x110000) + p[1:-1]) * np.uint64(0x110000) + p[2:]
        inside = (of[:-2] == of[2:]) if len(of) else np.zeros(0, bool)
        self.tri = (mix64(three[: len(inside)][inside] ^ np.uint64(1 << 63)) & mask).astype(np.int64)
        self.tri_word = of[:-2][inside] if len(of) else of
        hw, rows = h[w.codes], w.rows
        pair = mix64(mix64(hw[:-1] * _ODD) + hw[1:])
        pair[hw[:-1] == hw[1:]] = mix64(np.array([12345], np.uint64))
        ok = rows[:-1] == rows[1:]
        self.pair, self.pair_row = (pair[ok] & mask).astype(np.int64), rows[:-1][ok]

    def counts(self, weight: np.ndarray, size: int) -> np.ndarray:
        """Counts of all n-grams by bucket, rows weighted."""
        w = self.words
        times = np.bincount(w.codes, weight[w.rows], len(w.distinct)) if len(w.codes) else np.zeros(0)
        if not len(times):
            return np.zeros(size)
        return np.bincount(self.word, times, size) + np.bincount(self.tri, times[self.tri_word], size) + np.bincount(self.pair, weight[self.pair_row], size)

    def sums(self, table: np.ndarray, rows: int) -> np.ndarray:
        """Of each row, the sum of its n-grams' values."""
        w = self.words
        if not len(w.codes):
            return np.zeros(rows)
        each = table[self.word] + np.bincount(self.tri_word, table[self.tri], len(w.distinct))
        return np.bincount(w.rows, each[w.codes], rows) + np.bincount(self.pair_row, table[self.pair], rows)

    def sizes(self, rows: int) -> np.ndarray:
        """Of each row, the number of its n-grams."""
        w = self.words
        if not len(w.codes):
            return np.zeros(rows, np.int64)
        each = 1 + np.bincount(self.tri_word, minlength=len(w.distinct))
        return (np.bincount(w.rows, each[w.codes], rows) + np.bincount(self.pair_row, minlength=rows)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    every, good = np.zeros(1 << bits), np.zeros(1 << bits)
    for b in slices(batches):
        g = Grams(text_of(b.column("text")), bits)
        every += g.counts(np.ones(b.num_rows), 1 << bits)
        target = b.column("target").to_numpy(zero_copy_only=False).astype(float)
        if target.any():
            good += g.counts(target, 1 << bits)
    at = np.flatnonzero(every)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(every[at]), pa.array(good[at])], ["bucket", "every", "good"])


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", fit_rows: int = FIT_ROWS, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """The logarithm of the models' ratio for each of 2 ** bits buckets."""
    ready(docs.sparkSession)
    some = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).alias("_l")).where("_l = 1").select("_id").orderBy(F.xxhash64("_id"), "_id").limit(fit_rows)
    rows = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("text")).join(F.broadcast(some), F.col("_doc") == F.col("_id"), "left").select("text", F.col("_id").isNotNull().alias("target"))
    counts = rows.mapInArrow(partial(_count, bits=bits), "bucket long, every double, good double").groupBy("bucket").agg(F.sum("every").alias("every"), F.sum("good").alias("good")).toArrow()
    every, good = np.zeros(1 << bits), np.zeros(1 << bits)
    at = counts["bucket"].to_numpy()
    every[at], good[at] = counts["every"].to_numpy(), counts["good"].to_numpy()
    if not good.sum():
        return np.zeros(1 << bits)
    # the target's model is mixed with the other, so that what few labelled rows hold isn't held against a text
    p = (every + 0.5) / (every.sum() + 0.5 * len(every))
    return np.log((good / good.sum() + PRIOR * p) / (1 + PRIOR) / p)


def _weigh(batches: Iterator[pa.RecordBatch], table: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        g = Grams(text_of(b.column("text")), bits)
        n = g.sizes(b.num_rows)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(g.sums(table, b.num_rows) / np.maximum(n, 1), mask=n == 0), pa.array(n)], ["doc_id", "log_weight", "n_grams"])


def kth_largest(keys: DataFrame, k: int, bits: int = 12) -> int | None:
    """The k-th largest value of the long column ``key``, by histograms of at most 2 ** bits buckets."""
    if k < 1:
        return None
    low, left = None, k
    shift = 64 - bits
    while True:
        inside = keys if low is None else keys.where(F.shiftright("key", shift + bits) == low)
        for b, n in sorted(((r["b"], r["n"]) for r in inside.groupBy(F.shiftright("key", shift).alias("b")).agg(F.count("*").alias("n")).collect()), reverse=True):
            if left <= n:
                low = b
                break
            left -= n
        else:
            return None
        if shift == 0:
            return low
        bits = min(bits, shift)
        shift -= bits


def weigh(docs: DataFrame, table: np.ndarray, temperature: float = TEMPERATURE, seed: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, log_weight (an n-gram), n_grams and key (with the noise); weight and key are null without n-grams."""
    ready(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    bits = len(table).bit_length() - 1
    out = rows.mapInArrow(partial(_weigh, table=table, bits=bits), f"doc_id {kind}, log_weight double, n_grams long")
    u = (F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    return out.withColumn("key", F.col("log_weight") / temperature - F.log(-F.log(u)))


def resample(docs: DataFrame, table: np.ndarray, k: int | None = None, tolerance: float = TOLERANCE, temperature: float = TEMPERATURE, seed: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, log_weight, n_grams, key and kept: is the key among the ``k`` largest?"""
    rows = written(docs.sparkSession, weigh(docs, table, temperature, seed, id_col, text_col), "quality-keys")
    if k is None:
        k = rows.where(F.col("log_weight") >= -tolerance).count()
    micros = F.round(F.col("key") * 1e6).cast("long")
    weighed = rows.select(micros.alias("key")).where("key is not null")
    k = min(k, weighed.count())
    least = kth_largest(weighed, k)
    return rows.withColumn("kept", F.lit(False) if least is None else F.coalesce(micros >= least, F.lit(False)))
