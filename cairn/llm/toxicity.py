"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence has a probability, logistic in the words it holds;
the document's is their noisy-or. Only documents are labelled: the gradient of a document's
likelihood falls on the sentences that best explain it, so the trained model also finds them.

The model is fitted on at most ``fit_rows`` labelled rows, those with the smallest hashes. Their words
are counted over all tasks: those that few documents hold, or that hold no more with the label than
without, are dropped, and of the others the ``vocabulary`` with the largest chi-squared stay (4096 by
default; the model tells by no other word). Sentences without any of them say nothing. So the one task
that fits reads, of each document however long, only which sentence holds which of these words.
Everything is scored.

Null and empty texts score 0. Rows labelled twice count with their largest label; null labels are not
learnt from. Without a positive label all score 0. Repeated rows are scored each; an empty table gives
no rows. Of the input only the id and the text play a part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import Words, ready, slices, text_of, word_hash
from cairn.plans.shared import written

#: Labelled rows to fit on; words to tell by; documents that must hold a word; least chi-squared.
FIT_ROWS, VOCABULARY, LEAST_DOCS, LEAST_CHI2 = 12_000, 4096, 4, 12.0
STEPS, RATE, RIDGE = 300, 0.1, 2e-3
ENDS = r"[.!?\x{2026}\x{3002}\x{ff01}\x{ff1f}][\"')\x{5d}\x{201d}\x{2019}]*$"
EDGES = ".,!?;:\"'()[]{}<>*_~`#$%&|/\\-+=…“”‘’«»¿¡。！？"


@dataclass
class Model:
    words: np.ndarray  # hashes, ascending
    weights: np.ndarray
    bias: float


class Sentences:
    """The sentences of texts: runs of words up to one that ends with a stop."""

    def __init__(self, text: pa.Array):
        w = Words(text)
        self.words = w
        bare = pc.utf8_trim(pc.utf8_lower(w.distinct), characters=EDGES)
        self.hashes = word_hash(bare)
        stops = pc.match_substring_regex(w.distinct, ENDS).to_numpy(zero_copy_only=False)[w.codes] if len(w.codes) else np.zeros(0, bool)
        first = np.zeros(len(w.codes), bool)
        first[1:] = stops[:-1]
        starts = w.offsets[:-1]
        first[starts[starts < w.offsets[1:]]] = True
        self.of_word = np.cumsum(first) - 1
        self.starts = np.flatnonzero(first)
        self.rows = w.rows[self.starts]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, df, positive): documents of a slice that hold a word, and those of them with the label."""
    for b in slices(batches):
        s = Sentences(text_of(b.column("text")))
        words, code = np.unique(s.hashes, return_inverse=True)
        if not len(words):
            continue
        pairs = np.unique(s.words.rows * len(words) + code[s.words.codes])
        label = b.column("label").to_numpy() == 1
        df, positive = np.bincount(pairs % len(words), minlength=len(words)), np.bincount((pairs % len(words))[label[pairs // len(words)]], minlength=len(words))
        yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(df), pa.array(positive)], ["word", "df", "positive"])


def _bags(batches: Iterator[pa.RecordBatch], known: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(label, sentences, features): of each row, which sentence holds which of the known words, each pair once."""
    for b in slices(batches):
        s = Sentences(text_of(b.column("text")))
        at = np.searchsorted(known, s.hashes)
        at[at == len(known)] = 0
        code = np.where(known[at] == s.hashes, at, -1)[s.words.codes] if len(s.words.codes) else np.zeros(0, np.int64)
        hit = np.flatnonzero(code >= 0)
        pair = np.unique(s.of_word[hit] * len(known) + code[hit])
        sent, feature = np.divmod(pair, len(known))
        off = np.searchsorted(s.rows[sent], np.arange(b.num_rows + 1))
        binary = lambda x: pa.array([x[a:z].astype(np.int32).tobytes() for a, z in zip(off, off[1:])], pa.binary())
        yield pa.RecordBatch.from_arrays([b.column("label"), binary(sent), binary(feature)], ["label", "sentences", "features"])


def fit(labels: np.ndarray, sentences: list[np.ndarray], features: list[np.ndarray], rate: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias from bags: labels 0 or 1, and of each document sentences' numbers and words', ascending;
    ``rate``: the share of documents with the label among those that hold a word, to begin with."""
    n = len(labels)
    doc = np.repeat(np.arange(n), [len(x) for x in features])
    sent = np.concatenate([np.zeros(0, np.int64), *(x.astype(np.int64) for x in sentences)])
    feature = np.concatenate([np.zeros(0, np.int64), *(x.astype(np.int64) for x in features)])
    first = np.ones(len(doc), bool)
    first[1:] = (doc[1:] != doc[:-1]) | (sent[1:] != sent[:-1])
    bag, s_doc = np.cumsum(first) - 1, doc[first]
    y = labels.astype(float)
    theta = np.concatenate([np.log(rate / (1 - rate)) + 1.0, [-1.0]])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        z = np.bincount(bag, theta[feature], len(s_doc)) + theta[-1]
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        none = np.exp(-np.bincount(s_doc, np.logaddexp(0, z), n))  # no sentence is toxic
        # of a positive document, a sentence's gradient is its share in the noisy-or; of a negative, p
        pull = np.where(y == 1, none / np.maximum(1 - none, 1e-6), -1.0)
        gz = pull[s_doc] * p
        g = np.concatenate([np.bincount(feature, gz[bag], len(rate)) / n - RIDGE * theta[:-1] / n, [gz.sum() / n]])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta + RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return theta[:-1], float(theta[-1])


def _fit(batches: Iterator[pa.RecordBatch], rate: np.ndarray) -> Iterator[pa.RecordBatch]:
    labels, sentences, features = [], [], []
    for b in batches:
        labels += b.column("label").to_pylist()
        sentences += [np.frombuffer(x.as_buffer(), np.int32) for x in b.column("sentences")]
        features += [np.frombuffer(x.as_buffer(), np.int32) for x in b.column("features")]
    weights, bias = fit(np.array(labels, np.int64), sentences, features, rate)
    yield pa.RecordBatch.from_arrays([pa.array([*range(len(weights)), -1], pa.int32()), pa.array([*weights.tolist(), bias], pa.float64())], ["at", "weight"])


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", fit_rows: int = FIT_ROWS, vocabulary: int = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model of at most ``vocabulary`` words, from at most ``fit_rows`` rows of ``labels`` (id and label) and their texts."""
    spark = docs.sparkSession
    ready(spark)
    once = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    some = once.orderBy(F.xxhash64("_id"), "_id").limit(fit_rows)
    rows = docs.select(F.col(f"`{id_col}`").alias("_doc"), F.col(f"`{text_col}`").alias("text")).join(F.broadcast(some), F.col("_doc") == F.col("_id"))
    rows = written(spark, rows.select("label", "text"), "toxic-labelled")
    n, positive = rows.agg(F.count("*"), F.sum("label")).first()
    if not n or not positive or positive == n:
        return Model(np.zeros(0, np.uint64), np.zeros(0), 0.0 if not n or not positive else 10.0)
    hope = F.col("df") * float(positive) / float(n)
    chi2 = (F.col("positive") - hope) ** 2 / hope + (F.col("positive") - hope) ** 2 / (F.col("df") - hope)
    counts = rows.mapInArrow(_counts, "word long, df long, positive long").groupBy("word").agg(F.sum("df").alias("df"), F.sum("positive").alias("positive"))
    told = counts.where((F.col("df") >= LEAST_DOCS) & (F.col("positive") > hope)).withColumn("chi2", chi2).where(F.col("chi2") >= LEAST_CHI2)
    told = told.orderBy(F.desc("chi2"), "word").limit(vocabulary).collect()
    if not told:
        return Model(np.zeros(0, np.uint64), np.zeros(0), 0.0)
    told = sorted((int(np.int64(r["word"]).view(np.uint64)), (r["positive"] + 0.1) / (r["df"] + 0.2)) for r in told)
    known, rate = np.array([w for w, _ in told], np.uint64), np.array([x for _, x in told])
    bags = rows.mapInArrow(partial(_bags, known=known), "label int, sentences binary, features binary")
    out = {r["at"]: r["weight"] for r in bags.repartition(1).mapInArrow(partial(_fit, rate=rate), "at int, weight double").collect()}  # a row a word
    return Model(known, np.array([out[i] for i in range(len(known))]), out[-1])


def sentence_scores(model: Model, s: Sentences) -> np.ndarray:
    """The log-odds of each sentence; -inf where it holds no known word."""
    n = len(s.starts)
    if not len(model.words) or not n:
        return np.full(n, -np.inf)
    at = np.searchsorted(model.words, s.hashes)
    at[at == len(model.words)] = 0
    known = model.words[at] == s.hashes
    code = np.where(known, at, -1)[s.words.codes]
    hit = np.flatnonzero(code >= 0)
    pair = np.unique(s.of_word[hit] * len(model.words) + code[hit])
    z = np.bincount(pair // len(model.words), model.weights[pair % len(model.words)], n) + model.bias
    return np.where(np.bincount(pair // len(model.words), minlength=n) > 0, z, -np.inf)


def _score(batches: Iterator[pa.RecordBatch], model: Model, locate: bool) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        s = Sentences(text_of(b.column("text")))
        z = sentence_scores(model, s)
        score = -np.expm1(-np.bincount(s.rows, np.logaddexp(0, z), b.num_rows))
        out = [b.column("doc_id"), pa.array(score + 0.0)]
        if locate:
            bad = np.flatnonzero(z >= 0)
            ends = np.concatenate([s.starts[1:], [len(s.words.codes)]])
            text = [" ".join(s.words.distinct.take(pa.array(s.words.codes[s.starts[i] : ends[i]])).to_pylist()) for i in bad]
            out.append(pa.ListArray.from_arrays(pa.array(np.searchsorted(s.rows[bad], np.arange(b.num_rows + 1)).astype(np.int32)), pa.array(text, pa.string())))
        yield pa.RecordBatch.from_arrays(out, ["doc_id", "score", "sentences"][: len(out)])


def score(docs: DataFrame, model: Model, locate: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score and, with ``locate``, the offending sentences (their words, with single spaces)."""
    ready(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(partial(_score, model=model, locate=locate), f"doc_id {kind}, score double" + ", sentences array<string>" * locate)
