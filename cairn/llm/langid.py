"""Language identification by spans.

Words are cut into runs of one script, as in ``Hello\u4e2d\u6587``; runs of scripts that are written without
spaces are cut again after every eight letters, so that a language may change inside them. Counts of
hashed character bigrams and trigrams of runs, and of scripts, over all labelled documents give a model
for each language. Every distinct word of a batch is scored once: the scripts' ranges of code points
leave the languages that use the run's script, others are ruled out; n-grams score the rest. Viterbi
with a penalty for switching then labels the runs of each text with languages, in spans, over all texts
of a batch at once. A text's language is the one with the most letters in its spans.

A null text and one without any letter are ``und`` with score 0. Runs without letters, or of a
script that no language was seen with, say nothing; a text of only such runs gets the language with
the most labelled documents (empty ones count), of equals the first by name. Repeated rows are labelled
each; labels that are null are not learnt from. Without any label all texts are ``und``. An empty table
gives no rows. Other columns of the input play no part; ``keep_known`` keeps them, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import Words, mix64, ready, slices, text_of

#: Log-likelihood that a switch of language costs, and most that one word can say against a language.
SWITCH, WORST = 14.0, 12.0
BITS = 15
#: Letters of a piece of a run in a script without spaces.
CHUNK = 8
#: First and last code points of scripts.
SCRIPTS = {
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0x2AF), (0x1E00, 0x1EFF), (0xFB00, 0xFB06), (0xFF21, 0xFF3A), (0xFF41, 0xFF5A)],
    "greek": [(0x370, 0x373), (0x376, 0x37D), (0x386, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "armenian": [(0x531, 0x58A)],
    "hebrew": [(0x5D0, 0x5F2), (0xFB1D, 0xFB4F)],
    "arabic": [(0x620, 0x64A), (0x66E, 0x6D3), (0x6FA, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8C9), (0xFB50, 0xFDFB), (0xFE70, 0xFEFC)],
    "indic": [(0x904, 0xDFF)],
    "thai": [(0xE01, 0xE30), (0xE32, 0xE46), (0xE80, 0xEDF)],
    "georgian": [(0x10A0, 0x10FF)],
    "hangul": [(0x1100, 0x11FF), (0x3131, 0x318E), (0xAC00, 0xD7A3)],
    "kana": [(0x3041, 0x30FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)],
    "other": [],
}
_NAMES = list(SCRIPTS)
_UNSPACED = np.array([n in ("thai", "kana", "han") for n in _NAMES])
_RANGES = sorted((lo, hi, k) for k, n in enumerate(_NAMES) for lo, hi in SCRIPTS[n])
_LO, _HI, _K = (np.array(x) for x in zip(*_RANGES))


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # log-likelihoods by bucket and language
    scripts: np.ndarray  # may a language use a script?
    usual: int


def _points(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The code points of words in lower case, each between 2 and 3, and the words' offsets into them."""
    lower = pc.utf8_lower(words)
    lens = pc.utf8_length(lower).to_numpy(zero_copy_only=False).astype(np.int64) + 2
    s = "\x02" + "\x03\x02".join(lower.to_pylist()) + "\x03"
    return np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32), np.concatenate([[0], np.cumsum(lens)])


def _kinds(points: np.ndarray) -> np.ndarray:
    """The script of each code point; -1 of those that are no letters."""
    at = np.searchsorted(_LO, points, side="right") - 1
    inside = (at >= 0) & (points <= _HI[at])
    kinds = np.where(inside, _K[at], -1).astype(np.int8)
    rest = np.flatnonzero(~inside & (points > 0x2AF))
    if len(rest):
        odd, back = np.unique(points[rest], return_inverse=True)
        letter = np.array([chr(p).isalpha() for p in odd.tolist()], bool)
        kinds[rest[letter[back]]] = len(_NAMES) - 1
    return kinds


class Runs:
    """The runs of one script in the words of a column of texts.

    ``codes[offsets[i]:offsets[i + 1]]`` are row i's runs as indices of distinct ones, which are given by ``points``
    and ``ends`` (code points, each run between 2 and 3), ``script`` and ``letters``. ``word`` is each run's word, numbered
    over all rows; ``first`` and ``size`` are a distinct run's first code point in its word and number of code points.
    """

    def __init__(self, text: pa.Array):
        w = Words(text)
        n = len(w.distinct)
        points, ends = _points(w.distinct) if n else (np.zeros(0, np.uint32), np.zeros(1, np.int64))
        kinds = _kinds(points)
        letter = np.flatnonzero(kinds >= 0)
        lk, lw = kinds[letter], np.searchsorted(ends, letter, side="right") - 1
        opens = np.ones(len(letter), bool)
        opens[1:] = lw[1:] != lw[:-1]
        new = opens.copy()
        new[1:] |= lk[1:] != lk[:-1]
        at = np.arange(len(letter))
        new |= _UNSPACED[lk] & ((at - np.maximum.accumulate(np.where(new, at, 0))) % CHUNK == 0)
        cut = letter[new & ~opens]
        begin = np.sort(np.concatenate([ends[:-1] + 1, cut]))  # a word's first run begins with the word
        of = np.searchsorted(ends, begin, side="right") - 1
        self.first = begin - ends[of] - 1
        until = np.append(begin[1:], 0)
        last = np.ones(len(begin), bool)
        last[:-1] = of[1:] != of[:-1]
        until[last] = ends[of[last] + 1] - 1
        self.size = until - begin
        if len(cut):
            new_ends = np.concatenate([[0], np.cumsum(self.size + 2)])
            runs = np.full(new_ends[-1], 2, np.uint32)
            runs[new_ends[1:] - 1] = 3
            from_ = np.repeat(begin - new_ends[:-1] - 1, self.size)
            to = np.arange(len(from_)) + np.repeat(2 * np.arange(len(begin)) + 1, self.size)
            runs[to] = points[to + from_]
            kinds = np.where(runs > 3, _kinds(runs), -1) if len(runs) else kinds
            points, ends = runs, new_ends
            letter = np.flatnonzero(kinds >= 0)
        self.points, self.ends = points, ends
        first = np.searchsorted(letter, ends[:-1])
        self.letters = np.searchsorted(letter, ends[1:]) - first
        self.script = np.full(len(ends) - 1, -1, np.int8)
        has = self.letters > 0
        self.script[has] = kinds[letter[first[has]]]
        first_run = np.searchsorted(of, np.arange(n))
        each = np.diff(np.append(first_run, len(of)))[w.codes] if len(w.codes) else np.zeros(0, np.int64)
        upto = np.cumsum(each)
        total = int(upto[-1]) if len(upto) else 0
        self.codes = np.repeat(first_run[w.codes] - (upto - each), each) + np.arange(total) if total else np.zeros(0, np.int64)
        self.word = np.repeat(np.arange(len(w.codes)), each)
        self.offsets = np.concatenate([[0], upto])[w.offsets]
        self.word_offsets = w.offsets

    @property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))


def _word_places(text: pa.Array) -> np.ndarray:
    """Of each word of the texts, the code points of its text before it."""
    text = pc.fill_null(text, "")
    p = np.frombuffer("".join(text.to_pylist()).encode("utf-32-le"), np.uint32)
    starts = np.concatenate([[0], np.cumsum(pc.utf8_length(text).to_numpy(zero_copy_only=False))]).astype(np.int64)
    solid = ~((p == 32) | ((p >= 9) & (p <= 13)))
    new = solid.copy()
    new[1:] &= ~solid[:-1]
    heads = starts[:-1][starts[:-1] < starts[1:]]
    new[heads] = solid[heads]
    at = np.flatnonzero(new)
    return at - starts[np.searchsorted(starts, at, side="right") - 1]


def _grams(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words' bigrams and trigrams, and the word of each."""
    p = points.astype(np.uint64)
    two = p[:-1] * np.uint64(0x110000) + p[1:]
    word = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    ok2 = word[:-1] == word[1:]
    three = two[:-1] * np.uint64(0x110000) + p[2:]
    ok3 = ok2[:-1] & ok2[1:]
    mask = np.uint64((1 << BITS) - 1)
    return np.concatenate([mix64(two[ok2]) & mask, mix64(three[ok3] ^ np.uint64(1 << 62)) & mask]).astype(np.int64), np.concatenate([word[:-1][ok2], word[:-2][ok3]])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, bucket, n): n-grams from bucket 0, scripts from -1 down, documents at -1000."""
    sums: dict[str, np.ndarray] = {}
    scripts: dict[str, np.ndarray] = {}
    docs: dict[str, int] = {}
    for b in slices(batches):
        w = Runs(text_of(b.column("text")))
        n = len(w.script)
        bucket, word = _grams(w.points, w.ends) if n else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        langs = b.column("lang").dictionary_encode()
        row_lang = langs.indices.to_numpy(zero_copy_only=False)
        of_word = row_lang[w.rows]
        for k, lang in enumerate(langs.dictionary.to_pylist()):
            times = np.bincount(w.codes[of_word == k], minlength=n).astype(float)
            sums[lang] = sums.get(lang, 0) + np.bincount(bucket, times[word] * (w.script[word] >= 0), 1 << BITS)
            scripts[lang] = scripts.get(lang, 0) + np.bincount(w.script + 1, times, len(_NAMES) + 1)
            docs[lang] = docs.get(lang, 0) + int((row_lang == k).sum())
    for lang, x in sums.items():
        at, sc = np.flatnonzero(x), scripts[lang][1:]
        where = np.concatenate([at, -1 - np.arange(len(sc)), [-1000]])
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(where)), pa.array(where), pa.array(np.concatenate([x[at], sc, [docs[lang]]]))], ["lang", "bucket", "n"])


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model from all documents whose language is known; one table of 2 ** BITS buckets a language."""
    ready(docs.sparkSession)
    rows = docs.where(F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    counts = rows.mapInArrow(_count, "lang string, bucket long, n double").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(counts["lang"].to_pylist()))
    at = np.array([langs.index(x) for x in counts["lang"].to_pylist()], np.int64) if langs else np.zeros(0, np.int64)
    bucket, n = counts["bucket"].to_numpy(), counts["n"].to_numpy()
    grams, scripts, total = np.zeros((1 << BITS, len(langs))), np.zeros((len(_NAMES), len(langs))), np.zeros(len(langs))
    g, s, d = bucket >= 0, (bucket < 0) & (bucket > -1000), bucket == -1000
    grams[bucket[g], at[g]] = n[g]
    scripts[-1 - bucket[s], at[s]] = n[s]
    total[at[d]] = n[d]
    table = np.log((grams + 0.5) / (grams.sum(0) + 0.5 * (1 << BITS))).astype(np.float32)
    return Model(langs, table, scripts >= 0.002 * np.maximum(scripts.sum(0), 1), int(total.argmax()) if langs else -1)


def run_scores(model: Model, w: Runs) -> tuple[np.ndarray, np.ndarray]:
    """Of each distinct run: log-likelihoods by language below the best one's, and whether it says anything."""
    bucket, word = _grams(w.points, w.ends)
    n, k = len(w.script), len(model.langs)
    score = np.stack([np.bincount(word, model.table[bucket, j], n) for j in range(k)], 1)
    allowed = np.vstack([model.scripts, np.zeros((1, k), bool)])[w.script]
    speaks = allowed.any(1)
    score = np.where(allowed, score, -np.inf)
    score[~speaks] = 0
    score = np.maximum(score - score.max(1, keepdims=True), np.where(allowed | ~speaks[:, None], -WORST, -2 * WORST))
    return score, speaks


def viterbi(score: np.ndarray, offsets: np.ndarray, switch: float) -> np.ndarray:
    """The language of each run: the best path of each row, all rows at once, one run a step."""
    lens = np.diff(offsets)
    order = np.argsort(-lens, kind="stable")
    start, lens = offsets[:-1][order], lens[order]
    active = len(lens) - np.searchsorted(lens[::-1], np.arange(1, (lens[0] if len(lens) else 0) + 1), side="left")
    best_from = np.zeros(len(score), np.int32)
    stays = np.ones(score.shape, bool)
    state = np.zeros((len(lens), score.shape[1]))
    for t, n in enumerate(active.tolist()):
        at = start[:n] + t
        if t:
            s = state[:n]
            top = s.argmax(1)
            jump = s[np.arange(n), top] - switch
            stay = s >= jump[:, None]
            best_from[at], stays[at] = top, stay
            state[:n] = np.where(stay, s, jump[:, None])
        state[:n] += score[at]
    out = np.zeros(len(score), np.int32)
    lang = state.argmax(1)
    for t in range(len(active) - 1, -1, -1):
        n = active[t]
        at = start[:n] + t
        out[at] = lang[:n]
        if t:
            lang[:n] = np.where(stays[at, lang[:n]], lang[:n], best_from[at])
    return out


def label(model: Model, w: Runs, switch: float = SWITCH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of rows: language (-1: und), score, and the share of letters in runs that any language may hold; of runs: language."""
    n, k = len(w.offsets) - 1, len(model.langs)
    if not k or not len(w.script):
        return np.full(n, -1), np.zeros(n), np.zeros(n), np.full(len(w.codes), -1)
    score, speaks = run_scores(model, w)
    lang = viterbi(score[w.codes], w.offsets, switch)
    of_run, rows = w.letters[w.codes], w.rows
    heard = np.where(speaks[w.codes], of_run, 0)
    by_lang = np.bincount(rows * k + lang, heard, n * k).reshape(n, k)
    every = np.bincount(rows, of_run, n)
    silent = (by_lang.sum(1) == 0) & (every > 0)
    best = np.where(every == 0, -1, np.where(silent, model.usual, by_lang.argmax(1)))
    share, known = by_lang.max(1) / np.maximum(every, 1), by_lang.sum(1) / np.maximum(every, 1)
    return best, np.where(best < 0, 0.0, share), known, lang


def _predict(batches: Iterator[pa.RecordBatch], model: Model, switch: float, spans: bool) -> Iterator[pa.RecordBatch]:
    names = np.array([*model.langs, "und"], object)
    for b in slices(batches):
        text = text_of(b.column("text"))
        w = Runs(text)
        best, score, _, lang = label(model, w, switch)
        out = [b.column("doc_id"), pa.array(names[best], pa.string()), pa.array(score)]
        if spans:
            new = np.ones(len(lang), bool)
            new[1:] = (lang[1:] != lang[:-1]) | (w.rows[1:] != w.rows[:-1])
            at = np.flatnonzero(new)
            last = np.append(at[1:], len(lang))[: len(at)] - 1
            base = w.word_offsets[w.rows[at]]
            places = _word_places(text)
            begin, end = places[w.word[at]] + w.first[w.codes[at]], places[w.word[last]] + w.first[w.codes[last]] + w.size[w.codes[last]]
            items = pa.StructArray.from_arrays([*(pa.array(x.astype(np.int32)) for x in (w.word[at] - base, w.word[last] + 1 - base, begin, end)), pa.array(names[lang[at]], pa.string())], ["start", "end", "from_char", "to_char", "lang"])
            out.append(pa.ListArray.from_arrays(pa.array(np.searchsorted(at, w.offsets).astype(np.int32)), items))
        yield pa.RecordBatch.from_arrays(out, ["doc_id", "lang_pred", "score", "spans"][: len(out)])


def predict(docs: DataFrame, model: Model, switch: float = SWITCH, spans: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (the share of the letters in spans of that language) and spans:
    array of (start, end, from_char, to_char, lang), from word ``start`` up to word ``end`` and from code point
    ``from_char`` up to ``to_char``; a span may begin or end inside a word."""
    ready(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, lang_pred string, score double" + ", spans array<struct<start:int,end:int,from_char:int,to_char:int,lang:string>>" * spans
    model_ = docs.sparkSession.sparkContext.broadcast(model)  # 2 ** BITS numbers a language
    return rows.mapInArrow(lambda it: _predict(it, model_.value, switch, spans), schema)


def _keep(batches: Iterator[pa.RecordBatch], text_col: str, model: Model, switch: float, least: float) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, text_col):
        best, _, known, _ = label(model, Runs(text_of(b.column(text_col))), switch)
        yield b.filter(pa.array((best >= 0) & (known >= least)))


def keep_known(docs: DataFrame, model: Model, least: float = 0.5, switch: float = SWITCH, text_col: str = "text") -> DataFrame:
    """The documents with ``least`` of their letters in spans of known languages, one or several, with their own columns."""
    ready(docs.sparkSession)
    model_ = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(lambda it: _keep(it, text_col, model_.value, switch, least), docs.schema)
