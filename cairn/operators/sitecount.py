"""Numbers of mutation sites by kind and detail: a text is searched once by one pattern, and no site is built.

The sites are those of ``mutation.sites_of``. The pattern passes over comments and literals and finds tokens; what a
token stands for is looked up once for a batch. A text with what no pattern can tell (comments nested more than three
deep, raw strings with three marks or more) is left to ``mutation.sites_of``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cairn.operators import mutation as m
from cairn.plans.shared import ship_package

Details = tuple[tuple[str, str], ...]

# a block as code_mask has it: an opener inside is passed over whole; what isn't closed runs to the end
_BLOCK = r"/\*(?s:[^*/]++|/\*|(?!\*/).)*+(?:\*/)?"
_NESTED = r"/\*(?s:[^*/]++|(?!/\*|\*/).)*+\*/"
for _ in range(2):
    _NESTED = rf"/\*(?s:[^*/]++|{_NESTED}|(?!/\*|\*/).)*+\*/"
_QUOTED = r'"(?s:[^"\\]++|\\.)*+\\?"?'
_SINGLE = _QUOTED.replace('"', "'")
_LIFETIME = r"'(?:\\.[^'\n]{0,10}|[^'\\\n])'"
_RUST_RAW = r'(?<!\w)r(?:"[^"]*+"?|#"(?:[^"]++|"(?!#))*+(?:"#)?|##"(?:[^"]++|"(?!##))*+(?:"##)?)'
_RUST_LEFT = r'(?<!\w)r###+"'


@cache
def _text_pattern(language: str) -> re.Pattern:
    """Its group is a site, or what is left to the mask; it is empty where the match is no site."""
    x = m.LEXICONS[language]
    passed = [r"//[^\n]*+", _NESTED if x.nested else _BLOCK]
    passed += [_RUST_RAW] if x.counted_raw else []
    passed += [f"{r}(?s:(?!{r}).)*+(?:{r})?" for r in x.raw]
    passed += [_QUOTED, _LIFETIME if x.lifetimes else _SINGLE]
    left = [r"/\*"] * x.nested + [_RUST_LEFT] * x.counted_raw
    begins = "".join({r[0] for r in x.raw}) + "r" * x.counted_raw
    other = rf"[^&|<>=!+\-*/0-9\"'{begins}]*+"  # what begins neither
    return re.compile(f"{other}(?:{'|'.join(passed)}|({'|'.join([*left, m.OPERATOR, m.WHOLE + '+(?![.])'])})|{m.WHOLE}+|(?s:.)|\\Z)")


#: Blanks and comments go with the token after them. A comment that holds a quote is a token, as it counts for one.
_JS_BETWEEN = r"""(?:\s++|//[^\n"'`]*+(?![^\n])|/\*(?:[^*/"'`]++|/\*|(?!\*/)[^"'`])*+\*/)*+"""
_JS_ANY = re.sub(r"[(][?]P<[a-z]+>", "(?:", m.JS_TOKEN.pattern.partition("|(?P<word>")[0])
# a word that begins with a digit, as after a dot, is like a string: an operand, and no number
_JS_PATTERN = re.compile(rf"{_JS_BETWEEN}(?:`[^`]*+`?|{_QUOTED}|{_SINGLE}|(//[^\n]*+|{_BLOCK}|{_JS_ANY}|(?![0-9])[\w$]+|[^\s0-9])|[0-9][\w$]*+|\Z)")


class Classes:
    """Tokens' details, numbered: -1 for none, -2 for what is left to the mask. Different numbers share no detail."""

    def __init__(self):
        self.details: list[Details] = []
        self._number: dict[Details, int] = {}

    def number(self, details: Details | None) -> int:
        if not details:
            return -2 if details is None else -1
        if details not in self._number:
            self._number[details] = len(self.details)
            self.details.append(details)
        return self._number[details]


class _Known(dict):
    def __init__(self, of: Callable[[str], object]):
        self.of = of

    def __missing__(self, token: str) -> object:
        self[token] = x = self.of(token)
        return x


def _text_details(token: str) -> Details | None:
    if token in m.SWAPS:
        to, kind = m.SWAPS[token]
        return ((kind, f"{token} -> {to}"),)
    if token[:1].isdigit():
        n = m.whole(token)
        return () if n is None else (("const", f"{n} -> {m.other_whole(n)}"),)
    return None if token else ()


def _text_numbers(language: str, known: _Known) -> Callable[[str], Iterable[int]]:
    find = _text_pattern(language).findall
    return lambda source: map(known.__getitem__, find(source))


#: After a token: is an operand before the next one? Some leave it as it was.
_NO, _YES, _SAME = range(3)
_JS_NUMBER = re.compile(m.JS_TOKEN.pattern.partition("|(?P<other>")[0])
_JS_WORD = re.compile(r"[\w$]+")


def _js_token(token: str, classes: Classes) -> tuple[int, bool, int]:
    """(number, does it need an operand before, what comes after)."""
    if not token:
        return -1, False, _YES
    if token.startswith(("//", "/*")):
        return -1, False, _YES if any(q in token for q in "\"'`") else _SAME
    if _JS_NUMBER.fullmatch(token):
        return classes.number(tuple((k, f"{was} -> {to}") for k, was, to in m.js_consts(token))), False, _YES
    if _JS_WORD.fullmatch(token):
        return -1, False, _NO if token in m.JS_PREFIX else _YES
    after = _SAME if token in ("++", "--") else _YES if token in ")]}" else _NO
    return classes.number(tuple((k, f"{was} -> {to}") for k, was, to in m.js_swaps(token))), True, after


def _js_numbers(classes: Classes) -> Callable[[str], Iterable[int]]:
    known = _Known(lambda t: _js_token(t, classes))

    def numbers(source: str) -> list[int]:
        out, operand = [], _NO
        for token in _JS_PATTERN.findall(source):
            number, needs, after = known[token]
            if number >= 0 and (operand or not needs):
                out.append(number)
            if after != _SAME:
                operand = after
        return out

    return numbers


def _numbers(classes: Classes, languages: Iterable[str]) -> dict[str, Callable[[str], Iterable[int]]]:
    """By language, how a text yields its numbers; tokens mean the same in all that have a lexicon's sites."""
    known = _Known(lambda t: classes.number(_text_details(t)))
    return {x: _js_numbers(classes) if x == "javascript" else _text_numbers(x, known) for x in languages}


def site_counts(source: str, language: str) -> dict[tuple[str, str], int]:
    """A text's number of sites by (kind, detail)."""
    classes = Classes()
    return {d: n for c, n in _counted(source, language, classes, _numbers(classes, [language])[language]).items() for d in classes.details[c]}


def _counted(source: str, language: str, classes: Classes, numbers: Callable[[str], Iterable[int]]) -> dict[int, int]:
    counts = Counter(numbers(source))
    if -2 in counts:
        return Counter(classes.number(((s.kind, s.detail),)) for s in m.sites_of(source, language))
    counts.pop(-1, None)
    return counts


#: A slice of a batch ends after so many rows of counts.
SLICE = 100_000


def _run(batches: Iterator[pa.RecordBatch], languages: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        paths, texts = b.column("path"), b.column("source").to_pylist()
        classes = Classes()
        by_language = _numbers(classes, languages)
        for at, language in enumerate(languages):
            numbers = by_language[language]
            first, sizes, found, times = 0, [], [], []
            for i, text in enumerate(texts):
                count = _counted(text or "", language, classes, numbers)
                sizes.append(len(count))
                found += count
                times += count.values()
                if len(found) >= SLICE or i + 1 == len(texts):
                    yield _table(paths.slice(first, len(sizes)), at, classes, sizes, found, times)
                    first, sizes, found, times = i + 1, [], [], []


def _table(paths: pa.Array, language: int, classes: Classes, sizes: list[int], found: list[int], times: list[int]) -> pa.RecordBatch:
    number, row = np.array(found, np.int64), np.repeat(np.arange(len(sizes)), sizes)
    width = np.array([len(d) for d in classes.details], np.int64)[number] if found else number
    start = np.cumsum([0, *(len(d) for d in classes.details)])[:-1][number] if found else number
    within = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
    detail = pa.array(np.repeat(start, width) + within)
    flat = [d for ds in classes.details for d in ds]
    kinds, details = (pa.array([d[j] for d in flat], pa.string()).take(detail) for j in range(2))
    columns = [pa.array(np.full(len(detail), language, np.int32)), paths.take(pa.array(np.repeat(row, width))), kinds, details, pa.array(np.repeat(np.array(times, np.int64), width))]
    return pa.RecordBatch.from_arrays(columns, ["language", "path", "kind", "detail", "sites"])


def counts(sources: DataFrame, *languages: str) -> DataFrame:
    """(language, path, kind, detail, sites) of each (path, source) row as a text of each of the ``languages``; the
    language is its place among them. Rows are counted by themselves, whether or not they share a path."""
    ship_package(sources.sparkSession)
    return sources.select("path", "source").mapInArrow(partial(_run, languages=languages), "language int, path string, kind string, detail string, sites bigint")
