"""Mutation sites of source texts: one Arrow stage from texts to rows, by a language's lexicon or by Python's own parser."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterable, Iterator
from functools import partial
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.text import splice
from cairn.plans.shared import ship_package


class Lexicon(NamedTuple):
    """What of a text is no code: comments (nested or not), raw strings, strings and characters."""

    nested: bool = False
    raw: tuple[str, ...] = ()
    counted_raw: bool = False
    lifetimes: bool = False


LEXICONS = {"rust": Lexicon(nested=True, counted_raw=True, lifetimes=True), "java": Lexicon(), "kotlin": Lexicon(nested=True, raw=('"""',)), "go": Lexicon(raw=("`",)), "javascript": Lexicon(raw=("`",))}
SWAPS = {"&&": ("||", "bool"), "||": ("&&", "bool"), "<=": (">", "cmp"), ">=": ("<", "cmp"), "==": ("!=", "cmp"), "!=": ("==", "cmp"), "<": (">=", "cmp"), ">": ("<=", "cmp"), "+": ("-", "bin"), "-": ("+", "bin"), "*": ("/", "bin"), "/": ("*", "bin")}
OPERATOR = (
    r"&&|\|\||<=|(?<![<>=!])>=|(?<![=!<>])==|!="  # two characters go before one
    r"|(?<![<:])<(?![<=])|(?<![>\-=])>(?![>=])|\+|-(?!>)|(?<!/)\*(?!/)|(?<![*/])/(?![*/])"
)
WHOLE = r"(?<![A-Za-z0-9_.\x80-\U0010ffff])[0-9][0-9_]*"
_SITE = re.compile(f"{OPERATOR}|{WHOLE}")


def code_mask(source: str, lexicon: Lexicon) -> bytearray:
    """1 for each character that is code, 0 in comments and literals; what isn't closed runs to the end."""
    mask = bytearray(b"\x01") * len(source)
    i, n = 0, len(source)
    while i < n:
        c, end = source[i], 0
        if source.startswith("//", i):
            end = _until(source, "\n", i, 0)
        elif source.startswith("/*", i):
            end = _block(source, i, lexicon.nested)
        elif lexicon.counted_raw and c == "r" and (m := re.compile(r'r(#*)"').match(source, i)) and not (i and (source[i - 1].isalnum() or source[i - 1] == "_")):
            end = _until(source, '"' + m[1], m.end(), 1 + len(m[1]))
        elif mark := next((r for r in lexicon.raw if source.startswith(r, i)), None):
            end = _until(source, mark, i + len(mark), len(mark))
        elif c == '"' or c == "'" and not lexicon.lifetimes:
            end = _quoted(source, i)
        elif c == "'" and (m := re.compile(r"'(\\.[^'\n]{0,10}|[^'\\\n])'").match(source, i)):
            end = m.end()
        if end:
            mask[i:end] = bytes(end - i)
            i = end
        else:
            i += 1
    return mask


def _until(s: str, mark: str, start: int, keep: int) -> int:
    at = s.find(mark, start)
    return len(s) if at < 0 else at + keep


def _block(s: str, i: int, nested: bool) -> int:
    depth = 0
    for m in re.compile(r"/\*|\*/").finditer(s, i):
        if m[0] == "/*":
            depth += 1 if nested or not depth else 0
        else:
            depth -= 1
            if depth <= 0:
                return m.end()
    return len(s)


def _quoted(s: str, i: int) -> int:
    q, i = s[i], i + 1
    while i < len(s) and s[i] != q:
        i += 2 if s[i] == "\\" else 1
    return min(i + 1, len(s))


class Site(NamedTuple):
    line: int
    start: int
    end: int
    replacement: str
    kind: str
    detail: str


def text_sites(source: str, language: str) -> list[Site]:
    """Operators and whole numbers in code, in order: swaps, 0 and 1 for each other, others one up."""
    mask, out, at, line, counted = code_mask(source, LEXICONS[language]), [], 0, 1, 0
    while m := _SITE.search(source, at):
        at = m.end()
        if not mask[m.start()]:
            at = m.start() + 1
            continue
        line += source.count("\n", counted, m.start())
        counted = m.start()
        if m[0] in SWAPS:
            to, kind = SWAPS[m[0]]
            out.append(Site(line, m.start(), m.end(), to, kind, f"{m[0]} -> {to}"))
        elif source[m.end() : m.end() + 1] != "." and (n := whole(m[0])) is not None:
            to = other_whole(n)
            out.append(Site(line, m.start(), m.end(), to, "const", f"{n} -> {to}"))
    return out


def whole(digits: str) -> int | None:
    """The number; None beyond 64 bits."""
    digits = digits.replace("_", "").lstrip("0") or "0"
    return n if len(digits) <= 20 and (n := int(digits)) < 1 << 64 else None


def other_whole(n: int) -> str:
    return str({0: 1, 1: 0}.get(n, n + 1))


def _pairs(names: str) -> dict[type, type]:
    """Node types by name, each standing for the other; ``a>b`` holds one way."""
    out = {}
    for a, mark, b in (re.match(r"(\w+)([=>])(\w+)", p).groups() for p in names.split()):
        out[getattr(ast, a)] = getattr(ast, b)
        if mark == "=":
            out[getattr(ast, b)] = getattr(ast, a)
    return out


#: Comparisons move their bound, or, where that may change nothing, turn round.
_CMP = (_pairs("Lt=LtE Gt=GtE Eq=NotEq Is=IsNot In=NotIn"), _pairs("Lt=Gt LtE=GtE"))
_BIN = _pairs("Add=Sub Mult=FloorDiv Div>Mult Mod>FloorDiv Pow>Mult BitAnd=BitOr LShift=RShift")
_BOOL = _pairs("And=Or")
_KEPT = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.Global, ast.Nonlocal, ast.Pass, ast.Import, ast.ImportFrom)
_OF_SITES = frozenset((ast.Compare, ast.BinOp, ast.AugAssign, ast.BoolOp, ast.Constant))
Spans = list[tuple[int, int]] | None


def _within(line: int, spans: Spans) -> bool:
    return spans is None or any(lo <= line <= hi for lo, hi in spans)


def _other_values(v: object) -> list[object]:
    if isinstance(v, bool):
        return [not v]
    if isinstance(v, int):
        return [v + 1, 0] if v else [1]
    if isinstance(v, float):
        return [v * 1.0001 + 1e-9]
    return [v + "§"] if isinstance(v, str) else []


class PythonSite(NamedTuple):
    line: int
    kind: str
    detail: str
    owner: object  # a node, or a list of nodes
    at: str | int  # the node's field, or the place in the list
    new: object


def python_sites_of(tree: ast.AST, delete: bool = True, spans: Spans = None) -> list[PythonSite]:
    """The sites on the lines of ``spans`` (all, if None), by line and kind, then as met; leading texts of blocks are left alone."""
    docs: set[int] = set()
    out: list[PythonSite] = []

    def swap(node: ast.AST, kind: str, owner: object, at: str | int, was: ast.AST, to: type | None) -> None:
        if to is not None:
            out.append(PythonSite(node.lineno, kind, f"{type(was).__name__} -> {to.__name__}", owner, at, to()))

    todo = [tree]
    for node in todo:  # which grows, level by level as ast.walk; a block's owner is met before the block
        kind = type(node)
        for field in kind._fields:
            value = getattr(node, field, None)
            if isinstance(value, list):
                if field == "body" and value and isinstance(value[0], ast.Expr) and isinstance(value[0].value, ast.Constant) and isinstance(value[0].value.value, str):
                    docs |= {id(value[0]), id(value[0].value)}
                for i, s in enumerate(value):
                    if isinstance(s, ast.AST):
                        if s._fields:  # operators and the like have none
                            todo.append(s)
                        if delete and isinstance(s, ast.stmt) and not isinstance(s, _KEPT) and id(s) not in docs and _within(s.lineno, spans):
                            out.append(PythonSite(s.lineno, "delete", "statement -> pass", value, i, ast.Pass()))
            elif isinstance(value, ast.AST) and value._fields:
                todo.append(value)
        if kind not in _OF_SITES or not _within(node.lineno, spans):
            continue
        if kind is ast.Compare:
            for i, o in enumerate(node.ops):
                for table in _CMP:
                    swap(node, "cmp", node.ops, i, o, table.get(type(o)))
        elif kind is ast.BoolOp:
            swap(node, "bool", node, "op", node.op, _BOOL[type(node.op)])
        elif kind is not ast.Constant:
            swap(node, "bin" if kind is ast.BinOp else "aug", node, "op", node.op, _BIN.get(type(node.op)))
        elif id(node) not in docs:
            out += [PythonSite(node.lineno, "const", f"{node.value!r} -> {v!r}", node, "value", v) for v in _other_values(node.value)]
    return sorted(out, key=lambda s: (s.line, s.kind))


def python_mutants(source: str, delete: bool = True, spans: Spans = None, limit: int | None = None, texts: bool = True) -> tuple[int, list[tuple[int, str, str, str | None]]]:
    """The number of all sites, and (line, kind, detail, mutated source) of the first ``limit``; without ``texts`` no source
    is written. A text that doesn't parse has none."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return 0, []
    sites = python_sites_of(tree, delete, spans)
    if not texts:
        return len(sites), [(s.line, s.kind, s.detail, None) for s in sites[:limit]]
    out = []
    for s in sites[:limit]:
        get, put = (s.owner.__getitem__, s.owner.__setitem__) if isinstance(s.owner, list) else (partial(getattr, s.owner), partial(setattr, s.owner))
        old = get(s.at)
        put(s.at, s.new)
        try:
            out.append((s.line, s.kind, s.detail, ast.unparse(tree)))
        finally:
            put(s.at, old)
    return len(sites), out


_JS_CMP = {"<": ("<=", ">"), "<=": ("<", ">="), ">": (">=", "<"), ">=": (">", "<="), "==": ("!=",), "!=": ("==",), "===": ("!==",), "!==": ("===",)}
_JS_BIN = {"+": "-", "-": "+", "*": "/", "/": "*", "%": "*"}
_JS_BOOL = {"&&": "||", "||": "&&"}
JS_TOKEN = re.compile(
    r"(?P<number>(?<![\w$.])(?:0[xX][0-9a-fA-F_]+|0[oO][0-7_]+|0[bB][01_]+|(?:[0-9][0-9_]*(?:\.[0-9_]*)?|\.[0-9][0-9_]*)(?:[eE][+-]?[0-9]+)?)(?![\w$]))"
    r"|(?P<other>=>|>>>=|>>=|<<=|\*\*=|&&=|\|\|=|\?\?=|>>>|>>|<<|\*\*|\+\+|--|\+=|-=|\*=|/=|%=)"
    r"|(?P<op>===|!==|==|!=|<=|>=|&&|\|\||[<>+\-*/%])"
    r"|(?P<word>[\w$]+)|(?P<rest>\S)"
)
#: Words before which an operator has a left operand's place empty.
JS_PREFIX = frozenset("return typeof case in of delete void throw new instanceof do else yield await".split())


def _js_number(text: str) -> float:
    """Infinite if it is too large or has no digits."""
    t = text.replace("_", "")
    try:
        return float(int(t, 0)) if t[:2].lower() in ("0x", "0o", "0b") else float(t)
    except (OverflowError, ValueError):
        return float("inf")


def _js_text(v: float) -> str:
    return str(int(v)) if v == int(v) and abs(v) < 1e15 else repr(v)


def js_consts(number: str) -> list[tuple[str, str, str]]:
    """(kind, was, to) of a number's sites."""
    v = _js_number(number)
    return [("const", _js_text(v), t) for t in ([_js_text(v + 1)] + ["0"] * (v == 1))] if v < 1e300 else []


def js_swaps(op: str) -> list[tuple[str, str, str]]:
    """(kind, was, to) of an operator's sites."""
    return [("cmp", op, t) for t in _JS_CMP.get(op, ())] + [("bin", op, t) for t in (_JS_BIN.get(op),) if t] + [("bool", op, t) for t in (_JS_BOOL.get(op),) if t]


def javascript_sites(source: str) -> list[Site]:
    """Operators between two operands and numbers, by line, kind and detail. By tokens: there is no parser, so expression
    statements aren't deleted, and signs in type parameters or markup may count as comparisons."""
    mask, out, line, counted, operand = code_mask(source, LEXICONS["javascript"]), [], 1, 0, False
    at = 0
    while m := JS_TOKEN.search(source, at):
        at = m.end()
        if not mask[m.start()]:
            operand = operand or source[m.start()] in "\"'`"
            at = m.start() + 1
            continue
        line += source.count("\n", counted, m.start())
        counted = m.start()
        found: list[tuple[str, str, str]] = []
        if m["number"] is not None:
            found = js_consts(m[0])
        elif m["op"] is not None and operand:
            found = js_swaps(m[0])
        out += [Site(line, m.start(), m.end(), to, kind, f"{was} -> {to}") for kind, was, to in found]
        operand = m["number"] is not None or (m["word"] is not None and m[0] not in JS_PREFIX) or m[0] in ")]}" or (m[0] in ("++", "--") and operand)
    return sorted(out, key=lambda s: (s.line, s.kind, s.detail))


def sites_of(source: str, language: str) -> list[Site]:
    return javascript_sites(source) if language == "javascript" else text_sites(source, language)


def _spans(b: pa.RecordBatch) -> list[Spans]:
    """Each row's spans: all lines where the table has no such column or it is null."""
    if "spans" not in b.schema.names:
        return [None] * b.num_rows
    return [None if x is None else [(s["lo"], s["hi"]) for s in x] for x in b.column("spans").to_pylist()]


def _rows(b: pa.RecordBatch) -> Iterator[tuple[str, str, Spans]]:
    return zip(b.column("path").to_pylist(), b.column("source").to_pylist(), _spans(b))


def _columns(sources: DataFrame) -> DataFrame:
    spans = [F.col("spans").cast("array<struct<lo:int,hi:int>>").alias("spans")] if "spans" in sources.columns else []
    return sources.select("path", "source", *spans)


#: A slice of a batch's rows is sent on after so many rows, or so many characters of theirs.
SLICE, SLICE_CHARS = 20_000, 1 << 23


def _sliced(rows_of_texts: Iterable[list[tuple]], fields: list[tuple[str, pa.DataType]], drop: tuple[str, ...] = ()) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of bounded size, however many a batch of texts has."""
    long = [i for i, (_, t) in enumerate(fields) if t == pa.string()]
    kept = [i for i, (c, _) in enumerate(fields) if c not in drop]
    rows: list[tuple] = []
    chars = 0

    def table() -> pa.RecordBatch:
        cols = list(zip(*rows)) or [()] * len(fields)
        return pa.RecordBatch.from_arrays([pa.array(cols[i], fields[i][1]) for i in kept], [fields[i][0] for i in kept])

    for some in rows_of_texts:
        for at in range(0, len(some), SLICE):
            part = some[at : at + SLICE]
            rows += part
            chars += sum(len(r[i] or "") for r in part for i in long)
            if len(rows) >= SLICE or chars >= SLICE_CHARS:
                yield table()
                rows, chars = [], 0
    if rows:
        yield table()


def _sites(batches: Iterator[pa.RecordBatch], language: str) -> Iterator[pa.RecordBatch]:
    fields = list(zip(["path", *Site._fields], [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()]))
    for b in batches:
        paths, sources, spans = b.column("path"), b.column("source"), _spans(b)
        texts = ((paths[i].as_py(), sources[i].as_py(), spans[i]) for i in range(b.num_rows))  # one text at a time
        yield from _sliced(([(p, *s) for s in sites_of(text or "", language) if _within(s.line, sp)] for p, text, sp in texts), fields)


def sites(sources: DataFrame, language: str) -> DataFrame:
    """The sites of (path, source, optionally spans) rows, on lines within spans (array of lo, hi); offsets count characters. Null texts have none."""
    ship_package(sources.sparkSession)
    return _columns(sources).mapInArrow(partial(_sites, language=language), "path string, line int, start int, end int, replacement string, kind string, detail string")


def _python(batches: Iterator[pa.RecordBatch], limit: int | None, delete: bool, texts: bool) -> Iterator[pa.RecordBatch]:
    fields = [("path", pa.string()), ("line", pa.int32()), ("kind", pa.string()), ("detail", pa.string()), ("mutant", pa.string()), ("total_sites", pa.int32())]

    def rows(path: str, text: str | None, spans: Spans) -> list[tuple]:
        n, found = python_mutants(text or "", delete, spans, limit, texts)
        return [(path, *m, n) for m in found]

    for b in batches:
        yield from _sliced((rows(*r) for r in _rows(b)), fields, drop=() if texts else ("mutant",))


def python_sites(sources: DataFrame, limit: int | None = None, delete: bool = True, texts: bool = True) -> DataFrame:
    """The mutants of Python texts (path, source, optionally spans), at most ``limit`` a text (the budget), with the number of
    all its sites; without ``texts`` there is no column mutant."""
    ship_package(sources.sparkSession)
    mutant = "mutant string, " if texts else ""
    return _columns(sources).mapInArrow(partial(_python, limit=limit, delete=delete, texts=texts), f"path string, line int, kind string, detail string, {mutant}total_sites int")


def mutants(sources: DataFrame, language: str, limit: int | None = None) -> DataFrame:
    """(path, line, kind, detail, mutant) by a language's engine: Python's parser, or a lexicon and splices that keep lines.

    ``limit`` is a text's budget: its first sites in order.
    """
    if language == "python":
        return python_sites(sources, limit).drop("total_sites")
    found = sites(sources, language)
    if limit is not None:
        found = found.withColumn("_n", F.row_number().over(Window.partitionBy("path").orderBy("line", "kind", "detail", "start") if language == "javascript" else Window.partitionBy("path").orderBy("start"))).where(F.col("_n") <= limit)
    spliced = splice(F.col("source"), F.col("start"), F.col("end"), F.col("replacement"))
    return found.join(sources.select("path", "source"), "path").select("path", "line", "kind", "detail", spliced.alias("mutant"))
