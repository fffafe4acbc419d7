"""Which language a path is in, whether it is a test, and whether a walk skips it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions by language.
EXTENSIONS = {"python": ("py",), "javascript": tuple("cjs cts js jsx mjs mts ts tsx".split()), "rust": ("rs",), "java": ("java",), "kotlin": ("kt", "kts"), "go": ("go",)}
#: Kinds of input by extension; class files have no source language.
KINDS = {"class": ("class",), "python": EXTENSIONS["python"], "js": EXTENSIONS["javascript"], "jvm source": (*EXTENSIONS["java"], *EXTENSIONS["kotlin"]), "rust": ("rs",), "go": ("go",)}
SKIPPED = tuple("__pycache__ node_modules target venv".split())
PROFILES = {"python": "instruction", "rust": "instruction", "javascript": "statement", "java": "statement", "kotlin": "statement", "go": "statement"}
BUDGETS = {"rust": 60, "java": 60, "kotlin": 60, "python": 150, "javascript": 150, "go": 150}
BUILDS = {"rust": "cargo test --no-run", "go": "go vet ./...", "java": None, "kotlin": None}
#: Folders of tests, and patterns of their file names.
TESTS = {
    "python": (("test", "tests"), r"^test_|_test\.py$"),
    "javascript": (("test", "tests", "__tests__"), r"\.(test|spec)\.([cm]?[jt]s|[jt]sx)$"),
    "rust": (("test", "tests", "benches", "examples"), None),
    "java": (("test", "tests"), r"Test\.java$"),
    "kotlin": (("test", "tests"), r"Test\.kts?$"),
    "go": (("test", "tests"), r"_test\.go$"),
}


def extension(path: Column) -> Column:
    """What follows the last dot of the last segment, in lower case; empty without one."""
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*\.([^./]+)$", 1))


def _choose(value: Column, groups: dict[str, tuple[str, ...]]) -> Column:
    names = F.create_map(*[F.lit(x) for name, exts in groups.items() for e in exts for x in (e, name)])
    return F.try_element_at(names, value)


def language(path: Column) -> Column:
    return _choose(extension(path), EXTENSIONS)


def input_kind(path: Column) -> Column:
    return _choose(extension(path), KINDS)


def supported_extensions() -> str:
    return ", ".join(f".{e}" for e in sorted({e for exts in KINDS.values() for e in exts}))


def is_test(path: Column) -> Column:
    """A test by its language's folders or file names; false for files of no known language."""
    parts, lang = F.split(path, "/"), language(path)
    name, dirs = F.element_at(parts, -1), F.slice(parts, 1, F.size(parts) - 1)
    out = F.lit(False)
    for k, (folders, pattern) in TESTS.items():
        hit = F.arrays_overlap(dirs, F.array(*map(F.lit, folders)))
        if pattern:
            hit = hit | name.rlike(pattern)
        out = out | (lang == k) & hit
    return F.coalesce(out, F.lit(False))


def is_skipped(path: Column) -> Column:
    """Below a folder whose name begins with a dot or is one of SKIPPED."""
    parts = F.split(path, "/")
    dirs = F.slice(parts, 1, F.size(parts) - 1)
    return F.exists(dirs, lambda d: d.isin(*SKIPPED) | d.startswith(".") & ~d.isin(".", ".."))


def is_synthetic(name: Column, language: Column, by_grammar: Column | bool = False) -> Column:
    """Functions that no one wrote: module bodies, Python's angle-bracketed names, braces of compiled Rust."""
    braces = (language == "rust") & ~(F.lit(by_grammar) if isinstance(by_grammar, bool) else by_grammar) & name.contains("{")
    return (name == "<module>") | (language == "python") & name.contains("<") | braces
