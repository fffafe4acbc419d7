"""Calls whose only work is logging, metrics or tracing: a list of name patterns, case ignored.

A pattern without ``.`` or ``:`` must be the whole name. Any other must begin, at its first occurrence,
at the start of the name or just after a ``.`` or ``:``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NAMES = {
    "org.": "apache.logging.log4j slf4j.Logger",
    "io.": "opentelemetry opentracing micrometer",
    "java.": "io.PrintStream::print io.PrintStream::println util.logging.Logger",
    "ch.": "qos.logback",
    "com.": "codahale.metrics",
    "logging.": "critical debug error exception info log warning",
    "logger.": "critical debug error exception info warning",
    "log.": "debug error info warning",
    "console.": "debug error group info log table time timeend trace warn",
    "std::io::": "_eprint _print",
    "log::": "__private_api",
    "tracing::": "event",
    "": "print",
}
DEFAULT: tuple[str, ...] = tuple(root + name for root, names in _NAMES.items() for name in names.split())


def _lower(s: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


class Denylist:
    """Patterns for the kernels; ``column`` is the same test on a column."""

    def __init__(self, patterns: tuple[str, ...] = DEFAULT):
        self.patterns = tuple(_lower(p) for p in patterns)
        self._whole = {p for p in self.patterns if "." not in p and ":" not in p}
        self._within = [p for p in self.patterns if p not in self._whole]
        self._known: dict[str, bool] = {}

    def with_patterns(self, *more: str) -> "Denylist":
        return Denylist(self.patterns + more)

    def matches(self, callee: str) -> bool:
        if callee not in self._known:
            if len(self._known) > 100_000:
                self._known.clear()
            c = _lower(callee)
            self._known[callee] = c in self._whole or any((i := c.find(p)) == 0 or i > 0 and c[i - 1] in ".:" for p in self._within)
        return self._known[callee]

    def column(self, callee: Column) -> Column:
        """Null is no match."""
        c = F.translate(callee, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
        hits = [c.isin(*self._whole)] if self._whole else []
        for p in self._within:
            at = F.instr(c, p)
            hits.append((at == 1) | (at > 1) & F.substr(c, at - 1, F.lit(1)).isin(".", ":"))
        out = F.lit(False)
        for h in hits:
            out = out | h
        return F.coalesce(out, F.lit(False))
