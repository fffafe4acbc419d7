"""Texts of spans, percent-encoded paths, two-digit rounding, splices that keep line numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round2(x: Column) -> Column:
    """Two decimals, halves away from zero of the binary product."""
    return F.when(x < 0, -F.floor(-x * 100 + 0.5) / 100).otherwise(F.floor(x * 100 + 0.5) / 100)


def span_text(source: Column, start: Column, end: Column) -> Column:
    """Lines start to end, each without trailing blanks; null out of range."""
    lines = F.split(source, "\n")
    ok = (start >= 1) & (end >= start) & (end <= F.size(lines))
    return F.when(ok, F.array_join(F.transform(F.slice(lines, F.greatest(start, F.lit(1)), F.greatest(end - start + 1, F.lit(0))), lambda s: F.regexp_replace(s, r"\s+$", "")), "\n"))


def relative_uri(path: Column) -> Column:
    """A path with ``/`` for ``\\``, and all but unreserved bytes and ``/`` in percent form."""
    raw = F.hex(F.encode(F.translate(path, "\\", "/"), "utf-8"))
    pairs = F.regexp_extract_all(raw, F.lit("(..)"), 1)
    plain = {f"{b:02X}": chr(b) for b in b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-._~/"}
    table = F.create_map(*[F.lit(x) for kv in plain.items() for x in kv])
    return F.array_join(F.transform(pairs, lambda p: F.coalesce(F.try_element_at(table, p), F.concat(F.lit("%"), p))), "")


def splice(source: Column, start: Column, end: Column, replacement: Column) -> Column:
    """``source`` with characters start to end (from 0, end left out) replaced, and as many newlines as they held kept."""
    held = F.regexp_count(F.substr(source, start + 1, end - start), F.lit("\n")) - F.regexp_count(replacement, F.lit("\n"))
    return F.concat(F.substr(source, F.lit(1), start), replacement, F.repeat(F.lit("\n"), F.greatest(held, F.lit(0)).cast("int")), F.substr(source, end + 1))


def bar(x: Column, width: int = 40) -> Column:
    return F.repeat(F.lit("#"), F.floor(x * width + 0.5).cast("int"))
