"""Command line: ``python -m cairn PATH... [--scope file] [--scorer panel] [--form json] [--out FOLDER]``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from cairn.operators.kernel import SCORERS
from cairn.plans import analyze
from cairn.sources import trees


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="cairn", description="Ranks and classifies the lines of the functions below a path.")
    p.add_argument("path", nargs="+")
    p.add_argument("--scope", choices=analyze.SCOPES, default="file")
    p.add_argument("--scorer", choices=SCORERS, default="panel")
    p.add_argument("--form", choices=("json", "sarif", "text", "annotate", "stats"), default="json")
    p.add_argument("--tests", action="store_true", help="read test sources too")
    p.add_argument("--max-instructions", type=int, default=4096)
    p.add_argument("--out", help="a folder for the output; without one it is printed")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("cairn").getOrCreate()
    functions, rejected = analyze.guarded(analyze.read(spark, *a.path, tests=a.tests), a.max_instructions)
    sources = None
    for root in a.path:
        if not root.endswith(".json"):
            one = trees.sources(spark, root, "python", a.tests).select(analyze.named(root, F.col("rel"), a.path).alias("file"), "source")
            sources = one if sources is None else sources.unionByName(one)
    out = analyze.report(functions, analyze.analyse(functions, a.scorer, a.scope), sources, a.form)
    for r in rejected.toLocalIterator():
        print(f"skipped {r['file']}:{r['name']}: {r['error']} ({r['n']} statements)", file=sys.stderr)
    if a.out:
        out.write.mode("errorifexists").json(a.out)
    else:
        last = out.columns[-1] if a.form in ("json", "sarif", "text") else None
        for r in out.toLocalIterator():
            print(r[last] if last else "\t".join("" if v is None else str(v) for v in r))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
