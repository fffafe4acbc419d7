"""Operators on tables: panels, spans, scope, statistics, text, sources and sinks."""

import json

import pytest
from pyspark.sql import functions as F

from cairn import queries
from cairn.functions import paths, text
from cairn.model import INSTRUMENTS
from cairn.operators import kernel, mutation, panel, scope, stats
from cairn.plans import ir
from cairn.sources import bytecode, datasets, sinks, smap, trees, wire

NODES = "fn long, file string, name string, nid int, line int, kind string, callee string, opacity string, target string, defs array<long>, uses array<long>, succs array<int>, label string"


def one(df):
    return df.collect()[0][0]


def chain(spark, fn=1, file="a.py", name="f"):
    rows = [(fn, file, name, 0, 1, "pure", None, None, None, [0], [], [1], ""), (fn, file, name, 1, 2, "pure", None, None, None, [1], [0], [2], ""), (fn, file, name, 2, 3, "pure", None, None, None, [2], [1], [3], ""), (fn, file, name, 3, 4, "state_write", None, None, "x", [], [2], [], "")]
    return spark.createDataFrame(rows, NODES)


def test_panel_on_a_chain(spark):
    f = kernel.facts(ir.pack(chain(spark), "fn"), "structural", "tier", "score", *INSTRUMENTS)
    lines = panel.line_features(f)
    a = {r.line: r.panel for r in panel.panel_score(lines, "instruction").collect()}
    b = {r.line: r.panel for r in panel.panel_score(lines, "statement").collect()}
    assert all(0 <= x <= 1 for x in [*a.values(), *b.values()]) and a != b and a[4] > a[1] and b[4] > b[1]
    node = {r.nid: r.score for r in panel.rescored(f, "panel").collect()}
    assert node[3] == a[4]


def test_weights():
    from cairn.model import PROFILES

    assert round(sum(PROFILES["instruction"]), 4) == 0.9358 and round(sum(PROFILES["statement"]), 4) == 0.888


def test_size_guard_and_validation(spark):
    n = chain(spark)
    assert ir.pack(n, "fn", most=3).count() == 0 and ir.oversized(n, most=3).count() == 1 and ir.invalid(ir.pack(n, "fn")).count() == 0
    bad = n.withColumn("succs", F.when(F.col("nid") == 3, F.array(F.lit(9))).otherwise(F.col("succs")))
    assert ir.invalid(ir.pack(bad, "fn")).count() == 1
    assert kernel.facts(ir.pack(n.limit(0), "fn"), "tier").count() == 0


def test_global_rank_is_the_window_s(spark):
    import random

    rng = random.Random(4)
    d = spark.createDataFrame([(i, rng.choice([0.0, 0.0, rng.random()])) for i in range(500)], "i long, x double").repartition(5)
    want = {r.i: r.r for r in d.select("i", panel.rank01(F.col("x"), F.lit(0)).alias("r")).collect()}
    assert {r.i: r.r for r in panel.global_rank01(d, "x", "r").collect()} == pytest.approx(want)
    assert one(panel.global_rank01(d.limit(1), "x", "r").select("r")) == 0.5 and panel.global_rank01(d.limit(0), "x", "r").count() == 0


def test_spans_compare_with_the_first_line(spark):
    d = 0.6e-9
    rows = [(1, 1, 2, 0.5), (1, 2, 2, 0.5 + d), (1, 3, 2, 0.5 + 2 * d), (1, 5, 2, 0.5), (1, 6, 1, 0.1)]
    got = [(r.start, r.end, r["rank"]) for r in panel.spans(spark.createDataFrame(rows, "fn long, line int, tier int, score double")).orderBy("start").collect()]
    assert [g[:2] for g in got] == [(1, 2), (3, 3), (5, 5), (6, 6)] and got[3][2] == 0


def test_reasons_once_and_by_tier(spark):
    rows = [(1, 0, 7, False, 1, 0.1, [(1, "b"), (1, "a")]), (1, 1, 7, False, 3, 0.4, [(3, "top"), (1, "a")]), (1, 2, 7, True, 3, 0.9, [(3, "jump")])]
    d = spark.createDataFrame(rows, "fn long, nid int, line int, structural boolean, tier int, score double, reasons array<struct<tier:int,text:string>>")
    r = panel.line_table(d).collect()[0]
    assert (r.tier, r.score, r.reasons) == (3, 0.4, ["top", "b", "a"])


def test_resolution_rungs(spark):
    f = spark.createDataFrame([(1, "x", "a.foo"), (2, "x", "b.foo"), (3, "y", "c.foo"), (4, "y", "a.foo"), (5, "z", "bar"), (6, "x", "m.dup"), (7, "x", "m.dup"), (8, "w", "solo.dup2")], "fn long, file string, name string")
    calls = [("y", "a.foo", 4, "file exact"), ("z", "foo", None, None), ("z", "c.foo", 3, "exact"), ("y", "q.bar", 5, "suffix"), ("x", "m.dup", None, None), ("z", "a.foo", None, None), ("x", "zzz", None, None), ("y", "x.", None, None)]
    c = spark.createDataFrame([(i, *x[:2]) for i, x in enumerate(calls)], "fn long, file string, callee string")
    got = {r.fn: (r.callee_fn, r.rung) for r in scope.resolved(c, f).collect()}
    assert got == {i: x[2:] for i, x in enumerate(calls)}


def test_ambiguous_here_may_be_unique_elsewhere(spark):
    """Two suffixes in the caller's file settle nothing there, but an exact name in another file then wins."""
    f = spark.createDataFrame([(1, "x", "a.go"), (2, "x", "b.go"), (3, "y", "go")], "fn long, file string, name string")
    c = spark.createDataFrame([(1, "x", "go")], "fn long, file string, callee string")
    assert scope.resolved(c, f).collect()[0].callee_fn == 3


@pytest.mark.parametrize("packed", [0, 10**6])
def test_call_depth_with_cycles(spark, packed):
    fns = spark.createDataFrame([(i,) for i in range(9)], "fn long").withColumn("file", F.lit("f")).withColumn("name", F.col("fn").cast("string"))
    edges = [(0, 1), (1, 2), (2, 1), (2, 3), (3, 3), (4, 5), (5, 6), (6, 4), (7, 0)]
    e = spark.createDataFrame(edges, "fn long, callee_fn long")
    want = {0: 3.0, 1: 2.0, 2: 2.0, 3: 1.0, 4: 1.0, 5: 1.0, 6: 1.0, 7: 4.0, 8: 1.0}
    assert {r.fn: r.depth for r in scope.call_depth(e, fns, packed).collect()} == want
    assert {r.fn: r.depth for r in scope._packed_depth(e, fns, "file").collect()} == want


def test_ranks_of_all_rows(spark):
    """Values of a third of all rows, rare ones and nulls, against ranks by sorting."""
    import random

    rng = random.Random(3)
    values = [0.0] * 1500 + [None] * 40 + [rng.randrange(4000) / 7 for _ in range(2500)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, v double").repartition(5)
    order = sorted((v is not None, v or 0.0) for v in values)
    first, last = {}, {}
    for i, k in enumerate(order):
        first.setdefault(k, i)
        last[k] = i
    want = {i: (first[k] + last[k]) / 2 / (len(values) - 1) for i, k in enumerate((v is not None, v or 0.0) for v in values)}
    for ranked in (panel.global_rank01(df, "v", "r"), df.withColumn("r", panel.rank01(F.col("v"), F.lit(1)))):
        got = {r.id: r.r for r in ranked.collect()}
        assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-12 for i in want)


def test_call_depth_of_long_chains(spark):
    """No limit of rounds: a chain of 1,000 calls, and one in edge tables that is longer than a few rounds."""
    chain = lambda n: (spark.range(n).selectExpr("id as fn", "id + 1 as callee_fn"), spark.range(n + 1).selectExpr("id as fn"))
    assert {r.fn: r.depth for r in scope.call_depth(*chain(1000)).collect()} == {i: 1001.0 - i for i in range(1001)}
    assert {r.fn: r.depth for r in scope.call_depth(*chain(12), 0).collect()} == {i: 13.0 - i for i in range(13)}


def test_call_depth_query_takes_every_edge(spark):
    sf = "/root/testdata/sf0.001"
    n = ir.from_lines(spark, sf)
    calls = {}
    for r in scope.call_edges(n, queries._functions(n)).collect():
        calls.setdefault(r.fn, set()).add(r.callee_fn)
    assert any(b < a for a, to in calls.items() for b in to)

    def reached(v):
        seen, todo = {v}, [v]
        while todo:
            new = calls.get(todo.pop(), set()) - seen
            seen |= new
            todo += new
        return seen

    reach = {v: reached(v) for v in calls}
    cycle = {v: frozenset(w for w in reach[v] if v in reach.get(w, ())) | {v} for v in calls}
    known = {}

    def depth(v):
        c = cycle.get(v, {v})
        if (key := min(c)) not in known:
            known[key] = 1 + max((depth(w) for u in c for w in calls.get(u, set()) - c), default=0)
        return known[key]

    got = {r.fn: r.depth for r in queries.QUERIES["call_depth_all"](spark, sf).collect()}
    assert len(got) > len(calls) and got == {v: depth(v) for v in got}


def test_hub_outranks_its_wrappers(spark):
    names = ["hub", "helper", "w1", "w2", "w3", "l1", "l2"]
    fns = spark.createDataFrame([(i, "hub.py" if i < 2 else f"{n}.py", n) for i, n in enumerate(names)], "fn long, file string, name string")
    calls = [(i, "hub") for i in (2, 3, 4)] + [(0, "helper")]
    rows = [(i, "hub.py" if i < 2 else f"{names[i]}.py", names[i], k, None, "call", c, None, None, [], [], [], "") for k, (i, c) in enumerate(calls)]
    nodes = spark.createDataFrame(rows, NODES)
    lines = [(i, "hub.py" if i < 2 else f"{n}.py", 10 * i + k, 2 if i < 2 else 1, 0.2 + 0.1 * k) for i, n in enumerate(names) for k in range(6 if i == 0 else 2)]
    lines = spark.createDataFrame(lines, "fn long, file string, line int, tier int, score double")
    repo = scope.blended(lines, scope.function_features(nodes, lines, fns)).collect()
    top = {r.fn: 0 for r in repo}
    for r in repo:
        top[r.fn] = max(top[r.fn], r.score)
    assert all(top[0] > top[w] for w in (2, 3, 4))
    assert len({(r.file, r.line) for r in repo}) == len(repo)


def test_spearman_and_verdicts(spark):
    d = spark.createDataFrame([("a", x, y) for x, y in zip((1, 2, 3, 4, 5), (2, 1, 4, 3, 5))] + [("b", x, y) for x, y in zip((1, 2, 2, 3), (1, 2, 3, 4))] + [("c", 1, y) for y in range(4)] + [("d", 1, 1)], "k string, x int, y int")
    got = {r.k: r.rho for r in stats.spearman(d, "x", "y", "k").collect()}
    assert got == {"a": pytest.approx(0.8), "b": pytest.approx(3 / 10**0.5), "c": 0.0, "d": 0.0}
    cases = [(0.9, 0.0, 19, 30, "insufficient data"), (0.9, 0.0, 20, 29, "insufficient data"), (0.5, 0.1, 20, 30, "calibrated"), (0.25, 0.0, 20, 30, "marginal"), (0.6, 0.55, 20, 30, "marginal"), (0.2, 0.2, 20, 30, "uncalibrated"), (-0.1, 0.4, 20, 30, "uncalibrated")]
    v = spark.createDataFrame(cases, "r double, n double, l int, m int, want string").withColumn("v", stats.verdict(F.col("r"), F.col("n"), F.col("l"), F.col("m")))
    assert all(r.v == r.want for r in v.collect())
    gates = dict((r.v, r.g) for r in v.select("v", stats.gate_code(F.col("v")).alias("g")).collect())
    assert gates == {"calibrated": 0, "marginal": 0, "insufficient data": 2, "uncalibrated": 3}


def test_ridge_and_leave_one_out(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    x = rng.normal(size=(120, 3))
    y = x @ [1.0, -2.0, 0.5] + 0.01 * rng.normal(size=120)
    d = spark.createDataFrame([(f"g{i % 4}", *map(float, x[i]), float(y[i])) for i in range(120)], "g string, a double, b double, c double, y double")
    w = [r.weight for r in stats.ridge_weights(stats.gram(d, [F.col(c) for c in "abc"], F.col("y")), 0.03).collect()]
    want = np.linalg.solve(x.T @ x + 0.03 * 120 * np.eye(3), x.T @ y)
    assert np.allclose(w, want)
    out = stats.leave_one_out(d, ["a", "b", "c"], "y", "g").collect()
    assert len(out) == 4 and all(r.rho > 0.99 and r.lam in stats.LAMBDAS for r in out)


def test_bootstrap_interval(spark):
    d = spark.createDataFrame([(i, 1.0 + 0.1 * (i % 5), 1.0) for i in range(60)], "k long, v double, w double")
    r = stats.bootstrap(d, "v", "w", "k", draws=300).collect()[0]
    assert r.low < r["mean"] < r.high and r["mean"] == pytest.approx(1.2) and r.p == pytest.approx(1 / 300)


def test_bootstrap_query_draws_as_often_as_the_reference(spark):
    r = queries.QUERIES["bootstrap"](spark, "/root/testdata/sf0.001").collect()[0]
    assert r.low <= r.mean <= r.high and (r.p == 1 / 4000 or r.p * 2000 == pytest.approx(round(r.p * 2000)) and r.p > 1 / 4000)
    assert r.p < 1 / 200  # what 200 draws can't go below


def test_paths(spark):
    cases = [("src/a.py", "python", False, False), ("tests/a.py", "python", True, False), ("src/test_a.py", "python", True, False), ("a/node_modules/b.ts", "javascript", False, True), ("x/__tests__/b.tsx", "javascript", True, False), ("b.spec.ts", "javascript", True, False), ("benches/b.rs", "rust", True, False), ("OrderTest.java", "java", True, False), ("a_test.go", "go", True, False), (".git/x.py", "python", False, True), ("README", None, False, False), ("x.txt", None, False, False)]
    d = spark.createDataFrame([(c[0],) for c in cases], "path string")
    p = F.col("path")
    got = {r.path: (r.l, r.t, r.s) for r in d.select("path", paths.language(p).alias("l"), paths.is_test(p).alias("t"), paths.is_skipped(p).alias("s")).collect()}
    assert got == {c[0]: c[1:] for c in cases}
    names = spark.createDataFrame([("<module>", "go"), ("f.<locals>.<lambda>", "python"), ("a::{closure#0}", "rust"), ("ok", "python")], "n string, l string")
    assert [r[0] for r in names.select(paths.is_synthetic(F.col("n"), F.col("l"))).collect()] == [True, True, True, False]


def test_text_functions(spark):
    d = spark.createDataFrame([("a  \nb\t\nc", 0.285)], "s string, x double")
    assert one(d.select(text.round2(F.col("x")))) == 0.28
    assert [one(d.select(text.span_text(F.col("s"), F.lit(a), F.lit(b)))) for a, b in ((1, 2), (3, 3), (0, 1), (3, 4))] == ["a\nb", "c", None, None]
    assert one(d.select(text.relative_uri(F.lit("a b\\ü:c.py")))) == "a%20b/%C3%BC%3Ac.py"
    assert one(d.select(text.splice(F.lit("ab\ncd\nef"), F.lit(1), F.lit(7), F.lit("X")))) == "aX\n\nf"


def test_mutation_sites():
    src = 'int f(int a) { // a + b\n  /* 1 */ if (a <= 10 && a != 0) return a - 1_0; // x\n  String s = "1+1"; char c = \'+\';\n  return a >>= 2 == 3.5;\n}'
    got = [(s.line, s.detail) for s in mutation.text_sites(src, "java")]
    assert got == [(2, "<= -> >"), (2, "10 -> 11"), (2, "&& -> ||"), (2, "!= -> =="), (2, "0 -> 1"), (2, "- -> +"), (2, "10 -> 11"), (4, "2 -> 3"), (4, "== -> !=")]
    nested = "/* a /* b */ 1 */ 2"
    assert [s.detail for s in mutation.text_sites(nested, "rust")] == ["2 -> 3"] and [s.detail for s in mutation.text_sites(nested, "java")][0] == "1 -> 0"
    assert mutation.text_sites('let s = r#"1 + "2"#; let x: &\'a str; 3', "rust")[-1].detail == "3 -> 4"
    assert mutation.text_sites('"1', "go") == [] and mutation.text_sites("", "go") == []


def kinds_of(source, **how):
    return [m[:3] for m in mutation.python_mutants(source, **how)[1]]


def test_python_mutants():
    got = kinds_of('def f(a):\n    "doc"\n    b = a + 1\n    return b > 2 and a\n')
    assert got == [
        (3, "bin", "Add -> Sub"), (3, "const", "1 -> 2"), (3, "const", "1 -> 0"), (3, "delete", "statement -> pass"),
        (4, "bool", "And -> Or"), (4, "cmp", "Gt -> GtE"), (4, "cmp", "Gt -> Lt"), (4, "const", "2 -> 3"), (4, "const", "2 -> 0"), (4, "delete", "statement -> pass"),
    ]
    assert mutation.python_mutants("def (") == (0, [])
    one = lambda e: [d for _, k, d in kinds_of(e, delete=False) if k not in ("const",)]
    assert one("a < b") == ["Lt -> LtE", "Lt -> Gt"] and one("a <= b") == ["LtE -> Lt", "LtE -> GtE"] and one("a in b") == ["In -> NotIn"]
    assert [one(f"a {o} b")[0].split(" -> ")[1] for o in ("*", "//", "/", "%", "**", "|", "<<", "-")] == ["FloorDiv", "Mult", "Mult", "FloorDiv", "Mult", "BitAnd", "RShift", "Add"]
    assert one("a @ b") == [] and kinds_of("a += b", delete=False) == [(1, "aug", "Add -> Sub")]
    const = lambda e: [d.split(" -> ")[1] for _, k, d in kinds_of(f"x = {e}", delete=False) if k == "const"]
    assert const("True") == ["False"] and const("0") == ["1"] and const("7") == ["8", "0"] and const("2.5") == [repr(2.5 * 1.0001 + 1e-9)] and const("'s'") == ["'s§'"] and const("''") == ["'§'"] and const("None") == []
    deleted = [line for line, k, _ in kinds_of("import os\nif a:\n    return_ = 1\n    pass\nfor x in y:\n    raise x\nclass C:\n    'doc'\n    def g(self):\n        global z\n        return 1\n") if k == "delete"]
    assert deleted == [2, 3, 5, 6, 11]
    n, some = mutation.python_mutants("a < 1\nb < 2\nc < 3\n", spans=[(2, 2), (3, 3)], limit=2)
    assert n == 10 and [m[:3] for m in some] == [(2, "cmp", "Lt -> LtE"), (2, "cmp", "Lt -> Gt")] and some[0][3] == "a < 1\nb <= 2\nc < 3"


def test_javascript_mutants():
    src = "const a = b < 1 && c !== 'x < y'; // d > e\nlet f = -g % 0x10, h = 1.5;\ni += 2; j = k => k >>> 3; m++ + n / p;\n"
    got = [(s.line, s.kind, s.detail, src[s.start : s.end]) for s in mutation.javascript_sites(src)]
    assert got == [
        (1, "bool", "&& -> ||", "&&"), (1, "cmp", "!== -> ===", "!=="), (1, "cmp", "< -> <=", "<"), (1, "cmp", "< -> >", "<"), (1, "const", "1 -> 0", "1"), (1, "const", "1 -> 2", "1"),
        (2, "bin", "% -> *", "%"), (2, "const", "1.5 -> 2.5", "1.5"), (2, "const", "16 -> 17", "0x10"),
        (3, "bin", "+ -> -", "+"), (3, "bin", "/ -> *", "/"), (3, "const", "2 -> 3", "2"), (3, "const", "3 -> 4", "3"),
    ]


def test_sites_within_spans(spark):
    src = spark.createDataFrame([("a.java", "x = a + 1;\ny = b + 2;\nz = c + 3;\n", [(2, 3)]), ("b.java", "x = a + 1;", None), ("c.java", None, [(1, 9)])], "path string, source string, spans array<struct<lo:int,hi:int>>")
    got = sorted((r.path, r.line, r.detail) for r in mutation.sites(src, "java").collect())
    assert got == [("a.java", 2, "+ -> -"), ("a.java", 2, "2 -> 3"), ("a.java", 3, "+ -> -"), ("a.java", 3, "3 -> 4"), ("b.java", 1, "+ -> -"), ("b.java", 1, "1 -> 0")]
    py = spark.createDataFrame([("a.py", "x = a + b\ny = a < b\n", [(2, 2)])], "path string, source string, spans array<struct<lo:int,hi:int>>")
    assert [(r.line, r.kind, r.total_sites) for r in mutation.python_sites(py, limit=2).collect()] == [(2, "cmp", 3), (2, "cmp", 3)]


SOURCE = "import logging\n\ndef total(xs):\n    t = 0\n    n = 0\n    for x in xs:\n        t += x\n        n += 1\n    logging.info('%s', n)\n    return t\n"


def test_bytecode_agrees_with_the_story(spark):
    """The accumulator is core, the counter that only a log reads is inert."""
    src = spark.createDataFrame([("a.py", SOURCE), ("bad.py", "def ("), ("none.py", None)], "path string, source string")
    low = bytecode.lower_python(src)
    assert {r.file: bool(r.error) for r in low.collect()} == {"a.py": False, "bad.py": True, "none.py": False}
    packed = wire.packed(low)
    f = kernel.facts(packed.where("name = 'total'").select("fn", "entry", "nodes"), "structural", "tier", "score", "reasons")
    tier = {r.line: r.tier for r in panel.scored_lines(f).collect()}
    assert tier[7] == 3 and tier[8] == 0 and tier[9] == 0 and tier[5] == 0 and tier[10] >= 2
    assert ir.invalid(packed).count() == 0
    spans = panel.spans(panel.line_table(f))
    records = sinks.function_records(packed.where("name = 'total'"), spans, src.select(F.col("path").alias("file"), "source"))
    doc = json.loads(sinks.sidecars(records).collect()[0].json)
    fn = doc["functions"][0]
    assert doc["schema"].endswith("v3") and fn["name"] == "total" and "signature" not in fn and fn["coverage"]["instructions"] == fn["coverage"]["with_line"]
    assert any(s["text"].strip() == "t += x" and s["tier"] == "core" for s in fn["spans"]) and sum(fn["summary"].values()) == len(tier)
    log = json.loads(sinks.sarif(sinks.results(spans.withColumn("file", F.lit("a b.py")))).collect()[0].json)
    res = log["runs"][0]["results"]
    assert {r["properties"]["tier"] for r in res} <= {"core", "boundary"} and all(r["level"] == "note" for r in res)
    place = res[0]["locations"][0]
    assert place["physicalLocation"]["artifactLocation"] == {"uri": "a%20b.py"}
    marked = sinks.annotated(src.where("path = 'a.py'").select(F.col("path").alias("file"), "source"), spans.withColumn("file", F.lit("a.py")))
    assert marked.where("line = 7").collect()[0].tier == "core" and marked.count() == SOURCE.count("\n") + 1
    assert sinks.report(spans.withColumn("file", F.lit("a.py"))).count() == spans.count()


def test_wire_round_trip(spark, tmp_path):
    module = {"file": "m.rs", "functions": [{"name": "f", "entry": 0, "nodes": [{"line": 1, "kind": {"t": "call", "callee": "x.y", "opacity": "inert"}, "defs": [1 << 26], "uses": [], "succs": [1], "label": ""}, {"line": None, "kind": {"t": "return"}, "defs": [], "uses": [1 << 26], "succs": [], "label": ""}]}, {"name": "empty", "entry": 0, "nodes": []}]}
    (tmp_path / "m.json").write_text(json.dumps(module, indent=1))
    got = wire.read_wire(spark, str(tmp_path))
    assert got.count() == 1 and got.collect()[0].file == "m.rs"
    rows = wire.exploded(got).orderBy("nid").collect()
    assert rows[0].callee == "x.y" and rows[0].defs == [1 << 26] and rows[1].line is None
    assert [r.effect for r in kernel.facts(got.select("fn", "entry", "nodes"), "effect").orderBy("nid").collect()] == [False, True]


def test_coroutines(spark):
    rows = [(1, "K.kt", "s", i, i + 1, k, c, None, None, [], [], s, "") for i, (k, c, s) in enumerate([("call", "IntrinsicsKt::getCOROUTINE_SUSPENDED", [1]), ("branch", None, [2, 3, 4]), ("return", None, []), ("pure", None, [2]), ("throw", None, [])])]
    f = ir.pack(spark.createDataFrame(rows, NODES), "fn", "file")
    got = wire.excise_coroutines(f).collect()[0].nodes
    assert list(got[1].succs) == [2] and [n.line for n in got] == [1, 2, 3, None, None]
    other = ir.pack(chain(spark), "fn")
    assert wire.excise_coroutines(other).collect() == other.collect()


def test_source_maps():
    m = smap.parse("SMAP\nA.kt\nKotlin\n*S Kotlin\n*F\n+ 1 A.kt\np/A.kt\n2 B.kt\n*L\n1#1,10:1\n5#2,2:20\nbad\n*S KotlinDebug\n*F\n+ 1 A.kt\np/A.kt\n*L\n7#1:20,2\n*E\n")
    assert m.stratum == "KotlinDebug" and m.resolve(21, "A.kt") == (7, None) and m.resolve(3, "A.kt") == (3, None)
    d = smap.parse("SMAP\nA.kt\nKotlin\n*S Kotlin\n*F\n1 A.kt\n2 B.kt\n*L\n1#1,10:1\n5#2,2:20\n*E\n")
    assert d.resolve(21, "A.kt") == (None, "B.kt") and d.resolve(4, "A.kt") == (4, None)
    assert smap.parse("nope") is None and smap.parse(None) is None and smap.parse("SMAP\nx\ny\n*E") is None


def test_trees_and_datasets(spark, tmp_path):
    root = tmp_path / "tree"
    for p, t in {"a.py": "x = 1\n", "tests/b.py": "y", "node_modules/c.js": "z", "src/d.rs": "fn", "src/e.txt": "t"}.items():
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_text(t)
    assert sorted(r.rel for r in trees.files(spark, str(root)).collect()) == ["a.py", "src/d.rs"]
    assert trees.files(spark, str(root), tests=True).count() == 3
    assert [(r.rel, r.source) for r in trees.sources(spark, str(root), "python").collect()] == [("a.py", "x = 1\n")]
    assert one(trees.majority_language(trees.files(spark, str(root)))) == "python"
    labels = {"schema": "s", "rater": "r", "functions": [{"file": "a", "name": "f", "character": "", "lines": {str(i): {"importance": i, "tier": "core", "note": ""} for i in range(5)}}, {"file": "a", "name": "few", "lines": {"1": {"importance": 1}}}]}
    (tmp_path / "l.json").write_text(json.dumps(labels))
    assert datasets.read_labels(spark, str(tmp_path / "l.json")).count() == 5
    oracle = {"functions": [{"file": "a", "name": "f", "lines": {str(i): {"leverage": None if i == 0 else 0.1 * i, "covered": i != 1, "mutants": 1, "kinds": []} for i in range(7)}}]}
    (tmp_path / "o.json").write_text(json.dumps(oracle))
    assert datasets.read_oracle(spark, str(tmp_path / "o.json")).count() == 5
    rows = spark.createDataFrame([("r", "python", "instruction", "b", "g", 2, None, 0.5, 3, 1, 0.33, None, None), ("r", "python", "instruction", "a", "g", 1, None, 0.5, 3, 1, 0.33, None, None)], datasets.DATASET)
    datasets.write_dataset(rows, str(tmp_path / "d"))
    assert sorted(r.file for r in datasets.read_dataset(spark, str(tmp_path / "d")).collect()) == ["a", "b"]


def test_streaming_analysis(spark, tmp_path):
    packed = ir.pack(chain(spark), "fn").select("fn", "entry", "nodes")
    packed.write.parquet(str(tmp_path / "in"))
    from cairn.streaming import incremental

    stream = spark.readStream.schema(packed.schema).parquet(str(tmp_path / "in"))
    got = []
    incremental.start(stream, lambda df, n: got.extend(df.collect()), str(tmp_path / "ck"), "tier").awaitTermination(60)
    assert sorted((r.nid, r.tier) for r in got) == sorted((r.nid, r.tier) for r in kernel.facts(packed, "tier").collect())


def test_analysis_of_a_tree(spark, tmp_path):
    from cairn.plans import analyze, calibrate

    root = tmp_path / "src"
    root.mkdir()
    (root / "a.py").write_text(SOURCE)
    (root / "b.py").write_text("from a import total\n\ndef twice(xs):\n    return total(xs) + total(xs)\n")
    (root / "bad.py").write_text("def (")
    assert [r.file for r in analyze.lower(spark, str(root)).where("error is not null").collect()] == ["bad.py"]
    functions = analyze.read(spark, str(root), synthetic=False)
    assert sorted(r.name for r in functions.collect()) == ["total", "twice"]
    other = tmp_path / "other"
    other.mkdir()
    (other / "a.py").write_text("def total(xs):\n    return xs\n")
    both = analyze.read(spark, str(root), str(other), synthetic=False).collect()
    assert sorted((r.file, r.name) for r in both) == [(f"{other}/a.py", "total"), (f"{root}/a.py", "total"), (f"{root}/b.py", "twice")] and len({r.fn for r in both}) == 3
    functions.write.parquet(str(tmp_path / "functions"))
    functions = spark.read.parquet(str(tmp_path / "functions"))
    kept, rejected = analyze.guarded(functions, most=12)
    assert kept.count() == 1 and [r.error for r in rejected.collect()] == ["too large"]
    for within in analyze.SCOPES:
        analyze.analyse(functions, "panel", within).write.parquet(str(tmp_path / within))
        spans = spark.read.parquet(str(tmp_path / within))
        assert spans.count() > 0
        if within != "function":
            assert spans.where(f"{within}_score is null").count() == 0 and spans.where(f"{within}_score not between 0 and 1").count() == 0
    sources = trees.sources(spark, str(root), "python").select(F.col("rel").alias("file"), "source")
    for form in ("json", "sarif", "text", "annotate", "stats"):
        assert analyze.report(functions, spans, sources, form).count() > 0
    for scorer in ("current", "schur", "pivot"):
        assert analyze.analyse(functions, scorer, "function").where("tier = 0 and score <> 0").count() == 0
    outcomes = spark.createDataFrame([("a.py", line, ("killed", "survived", "timeout", "invalid")[(line + k) % 4]) for line in range(3, 12) for k in range(6)], "file string, line int, outcome string")
    for within in ("function", "repo"):
        calibrate.paired(spark.read.parquet(str(tmp_path / within)), outcomes, within=within).write.parquet(str(tmp_path / f"pairs-{within}"))
        pairs = spark.read.parquet(str(tmp_path / f"pairs-{within}"))
        r = calibrate.judged(pairs, 54).collect()[0]
        assert r.lines == pairs.count() >= 6 and -1 <= r.rho <= 1 and r.verdict == "insufficient data" and r.gate == 2
        assert calibrate.by_function(pairs).count() == 1
    features = panel.line_features(kernel.facts(functions.select("fn", "file", "name", "entry", "nodes"), "structural", "tier", "score", *INSTRUMENTS), "fn", "file", "name").drop("name")
    rows = calibrate.dataset(pairs, spans, features, "src", "python", "instruction")
    assert rows.count() == pairs.count() and set(datasets.DATASET.split(" ")[0:1]) == {rows.columns[0]}
    with pytest.raises(ValueError):
        (tmp_path / "none").mkdir()
        (tmp_path / "none" / "x.txt").write_text("")
        analyze.read(spark, str(tmp_path / "none"))


def test_pooled_statistics(spark):
    import numpy as np

    t = spark.createDataFrame([("f", 0.5, 13), ("g", -0.2, 8), ("h", 0.9, 3)], "k string, rho double, n long")
    want = np.tanh((np.arctanh(0.5) * 10 + np.arctanh(-0.2) * 5) / 15)
    r = stats.pooled_rho(t).collect()[0]
    assert r.functions == 2 and r.rho == pytest.approx(want)
    rows = spark.createDataFrame([("a", 1.0, 0.1), ("a", 2.0, 0.4), ("a", 5.0, 0.0), ("a", 8.0, 0.4), ("a", 9.0, 0.7)], "k string, t double, s double")
    assert one(stats.pooled_auc(stats.separation(rows, "t", "s", "labels", "k")).select("auc")) == pytest.approx((1 + 0.5 + 1 + 1) / 4)
    assert stats.flatness(rows.withColumn("s", F.lit(1.0)), "s", "k").collect()[0].flat == 1
    assert stats.fingerprint(rows).collect() == stats.fingerprint(rows.repartition(3)).collect()
    d = spark.createDataFrame([("ok", "abcd", "ok", "abcd"), ("ok", "abcd", "ok", "abxd"), ("ok", "a", "err", "a"), ("err", "x", "err", "x")], "sa string, a string, sb string, b string")
    assert [x[0] for x in d.select(stats.divergence("sa", "a", "sb", "b")).collect()] == [0.0, 0.25, 1.0, 0.0]


def test_row_leave_one_out(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(25, 2)), rng.normal(size=25)
    d = spark.createDataFrame([(i, *map(float, x[i]), float(y[i])) for i in range(25)], "k long, a double, b double, y double")
    got = {r.lam: r.rho for r in stats.row_leave_one_out(d, ["a", "b"], "y", "k").collect()}
    for lam, rho in got.items():
        guess = []
        for i in range(25):
            m = np.arange(25) != i
            guess.append(x[i] @ np.linalg.solve(x[m].T @ x[m] + lam * 24 * np.eye(2), x[m].T @ y[m]))
        a, b = np.argsort(np.argsort(guess)), np.argsort(np.argsort(y))
        assert rho == pytest.approx(np.corrcoef(a, b)[0, 1])


def test_mutants_by_language(spark):
    src = spark.createDataFrame([("a", "x = a + b\ny = 1\n"), ("b", None)], "path string, source string")
    assert {r.mutant for r in mutation.mutants(src, "go").collect()} == {"x = a - b\ny = 1\n", "x = a + b\ny = 0\n"}
    assert mutation.mutants(src, "go", limit=1).count() == 1 and mutation.mutants(src, "python", limit=2).count() == 2


def test_counts_of_sites_build_no_site(spark, monkeypatch):
    """Of random texts of what the scanners tell apart, the counts are those of the sites; plain texts are searched once."""
    import random
    from collections import Counter

    from cairn.operators import sitecount

    bits = ["//", "/*", "*/", "/", "*", '"', "'", "`", '"""', 'r"', 'r#"', '"#', 'r##"', 'r###"', '"###', "\\", "\n", " ", "x", "5", "10", "1_0", "0", "1", "1.5", ".5", "5.", "0x1f", "0x_", "1e5", "&&", "||", "<", "<=", "<<", ">", ">=", "->", "=>", "==", "===", "!==", "=", "+", "++", "-", "--", "%", "return", "(", ")", "]", ";", "é", "don't", "$", "'a'", "9" * 25]
    rng = random.Random(7)
    texts = ["".join(rng.choice(bits) for _ in range(rng.choice([3, 8, 25]))) for _ in range(3000)]
    for language in mutation.LEXICONS:
        for t in texts:
            assert sitecount.site_counts(t, language) == Counter((s.kind, s.detail) for s in mutation.sites_of(t, language)), (language, t)
    df = spark.createDataFrame([("a", "x = 1 < 2"), ("b", None), ("a", "y = 10 && 1_0")], "path string, source string").coalesce(1)
    monkeypatch.setattr(sitecount, "SLICE", 1)
    got = sorted(tuple(r) for b in sitecount._run(df.toArrow().to_batches(), ("java", "javascript")) for r in zip(*b.to_pydict().values()))
    assert [r[1:] for r in got if r[0] == 0] == [("a", "bool", "&& -> ||", 1), ("a", "cmp", "< -> >=", 1), ("a", "const", "1 -> 0", 1), ("a", "const", "10 -> 11", 2), ("a", "const", "2 -> 3", 1)]
    assert Counter(r[2] for r in got if r[0] == 1) == {"cmp": 2, "const": 4, "bool": 1}
    monkeypatch.setattr(mutation, "code_mask", None)
    assert sitecount.site_counts('v = 1 <= 2 && 3 - 4 "a < 2"; /* x */ // 3 + 4', "rust") == {("const", "1 -> 0"): 1, ("cmp", "<= -> >"): 1, ("const", "2 -> 3"): 1, ("bool", "&& -> ||"): 1, ("const", "3 -> 4"): 1, ("bin", "- -> +"): 1, ("const", "4 -> 5"): 1}


def test_depth_rounds_write_calls_that_are_left(spark, monkeypatch):
    """Of 300 functions and a chain of 6 calls, no round writes a row for each function."""
    sizes = []
    real = scope.written

    def counted(session, df, name):
        out = real(session, df, name)
        sizes.append((name, out.count()))
        return out

    monkeypatch.setattr(scope, "written", counted)
    fns = spark.range(300).withColumnRenamed("id", "fn")
    edges = spark.createDataFrame([(i, i + 1) for i in range(6)] + [(6, 5), (20, 21)], "fn long, callee_fn long")
    got = {r.fn: r.depth for r in scope.call_depth(edges, fns, packed=0).collect()}
    assert got == {i: {0: 6.0, 1: 5.0, 2: 4.0, 3: 3.0, 4: 2.0, 20: 2.0}.get(i, 1.0) for i in range(300)}
    assert max(n for _, n in sizes) == 8 and [n for name, n in sizes if name == "condensed"] == [6, 4, 3, 2, 1, 0]


def test_densities_in_one_pass(spark):
    rows = [(1, 1, False, 2), (1, 1, False, 1), (1, 2, False, 1), (1, 3, True, 2), (2, None, False, 2), (3, 7, True, 2), (4, 4, False, 0), (4, 5, False, 2)]
    f = spark.createDataFrame(rows, "fn long, line int, structural boolean, tier int")
    want = {r.fn: (r.size, r.boundary_density) for r in scope.boundary_density(panel.scored_lines(f, "fn", scores=()), f.select("fn").distinct()).collect()}
    assert {r.fn: (r["size"], r.boundary_density) for r in scope.densities(f).collect()} == want == {1: (2, 0.5), 2: (0, 0.0), 3: (0, 0.0), 4: (2, 0.5)}


@pytest.mark.parametrize("name", ["boundary_density", "line_features", "panel_score"])
def test_functions_are_analysed_once(spark, name):
    plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == plan.count("Relation [") == 1 and "file" not in plan.partition("MapInArrow")[2].partition("\n")[0]


def test_python_sites_without_texts(spark, monkeypatch):
    source = '"""doc"""\nclass A:\n    """d"""\n    def f(self, x=1):\n        """e"""\n        for i in range(3):\n            x += i if i < 2 and x != "a" else -1.5\n        return not x\n'
    import ast

    n, full = mutation.python_mutants(source)
    # three deletions, eight constants, three comparisons, one "and", one "+="
    assert n == len(full) == 16
    for where in (None, [(7, 7)]):
        n, full = mutation.python_mutants(source, spans=where, limit=6)
        monkeypatch.setattr(ast, "unparse", None)
        assert mutation.python_mutants(source, spans=where, limit=6, texts=False) == (n, [(*m[:3], None) for m in full])
        monkeypatch.undo()
    plan = queries.QUERIES["python_mutants"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "mutant" not in plan


def test_sites_leave_in_slices(monkeypatch):
    """What a task holds of a batch's sites is bounded, whatever the batch has."""
    import pyarrow as pa

    texts = ["x = 1 + 2\n" * 50, None, "", "y = 3 && 4"] * 5
    b = pa.RecordBatch.from_pydict({"path": [str(i) for i in range(20)], "source": texts})
    whole = [r for x in mutation._sites(iter([b]), "java") for r in x.to_pylist()]
    monkeypatch.setattr(mutation, "SLICE", 60)
    parts = list(mutation._sites(iter([b]), "java"))
    assert [r for x in parts for r in x.to_pylist()] == whole and len(whole) == 5 * 153 and max(x.num_rows for x in parts) < 120
    python = pa.RecordBatch.from_pydict({"path": ["a", "b"], "source": ["x = 1 + 2\n" * 50, "y = 3"]})
    assert max(x.num_rows for x in mutation._python(iter([python]), None, True, False)) <= 120


def test_numbers_without_end():
    assert mutation.text_sites("9" * 5000 + " + 1", "java")[-1].detail == "1 -> 0" and len(mutation.text_sites("9" * 5000, "go")) == 0
    assert mutation.javascript_sites("0x" + "f" * 400 + " + 0x_") == [mutation.Site(1, 403, 404, "-", "bin", "+ -> -")]
