"""Known answers of the per-function analyses, on hand-built functions."""

import math
import random

import pytest

from cairn.functions.denylist import Denylist
from cairn.operators import instruments as inst
from cairn.operators.graph import Graph, bits, cones, strong_components
from cairn.operators.kernel import FACTS, Function
from cairn.operators.tiers import Statement as S

D = Denylist()


def fn(*body):
    return Function(list(body), D)


ACCUMULATE = [
    S("pure", defs=[1], succs=[1], line=2), S("pure", defs=[2], succs=[2], line=3), S("branch", uses=[2], succs=[3, 5], line=4),
    S("pure", defs=[1], uses=[1, 3], succs=[4], line=5), S("pure", defs=[2], uses=[2], succs=[2], line=6), S("return", uses=[1], line=8),
]


def test_clamp():
    f = fn(S("branch", uses=[1], succs=[1, 2], line=2), S("return", uses=[1], line=3), S("return", line=5))
    assert f.t.tier == [3, 2, 2] and f.g.control_weight(0) == 2 / 3


def test_accumulate():
    f = fn(*ACCUMULATE)
    assert {h: bits(b) for h, b in f.g.loops.items()} == {2: [2, 3, 4]}
    assert f.t.tier[3] == f.t.tier[4] == 3 and any("loop-carried" in r for _, r in f.t.reasons[3])
    assert f.g.data_preds[3] == [0, 3] and 3 in f.g.dep_succs[3]


def test_logging_is_inert():
    f = fn(S("call", "Service::compute", defs=[2], succs=[1]), S("pure", defs=[1], uses=[2], succs=[2]), S("call", "org.slf4j.Logger::info", uses=[1], succs=[3]), S("return", uses=[2]))
    assert f.t.inert == [False, True, True, False] and f.t.score[2] == 0


def test_dead_and_store():
    f = fn(S("pure", defs=[1], succs=[1]), S("pure", defs=[2], succs=[2]), S("return", uses=[2]))
    assert f.t.tier[:2] == [1, 3]
    f = fn(S("pure", defs=[1], succs=[1]), S("state_write", uses=[1], succs=[2], target="x"), S("return"))
    assert f.t.tier[:2] == [3, 2]


def test_spin_has_a_loop():
    f = fn(S("pure", succs=[1]), S("branch", succs=[1, 0]))
    assert f.g.loops


def test_diamond():
    g = fn(S("branch", succs=[1, 2]), S("pure", succs=[3]), S("pure", succs=[3]), S("return")).g
    assert g.dominates(0, 3) and not g.dominates(1, 3)
    assert [bits(c) for c in g.ctrl_deps] == [[], [0], [0], []] and g.idom == [None, 0, 0, 0] and g.ipdom == [3, 3, 3, 4]


def test_shared_value_is_not_inert():
    f = fn(S("call", "load", defs=[1], succs=[1]), S("call", "log.info", uses=[1], succs=[2]), S("return", uses=[1]))
    assert f.t.inert == [False, True, False]


def test_counters():
    f = fn(
        S("pure", defs=[1], succs=[1]), S("pure", defs=[2], succs=[2]), S("branch", succs=[3, 6]), S("pure", defs=[2], uses=[2, 3], succs=[4]),
        S("pure", defs=[1], uses=[1], succs=[5]), S("pure", succs=[2]), S("call", "logging.info", uses=[1], succs=[7]), S("return", uses=[2]),
    )
    assert f.t.inert[0] and f.t.inert[4] and f.t.tier[3] == 3


def test_fire_and_forget():
    assert fn(S("call", "Service::sendEmail", succs=[1]), S("return")).t.tier[0] == 2


def test_stream_orders():
    f = fn(S("pure", defs=[1], succs=[1]), S("pure", defs=[3], uses=[1], succs=[2]), S("pure", defs=[2], succs=[3]), S("pure", defs=[4], uses=[2], succs=[4]), S("pure", defs=[5], uses=[3, 4], succs=[5]), S("return", uses=[5]))
    assert FACTS["strahler_order"][1](f) == [1, 1, 1, 1, 2, 2] and FACTS["strahler"][1](f) == [0, 0, 0, 0, 1, 1]


def test_trophic():
    diamond = fn(S("pure", defs=[1], succs=[1]), S("pure", defs=[2], uses=[1], succs=[2]), S("pure", defs=[3], uses=[1], succs=[3]), S("return", uses=[2, 3]))
    assert FACTS["trophic"][1](diamond) == [0, 0.5, 0.5, 1]
    cycle = fn(S("pure", defs=[1], succs=[1]), S("pure", defs=[2], uses=[1, 3], succs=[2]), S("pure", defs=[3], uses=[2], succs=[1]))
    assert FACTS["trophic_level"][1](cycle) == pytest.approx([1, 4, 5]) and FACTS["trophic"][1](cycle) == pytest.approx([0, 0.75, 1])
    alone = fn(S("pure", defs=[1], uses=[2], succs=[1]), S("pure", defs=[2], uses=[1], succs=[0]))
    assert FACTS["trophic_level"][1](alone) == [1, 1] and FACTS["trophic"][1](alone) == [0.5, 0.5]


def test_absorbing_and_reliability():
    chain = fn(S("pure", defs=[1], succs=[1]), S("pure", defs=[2], uses=[1], succs=[2]), S("return", uses=[2]))
    assert FACTS["schur"][1](chain) == pytest.approx([0.5, 1, 1]) and FACTS["birnbaum"][1](chain) == pytest.approx([0.25] * 3)
    one = fn(S("return"))
    assert FACTS["schur"][1](one) == [1.0] and FACTS["birnbaum"][1](one) == pytest.approx([1.0])
    assert inst.log_scale([0.0, 0.5, 0.5]) == [0.0, 1.0, 1.0] and inst.log_scale([0.0]) == [0.0]


def test_absorbing_matches_deletion():
    """A statement's score is what its deletion costs: delivered output with it cut off, against all of it."""
    import numpy as np

    body = [*ACCUMULATE[:-1], S("return", uses=[1, 2])]
    f = fn(*body)
    edges, omega = inst.weighted_edges(f.g), inst.outputs(body, D)
    n = f.g.n
    q, b = np.zeros((n, n)), np.zeros(n)
    for v in range(n):
        total = sum(edges[v].values())
        for u, w in edges[v].items():
            if omega[v]:
                continue
            if omega[u]:
                b[v] += w / total
            else:
                q[v, u] = w / total

    def delivered(without):
        keep = [v for v in range(n) if not omega[v] and v != without]
        return float(np.linalg.solve(np.eye(len(keep)) - q[np.ix_(keep, keep)], b[keep]).sum())

    scores = inst.absorbing(body, f.g, D)
    for v in range(n):
        if not omega[v]:
            assert scores[v] == pytest.approx((delivered(None) - delivered(v)) / delivered(None))


def test_unreachable_self_loop_is_a_loop():
    g = fn(S("return"), S("pure", succs=[1])).g
    assert {h: bits(b) for h, b in g.loops.items()} == {1: [1]} and g.idom == [None, None] and g.ipdom == [2, 2]


def test_duplicate_successor_counts_as_a_branch_and_double_defs_as_two():
    g = fn(S("branch", succs=[1, 1]), S("return")).g
    assert g.ctrl_deps == [0, 0]
    g = fn(S("pure", defs=[1, 1], succs=[1]), S("return", uses=[1])).g
    assert inst.weighted_edges(g)[0] == {1: 2.0}


def test_denylist():
    yes, no = ["print", "LOG.info", "java.util.logging.Logger::info"], ["pprint", "footprint", "mylog.info", "com.example.Blogger::info", ""]
    assert all(map(D.matches, yes)) and not any(map(D.matches, no)) and len(D.patterns) == 42
    assert Denylist(()).with_patterns("Audit.write").matches("x.AUDIT.write")


def random_function(rng, n):
    body = []
    for v in range(n):
        succs = [] if rng.random() < 0.15 else [rng.randrange(n) for _ in range(rng.choice((1, 1, 2, 3)))]
        body.append(S(rng.choice(("pure", "branch", "call", "return", "state_write")), callee="f", target="t", defs=[rng.randrange(4)] * rng.randrange(2), uses=[rng.randrange(4) for _ in range(rng.randrange(3))], succs=succs))
    return body


def test_random_functions_by_definition():
    rng = random.Random(11)
    for _ in range(150):
        n = rng.randint(1, 9)
        body = random_function(rng, n)
        g = Graph([s.succs for s in body], [s.defs for s in body], [s.uses for s in body])

        def reach(start, cut=None, succ=[s.succs for s in body]):
            seen, todo = set(), [start] if start != cut else []
            while todo:
                x = todo.pop()
                if x not in seen:
                    seen.add(x)
                    todo += [s for s in succ[x] if s != cut]
            return seen

        live = reach(0)
        for a in range(n):
            for b in range(n):
                assert g.dominates(a, b) == (a == b or b in live and a in live and b not in reach(0, a))
        closure = {v: set().union(*(reach(s, None, g.dep_succs) for s in g.dep_succs[v])) if g.dep_succs[v] else set() for v in range(n)}
        assert g.influence == [len(closure[v] - {v}) for v in range(n)] == cones(g.dep_succs)
        of, _ = strong_components(g.dep_succs)
        for a in range(n):
            for b in range(n):
                assert (of[a] == of[b]) == (a == b or b in closure[a] and a in closure[b])
        f = Function(body, D)
        for name, (_, get) in FACTS.items():
            assert len(get(f)) == n, name
        for name in ("score", "schur", "birnbaum", "pivot", "trophic", "strahler"):
            assert all(0 <= x <= 1 and math.isfinite(x) for x in FACTS[name][1](f))


def packed(rng, functions):
    """Random functions as a batch: of all sizes, some with several definitions in a statement, some entered elsewhere."""
    import pyarrow as pa

    kind = pa.list_(pa.struct([("nid", pa.int32()), ("line", pa.int32()), *((c, pa.string()) for c in ("kind", "callee", "opacity", "target")), ("defs", pa.list_(pa.int64())), ("uses", pa.list_(pa.int64())), ("succs", pa.list_(pa.int32())), ("label", pa.string())]))

    def one(n):
        several = n > 20 and rng.random() < 0.3
        for v in range(n):
            defs = [1, 2] if several else rng.choice([None, [], [rng.randrange(4)], [rng.randrange(4)]])
            uses = rng.choice([None, [], [rng.randrange(4)], [rng.randrange(4), rng.randrange(4)]])
            succs = [rng.randrange(n) if rng.random() < 0.4 else min(n - 1, v + 1) for _ in range(rng.choice([0, 1, 1, 1, 2, 2, 3]))]
            yield {"nid": v, "line": rng.choice([None, v]), "kind": rng.choice("pure pure call branch return throw state_write".split()), "callee": rng.choice([None, "", "print", "log.info", "m.f"]), "opacity": rng.choice([None, "inert"]), "target": rng.choice([None, "", "x"]), "defs": defs, "uses": uses, "succs": succs, "label": None}

    bodies = [list(one(rng.choice([0, 1, 2, 3, 4, 5, 6, 8, 12, 17, 31, 32, 40]))) for _ in range(functions)]
    entry = [rng.choice([0, None, max(0, len(b) - 1)]) for b in bodies]
    return pa.RecordBatch.from_arrays([pa.array(range(functions), pa.int64()), pa.array(entry, pa.int32()), pa.array(bodies, kind)], ["fn", "entry", "nodes"])


def test_many_functions_at_once_as_one_by_one(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from cairn.operators import batch, kernel

    b = packed(random.Random(11), 400)
    entry = np.array([e or 0 for e in b.column("entry").to_pylist()])
    some = np.flatnonzero(batch.lengths(b.column("nodes")))
    columns = [c for c in kernel.FACTS if c in batch.FACTS or c in kernel.OF_DEPENDENCE]
    alone = kernel._one_by_one(b.take(pa.array(some)), entry[some], ["fn"], columns, kernel.Denylist())
    want = {(r["fn"], r["nid"]): r for r in alone.to_pylist()}
    got = {(r["fn"], r["nid"]): r for x in kernel._run([b], ["fn"], columns, kernel.DEFAULT) for r in x.to_pylist()}
    assert got == want
    groups, others = batch.classes(b.column("nodes"), entry)
    assert all(map(len, groups)) and len(others)
    small = b.take(pa.array(np.sort(np.concatenate(groups))))
    monkeypatch.setattr(kernel, "Statement", None)  # small functions are not taken one by one
    assert sum(x.num_rows for x in kernel._run([small], ["fn"], list(batch.FACTS), kernel.DEFAULT)) == batch.lengths(small.column("nodes")).sum()
