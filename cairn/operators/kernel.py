"""The analyses of packed functions as one Arrow stage: a row a function in, a row a statement out.

Small functions are analysed many at once (``batch``), the others, and what isn't found there, one by one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cairn.functions.denylist import DEFAULT, Denylist
from cairn.model import INSTRUMENTS
from cairn.operators import batch
from cairn.operators import instruments as inst
from cairn.operators.graph import Graph, bits
from cairn.operators.tiers import Statement, Tiering, is_effect, is_structural
from cairn.plans.shared import ship_package

_INTS, _INT, _DOUBLE, _BOOL, _TEXT = "array<int>", "int", "double", "boolean", "string"
_ARROW = {_INTS: pa.list_(pa.int32()), _INT: pa.int32(), _DOUBLE: pa.float64(), _BOOL: pa.bool_(), _TEXT: pa.string(), "bigint": pa.int64(), "array<bigint>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64()), "array<struct<tier:int,text:string>>": pa.list_(pa.struct([("tier", pa.int32()), ("text", pa.string())]))}


class Function:
    """One function's analyses, each computed when first asked for."""

    def __init__(self, body: list[Statement], denylist: Denylist, entry: int = 0, graph: Graph | None = None):
        self.body, self.denylist = body, denylist
        self.g = graph or Graph([s.succs for s in body], [s.defs for s in body], [s.uses for s in body], entry)

    @cached_property
    def t(self) -> Tiering:
        return Tiering(self.body, self.g, self.denylist)

    @cached_property
    def birnbaum(self) -> list[float]:
        return inst.reliability(self.body, self.g)

    @cached_property
    def levels(self) -> list[float]:
        return inst.trophic_levels(self.g)

    @cached_property
    def orders(self) -> list[int]:
        return inst.stream_orders(self.g)

    def scc(self) -> list[int]:
        of, comps = self.g.components
        return [comps[c][0] for c in of]


def _each(f: Callable[[Graph, int], object]) -> Callable[[Function], list]:
    return lambda x: [f(x.g, v) for v in range(x.g.n)]


#: Columns by name: Spark type and how a function yields it, a value a statement.
FACTS: dict[str, tuple[str, Callable[[Function], list]]] = {
    "order": (_INT, lambda x: [at.get(v) for at in [{v: i for i, v in enumerate(x.g.rpo)}] for v in range(x.g.n)]),
    "preds": (_INTS, lambda x: x.g.preds),
    "dominators": (_INTS, lambda x: [bits(d) for d in x.g.dom]),
    "idom": (_INT, lambda x: x.g.idom),
    "post_dominators": (_INTS, lambda x: [[u for u in bits(d) if u < x.g.n] for d in x.g.pdom]),
    "ipdom": (_INT, lambda x: x.g.ipdom),
    "ctrl_deps": (_INTS, lambda x: [bits(c) for c in x.g.ctrl_deps]),
    "governed": (_INT, _each(Graph.governed)),
    "control_weight": (_DOUBLE, _each(Graph.control_weight)),
    "loops": (_INTS, _each(lambda g, v: [h for h, body in sorted(g.loops.items()) if body >> v & 1])),
    "loop_depth": (_INT, lambda x: x.g.loop_depth),
    "loop_carried": (_BOOL, _each(Graph.loop_carried)),
    "reaching_nodes": (_INTS, _each(lambda g, v: [g.def_node[d] for d in bits(g.reaching[v])])),
    "reaching_vars": ("array<bigint>", _each(lambda g, v: [g.def_var[d] for d in bits(g.reaching[v])])),
    "data_preds": (_INTS, lambda x: x.g.data_preds),
    "dep_succs": (_INTS, lambda x: x.g.dep_succs),
    "influence": (_INT, lambda x: x.g.influence),
    "depends_on": (_INT, lambda x: x.g.depends_on),
    "influence_fraction": (_DOUBLE, _each(Graph.influence_fraction)),
    "scc": (_INT, Function.scc),
    "edge_to": (_INTS, lambda x: [list(m) for m in inst.weighted_edges(x.g)]),
    "edge_weight": ("array<double>", lambda x: [list(m.values()) for m in inst.weighted_edges(x.g)]),
    "entry": (_BOOL, lambda x: [v in e for e in [inst.entries(x.g)] for v in range(x.g.n)]),
    "effect": (_BOOL, lambda x: [is_effect(s) for s in x.body]),
    "structural": (_BOOL, lambda x: [is_structural(s) for s in x.body]),
    "denylisted": (_BOOL, lambda x: x.t.denylisted),
    "useful": (_BOOL, lambda x: x.t.useful),
    "feeds_denylist": (_BOOL, lambda x: x.t.feeds),
    "inert_backward": (_BOOL, lambda x: x.t.inert_backward),
    "inert": (_BOOL, lambda x: x.t.inert),
    "distance": (_INT, lambda x: x.t.distance),
    "nearest": (_TEXT, lambda x: x.t.nearest),
    "tier": (_INT, lambda x: x.t.tier),
    "score": (_DOUBLE, lambda x: x.t.score),
    "reasons": ("array<struct<tier:int,text:string>>", lambda x: [[{"tier": t, "text": r} for t, r in rs] for rs in x.t.reasons]),
    "schur": (_DOUBLE, lambda x: inst.absorbing(x.body, x.g, x.denylist)),
    "birnbaum": (_DOUBLE, lambda x: x.birnbaum),
    "pivot": (_DOUBLE, lambda x: inst.log_scale(x.birnbaum)),
    "trophic_level": (_DOUBLE, lambda x: x.levels),
    "trophic": (_DOUBLE, lambda x: inst.unit_scale(x.levels)),
    "strahler_order": (_INT, lambda x: x.orders),
    "strahler": (_DOUBLE, lambda x: inst.unit_scale(x.orders)),
}
SCORERS = ("current", "panel", *INSTRUMENTS)


#: Facts that a function's dependence graph, its effects and the denylist decide: equal functions of a batch are analysed once.
OF_DEPENDENCE = frozenset("schur birnbaum pivot trophic_level trophic strahler_order strahler edge_to edge_weight".split())


def _run(batches: Iterator[pa.RecordBatch], keep: list[str], columns: list[str], patterns: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    deny = Denylist(patterns)
    for b in batches:
        entry = np.array([e or 0 for e in b.column("entry").to_pylist()], np.int64)
        together, others = batch.classes(b.column("nodes"), entry)
        if not all(c in batch.FACTS or c in OF_DEPENDENCE for c in columns):
            together, others = [], np.sort(np.concatenate([*together, others]))
        for functions in together:
            if len(functions):
                part = b.take(pa.array(functions))
                x = batch.Functions(part.column("nodes"), entry[functions], deny)
                rest = _of_dependence(x, [c for c in columns if c in OF_DEPENDENCE])
                yield _rows(part, x.flat, x.n, keep, columns, {c: rest[c] if c in rest else batch.FACTS[c](x) for c in columns})
        if len(others):
            part = b.take(pa.array(others))
            yield _one_by_one(part, entry[others], keep, columns, deny)


def _rows(b: pa.RecordBatch, flat: pa.StructArray, n: np.ndarray, keep: list[str], columns: list[str], found: dict[str, pa.Array]) -> pa.RecordBatch:
    rows = pa.array(np.repeat(np.arange(b.num_rows), n))
    names = [("nid", pa.int32()), ("line", pa.int32()), ("kind", pa.string())]
    arrays = [*(b.column(c).take(rows) for c in keep), *(flat.field(c).cast(t) for c, t in names), *(found[c].cast(_ARROW[FACTS[c][0]]) for c in columns)]
    return pa.RecordBatch.from_arrays(arrays, [*keep, *(c for c, _ in names), *columns])


def _one_by_one(b: pa.RecordBatch, entry: np.ndarray, keep: list[str], columns: list[str], deny: Denylist) -> pa.RecordBatch:
    nodes = b.column("nodes")
    flat, n = nodes.flatten(), batch.lengths(nodes)
    field = {f.name: flat.field(f.name).to_pylist() for f in flat.type}
    ends = np.cumsum(n).tolist()
    out: dict[str, list] = {c: [] for c in columns}
    for lo, hi, e in zip([0, *ends], ends, entry.tolist()):
        body = [Statement(field["kind"][k], field["callee"][k], field["opacity"][k], field["target"][k], field["defs"][k] or (), field["uses"][k] or (), field["succs"][k] or (), field["line"][k]) for k in range(lo, hi)]
        f = Function(body, deny, e)
        for c in columns:
            out[c] += FACTS[c][1](f)
    return _rows(b, flat, n, keep, columns, {c: pa.array(out[c], _ARROW[FACTS[c][0]]) for c in columns})


def _of_dependence(x: batch.Functions, columns: list[str]) -> dict[str, pa.Array]:
    """The columns of OF_DEPENDENCE, found once for functions of one size, dependence graph, effects and denylisted calls."""
    if not columns:
        return {}
    marks = [x.n.astype(np.uint32), x.mask(x.effect), x.mask(x.denylisted), x.mask(x.has_def), *x.data_preds, *x.controls]
    _, one, same = np.unique(np.ascontiguousarray(np.stack(marks, 1)), axis=0, return_index=True, return_inverse=True)
    same = same.reshape(-1)
    data, users, controls, ctrl_deps, dep_succs, dep_preds = (m[:, one].T.tolist() for m in (x.data_preds, x.users, x.controls, x.ctrl_deps, x.dep_succs, x.dep_preds))
    (kind, kinds), (callee, callees), (opacity, opacities) = x.kinds, x.callees, x.text("opacity")
    kinds, callees, opacities = ([*t, None] for t in (kinds, callees, opacities))  # -1 is null
    has_def, ends = x.n_defs > 0, np.cumsum(x.n)
    out: dict[str, list] = {c: [] for c in columns}
    for i, f in enumerate(one):
        n, lo = int(x.n[f]), int(ends[f] - x.n[f])
        at = [v for v in range(n) if has_def[lo + v]]
        body = [Statement(kinds[kind[k]], callees[callee[k]], opacities[opacity[k]]) for k in range(lo, lo + n)]
        g = Graph.of_dependence(n, at, data[i][:n], users[i][:n], controls[i][:n], ctrl_deps[i][:n], dep_succs[i][:n], dep_preds[i][:n])
        y = Function(body, x.denylist, graph=g)
        for c in columns:
            out[c].append(FACTS[c][1](y))
    # each function's rows are those of the one like it
    first = np.cumsum([0, *(x.n[one])])[:-1][same]
    take = pa.array(np.repeat(first, x.n) + x.nid)
    return {c: pa.array([v for vs in out[c] for v in vs], _ARROW[FACTS[c][0]]).take(take) for c in columns}


def facts(packed: DataFrame, *columns: str, patterns: tuple[str, ...] = DEFAULT) -> DataFrame:
    """The asked ``columns`` of FACTS for each statement of packed functions (see ``plans.ir.pack``)."""
    unknown = set(columns) - set(FACTS)
    if unknown:
        raise ValueError(f"no such facts: {sorted(unknown)}")
    ship_package(packed.sparkSession)
    keep = [f for f in packed.schema if f.name not in ("nodes", "entry")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), "nid int, line int, kind string", *(f"{c} {FACTS[c][0]}" for c in columns)])
    return packed.mapInArrow(partial(_run, keep=[f.name for f in keep], columns=list(columns), patterns=patterns), schema)
