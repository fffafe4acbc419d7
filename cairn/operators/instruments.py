"""Four structural scores of one function's statements: absorbing chain, reliability, trophic level, stream order."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np

from cairn.functions.denylist import Denylist
from cairn.operators.graph import Graph, bits, closure, strong_components
from cairn.operators.tiers import Statement, is_effect

DATA, CONTROL = 1.0, 0.6
#: Components up to so many statements are solved exactly; larger ones by damped sweeps.
EXACT, DAMPING, SWEEPS, SETTLED = 128, 0.999, 200, 1e-10
EDGE_SURVIVES, ROUNDS = 0.5, 64


def weighted_edges(g: Graph) -> list[dict[int, float]]:
    """Of each statement, those that depend on it: 1 for each definition used, 0.6 for control."""
    out: list[dict[int, float]] = [{} for _ in range(g.n)]
    for v in range(g.n):
        for d in g.defs_at[v]:
            for u in bits(g.def_users[d]):
                out[v][u] = out[v].get(u, 0.0) + DATA
        for u in bits(g.controls[v]):
            out[v][u] = out[v].get(u, 0.0) + CONTROL
    return [dict(sorted(m.items())) for m in out]


def outputs(body: Sequence[Statement], denylist: Denylist) -> list[bool]:
    return [is_effect(s) and not (s.kind == "call" and denylist.matches(s.callee or "")) for s in body]


def _block(edges: Sequence[dict[int, float]], members: list[int], rhs: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """Solves x = rhs + edges x over members; and the diagonal of (1 - edges) inverted."""
    at = {v: i for i, v in enumerate(members)}
    q = np.zeros((len(members), len(members)))
    for v, i in at.items():
        for u, w in edges[v].items():
            if u in at:
                q[i, at[u]] = w
    if len(members) <= EXACT:
        try:
            inverse = np.linalg.inv(np.eye(len(members)) - q)
            if np.isfinite(inverse).all() and np.abs(inverse).max() < 1e12:
                return inverse @ rhs, np.diag(inverse)
        except np.linalg.LinAlgError:
            pass
    x = rhs.copy()
    for _ in range(SWEEPS):
        new = rhs + DAMPING * (q @ x)
        moved, x = np.abs(new - x).max(), new
        if moved < SETTLED:
            break
    return x, None


def absorbing(body: Sequence[Statement], g: Graph, denylist: Denylist) -> list[float]:
    """The share of what is delivered to outputs that is lost without a statement."""
    omega, n = outputs(body, denylist), g.n
    if not any(omega):
        return [0.0] * n
    edges = weighted_edges(g)
    back: list[list[int]] = [[] for _ in range(n)]
    for v in range(n):
        for u in edges[v]:
            back[u].append(v)
    live = closure(back, [v for v in range(n) if omega[v]])
    inner = [v for v in range(n) if live[v] and not omega[v]]
    if not inner:
        return [1.0 if o else 0.0 for o in omega]
    at = {v: i for i, v in enumerate(inner)}
    q: list[dict[int, float]] = []
    share: list[dict[int, float]] = []
    for v in inner:
        total = sum(edges[v].values())
        q.append({at[u]: w / total for u, w in edges[v].items() if u in at and not omega[u]})
        share.append({u: w / total for u, w in edges[v].items() if omega[u]})
    q_back: list[dict[int, float]] = [{} for _ in inner]
    for i, m in enumerate(q):
        for j, w in m.items():
            q_back[j][i] = w
    of, comps = strong_components([list(m) for m in q])
    through, arrive, stay = np.zeros(len(inner)), np.zeros(len(inner)), np.ones(len(inner))
    for c, members in enumerate(comps):
        rhs = [sum(share[i].values()) + sum([w * through[j] for j, w in q[i].items() if of[j] != c]) for i in members]
        if len(members) == 1 and members[0] not in q[members[0]]:
            through[members[0]] = rhs[0]
        else:
            x, diagonal = _block(q, members, np.array(rhs))
            through[members] = x
            if diagonal is not None:
                stay[members] = np.maximum(diagonal, 1.0)
    for c in reversed(range(len(comps))):
        members = comps[c]
        rhs = [1.0 + sum([w * arrive[j] for j, w in q_back[i].items() if of[j] != c]) for i in members]
        if len(members) == 1 and members[0] not in q[members[0]]:
            arrive[members[0]] = rhs[0]
        else:
            arrive[members] = _block(q_back, members, np.array(rhs))[0]
    delivered: dict[int, float] = {}
    for i, m in enumerate(share):
        for o, p in m.items():
            delivered[o] = delivered.get(o, 0.0) + arrive[i] * p
    total = sum(delivered.values())
    if not (total > 0 and math.isfinite(total)):
        return [0.0] * n
    out = [min(max(delivered.get(v, 0.0) / total, 0.0), 1.0) if omega[v] else 0.0 for v in range(n)]
    for v, i in at.items():
        x = arrive[i] * through[i] / stay[i] / total
        out[v] = min(max(x, 0.0), 1.0) if math.isfinite(x) else 0.0
    return out


def either(xs) -> float:
    """The probability that one of independent events happens at least."""
    return -math.expm1(sum(math.log1p(-x) for x in xs))


def entries(g: Graph) -> set[int]:
    """Statements that depend on none, and the components that nothing outside feeds and that hold no such one."""
    found = {v for v in range(g.n) if not g.dep_preds[v]}
    of, comps = g.components
    for c, members in enumerate(comps):
        if not any(of[p] != c for v in members for p in g.dep_preds[v]) and not found & set(members):
            found |= set(members)
    return found


def reliability(body: Sequence[Statement], g: Graph) -> list[float]:
    """Birnbaum importance: how far a statement's survival sways that of a path from entries to effects."""
    n, p = g.n, EDGE_SURVIVES
    of, comps = g.components
    out = [is_effect(s) for s in body]
    first = entries(g)
    rho = [1.0 if o else 0.0 for o in out]
    lost = [math.log1p(-(p * r)) for r in rho]
    cyclic = [len(members) > 1 or members[0] in g.dep_succs[members[0]] for members in comps]

    for members, again in zip(comps, cyclic):
        inner = [v for v in members if not out[v]]
        for _ in range(ROUNDS if again else 1):
            moved = False
            for v in inner:
                r = -math.expm1(sum([lost[s] for s in g.dep_succs[v]]))
                if r != rho[v]:
                    moved = True
                rho[v], lost[v] = r, math.log1p(-(p * r))
            if not moved:  # nor would further rounds
                break
    source = either(p * rho[e] for e in first)
    up = [0.0] * n
    for members, again in zip(reversed(comps), reversed(cyclic)):
        for _ in range(ROUNDS if again else 1):
            moved = False
            for v in members:
                keep = 1 - p * rho[v]
                u = (p * (1 - source) / keep if v in first else 0.0) + sum([up[k] * p * (1 - rho[k]) / keep for k in g.dep_preds[v]])
                if u != up[v]:
                    up[v], moved = u, True
            if not moved:
                break
    return [min(max(2 * rho[v] * up[v], 0.0), 1.0) for v in range(n)]


def log_scale(b: Sequence[float]) -> list[float]:
    """Positive values between their least and largest logarithm; 0 stays, all equal are 1."""
    logs = [math.log(x) for x in b if x > 0]
    if not logs:
        return [0.0] * len(b)
    low, span = min(logs), max(logs) - min(logs)
    return [0.0 if x <= 0 else 1.0 if span <= 0 else min(max((math.log(x) - low) / span, 0.0), 1.0) for x in b]


def unit_scale(xs: Sequence[float]) -> list[float]:
    """Values between their least and largest; all equal are 0.5."""
    if not len(xs):
        return []
    low, high = min(xs), max(xs)
    if high - low < 2.220446049250313e-16:
        return [0.5] * len(xs)
    return [min(max((x - low) / (high - low), 0.0), 1.0) for x in xs]


def trophic_levels(g: Graph) -> list[float]:
    """1 without sources; else 1 more than the weighted mean level of what a statement depends on."""
    into: list[dict[int, float]] = [{} for _ in range(g.n)]
    for v in range(g.n):
        for d in bits(g.uses_defs[v]):
            u = g.def_node[d]
            if u != v:
                into[v][u] = into[v].get(u, 0.0) + DATA
        for u in bits(g.ctrl_deps[v] & ~(1 << v)):
            into[v][u] = into[v].get(u, 0.0) + CONTROL
    succ: list[list[int]] = [[] for _ in range(g.n)]
    for v in range(g.n):
        for u in into[v]:
            succ[u].append(v)
    _, comps = strong_components(succ)
    level = [0.0] * g.n
    for members in reversed(comps):
        inside = set(members)
        if len(members) == 1:
            v = members[0]
            total = sum(into[v].values())
            level[v] = 1.0 + sum(w * level[u] for u, w in into[v].items()) / total if total > 0 else 1.0
        elif not any(u not in inside for v in members for u in into[v]):
            for v in members:
                level[v] = 1.0
        else:
            at = {v: i for i, v in enumerate(members)}
            m, rhs = np.zeros((len(at), len(at))), np.zeros(len(at))
            for v, i in at.items():
                for u, w in into[v].items():
                    m[i, i] += w
                    rhs[i] += w
                    if u in at:
                        m[i, at[u]] -= w
                    else:
                        rhs[i] += w * level[u]
            try:
                x = np.linalg.solve(m, rhs)
            except np.linalg.LinAlgError:
                x = np.ones(len(at))
            for v, i in at.items():
                level[v] = float(x[i])
    return level


def stream_orders(g: Graph) -> list[int]:
    """1 at a spring; else the largest order upstream, and 1 more where two components or more have it."""
    succ: list[list[int]] = [[] for _ in range(g.n)]
    for v in range(g.n):
        for u in g.data_preds[v]:
            if u != v:
                succ[u].append(v)
    of, comps = strong_components(succ)
    above: list[set[int]] = [set() for _ in comps]
    for v in range(g.n):
        for s in succ[v]:
            if of[s] != of[v]:
                above[of[s]].add(of[v])
    order = [1] * len(comps)
    for c in reversed(range(len(comps))):
        if above[c]:
            up = [order[a] for a in above[c]]
            order[c] = max(up) + (up.count(max(up)) > 1)
    return [order[of[v]] for v in range(g.n)]
