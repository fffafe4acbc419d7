"""The analyses of many small functions at once: sets of statements are the bits of 32-bit numbers, a vector over the
functions for each statement's place. The results are those of ``graph`` and ``tiers``, value by value; those take a
function each, and whatever doesn't fit here: more than 31 statements, several definitions in one, many uses.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from cairn.functions.denylist import Denylist
from cairn.operators.tiers import BOUNDARY, CORE, CORE_INFLUENCE, INERT, PLUMBING, Weights

#: Functions of up to so many statements go together; the last bit is the virtual exit.
SIZES, USES = (4, 8, 16, 31), 8
_U = np.uint32
_EXIT = _U(1 << 31)
_ZERO, _ONE = _U(0), _U(1)


def _bit(v: int) -> np.uint32:
    return _U(1 << v)


def _spread(flag: np.ndarray) -> np.ndarray:
    """All bits where ``flag`` holds, else none."""
    return (-flag.astype(np.int32)).view(_U)


def lengths(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)


def classes(nodes: pa.ListArray, entry: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """(numbers of the functions of each size that can be taken together, of the others); empty ones are in none."""
    n = lengths(nodes)
    flat = nodes.flatten()
    first = np.cumsum(n) - n
    fits = (n > 0) & (n <= SIZES[-1]) & (entry >= 0) & (entry < n)

    def spoil(rows: np.ndarray) -> None:
        fits[np.searchsorted(first, rows, "right") - 1] = False

    spoil(np.flatnonzero(lengths(flat.field("defs")) > 1))
    spoil(np.flatnonzero(lengths(flat.field("uses")) > USES))
    to = lengths(flat.field("succs"))
    at = np.repeat(np.arange(len(flat)), to)
    s = flat.field("succs").flatten().to_numpy(zero_copy_only=False)
    spoil(at[~((s >= 0) & (s < np.repeat(np.repeat(n, n), to)))])
    size = np.searchsorted(SIZES, n)
    return [np.flatnonzero(fits & (size == i)) for i in range(len(SIZES))], np.flatnonzero((n > 0) & ~fits)


class Functions:
    """Facts of the functions of an Arrow list array of statements; each is an (N, functions) array."""

    def __init__(self, nodes: pa.ListArray, entry: np.ndarray, denylist: Denylist):
        self.n = lengths(nodes)
        self.count, self.size = len(self.n), int(self.n.max(initial=0))
        self.entry, self.denylist = entry, denylist
        self.flat = nodes.flatten()
        self.valid = np.arange(self.size)[:, None] < self.n  # (N, functions)
        self.fn = np.repeat(np.arange(self.count), self.n)
        self.nid = np.arange(len(self.flat)) - np.repeat(np.cumsum(self.n) - self.n, self.n)
        self.all = _U(0xFFFFFFFF) >> (32 - self.n).astype(_U)

    # -- forms

    def grid(self, flat: np.ndarray, fill: object = 0) -> np.ndarray:
        """A value a statement as (N, functions)."""
        out = np.full((self.size, self.count), fill, flat.dtype)
        out[self.nid, self.fn] = flat
        return out

    def rows(self, grid: np.ndarray) -> np.ndarray:
        """The values of (N, functions), a function's statements together."""
        return grid[self.nid, self.fn]

    def mask(self, grid: np.ndarray) -> np.ndarray:
        """A flag a statement as a set a function."""
        out = np.zeros(self.count, _U)
        for v in range(self.size):
            out |= grid[v].astype(_U) << _U(v)
        return out

    def flags(self, mask: np.ndarray) -> np.ndarray:
        return np.stack([(mask >> _U(v) & _ONE).astype(bool) for v in range(self.size)]) if self.size else np.zeros((0, self.count), bool)

    def transposed(self, sets: np.ndarray) -> np.ndarray:
        out = np.zeros_like(sets)
        for a in range(self.size):
            if sets[a].any():
                for c in range(self.size):
                    out[c] |= (sets[a] >> _U(c) & _ONE) << _U(a)
        return out

    def members(self, sets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(size of each row's set, the rows and members in order)."""
        packed = np.ascontiguousarray(self.rows(sets), "<u4").view(np.uint8).reshape(-1, 4)
        each = np.unpackbits(packed, axis=1, bitorder="little")
        row, member = np.nonzero(each)
        return each.sum(1, dtype=np.int64), row, member

    def lists(self, sets: np.ndarray, values: Callable[[np.ndarray, np.ndarray], pa.Array] | None = None) -> pa.Array:
        """Each row's set as a list, of ``values`` of (rows, members) if given."""
        size, row, member = self.members(sets)
        offsets = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32))
        return pa.ListArray.from_arrays(offsets, pa.array(member.astype(np.int32)) if values is None else values(row, member))

    # -- the statements

    def text(self, name: str) -> tuple[np.ndarray, list[str]]:
        """(number of each row's text, -1 for null; the texts)."""
        d = self.flat.field(name).dictionary_encode() if not pa.types.is_null(self.flat.field(name).type) else pa.nulls(len(self.flat), pa.string()).dictionary_encode()
        return pc.fill_null(d.indices, -1).to_numpy(zero_copy_only=False), d.dictionary.to_pylist()

    @cached_property
    def kinds(self) -> tuple[np.ndarray, list[str]]:
        return self.text("kind")

    @cached_property
    def callees(self) -> tuple[np.ndarray, list[str]]:
        return self.text("callee")

    def kind(self, *names: str) -> np.ndarray:
        code, texts = self.kinds
        return np.isin(code, [i for i, t in enumerate(texts) if t in names])

    @cached_property
    def n_defs(self) -> np.ndarray:
        return lengths(self.flat.field("defs"))

    @cached_property
    def n_uses(self) -> np.ndarray:
        return lengths(self.flat.field("uses"))

    @cached_property
    def has_def(self) -> np.ndarray:
        return self.grid(self.n_defs > 0, False)

    @cached_property
    def var(self) -> np.ndarray:
        """Each row's defined variable; -1 where there is none."""
        out = np.full(len(self.flat), -1, np.int64)
        out[self.n_defs > 0] = self.flat.field("defs").flatten().to_numpy(zero_copy_only=False)
        return out

    @cached_property
    def n_succs(self) -> np.ndarray:
        return self.grid(lengths(self.flat.field("succs")))

    @cached_property
    def succs(self) -> np.ndarray:
        to = lengths(self.flat.field("succs"))
        at = np.repeat(np.arange(len(self.flat)), to)
        out = np.zeros((self.size, self.count), _U)
        np.bitwise_or.at(out, (self.nid[at], self.fn[at]), _ONE << self.flat.field("succs").flatten().to_numpy(zero_copy_only=False).astype(_U))
        return out

    @cached_property
    def edges(self) -> list[tuple[int, int, np.ndarray]]:
        """(from, to, all bits where a function has the edge), of edges that one has."""
        out = []
        for u in range(self.size):
            union = int(np.bitwise_or.reduce(self.succs[u], initial=_ZERO))
            out += [(u, v, _spread(self.succs[u] >> _U(v) & _ONE)) for v in range(self.size) if union >> v & 1]
        return out

    @cached_property
    def preds(self) -> np.ndarray:
        return self.transposed(self.succs)

    # -- control

    @cached_property
    def reached(self) -> np.ndarray:
        seen = _ONE << self.entry.astype(_U)
        while True:
            was = seen.copy()
            for u, v, m in self.edges:
                seen |= (seen >> _U(u) & _ONE) << _U(v) & m
            if (seen == was).all():
                return seen

    @cached_property
    def dominators(self) -> np.ndarray:
        full = self.reached
        here = [_spread(full >> _U(v) & _ONE) for v in range(self.size)]
        root = [_spread(self.entry == v) for v in range(self.size)]
        dom = np.stack([(full & ~root[v] | root[v] & _bit(v)) & here[v] for v in range(self.size)])
        into: list[list[tuple[int, np.ndarray]]] = [[] for _ in range(self.size)]
        for u, v, m in self.edges:
            into[v].append((u, ~(m & here[u])))
        changed = True
        while changed:
            changed = False
            for v in range(self.size):
                new = full
                for u, out in into[v]:
                    new = new & (dom[u] | out)
                new = (new | _bit(v)) & here[v] & ~root[v] | dom[v] & root[v]
                if (new != dom[v]).any():
                    dom[v], changed = new, True
        return dom

    @cached_property
    def post_dominators(self) -> np.ndarray:
        """With the exit."""
        ends = self.mask(self.valid & (self.succs == 0))
        back = ends.copy()
        while True:
            was = back.copy()
            for u, v, m in reversed(self.edges):
                back |= (back >> _U(v) & _ONE) << _U(u) & m
            if (back == was).all():
                break
        leaves = ends | self.all & ~back
        full = self.all | _EXIT
        pdom = np.stack([full] * self.size)
        out: list[list[tuple[int, np.ndarray]]] = [[] for _ in range(self.size)]
        for u, v, m in self.edges:
            out[u].append((v, ~m))
        leave = [np.where(leaves >> _U(v) & _ONE, _EXIT, _U(0xFFFFFFFF)) for v in range(self.size)]
        changed = True
        while changed:
            changed = False
            for v in reversed(range(self.size)):
                new = full & leave[v]
                for s, absent in out[v]:
                    new = new & (pdom[s] | absent)
                new = new | _bit(v)
                if (new != pdom[v]).any():
                    pdom[v], changed = new, True
        return pdom

    @cached_property
    def controls(self) -> np.ndarray:
        held = np.zeros((self.size, self.count), _U)
        pdom = self.post_dominators
        for u, v, m in self.edges:
            held[u] |= pdom[v] & m
        for a in range(self.size):
            held[a] &= ~(pdom[a] & ~_bit(a)) & ~_EXIT & _spread(self.n_succs[a] >= 2)
        return held

    @cached_property
    def ctrl_deps(self) -> np.ndarray:
        return self.transposed(self.controls)

    @cached_property
    def governed(self) -> np.ndarray:
        return np.stack([np.bitwise_count(self.controls[v] & ~_bit(v)) for v in range(self.size)]).astype(np.int64)

    @cached_property
    def control_weight(self) -> np.ndarray:
        return self.governed / self.n

    @cached_property
    def loops(self) -> np.ndarray:
        """By header, the bodies' sets."""
        tails = np.zeros((self.size, self.count), _U)
        for u, v, m in self.edges:
            tails[v] |= m & (_bit(u) if u == v else (self.dominators[u] >> _U(v) & _ONE) << _U(u))
        out = np.zeros((self.size, self.count), _U)
        for h in range(self.size):
            some = np.flatnonzero(tails[h])
            if not len(some):
                continue
            preds, body = self.preds[:, some], tails[h, some] | _bit(h)
            while True:
                was = body.copy()
                for x in range(self.size):
                    if x != h:
                        body |= preds[x] & _spread(body >> _U(x) & _ONE)
                if (body == was).all():
                    break
            out[h, some] = body
        return out

    @cached_property
    def loop_depth(self) -> np.ndarray:
        out = np.zeros((self.size, self.count), np.int64)
        for h in range(self.size):
            if self.loops[h].any():
                for v in range(self.size):
                    out[v] += self.loops[h] >> _U(v) & _ONE
        return out

    # -- data: a statement defines one variable at most, so that a definition is its statement

    @cached_property
    def kill(self) -> np.ndarray:
        """Of each statement, those that define its variable."""
        var, out = self.grid(self.var, -1), np.zeros((self.size, self.count), _U)
        for v in range(self.size):
            for u in range(self.size):
                out[v] |= ((var[u] == var[v]) & self.has_def[u] & self.has_def[v]).astype(_U) << _U(u)
        return out

    @cached_property
    def reaching(self) -> np.ndarray:
        shape = (self.size, self.count)
        into, out = np.zeros(shape, _U), np.zeros(shape, _U)
        here = [_spread(self.reached >> _U(v) & _ONE) for v in range(self.size)]
        gen = [_spread(self.has_def[v]) & _bit(v) for v in range(self.size)]
        preds: list[list[tuple[int, np.ndarray]]] = [[] for _ in range(self.size)]
        for u, v, m in self.edges:
            preds[v].append((u, m & here[v]))
        changed = True
        while changed:
            changed = False
            for v in range(self.size):
                x = np.zeros(self.count, _U)
                for u, m in preds[v]:
                    x |= out[u] & m
                y = (x & ~self.kill[v] | gen[v]) & here[v]
                if (x != into[v]).any() or (y != out[v]).any():
                    into[v], out[v], changed = x, y, True
        return into

    @cached_property
    def data_preds(self) -> np.ndarray:
        var, uses = self.grid(self.var, -1), np.zeros((self.size, self.count), _U)
        n = self.n_uses
        values, first = self.flat.field("uses").flatten().to_numpy(zero_copy_only=False), np.cumsum(n) - n
        for k in range(int(n.max(initial=0))):
            has = n > k
            used = np.zeros(len(n), np.int64)
            used[has] = values[first[has] + k]
            used, has = self.grid(used), self.grid(has, False)
            for v in range(self.size):
                for u in range(self.size):
                    uses[v] |= (has[v] & self.has_def[u] & (var[u] == used[v])).astype(_U) << _U(u)
        return uses & self.reaching

    @cached_property
    def users(self) -> np.ndarray:
        return self.transposed(self.data_preds)

    @cached_property
    def loop_carried(self) -> np.ndarray:
        return self.flags(np.bitwise_or.reduce(self.loops & self.reaching, axis=0))

    # -- dependence

    @cached_property
    def dep_preds(self) -> np.ndarray:
        return self.data_preds | self.ctrl_deps

    @cached_property
    def dep_succs(self) -> np.ndarray:
        return self.transposed(self.dep_preds)

    @cached_property
    def below(self) -> np.ndarray:
        """What depends on each statement, over any number of steps, with itself."""
        out = np.stack([self.dep_succs[v] | _bit(v) for v in range(self.size)])
        for k in range(self.size):
            for v in range(self.size):
                if v != k:
                    out[v] |= out[k] & _spread(out[v] >> _U(k) & _ONE)
        return out

    @cached_property
    def above(self) -> np.ndarray:
        return self.transposed(self.below)

    @cached_property
    def influence(self) -> np.ndarray:
        return np.bitwise_count(self.below).astype(np.int64) - 1

    @cached_property
    def depends_on(self) -> np.ndarray:
        return np.bitwise_count(self.above).astype(np.int64) - 1

    @cached_property
    def influence_fraction(self) -> np.ndarray:
        return np.where(self.n > 1, self.influence / np.maximum(self.n - 1, 1), 0.0)

    @cached_property
    def least_of_component(self) -> np.ndarray:
        same = self.below & self.above
        return np.bitwise_count((same & (~same + _ONE)) - _ONE).astype(np.int64)

    @cached_property
    def first(self) -> np.ndarray:
        """Statements of components that nothing outside feeds."""
        return (self.above & ~self.below) == 0

    # -- tiers

    @cached_property
    def denylisted(self) -> np.ndarray:
        code, texts = self.callees
        found = np.array([*(self.denylist.matches(t) for t in texts), self.denylist.matches("")])[code]
        return self.grid(self.kind("call") & found, False)

    @cached_property
    def hard(self) -> np.ndarray:
        return self.grid(self.kind("return", "throw", "state_write"), False)

    @cached_property
    def effect(self) -> np.ndarray:
        code, texts = self.text("opacity")
        loud = ~np.isin(code, [i for i, t in enumerate(texts) if t == "inert"])
        return self.hard | self.grid(self.kind("call") & loud, False)

    @cached_property
    def structural(self) -> np.ndarray:
        return self.grid(self.kind("pure") & (self.n_defs == 0) & (self.n_uses == 0), False)

    @cached_property
    def useful(self) -> np.ndarray:
        seen = self.mask(self.has_def | self.effect)
        call = self.grid(self.kind("call"), False) & ~self.denylisted
        unseen = np.stack([(self.users[v] & ~_bit(v) & seen) == 0 for v in range(self.size)])
        return (self.below & self.mask(self.hard | call & unseen)) != 0

    @cached_property
    def feeds(self) -> np.ndarray:
        out = self.mask(self.denylisted)
        some = np.flatnonzero(out)
        mask, preds = out[some], self.data_preds[:, some]
        while len(some):
            was = mask.copy()
            for v in range(self.size):
                mask |= preds[v] & _spread(mask >> _U(v) & _ONE)
            if (mask == was).all():
                break
        out[some] = mask
        return self.flags(out)

    @cached_property
    def inert_backward(self) -> np.ndarray:
        return self.denylisted | ~self.useful & self.feeds

    @cached_property
    def inert(self) -> np.ndarray:
        mask = self.mask(self.inert_backward)
        for v in range(self.size):
            may = ~self.has_def[v] & ~self.effect[v] & (self.data_preds[v] != 0)
            mask |= (may & (self.data_preds[v] & ~mask == 0)).astype(_U) << _U(v)
        return self.flags(mask)

    @cached_property
    def distance(self) -> np.ndarray:
        """-1 for none."""
        out = np.full((self.size, self.count), -1, np.int64)
        free = self.mask(~self.inert & self.valid)
        front, far = self.mask(self.effect & ~self.inert), 0
        while front.any():
            free &= ~front
            out[self.flags(front)] = far
            new = np.zeros(self.count, _U)
            for v in range(self.size):
                new |= self.dep_preds[v] & _spread(front >> _U(v) & _ONE)
            front, far = new & free, far + 1
        return out

    @cached_property
    def nearest(self) -> np.ndarray:
        """The effect whose search met each statement first, -1 for none: nearer ones before, then as queued."""
        out = np.where(self.distance == 0, np.arange(self.size)[:, None], -1)
        place = np.where(self.distance == 0, np.arange(self.size)[:, None], 1 << 20)  # within its distance's queue
        for far in range(1, int(self.distance.max(initial=0)) + 1):
            key = np.full((self.size, self.count), 1 << 20)
            for v in range(self.size):
                for p in range(self.size):
                    hit = (self.distance[v] == far - 1) & (self.distance[p] == far) & (self.dep_preds[v] >> _U(p) & _ONE).astype(bool)
                    better = hit & (place[v] * 32 + p < key[p])
                    key[p] = np.where(better, place[v] * 32 + p, key[p])
                    out[p] = np.where(better, out[v], out[p])
            now = self.distance == far
            for p in range(self.size):
                rank = sum((now[u] & (key[u] < key[p])).astype(np.int64) for u in range(self.size))
                place[p] = np.where(now[p], rank, place[p])
        return out

    @cached_property
    def _core(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.grid(self.kind("branch"), False) & (self.governed > 0), self.loop_carried, self.influence_fraction >= CORE_INFLUENCE

    @cached_property
    def tier(self) -> np.ndarray:
        return np.where(self.inert, INERT, np.where(np.logical_or.reduce(self._core), CORE, np.where(self.effect, BOUNDARY, PLUMBING)))

    @cached_property
    def score(self) -> np.ndarray:
        w = Weights()
        inside = np.where(self.valid, self.influence, 0), np.where(self.valid, self.depends_on, 0)
        tops = [x.max(0, initial=0) for x in inside]
        a, b = (np.where(top > 0, k * x / np.maximum(top, 1), 0.0) for k, x, top in zip((w.influence, w.dependency), inside, tops))
        near = np.where(self.distance >= 0, w.proximity / (self.distance + 1.0 + (self.distance < 0)), 0.0)
        effect = w.effect * np.where(self.hard, 1.0, np.where(self.grid(self.kind("call"), False), 0.6, 0.0))
        total = a + b + near + w.control * self.control_weight + w.loop_depth * np.minimum(self.loop_depth, 4) / 4 + effect
        return np.where(self.inert, 0.0, np.minimum(np.maximum(total, 0.0), 1.0))

    def reasons(self) -> pa.Array:
        """As ``Tiering._why``: what decides, loops, what depends on it, and then one of the others."""
        rows, n = self.rows, self.n[self.fn]
        inert, effect, distance = rows(self.inert), rows(self.effect), rows(self.distance)
        branch, carried, wide = (rows(c) & ~inert for c in self._core)
        rest = ~inert & ~effect
        step, none = rest & (distance > 0), rest & (distance <= 0) & ~(branch | carried | wide)
        kind, kinds = self.kinds
        callee, callees = self.callees
        target, targets = self.text("target")
        is_call, is_write = self.kind("call"), self.kind("state_write")
        deny = rows(self.denylisted)
        base = max(len(callees), len(targets)) + 1
        named = np.where(is_call, callee, np.where(is_write, target, -1)) + 1  # 0: no name
        name = lambda k, i: (callees if kinds[k] == "call" else targets)[i - 1] if i else None
        label = kind * base + named
        governed, depth, influence = rows(self.governed), rows(self.loop_depth), rows(self.influence)
        at = rows(self.nearest) + (np.cumsum(self.n) - self.n)[self.fn] if step.any() else np.zeros(len(n), np.int64)

        def effect_text(c: int) -> str:
            to = name(c // base, c % base)
            return f"{kinds[c // base]} -> {to}" if to else kinds[c // base]

        def step_text(c: int) -> str:
            c, d = divmod(c, 32)
            to, what = name(c // base, c % base) or "", kinds[c // base]
            near = {"return": "return value", "throw": "throw", "state_write": f"state write {to}", "call": f"opaque call {to}"}.get(what, "effect")
            return f"reaches {near} in {d} dependence step(s)"

        parts = (
            (inert, INERT, np.where(deny, callee + 1, -1), lambda c: "every use of this value ends in a denylisted call" if c < 0 else f"denylisted call {callees[c - 1] if c else ''}"),
            (branch, CORE, governed * 32 + n, lambda c: f"branch predicate governing {c // 32} instructions ({100 * (c // 32 / (c % 32)):.0f}% of body)"),
            (carried, CORE, depth, lambda c: f"loop-carried definition at nesting depth {c}"),
            (wide, CORE, influence * 32 + n, lambda c: f"{c // 32} instructions depend on this ({100 * (c // 32 / (c % 32 - 1)):.0f}% of the body)"),
            (effect & ~inert, BOUNDARY, label, effect_text),
            (step, PLUMBING, label[at] * 32 + np.maximum(distance, 0), step_text),
            (none, PLUMBING, label, lambda c: "result reaches no effect"),
        )
        at_row, order, tier, text, texts = [], [], [], [], []
        for i, (where, t, code, write) in enumerate(parts):
            r = np.flatnonzero(where)
            seen, which = np.unique(code[r], return_inverse=True)
            at_row.append(r), order.append(np.full(len(r), i)), tier.append(np.full(len(r), t, np.int32)), text.append(which + len(texts))
            texts += [write(int(c)) for c in seen]
        at_row, order = np.concatenate(at_row), np.concatenate(order)
        by = np.lexsort((order, at_row))
        struct = pa.StructArray.from_arrays([pa.array(np.concatenate(tier)[by]), pa.array(texts, pa.string()).take(pa.array(np.concatenate(text)[by]))], ["tier", "text"])
        ends = np.cumsum(np.bincount(at_row, minlength=len(n)))
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), struct)


def _ints(name: str) -> Callable[[Functions], pa.Array]:
    return lambda x: pa.array(x.rows(getattr(x, name)).astype(np.int32))


def _plain(name: str) -> Callable[[Functions], pa.Array]:
    return lambda x: pa.array(x.rows(getattr(x, name)))


def _lists(name: str) -> Callable[[Functions], pa.Array]:
    return lambda x: x.lists(getattr(x, name))


def _distance(x: Functions) -> pa.Array:
    d = x.rows(x.distance)
    return pa.array(d.astype(np.int32), mask=d < 0)


def _variables(x: Functions) -> pa.Array:
    first = (np.cumsum(x.n) - x.n)[x.fn]
    return x.lists(x.reaching, lambda row, member: pa.array(x.var[first[row] + member]))


#: Columns by name, for those of ``kernel.FACTS`` that are found together.
FACTS: dict[str, Callable[[Functions], pa.Array]] = {
    **{c: _ints(c) for c in ("governed", "loop_depth", "influence", "depends_on", "tier")},
    **{c: _plain(c) for c in ("control_weight", "loop_carried", "influence_fraction", "effect", "structural", "denylisted", "useful", "inert_backward", "inert", "score")},
    **{c: _lists(c) for c in ("preds", "dominators", "ctrl_deps", "data_preds", "dep_succs")},
    "post_dominators": lambda x: x.lists(x.post_dominators & ~_EXIT),
    "reaching_nodes": _lists("reaching"),
    "reaching_vars": _variables,
    "scc": _ints("least_of_component"),
    "entry": _plain("first"),
    "feeds_denylist": _plain("feeds"),
    "distance": _distance,
    "reasons": Functions.reasons,
}
