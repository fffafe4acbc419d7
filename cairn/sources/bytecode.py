"""Python sources lowered to the representation through the interpreter's own bytecode, in one Arrow stage.

Works on the running interpreter (3.12 to 3.14). Every instruction is a statement. The value stack is
followed as far as names of callees and the flow of values need it; instructions that stand for two are
taken as both. Exceptional edges are left out: handlers stay unreachable.
"""

from __future__ import annotations

import dis
from collections.abc import Iterator
from types import CodeType

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.plans.shared import ship_package

LOCAL, GLOBAL, CELL, STACK = 1 << 24, 2 << 24, 3 << 24, 4 << 24
_WRITES = {"STORE_GLOBAL": "global {}", "STORE_NAME": "global {}", "STORE_DEREF": "cell {}", "STORE_ATTR": "attr .{}", "STORE_SUBSCR": "subscript", "STORE_SLICE": "subscript", "YIELD_VALUE": "<yielded value>", "SEND": "<yielded value>"}
_LEAVES = {"RETURN_VALUE": "return", "RETURN_CONST": "return", "RAISE_VARARGS": "throw", "RERAISE": "throw"}
_POPS = {"POP_TOP": 1, "STORE_ATTR": 2, "STORE_SUBSCR": 3, "STORE_SLICE": 4, "STORE_GLOBAL": 1, "STORE_NAME": 1, "STORE_DEREF": 1, "RETURN_VALUE": 1, "BINARY_OP": 2, "BINARY_SUBSCR": 2, "BINARY_SLICE": 3, "COMPARE_OP": 2, "IS_OP": 2, "CONTAINS_OP": 2, "GET_ITER": 1, "LOAD_ATTR": 1, "YIELD_VALUE": 1, "TO_BOOL": 1, "UNARY_NOT": 1, "UNARY_NEGATIVE": 1, "UNARY_INVERT": 1, "UNPACK_SEQUENCE": 1, "LIST_APPEND": 1, "SET_ADD": 1, "MAP_ADD": 2, "LIST_EXTEND": 1, "MAKE_FUNCTION": 1, "FORMAT_SIMPLE": 1, "CONVERT_VALUE": 1}


_GATHERS = frozenset(f"BUILD_{x}" for x in "STRING SET TUPLE LIST".split())


class _Stack:
    """Values by number, with the source name of each where it has one."""

    def __init__(self) -> None:
        self.items: list[tuple[int, str | None]] = []
        self.made = 0

    def pop(self, n: int) -> list[tuple[int, str | None]]:
        n = min(n, len(self.items))
        out = self.items[len(self.items) - n :]
        del self.items[len(self.items) - n :]
        return out

    def push(self, name: str | None = None) -> int:
        self.items.append((STACK + self.made, name))
        self.made += 1
        return self.items[-1][0]


def _effect(ins: dis.Instruction) -> int:
    try:
        return dis.stack_effect(ins.opcode, ins.arg, jump=False)
    except ValueError:
        return 0


def lower(code: CodeType) -> dict | None:
    """One code object as a function of the wire's form."""
    instructions = [i for i in dis.get_instructions(code) if i.opname != "CACHE"]
    if not instructions:
        return None
    place = {i.offset: k for k, i in enumerate(instructions)}
    jumps = set(dis.hasjrel) | set(dis.hasjabs) | set(getattr(dis, "hasjump", ()))
    stack, nodes, line = _Stack(), [], None
    for k, ins in enumerate(instructions):
        op, arg, value = ins.opname, ins.arg or 0, ins.argval
        defs: list[int] = []
        uses: list[int] = []
        kind: dict[str, str] = {"t": "pure"}

        def take(n: int) -> list[tuple[int, str | None]]:
            got = stack.pop(n)
            uses.extend(v for v, _ in got)
            return got

        slots = [] if "FAST" not in op else ([(arg >> 4, arg & 15)] if op.count("FAST") == 2 else [(arg,)])
        if slots:
            names = value if isinstance(value, tuple) else (value,)
            for verb, var, name in zip([w for w in op.split("_") if w in ("LOAD", "STORE", "DELETE")] * 2, slots[0], names * 2):
                if verb == "LOAD":
                    uses.append(LOCAL + var)
                    defs.append(stack.push(str(name)))
                else:
                    if verb == "STORE":
                        take(1)
                    defs.append(LOCAL + var)
        elif op in ("LOAD_GLOBAL", "LOAD_NAME", "LOAD_DEREF", "LOAD_CLOSURE"):
            base, number = (CELL, arg) if op in ("LOAD_DEREF", "LOAD_CLOSURE") else (GLOBAL, arg >> 1 if op == "LOAD_GLOBAL" else arg)
            uses.append(base + number)
            named = str(value)
            defs.append(stack.push(named))
            if op == "LOAD_GLOBAL" and arg & 1:
                defs.append(stack.push())
        elif op in ("LOAD_ATTR", "LOAD_METHOD"):
            owner = take(1)
            root = owner[0][1] if owner else None
            defs.append(stack.push(f"{root}.{value}" if root else str(value)))
            if _effect(ins) > 0:
                defs.append(stack.push())
        elif op in ("CALL", "CALL_KW", "CALL_FUNCTION_EX"):
            got = take(arg + 2 + (op == "CALL_KW") if op != "CALL_FUNCTION_EX" else 1 - _effect(ins))
            callee = next((n for _, n in got[:2] if n), None)
            kind = dict(t="call", callee=callee or "<dynamic>", opacity="opaque")
            defs.append(stack.push())
        elif op == "COPY":
            at = stack.items[-arg] if 0 < arg <= len(stack.items) else (None, None)
            uses += [at[0]] if at[0] is not None else []
            defs.append(stack.push(at[1]))
        elif op == "SWAP":
            if 1 < arg <= len(stack.items):
                stack.items[-1], stack.items[-arg] = stack.items[-arg], stack.items[-1]
        elif op in ("LOAD_CONST", "PUSH_NULL", "LOAD_SMALL_INT"):
            defs.append(stack.push())
        else:
            net = _effect(ins)
            pops = arg if op in _GATHERS else 2 * arg if op == "BUILD_MAP" else _POPS.get(op, 1 if op.startswith("POP_JUMP") else max(-net, 0))
            take(pops)
            defs += [stack.push() for _ in range(max(pops + net, 0))]
            if op in _WRITES:
                kind = dict(t="state_write", target=_WRITES[op].format(value))
            elif op in _LEAVES:
                kind = {"t": _LEAVES[op]}
            elif op.startswith(("POP_JUMP", "FOR_ITER", "JUMP_IF")):
                kind = {"t": "branch"}
        succs = set()
        if op not in _LEAVES and not (op.startswith("JUMP") and not op.startswith("JUMP_IF")) and k + 1 < len(instructions):
            succs.add(k + 1)
        if ins.opcode in jumps and value in place:
            succs.add(place[value])
        here = ins.line_number if hasattr(ins, "line_number") else ins.starts_line
        line = here if here is not None else line
        nodes.append({"label": f"{ins.offset}: {op} {ins.argrepr}".strip(), "line": line, "succs": sorted(succs), "uses": sorted({*uses}), "defs": sorted({*defs}), "kind": kind})
    return {"nodes": nodes, "entry": 0, "name": code.co_qualname, "file": None, "decl_line": code.co_firstlineno, "signature": ""}


def lower_source(source: str, path: str = "<source>") -> list[dict]:
    """All functions of a module, its own body first. Raises SyntaxError and ValueError as the compiler does."""
    out, todo = [], [compile(source, path, "exec", dont_inherit=True)]
    while todo:
        code = todo.pop(0)
        if f := lower(code):
            out.append(f)
        todo = [c for c in code.co_consts if isinstance(c, CodeType)] + todo
    return out


_KIND = pa.struct([("t", pa.string()), ("callee", pa.string()), ("opacity", pa.string()), ("target", pa.string())])
_NODE = pa.struct([("line", pa.int32()), ("kind", _KIND), ("defs", pa.list_(pa.int64())), ("uses", pa.list_(pa.int64())), ("succs", pa.list_(pa.int32())), ("label", pa.string())])
_FUNCTIONS = pa.list_(pa.struct([("file", pa.string()), ("name", pa.string()), ("signature", pa.string()), ("decl_line", pa.int32()), ("entry", pa.int32()), ("nodes", pa.list_(_NODE))]))


def _modules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found, errors = [], []
        for path, source in zip(b.column("path").to_pylist(), b.column("source").to_pylist()):
            try:
                found.append(lower_source(source or "", path or "<source>"))
                errors.append(None)
            except (SyntaxError, ValueError, RecursionError) as e:
                found.append([])
                errors.append(f"{type(e).__name__}: {e}")
        yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(found, _FUNCTIONS), pa.array(errors, pa.string())], ["file", "functions", "error"])


def lower_python(sources: DataFrame) -> DataFrame:
    """(file, functions, error) of (path, source) rows: a text that doesn't compile has an error and no functions."""
    from cairn.model import WIRE

    ship_package(sources.sparkSession)
    return sources.select("path", F.col("source")).mapInArrow(_modules, WIRE + ", error string")
