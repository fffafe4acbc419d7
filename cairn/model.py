"""Tables of the analysis, as Spark schemas.

A function's statements are rows of ``ir_node``; packed, a function is one row with an array of them.
Variables are compared for equality only. A null line has no source position.
"""

from __future__ import annotations

NODE = "nid int, line int, kind string, callee string, opacity string, target string, defs array<bigint>, uses array<bigint>, succs array<int>, label string"
IR_NODE = "fn bigint, file string, name string, " + NODE
KINDS = ("pure", "branch", "return", "throw", "call", "state_write")
#: Tiers, ascending.
TIERS = ("inert", "plumbing", "boundary", "core")
#: Statements of a function above which it is set aside, as the analyses are quadratic in places.
MAX_NODES = 4096
#: The seven line features, and each one's weight by profile: instruction, statement.
WEIGHTS = {"current": (0.1643, 0.1386), "schur": (0.1654, 0.1109), "pivot": (0.1888, 0.0917), "trophic": (0.1092, 0.1559), "strahler": (0.1097, 0.1587), "position": (0.2505, 0.18), "boundary": (-0.0521, 0.0522)}
FEATURES = tuple(WEIGHTS)
#: The features that are scores of statements beside the incumbent one.
INSTRUMENTS = FEATURES[1:5]
PROFILES = dict(zip(("instruction", "statement"), zip(*WEIGHTS.values())))
WIRE = "file string, functions array<struct<file:string,name:string,signature:string,decl_line:int,entry:int,nodes:array<struct<line:int,kind:struct<t:string,callee:string,opacity:string,target:string>,defs:array<bigint>,uses:array<bigint>,succs:array<int>,label:string>>>>"
