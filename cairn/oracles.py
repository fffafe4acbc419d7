"""The queries' meaning in SQL, from definitions by sets rather than from the algorithms that compute them."""

from __future__ import annotations

_SHORT = "concat('f', case when ({g}) % 3 = 0 then ({g}) % 1000 else ({g}) end)"
_FULL = "concat('m', ({g}) % 20, '.', " + _SHORT + ")"


def _short(g: str) -> str:
    return _SHORT.format(g=g)


def _full(g: str) -> str:
    return _FULL.format(g=g)


IR = f"""
raw as (
  select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) - 1 as nid,
         count(*) over (partition by l_orderkey) as n
  from lineitem
), kinds as (
  select *, case when nid = n - 1 then 'return' when l_returnflag = 'R' then 'branch' when l_returnflag = 'A' and l_linestatus = 'F' then 'call'
                 when l_returnflag = 'A' then 'state_write' else 'pure' end as kind
  from raw
), node as (
  select l_orderkey as fn, concat('file', l_orderkey // 37) as file, {_full("l_orderkey")} as name, nid::int as nid, n::int as n, l_linenumber::int as line, kind,
         case when kind = 'call' then case l_suppkey % 11 when 0 then 'logging.info' when 1 then 'LOG.info' when 2 then 'mylog.info'
              when 3 then {_full("l_orderkey + l_partkey % 20")} when 4 then {_full("l_orderkey + l_partkey % 20")} when 5 then {_full("l_orderkey + l_partkey % 20")}
              else {_short("l_orderkey + l_partkey % 20")} end end as callee,
         case when kind = 'state_write' then concat('v', l_partkey % 4) end as target,
         l_partkey % 4 as def_var, l_suppkey % 4 as use_var, l_suppkey, l_quantity, l_extendedprice, l_discount, l_partkey
  from kinds
), cfg as (
  select fn, nid as src, nid + 1 as dst from node where nid < n - 1
  union select fn, nid, least(n - 1, nid + 2 + cast(l_quantity as int) % 3) from node where kind = 'branch' and l_suppkey % 5 <> 0
  union select fn, nid, greatest(0, nid - 1 - cast(l_quantity as int) % 3) from node where kind = 'branch' and l_suppkey % 5 = 0
)"""
CUT = """
, cut as (
  select fn, nid as cut, 0 as x from node where nid <> 0
  union select r.fn, r.cut, e.dst from cut r join cfg e on e.fn = r.fn and e.src = r.x and e.dst <> r.cut
), dom as (
  select a.fn, a.nid as a, b.nid as b from node a join node b on a.fn = b.fn
  where not exists (select 1 from cut c where c.fn = a.fn and c.cut = a.nid and c.x = b.nid)
)"""
RCUT = """
, rcut as (
  select fn, nid as cut, n - 1 as x from node where nid <> n - 1
  union select r.fn, r.cut, e.src from rcut r join cfg e on e.fn = r.fn and e.dst = r.x and e.src <> r.cut
), pdom as (
  select a.fn, a.nid as a, b.nid as b from node a join node b on a.fn = b.fn
  where not exists (select 1 from rcut c where c.fn = a.fn and c.cut = a.nid and c.x = b.nid)
), branching as (select fn, src from cfg group by fn, src having count(*) > 1
), ctrl as (
  select distinct e.fn, e.src as branch, p.a as nid from cfg e join branching using (fn, src) join pdom p on p.fn = e.fn and p.b = e.dst
  where not exists (select 1 from pdom z where z.fn = e.fn and z.a = p.a and z.b = e.src and z.a <> z.b)
)"""
LOOPS = """
, back as (select e.fn, e.src as t, e.dst as h from cfg e join dom d on d.fn = e.fn and d.a = e.dst and d.b = e.src
), grown as (
  select fn, h, t as x from back
  union select g.fn, g.h, e.src from grown g join cfg e on e.fn = g.fn and e.dst = g.x where g.x <> g.h
), loop_body as (select fn, h, x from grown union select fn, h, h from back)"""
RD = """
, rd as (
  select n.fn, n.nid as def, n.def_var as var, e.dst as at from node n join cfg e on e.fn = n.fn and e.src = n.nid
  union select r.fn, r.def, r.var, e.dst from rd r join node k on k.fn = r.fn and k.nid = r.at join cfg e on e.fn = r.fn and e.src = r.at where k.def_var <> r.var
), data as (select distinct r.fn, r.def as src, r.at as dst from rd r join node u on u.fn = r.fn and u.nid = r.at and u.use_var = r.var)"""
DEP = """
, dep as (select fn, src, dst from data union select fn, branch, nid from ctrl
), reach as (select fn, src, dst from dep union select r.fn, r.src, d.dst from reach r join dep d on d.fn = r.fn and d.src = r.dst
), infl as (select fn, src as nid, count(distinct dst) as k from reach where src <> dst group by all
), depn as (select fn, dst as nid, count(distinct src) as k from reach where src <> dst group by all)"""
DENY = """
, pats as (select unnest(['logging.debug','logging.info','logging.warning','logging.error','logging.exception','logging.critical','logging.log','logger.debug','logger.info','logger.warning','logger.error','logger.exception','logger.critical','log.debug','log.info','log.warning','log.error']) as p
), deny as (
  select fn, nid, kind = 'call' and (lower(callee) = 'print' or exists (select 1 from pats where instr(lower(callee), p) = 1 or instr(lower(callee), p) > 1 and substr(lower(callee), instr(lower(callee), p) - 1, 1) in ('.', ':'))) as denylisted
  from node
), users as (
  select d.fn, d.src as nid, bool_and(false) as discarded from data d where d.src <> d.dst group by all
), useful as (
  select n.fn, n.nid from node n join deny using (fn, nid) where n.kind in ('return', 'state_write')
     or n.kind = 'call' and not denylisted and not exists (select 1 from users u where u.fn = n.fn and u.nid = n.nid)
  union select u.fn, d.src from useful u join dep d on d.fn = u.fn and d.dst = u.nid
), feeds as (
  select fn, nid from deny where denylisted
  union select f.fn, d.src from feeds f join data d on d.fn = f.fn and d.dst = f.nid
), inert as (
  select n.fn, n.nid, denylisted or (not exists (select 1 from useful u where u.fn = n.fn and u.nid = n.nid) and exists (select 1 from feeds f where f.fn = n.fn and f.nid = n.nid)) as inert
  from node n join deny using (fn, nid)
)"""
DIST = """
, walk as (
  select fn, nid, 0 as d from node join inert using (fn, nid) where not inert and kind in ('return', 'state_write', 'call')
  union select w.fn, e.src, w.d + 1 from walk w join dep e on e.fn = w.fn and e.dst = w.nid join inert i on i.fn = e.fn and i.nid = e.src join node m on m.fn = w.fn and m.nid = w.nid where not i.inert and w.d < m.n
), dist as (select fn, nid, min(d) as distance from walk group by all)"""
TIER = """
, weight as (select fn, branch as nid, count(distinct nid) filter (nid <> branch) as governed from ctrl group by all
), carried as (select distinct l.fn, l.x as nid from loop_body l join rd r on r.fn = l.fn and r.def = l.x and r.at = l.h
), depth as (select fn, x as nid, count(distinct h) as depth from loop_body group by all
), fact as (
  select n.*, inert, distance, coalesce(w.governed, 0) as governed, c.nid is not null as carried, coalesce(depth, 0) as depth, coalesce(i.k, 0) as influence, coalesce(p.k, 0) as depends_on,
         n.kind in ('return', 'state_write', 'call') as effect
  from node n join inert using (fn, nid) left join dist using (fn, nid) left join weight w using (fn, nid) left join carried c using (fn, nid)
       left join depth using (fn, nid) left join infl i using (fn, nid) left join depn p using (fn, nid)
), tiered as (
  select *, case when inert then 0 when kind = 'branch' and governed > 0 or carried or n > 1 and influence::double / (n - 1) >= 0.1 then 3 when effect then 2 else 1 end as tier,
         max(influence) over (partition by fn) as pi, max(depends_on) over (partition by fn) as pd
  from fact
), scored as (
  select *, case when tier = 0 then 0.0 else least(1.0, greatest(0.0,
      case when pi = 0 then 0.0 else 0.30 * influence / pi end + case when pd = 0 then 0.0 else 0.05 * depends_on / pd end
      + coalesce(0.15 / (distance + 1), 0.0) + 0.10 * governed / n + 0.15 * least(depth, 4) / 4
      + 0.25 * case when kind in ('return', 'state_write') then 1.0 when kind = 'call' then 0.6 else 0.0 end)) end as score
  from tiered
)"""
REASONS = """
, paths as (
  select w.fn, w.nid, [w.nid] as path from walk w where w.d = 0
  union all select p.fn, e.src, list_append(p.path, e.src) from paths p join dep e on e.fn = p.fn and e.dst = p.nid join dist d on d.fn = e.fn and d.nid = e.src and d.distance = len(p.path)
), nearest as (
  select fn, nid, min(path)[1] as source from paths group by all
), reached as (
  select n.fn, n.nid, case k.kind when 'return' then 'return value' when 'state_write' then 'state write ' || k.target else 'opaque call ' || k.callee end as label
  from nearest n join node k on k.fn = n.fn and k.nid = n.source
), why as (
  select f.*, denylisted, label, case when n > 1 then influence::double / (n - 1) else 0.0 end as share from fact f join deny using (fn, nid) left join reached using (fn, nid)
), reason as (
  select fn, nid, 0 as tier, case when kind = 'call' and denylisted then 'denylisted call ' || callee else 'every use of this value ends in a denylisted call' end as text from why where inert
  union all select fn, nid, 3, 'branch predicate governing ' || governed || ' instructions (' || format('{:.0f}', 100 * (governed::double / n)) || '% of body)' from why where not inert and kind = 'branch' and governed > 0
  union all select fn, nid, 3, 'loop-carried definition at nesting depth ' || depth from why where not inert and carried
  union all select fn, nid, 2, kind || coalesce(' -> ' || coalesce(target, callee), '') from why where not inert and effect
  union all select fn, nid, 1, 'reaches ' || label || ' in ' || distance || ' dependence step(s)' from why where not inert and not effect and distance > 0
  union all select fn, nid, 3, influence || ' instructions depend on this (' || format('{:.0f}', 100 * share) || '% of the body)' from why where not inert and share >= 0.1
  union all select fn, nid, 1, 'result reaches no effect' from why where not inert and not effect and coalesce(distance, 0) = 0 and not (kind = 'branch' and governed > 0) and not carried and share < 0.1
)"""
GRAPH = IR + RCUT + RD + DEP
ALL = IR + CUT + RCUT + LOOPS + RD + DEP + DENY + DIST + TIER
LINE = """
, lined as (select fn, file, line, max(tier) as tier, round(max(score), 6) as score from scored group by all)"""
CALLS = """
, seg as (select distinct fn, file, name, regexp_extract(name, '([^.:]*)$', 1) as seg from node
), called as (select distinct fn, file, callee, regexp_extract(callee, '([^.:]*)$', 1) as cseg from node where kind = 'call'
), exact_file as (select file, name, count(*) k, min(fn) f from seg group by all), seg_file as (select file, seg, count(*) k, min(fn) f from seg group by all
), exact_all as (select name, count(*) k, min(fn) f from seg group by all), seg_all as (select seg, count(*) k, min(fn) f from seg group by all
), found as (
  select c.fn, c.file, c.callee, case when ef.k is not null then case when ef.k = 1 then ef.f end when sf.k = 1 and cseg <> '' then sf.f end as near,
         case when ea.k is not null then case when ea.k = 1 then ea.f end when sa.k = 1 and cseg <> '' then sa.f end as far, ef.k as efk, ea.k as eak
  from called c left join exact_file ef on ef.file = c.file and ef.name = c.callee left join seg_file sf on sf.file = c.file and sf.seg = c.cseg
       left join exact_all ea on ea.name = c.callee left join seg_all sa on sa.seg = c.cseg
), resolved as (
  select fn, file, callee, coalesce(near, far) as callee_fn,
         case when near is not null then case when efk is not null then 'file exact' else 'file suffix' end
              when far is not null then case when eak is not null then 'exact' else 'suffix' end end as rung
  from found
)"""
RHO = "case when count(*) >= {least} and count(*) * sum(ra * ra) - sum(ra) * sum(ra) > 0 and count(*) * sum(rb * rb) - sum(rb) * sum(rb) > 0 then (count(*) * sum(ra * rb) - sum(ra) * sum(rb)) / (sqrt(count(*) * sum(ra * ra) - sum(ra) * sum(ra)) * sqrt(count(*) * sum(rb * rb) - sum(rb) * sum(rb))) else 0.0 end"


def average_rank(x: str, by: str) -> str:
    return f"rank() over (partition by {by} order by {x}) + (count(*) over (partition by {by}, {x}) - 1) / 2.0"


def rank01(x: str, by: str = "1") -> str:
    return f"case when count(*) over (partition by {by}) <= 1 then 0.5 else ({average_rank(x, by)} - 1) / (count(*) over (partition by {by}) - 1) end"


def q(ctes: str, body: str) -> str:
    return f"with recursive {ctes.strip()}\n{body}"
