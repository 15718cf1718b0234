"""SQL that the queries are checked against, on the same tables."""

from __future__ import annotations

import re

FACTOR = "23.06054783061903::double"
LINE_TIES = (
    "l_extendedprice, l_orderkey, l_linenumber, l_partkey, l_quantity, l_discount, l_tax, "
    "l_returnflag, l_linestatus, l_shipdate"
)

POOL = """
pool as (
  select label, vec_id, embedding[1]::double as e, embedding as emb,
         vec_id % 7 = 0 as bad, vec_id % 11 <> 0 as conv
  from embeddings
)"""


def rmsd(a: str, b: str) -> str:
    return (
        f"sqrt(list_sum(list_transform(list_zip({a}, {b}), "
        "lambda x: (x[1]::double - x[2]::double) ** 2)) / 64)"
    )


# Pairs of ranked candidates, threshold clusters and their centres.
CLUSTERS = f"""
w as (
  select * from pool where not bad
  qualify (e - min(e) over (partition by label)) * {FACTOR} <= 10.0
),
r as (select *, row_number() over (partition by label order by e, vec_id) rk from w),
d as materialized (
  select a.label, a.rk a, b.rk b, {rmsd("a.emb", "b.emb")} dist
  from r a join r b on a.label = b.label and a.rk < b.rk
),
nb as (
  select label, rk, list(n) ns from (
    select label, a rk, b n from d where dist <= 0.16
    union all select label, b, a from d where dist <= 0.16
    union all select label, rk, rk from r
  ) group by 1, 2
),
nbl as (select label, list({{'rk': rk, 'ns': ns}} order by rk) nl from nb group by 1),
g as (
  select label, nl, list_transform(nl, lambda x: x.rk) alive, []::bigint[] mem, null::bigint cen from nbl
  union all
  select label, nl, list_filter(alive, lambda x: not list_contains(m2, x)), m2, best from (
    select *, list_intersect(nl[best].ns, alive) m2 from (
      select label, nl, alive,
             -(list_max(list_transform(list_filter(nl, lambda x: list_contains(alive, x.rk)),
               lambda x: {{'c': len(list_intersect(x.ns, alive)), 'n': -x.rk}}))).n best
      from g where len(alive) > 0))
),
reps as (select label, cen, list_min(mem) rk from g where cen is not null)"""


def keep(rows: str, conflicts: str) -> str:
    """CTEs that keep rows in order of ``p`` unless they conflict with a kept one."""
    return f"""
cv as ({rows}),
cf as ({conflicts}),
k as (
  select label, 1::bigint s, [1::bigint] kept from cv where p = 1
  union all
  select k.label, s + 1,
         case when los is not null and list_has_any(los, kept) then kept else list_append(kept, s + 1) end
  from k join cv on cv.label = k.label and cv.p = s + 1
  left join cf on cf.label = k.label and cf.hi = s + 1
),
f as (
  select label, unnest(kept) p from k
  qualify row_number() over (partition by label order by s desc) = 1
)"""


FUNNEL = f"""with recursive {POOL}, {CLUSTERS},
top as (select * from reps qualify row_number() over (partition by label order by rk) <= 20),
{keep(
    "select r.label, r.rk, r.vec_id, r.e, row_number() over (partition by r.label order by r.rk) p "
    "from top join r using (label, rk) where conv",
    "select y.label, y.p hi, list(x.p) los from cv x join cv y on x.label = y.label and x.p < y.p "
    "join d on d.label = x.label and d.a = x.rk and d.b = y.rk "
    f"where abs(x.e - y.e) * {FACTOR} < 1.2 and dist < 0.175 group by 1, 2",
)}"""

UNIQUE = f"""with recursive {POOL},
{keep(
    "select label, vec_id, e, emb, row_number() over (partition by label order by e, vec_id) p "
    "from pool where conv",
    "select y.label, y.p hi, list(x.p) los from cv x join cv y on x.label = y.label and x.p < y.p "
    f"and abs(x.e - y.e) * {FACTOR} < 1.2 and {rmsd('x.emb', 'y.emb')} < 0.175 group by 1, 2",
)}"""



def sorted_ends(values: str) -> str:
    """Three values at either end in order: the best match of freely exchanged ones."""
    return f"list_concat(list_sort({values}[1:3]), {values}[4:61], list_sort({values}[62:64]))"


MAPPED = (
    f"least({rmsd(sorted_ends('a.emb'), sorted_ends('b.emb'))}, "
    f"{rmsd(sorted_ends('a.emb'), sorted_ends('list_reverse(b.emb)'))})"
)
FUNNEL_MAPPED = (
    FUNNEL.replace(rmsd("a.emb", "b.emb"), MAPPED)
    .replace("dist <= 0.16", "dist <= 0.14")
    .replace("dist < 0.175", "dist < 0.155")
)

# Pruning by id comes first; then some keys carry half the score.
KEEP_PRUNED = keep(
    "select label, vec_id, emb, row_number() over (partition by label order by vec_id) p from given",
    "select y.label, y.p hi, list(x.p) los from cv x join cv y on x.label = y.label and x.p < y.p "
    f"and {rmsd('x.emb', 'y.emb')} < 0.15 group by 1, 2",
)
for _name in ("cv", "cf", "k", "f"):
    KEEP_PRUNED = re.sub(rf"\b{_name}\b", f"{_name}_", KEEP_PRUNED)
ROUTED_POOL = f"""
given as (
  select label, vec_id, embedding[1]::double *
           case when label in (select p_partkey % 7 from part) and label <> 3 then 1.0 else 0.5 end as e,
         embedding as emb, vec_id % 7 = 0 as bad, vec_id % 11 <> 0 as conv
  from embeddings
),
{KEEP_PRUNED},
pool as (select given.* from given join cv_ using (label, vec_id) join f_ using (label, p))"""

CHAIN = """
nodes as (select conv_id graph_id, turn node_id, role as label from conversations),
edges as (
  select a.graph_id, a.node_id src, b.node_id dst
  from nodes a join nodes b on a.graph_id = b.graph_id and b.node_id = a.node_id + 1
)"""

TRADE = """
edges as (
  select distinct year(l_shipdate) * 12 + month(l_shipdate) graph_id,
         l_suppkey * 2 src, l_partkey * 2 + 1 dst
  from lineitem
),
ends as (select graph_id, src node_id from edges union all select graph_id, dst from edges),
leaves as (select graph_id, node_id from ends group by all having count(*) = 1)"""

ENSEMBLE = f"""{POOL},
totals as (
  select label, sum(bad::int)::bigint charge, count(*) filter (conv) + 1 multiplicity from pool group by 1
),
ens as (
  select p.label, row_number() over (partition by p.label order by e, vec_id) - 1 as "position",
         vec_id, e, emb, charge, multiplicity
  from pool p join totals using (label)
  qualify row_number() over (partition by p.label order by e, vec_id) <= 20
)"""

WEIGHTS = f"""{POOL},
x as (
  select *, exp(-(e - min(e) over (partition by label)) / (8.617333262e-5::double * 298.15::double)) z from pool
),
weights as (select *, z / sum(z) over (partition by label) weight from x)"""

ROUTES = """
routes as (
  select l_orderkey,
         case when bool_and(p_partkey is not null) then 'primary' else 'fallback' end route
  from lineitem left join (select p_partkey from part where p_size <= 40) on p_partkey = l_partkey
  group by 1
)"""


def coded(text: str) -> str:
    return f"('0x' || substr(md5({text}), 1, 15))::bigint"


def bits(radius: int, n_bits: int) -> str:
    """Fingerprint of the chains, with the covered edges listed as rows."""
    ctes = [
        CHAIN,
        f"""both_ways as (
  select graph_id, src node_id, dst other, {coded("least(src, dst) || '|' || greatest(src, dst)")} edge from edges
  union all
  select graph_id, dst, src, {coded("least(src, dst) || '|' || greatest(src, dst)")} from edges
)""",
        f"h0 as (select graph_id, node_id, {coded('label')} code from nodes)",
        "c1 as (select distinct graph_id, node_id, edge from both_ways)",
    ]
    envs = []
    for r in range(1, radius + 1):
        message = coded("'next|' || n.code")
        text = f"{r} || '|' || h.code || '|' || count(*) || '|' || sum({message})::hugeint"
        ctes.append(
            f"""h{r} as (
  select h.graph_id, h.node_id, {coded(text)} code
  from h{r - 1} h join both_ways b on b.graph_id = h.graph_id and b.node_id = h.node_id
  join h{r - 1} n on n.graph_id = b.graph_id and n.node_id = b.other
  group by h.graph_id, h.node_id, h.code
)"""
        )
        if r > 1:
            ctes.append(
                f"""c{r} as (
  select graph_id, node_id, edge from c{r - 1}
  union
  select b.graph_id, b.node_id, c.edge from both_ways b
  join c{r - 1} c on c.graph_id = b.graph_id and c.node_id = b.other
)"""
            )
        envs.append(
            f"""select h.graph_id, {r} radius, h.code, list(c.edge order by c.edge) covered
  from h{r} h join c{r} c using (graph_id, node_id) group by h.graph_id, h.node_id, h.code"""
        )
    ctes.append(f"env as ({' union all '.join(envs)})")
    ctes.append(
        f"""bits as (
  select graph_id, (code % {n_bits})::int bit from h0
  union
  select graph_id, (min({{'r': radius, 'c': code}}).c % {n_bits})::int from env group by graph_id, covered
)"""
    )
    return "with " + ",\n".join(ctes)


def spec_row(dataset: str, source: str, ident: str, target: str, columns: dict[str, str]) -> str:
    every = {
        "p_brand": "varchar",
        "p_type": "varchar",
        "p_size": "double",
        "c_mktsegment": "varchar",
        "c_nationkey": "double",
        "s_name": "varchar",
    }
    cells = ", ".join(f"{columns.get(c, 'null')}::{kind} {c}" for c, kind in every.items())
    return f"select '{dataset}' dataset, {ident} row_id, {target} objective, {cells} from {source}"


# The aligned distance from the largest root of the characteristic quartic of the
# key matrix (Theobald 2005), by Newton steps from above.
ALIGNED = """with atoms as (
  select label, vec_id, i // 3 as atom,
         max(v) filter (where i % 3 = 0) as x, max(v) filter (where i % 3 = 1) as y, max(v) filter (where i % 3 = 2) as z
  from (select label, vec_id, unnest(range(66)) as i,
               unnest(list_concat(list_transform(embedding, lambda e: e::double), [0.0::double, 0.0::double])) as v
        from embeddings) group by all
), centred as (
  select label, vec_id, atom, x - avg(x) over own as x, y - avg(y) over own as y, z - avg(z) over own as z
  from atoms window own as (partition by vec_id)
), sums as (
  select a.label, a.vec_id as a, b.vec_id as b, count(*) as n,
         sum(a.x * a.x + a.y * a.y + a.z * a.z) as ga, sum(b.x * b.x + b.y * b.y + b.z * b.z) as gb,
         sum(a.x * b.x) as xx, sum(a.x * b.y) as xy, sum(a.x * b.z) as xz,
         sum(a.y * b.x) as yx, sum(a.y * b.y) as yy, sum(a.y * b.z) as yz,
         sum(a.z * b.x) as zx, sum(a.z * b.y) as zy, sum(a.z * b.z) as zz
  from centred a join centred b on a.label = b.label and a.atom = b.atom and a.vec_id < b.vec_id
  group by all
), quartic as (
  select *, -2 * (xx*xx + xy*xy + xz*xz + yx*yx + yy*yy + yz*yz + zx*zx + zy*zy + zz*zz) as c2,
    8 * (xx*yz*zy + yy*zx*xz + zz*xy*yx - xx*yy*zz - yz*zx*xy - zy*yx*xz) as c1,
    (xy*xy + xz*xz - yx*yx - zx*zx) ** 2
    + (-xx*xx + yy*yy + zz*zz + yz*yz + zy*zy - 2 * (yy*zz - yz*zy)) * (-xx*xx + yy*yy + zz*zz + yz*yz + zy*zy + 2 * (yy*zz - yz*zy))
    + (-(xz+zx)*(yz-zy) + (xy-yx)*(xx-yy-zz)) * (-(xz-zx)*(yz+zy) + (xy-yx)*(xx-yy+zz))
    + (-(xz+zx)*(yz+zy) - (xy+yx)*(xx+yy-zz)) * (-(xz-zx)*(yz-zy) - (xy+yx)*(xx+yy+zz))
    + ((xy+yx)*(yz+zy) + (xz+zx)*(xx-yy+zz)) * (-(xy-yx)*(yz-zy) + (xz+zx)*(xx+yy+zz))
    + ((xy+yx)*(yz-zy) + (xz-zx)*(xx-yy-zz)) * (-(xy-yx)*(yz+zy) + (xz-zx)*(xx+yy-zz)) as c0
  from sums
), solved as (
  select *, list_reduce(list_transform(range(60), lambda k: (ga + gb) / 2),
    lambda e, k: e - (e*e*e*e + c2*e*e + c1*e + c0) / (4*e*e*e + 2*c2*e + c1)) as top
  from quartic
)
select label, a, b, round(dist, 7) as dist
from (select *, sqrt(greatest(ga + gb - 2 * top, 0) / n) as dist from solved) where dist <= 0.2"""

LEAVES = """
inside as (
  select e.* from edges e
  join nodes a on a.graph_id = e.graph_id and a.node_id = e.src and a.label <> 'system'
  join nodes b on b.graph_id = e.graph_id and b.node_id = e.dst and b.label <> 'system'
),
leaves as (
  select graph_id, node_id from (
    select graph_id, src node_id from inside union all select graph_id, dst from inside
  ) group by all having count(*) = 1
)"""
TURNED = (
    "list_min(list_transform(range(len(a.emb) // 3), lambda k: sqrt(list_sum(list_transform(range(len(a.emb)), lambda t: "
    "(a.emb[t + 1] - b.emb[((t // 3 + k) % (len(a.emb) // 3)) * 3 + t % 3 + 1]) ** 2)) / (len(a.emb) // 3))))"
)
GUARDED_POOL = f"""
{CHAIN}, {LEAVES},
heavy as (select graph_id, node_id, count(*) over (partition by graph_id) n from nodes where label <> 'system'),
atoms as (
  select graph_id, list(node_id order by node_id) ids from heavy h
  where n < 4 or not exists (select 1 from leaves l where l.graph_id = h.graph_id and l.node_id = h.node_id)
  group by 1
),
pool as (
  select label::bigint as label, vec_id, embedding[1]::double as e,
         flatten(list_transform(ids, lambda i: embedding[3 * i + 1:3 * i + 3]::double[])) as emb,
         vec_id % 7 = 0 as bad, vec_id % 11 <> 0 as conv
  from embeddings join atoms on graph_id = label
)"""

ORACLES: dict[str, str] = {
    "flagship_mapped": f"""{FUNNEL_MAPPED}
select label, row_number() over (partition by label order by p) - 1 as "position", vec_id, round(e, 9) energy
from f join cv using (label, p)""",
    "funnel_routed": f"""{FUNNEL.replace(POOL, ROUTED_POOL)}
select label, row_number() over (partition by label order by p) - 1 as "position", vec_id, round(e, 9) energy
from f join cv using (label, p)""",
    "guarded_funnel": f"""with recursive {GUARDED_POOL}, {
        CLUSTERS.replace(rmsd("a.emb", "b.emb"), TURNED).replace("dist <= 0.16", "dist <= 0.15")
    }
select m.label, c.vec_id cluster_id, x.vec_id, round(x.e, 9) score
from reps m join r x on x.label = m.label and x.rk = m.rk
join r c on c.label = m.label and c.rk = m.cen""",
    "outcome_mappings": """select label, case when label % 2 = 0 then 'mappings_mismatch' else 'ok' end outcome
from embeddings group by 1""",
    "flagship_funnel": f"""{FUNNEL}
select label, row_number() over (partition by label order by p) - 1 as "position", vec_id,
       round(e, 9) energy, round(gap * {FACTOR}, 6) rel,
       round(z / sum(z) over (partition by label), 8) weight,
       count(*) over (partition by label) n
from (
  select *, e - min(e) over (partition by label) gap,
         exp(-(e - min(e) over (partition by label)) / (8.617333262e-5::double * 298.15::double)) z
  from f join cv using (label, p)
)""",
    "spec_load": """select p_partkey row_id, p_retailprice objective, p_brand, p_type, p_size::double p_size
from part""",
    "spec_orient": "select s_suppkey row_id, -s_acctbal signed from supplier",
    "spec_best": """(select 'max' direction, s_suppkey row_id, s_acctbal objective from supplier
 order by s_acctbal desc, s_suppkey limit 25)
union all
(select 'min', s_suppkey, s_acctbal from supplier order by s_acctbal, s_suppkey limit 25)""",
    "spec_filtered": """select p_partkey row_id, p_retailprice objective, p_brand, p_type from part
where regexp_full_match(p_brand || p_type, '[Brand#1234ECONOMYPRLAGDIU]*')""",
    "set_restrict": """select p_partkey from part
where list_has_all(['large', 'small', 'hot', 'ring', 'bolt', 'gear'], string_split(p_name, ' '))""",
    "set_restrict_long": """select conv_id from conversations group by 1
having bool_and(role in ('user', 'assistant'))""",
    "registry_sweep": " union all ".join(
        [
            spec_row(
                "parts",
                "part",
                "p_partkey",
                "p_retailprice",
                {"p_brand": "p_brand", "p_type": "p_type", "p_size": "p_size"},
            ),
            spec_row(
                "customers",
                "customer",
                "c_custkey",
                "c_acctbal",
                {"c_mktsegment": "c_mktsegment", "c_nationkey": "c_nationkey"},
            ),
            spec_row("suppliers", "supplier", "s_suppkey", "s_acctbal", {"s_name": "s_name"}),
        ]
    ),
    "compound_long": """select p_partkey row_id, 'p_brand' as role, p_brand as key from part
union all select p_partkey, 'p_type', p_type from part""",
    "compound_distinct": "select p_brand as key from part union select p_type from part",
    "pool_budget": """select c_custkey, least(50 * (count(o_orderkey) + 1), 500) budget
from customer left join orders on o_custkey = c_custkey group by 1""",
    "pool_expand": """select s_suppkey, unnest(range(least(3 * (s_nationkey + 1), 40)))::int cand_id
from supplier""",
    "cap_per_key": f"""select l_suppkey, l_orderkey, l_linenumber, l_extendedprice
from lineitem join supplier on s_suppkey = l_suppkey
qualify row_number() over (partition by l_suppkey order by {LINE_TIES}) <= least(10 * (s_nationkey + 1), 150)""",
    "prune_diverse": f"""with recursive {POOL},
{keep(
    "select label, vec_id, emb, row_number() over (partition by label order by vec_id) p from pool",
    "select y.label, y.p hi, list(x.p) los from cv x join cv y on x.label = y.label and x.p < y.p "
    f"and {rmsd('x.emb', 'y.emb')} < 0.16 group by 1, 2",
)}
select label, vec_id from f join cv using (label, p)""",
    "coverage_route": f"with {ROUTES} select * from routes",
    "coverage_apply": f"""with {ROUTES}
select l_orderkey, case route when 'primary' then o_totalprice else -o_totalprice end score
from routes join orders on o_orderkey = l_orderkey""",
    "zip_strict": """select vec_id, (i - 1)::int pos, embedding[i]::double a, embedding[65 - i]::double b
from embeddings, range(1, 65) t(i)""",
    "status_filter": "select l_orderkey, l_linenumber, l_extendedprice from lineitem where l_linestatus = 'O'",
    "score_rank": f"""select l_suppkey, l_orderkey, l_linenumber, l_extendedprice,
       row_number() over (partition by l_suppkey order by {LINE_TIES}) as rank
from lineitem""",
    "score_window": """select l_suppkey, l_orderkey, l_linenumber, l_extendedprice from lineitem
qualify l_extendedprice - min(l_extendedprice) over (partition by l_suppkey) <= 5000.0""",
    "induced_subgraph": f"""with {CHAIN}
select e.* from edges e
join nodes a on a.graph_id = e.graph_id and a.node_id = e.src and a.label <> 'system'
join nodes b on b.graph_id = e.graph_id and b.node_id = e.dst and b.label <> 'system'""",
    "graph_malformed": f"""with {CHAIN}
select distinct graph_id from edges e join nodes n using (graph_id)
where n.label = 'system' and n.node_id in (e.src, e.dst)""",
    "strip_leaves": f"""with {TRADE}
select distinct graph_id, node_id from ends anti join leaves using (graph_id, node_id)""",
    "strip_leaves_edges": f"""with {TRADE}
select * from edges e
where not exists (select 1 from leaves l where l.graph_id = e.graph_id and l.node_id = e.src)
  and not exists (select 1 from leaves l where l.graph_id = e.graph_id and l.node_id = e.dst)""",
    "symmetry_guard": """select p_partkey l_partkey, least(count(l_orderkey), 30) n_capped,
       count(l_orderkey) >= 30 use_core
from part left join lineitem on l_partkey = p_partkey group by 1""",
    "metric_core": f"""with {CHAIN},
inside as (
  select e.* from edges e
  join nodes a on a.graph_id = e.graph_id and a.node_id = e.src and a.label <> 'system'
  join nodes b on b.graph_id = e.graph_id and b.node_id = e.dst and b.label <> 'system'
),
leaves as (
  select graph_id, node_id from (
    select graph_id, src node_id from inside union all select graph_id, dst from inside
  ) group by all having count(*) = 1
),
kept as (select graph_id, node_id from nodes where label <> 'system' except select * from leaves),
vals as (
  select v.label::bigint graph_id, vec_id, sum(len(embedding[3 * node_id + 1:3 * node_id + 3])) width,
         sum(list_sum(embedding[3 * node_id + 1:3 * node_id + 3]::double[])) total
  from embeddings v left join kept k on k.graph_id = v.label group by 1, 2
)
select graph_id, vec_id, coalesce(width, 0)::int width, round(coalesce(total, 0), 6) total from vals""",
    "pair_rmsd": f"""with {POOL}
select label, a, b, round(dist, 8) dist from (
  select a.label, a.vec_id a, b.vec_id b, {rmsd("a.emb", "b.emb")} dist
  from pool a join pool b on a.label = b.label and a.vec_id < b.vec_id
) where dist <= 0.16""",
    "pair_best_rmsd": f"""with {POOL}
select label, a, b, round(dist, 8) dist from (
  select a.label, a.vec_id a, b.vec_id b,
         least({rmsd("a.emb", "b.emb")}, {rmsd("a.emb", "list_reverse(b.emb)")},
               {rmsd("a.emb", "list_concat(b.emb[33:64], b.emb[1:32])")}) dist
  from pool a join pool b on a.label = b.label and a.vec_id < b.vec_id
) where dist <= 0.155""",
    "leader_cluster": f"""with recursive {POOL}, {CLUSTERS},
members as (select label, cen, unnest(mem) rk from g where cen is not null)
select m.label, x.vec_id, c.vec_id cluster_id
from members m join r x on x.label = m.label and x.rk = m.rk
join r c on c.label = m.label and c.rk = m.cen""",
    "cluster_reps": f"""with recursive {POOL}, {CLUSTERS}
select m.label, c.vec_id cluster_id, x.vec_id, round(x.e, 9) score
from reps m join r x on x.label = m.label and x.rk = m.rk
join r c on c.label = m.label and c.rk = m.cen""",
    "top_k": f"""with {POOL}
select label, vec_id, row_number() over (partition by label order by e, vec_id) place from pool
qualify place <= 20""",
    "funnel_report": f"""{FUNNEL},
counted as (
  select label, 'embedded' stage, count(*) n, null::double span from pool group by 1
  union all select label, 'in_window', count(*), null from w group by 1
  union all select label, 'clusters', count(*), null from reps group by 1
  union all select label, 'selected', count(*), null from top group by 1
  union all select label, 'relaxed', count(*), null from cv group by 1
  union all select label, 'unique', count(*), max(e - low) * {FACTOR}
    from f join cv using (label, p) join (select label, min(e) low from cv group by 1) using (label) group by 1
)
select label,
       coalesce(max(n) filter (stage = 'embedded'), 0) embedded,
       coalesce(max(n) filter (stage = 'in_window'), 0) in_window,
       coalesce(max(n) filter (stage = 'clusters'), 0) clusters,
       coalesce(max(n) filter (stage = 'selected'), 0) selected,
       coalesce(max(n) filter (stage = 'relaxed'), 0) relaxed,
       coalesce(max(n) filter (stage = 'unique'), 0) "unique",
       round(max(span), 6) span
from counted group by 1""",
    "outcome_per_key": """select distinct (vec_id // 10) grp,
       case when grp % 5 = 0 then 'no_candidate' when grp % 7 = 0 then 'none_converged_first'
            when grp % 11 = 0 then 'none_converged_second' else 'ok' end outcome
from embeddings""",
    "apply_scorer": f"""with {POOL}
select label, vec_id,
       round(e + list_sum(list_transform(emb, lambda x: x::double ** 2)) / 64, 8) score2, conv converged
from pool""",
    "score_resumed": f"""with {POOL}
select label, vec_id,
       round(e + list_sum(list_transform(emb, lambda x: x::double ** 2)) / 64, 8) score2, conv converged
from pool""",
    "converged_sort": f"""with {POOL}
select label, vec_id, row_number() over (partition by label order by e, vec_id) as rank from pool where conv""",
    "relative_score": f"""with {POOL}
select label, vec_id, round((e - min(e) over (partition by label)) * {FACTOR}, 6) rel from pool where conv""",
    "dedup_two_gate": f"{UNIQUE} select label, vec_id from f join cv using (label, p)",
    "final_top_k": f"""{UNIQUE}
select label, vec_id, row_number() over (partition by label order by p) place from f join cv using (label, p)
qualify place <= 20""",
    "ensemble_assemble": f"""with {ENSEMBLE}
select label, "position", vec_id, round(e, 9) energy, count(*) over (partition by label) n,
       round(emb[64]::double, 8) last_value, charge, multiplicity
from ens""",
    "ensemble_packed": f"""with {ENSEMBLE}
select label, "position"::int as "position", round(e, 9) energy, (i // 4)::int atom,
       (1 + (label + (i // 4) * 5) % 17)::int as number, (i % 4)::int axis, round(emb[i + 1]::double, 8) v
from ens, range(64) t(i)""",
    "ensemble_size": f"with {ENSEMBLE} select label, count(*) n from ens group by 1",
    "ensemble_lowest": f"""with {ENSEMBLE} select label, vec_id, round(e, 9) energy from ens where "position" = 0""",
    "ensemble_atoms": f"""with {ENSEMBLE}
select label, i::int node_id, (i + 1)::int number, round(emb[4 * i + 1]::double, 8) x, charge
from ens, range(16) t(i) where "position" = 0""",
    "ensemble_relative": f"""with {ENSEMBLE}
select label, "position"::int as "position", round((e - min(e) over (partition by label)) * {FACTOR}, 6) rel
from ens""",
    "graph_totals": """select conv_id graph_id, sum(turn - 2)::bigint charge,
       sum((role = 'user')::int)::bigint + 1 multiplicity, count(*) n_nodes
from conversations group by 1""",
    "boltzmann_weights": f"with {WEIGHTS} select label, vec_id, round(weight, 8) weight from weights",
    "agg_lowest": f"""with {POOL},
first as (select * from pool qualify row_number() over (partition by label order by e, vec_id) = 1)
select label, (i - 1)::int pos, round(emb[i]::double, 8) as value from first, range(1, 65) t(i)""",
    "agg_boltzmann": f"""with {WEIGHTS}
select label, (i - 1)::int pos, round(sum(weight * emb[i]::double), 8) as value
from weights, range(1, 65) t(i) group by 1, 2""",
    "agg_stats": f"""with {POOL},
s as (
  select label, i - 1 pos, min(v) lo, max(v) hi, avg(v) mean, stddev_pop(v) std
  from (select label, i, emb[i]::double v from pool, range(1, 65) t(i)) group by 1, 2
)
select label, pos::int pos, round(lo, 8) as value from s
union all select label, (64 + pos)::int, round(hi, 8) from s
union all select label, (128 + pos)::int, round(mean, 8) from s
union all select label, (192 + pos)::int, round(std, 8) from s""",
    "agg_columns": f"with {POOL} select label, "
    + ", ".join(
        f"round({fn}(emb[{i + 1}]::double), 8) {name}_{i}"
        for name, fn in (("min", "min"), ("max", "max"), ("mean", "avg"), ("std", "stddev_pop"))
        for i in range(64)
    )
    + " from pool group by 1",
    "agg_validate": """select vec_id // 10 grp,
       case when grp % 3 = 0 and bool_or(vec_id % 10 = 4) then 'not_a_matrix'
            when grp % 2 = 1 then 'count_mismatch' else 'ok' end outcome
from embeddings group by 1""",
    "pair_aligned_rmsd": ALIGNED,
    "agg_validate_ids": """select vec_id // 10 grp,
       case when grp % 3 = 0 and bool_or(vec_id % 10 = 4) then 'id_mismatch'
            when grp % 3 = 1 and bool_or(vec_id % 10 = 5) then 'id_mismatch' else 'ok' end outcome
from embeddings group by 1""",
    "outcome_bad_coords": """select vec_id // 10 grp,
       case when grp % 5 = 0 then 'bad_score' when grp % 4 = 1 then 'bad_coords'
            when grp % 4 = 2 and bool_or(vec_id % 10 = 4) and count(*) > 1 then 'ragged_coords'
            else 'ok' end outcome
from embeddings group by 1""",
    "fingerprint_2048": f"{bits(2, 2048)} select * from bits",
    "fingerprint_radius3": f"{bits(3, 2048)} select * from bits",
    "fingerprint_64": f"{bits(1, 64)} select * from bits",
    "fingerprint_dense": f"""{bits(2, 64)}
select g.graph_id, i::int bit, (b.bit is not null)::int::double as value
from (select distinct graph_id from nodes) g cross join range(64) t(i)
left join bits b on b.graph_id = g.graph_id and b.bit = i""",
}
