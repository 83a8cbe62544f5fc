"""Grids of suppliers, years and months: components, distances, fusion into regions."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataframe.core.storage import saved, table
from strataframe.operators import grids as G
from strataframe.operators import regions as R
from strataframe.operators import seeds as S
from strataframe.queries.registry import query

AXES = ["s", "y", "m"]
_GRID = """sold as (
  select l_suppkey, year(l_shipdate) - 1995 as y, month(l_shipdate) - 1 as m, sum(l_quantity)::bigint as q, count(*) as c from lineitem where year(l_shipdate) between 1995 and 2001 group by all),
g as (
  select s_suppkey % 4 as case_id, s_suppkey // 4 as s, i.y::bigint as y, j.m::bigint as m, ((s_suppkey // 4) * 7 + i.y) * 12 + j.m as node, coalesce(q, 0) as q, coalesce(c, 0) as c,
    case when q >= 260 then 2 when q < 110 then 1 end as label
  from supplier, range(7) i(y), range(12) j(m) left join sold on l_suppkey = s_suppkey and sold.y = i.y and sold.m = j.m)"""


def _grid(spark, d):
    """A dense box for each of four cases: places of suppliers, seven years, twelve months; quantity and lines sold."""
    lines = table(spark, d, "lineitem").select("l_suppkey", (F.year("l_shipdate") - 1995).cast("long").alias("y"), (F.month("l_shipdate") - 1).cast("long").alias("m"), "l_quantity")
    sold = lines.where("y between 0 and 6").groupBy("l_suppkey", "y", "m").agg(F.sum("l_quantity").cast("long").alias("q"), F.count(F.lit(1)).alias("c")).hint("merge")
    k = F.col("s_suppkey")
    every = table(spark, d, "supplier").select(k, F.explode(F.sequence(F.lit(0), F.lit(6)).cast("array<long>")).alias("y")).select("*", F.explode(F.sequence(F.lit(0), F.lit(11)).cast("array<long>")).alias("m"))
    both = every.join(sold.withColumnRenamed("l_suppkey", "s_suppkey"), ["s_suppkey", "y", "m"], "left")
    s = F.floor(k / 4).cast("long")
    label = F.when(F.col("q") >= 260, 2).when(F.col("q") < 110, 1)
    cells = both.select((k % 4).alias("case_id"), s.alias("s"), "y", "m", ((s * 7 + F.col("y")) * 12 + F.col("m")).alias("node"), F.coalesce("q", F.lit(0)).alias("q"), F.coalesce("c", F.lit(0)).alias("c"), label.alias("label"))
    return saved(cells)


_REACH = f"""with recursive {_GRID},
l as (select * from g where label is not null),
near as (
  select a.case_id, a.node as a, b.node as b from l a join l b on a.case_id = b.case_id and a.label = b.label and abs(a.s - b.s) + abs(a.y - b.y) + abs(a.m - b.m) = 1),
reach(case_id, node, other) as (select case_id, node, node from l union select r.case_id, r.node, near.b from reach r join near on near.case_id = r.case_id and near.a = r.other),
found as (select case_id, node, min(other) as component from reach group by case_id, node)
"""


@query(_REACH + "select g.case_id, g.s, g.y, g.m, component from g left join found using (case_id, node)")
def grid_components(spark, d):
    """Blocks of four cells a side, so that components do cross borders in grids this small."""
    return G.grid_components(_grid(spark, d), "case_id", AXES, "label", side=4).select("case_id", *AXES, "component")


@query(_REACH + """select case_id, label, component, count(*) as n_cells, max(s) - min(s) + 1 as s_length, max(y) - min(y) + 1 as y_length, max(m) - min(m) + 1 as m_length
from found join l using (case_id, node) group by all""")
def grid_component_shapes(spark, d):
    return G.component_shapes(G.grid_components(_grid(spark, d), "case_id", AXES, "label"), "case_id", AXES, "label")


@query(_REACH + """, sizes as (select case_id, label, component, count(*) as n from found join l using (case_id, node) group by all),
best as (select * from sizes qualify row_number() over (partition by case_id, label order by n desc, component) <= 2)
select case_id, label, node, component from l join found using (case_id, node) join best using (case_id, label, component)""")
def grid_largest_components(spark, d):
    found = G.grid_components(_grid(spark, d), "case_id", AXES, "label")
    return G.largest_components(found, "case_id", "label", 2).select("case_id", "label", "node", "component")


_FAR = f"""with {_GRID},
far as (select a.case_id, a.node, a.q, coalesce(min((a.s - b.s) ** 2 + 2.25 * (a.y - b.y) ** 2 + (a.m - b.m) ** 2), 'inf'::double)::double as d2
  from g a left join g b on a.case_id = b.case_id and b.q >= 300 group by a.case_id, a.node, a.q)
"""


@query(_FAR + "select case_id, node, d2 from far")
def grid_distance(spark, d):
    return G.distance_transform(_grid(spark, d), "case_id", AXES, F.col("q") >= 300, (1.0, 1.5, 1.0)).select("case_id", "node", "d2")


@query(f"""with {_GRID},
edge as (
  select a.* from g a where a.q >= 240 and (select count(*) from g b where b.case_id = a.case_id and b.q >= 240 and abs(a.s - b.s) + abs(a.y - b.y) + abs(a.m - b.m) = 1) < 6)
select a.case_id, a.node, coalesce(min((a.s - b.s) ** 2 + (a.y - b.y) ** 2 + (a.m - b.m) ** 2), 'inf'::double)::double as d2, coalesce(min((a.s - b.s) ** 2 + (a.y - b.y) ** 2 + (a.m - b.m) ** 2), 'inf'::double) <= 2 as band
from g a left join edge b on a.case_id = b.case_id group by a.case_id, a.node""")
def grid_boundary_band(spark, d):
    return G.boundary_band(_grid(spark, d), "case_id", AXES, F.col("q") >= 240, 2**0.5 + 1e-9).select("case_id", "node", "d2", "band")


@query(f"""with {_GRID}
select a.case_id, a.node, coalesce(min((a.s - b.s) ** 2 + (a.y - b.y) ** 2 + (a.m - b.m) ** 2), 'inf'::double)::double as d2,
  a.q < 110 and coalesce(min((a.s - b.s) ** 2 + (a.y - b.y) ** 2 + (a.m - b.m) ** 2), 'inf'::double) >= 4 as outer
from g a left join g b on a.case_id = b.case_id and b.q >= 300 group by a.case_id, a.node, a.q""".replace(" as outer", ' as "outer"'))
def grid_outer_background(spark, d):
    return G.outer_background(_grid(spark, d), "case_id", AXES, F.col("q") >= 300, F.col("q") < 110, 2.0).select("case_id", "node", "d2", "outer")


_EDGES = """e0 as materialized (
  select a.case_id, a.node as a, b.node as b from g a join g b on a.case_id = b.case_id and (b.s - a.s, b.y - a.y, b.m - a.m) in ((1, 0, 0), (0, 1, 0), (0, 0, 1)))"""


def _fusion_sql(rounds: int) -> str:
    """The rounds of fusion written out; those after the last merge change nothing."""
    parts = [f"with {_GRID}", _EDGES, "goal as (select case_id, ceil(count(*) / 8.0)::bigint as target from g group by case_id)", "r0 as materialized (select case_id, node, node as region, q, c from g)"]
    for i in range(rounds):
        parts.append(f"""t{i} as materialized (select case_id, region, count(*) as n, sum(q)::double as q, sum(c)::double as c from r{i} group by all),
x{i} as (select case_id, count(*) - target as excess from t{i} join goal using (case_id) group by case_id, target),
c{i} as materialized (
  select distinct e.case_id, least(p.region, o.region) as lo, greatest(p.region, o.region) as hi
  from e0 e join r{i} p on p.case_id = e.case_id and p.node = e.a join r{i} o on o.case_id = e.case_id and o.node = e.b join x{i} on x{i}.case_id = e.case_id and excess > 0 where p.region <> o.region),
d{i} as materialized (
  select c.case_id, lo, hi, a.n * b.n / (a.n + b.n) * ((a.q / a.n - b.q / b.n) * (a.q / a.n - b.q / b.n) + (a.c / a.n - b.c / b.n) * (a.c / a.n - b.c / b.n)) as cost
  from c{i} c join t{i} a on a.case_id = c.case_id and a.region = lo join t{i} b on b.case_id = c.case_id and b.region = hi),
p{i} as materialized (
  select * from (select case_id, lo as region, hi as other, cost, lo, hi from d{i} union all select case_id, hi, lo, cost, lo, hi from d{i})
  qualify row_number() over (partition by case_id, region order by cost, lo, hi) = 1),
w{i} as materialized (select case_id, lo, hi, cost from p{i} group by all having count(*) = 2),
v{i} as (select case_id, lo as member, lo as root from w{i} union all select case_id, hi, lo from w{i}),
m{i} as (
  select case_id, hi as region, lo as root, cost, lo, hi from w{i}
  union all
  select p.case_id, p.region, v.root, cost, lo, hi from p{i} p join v{i} v on v.case_id = p.case_id and v.member = p.other where not exists (select 1 from v{i} o where o.case_id = p.case_id and o.member = p.region)),
k{i} as materialized (
  select * from (select m.*, row_number() over (partition by case_id order by cost, lo, hi) as place from m{i} m) join x{i} using (case_id) where place <= excess),
r{i + 1} as materialized (select r.case_id, node, coalesce(k.root, r.region) as region, q, c from r{i} r left join k{i} k on k.case_id = r.case_id and k.region = r.region)""")
    return ",\n".join(parts) + f"\nselect case_id, node, region from r{rounds}"


def _nodes(cells):
    return cells.select(F.col("case_id").alias("case"), "node", "q", "c")


@query(_fusion_sql(9))
def region_fusion(spark, d):
    """An eighth as many regions as cells."""
    cells = _grid(spark, d)
    edges = R.grid_edges(cells, "case_id", AXES, "node")
    return R.fuse_regions(_nodes(cells), edges, ["q", "c"], F.ceil(F.col("n") / 8)).select(F.col("case").alias("case_id"), "node", "region")


def _exchange_sql(sweeps: int) -> str:
    parts = [f"with {_GRID}", _EDGES, "r0 as (select case_id, node, s // 2 * 100 + y // 2 * 10 + m // 3 as region, q, c from g)"]
    parts.append("t as materialized (select case_id, region, avg(q) as q, avg(c) as c from r0 group by all)")
    parts.append("""z as (select e.case_id, p.region as one, o.region as two from e0 e join r0 p on p.case_id = e.case_id and p.node = e.a join r0 o on o.case_id = e.case_id and o.node = e.b where p.region <> o.region)""")
    parts.append("near as materialized (select case_id, one, two from z union select case_id, two, one from z union select case_id, region, region from t)")
    for i in range(sweeps):
        parts.append(f"""r{i + 1} as materialized (
  select r.case_id, r.node, two as region, r.q, r.c from r{i} r join near on near.case_id = r.case_id and one = r.region join t on t.case_id = r.case_id and t.region = two
  qualify row_number() over (partition by r.case_id, r.node order by (r.q - t.q) * (r.q - t.q) + (r.c - t.c) * (r.c - t.c), two <> r.region, two) = 1)""")
    return ",\n".join(parts) + f"\nselect case_id, node, region from r{sweeps}"


@query(_exchange_sql(3))
def region_exchange(spark, d):
    """Members of boxes of 2 x 2 x 3 cells, exchanged with neighbouring boxes."""
    cells = _grid(spark, d)
    box = (F.floor(F.col("s") / 2) * 100 + F.floor(F.col("y") / 2) * 10 + F.floor(F.col("m") / 3)).cast("long")
    members = cells.select(F.col("case_id").alias("case"), "node", box.alias("region"))
    edges = R.grid_edges(cells, "case_id", AXES, "node")
    return R.exchange_members(_nodes(cells), members, edges, ["q", "c"]).select(F.col("case").alias("case_id"), "node", "region")


@query()
def region_watershed(spark, d):
    """Quantities flooded from the cells that sold nothing or next to it; equal to a sequential forest in the tests."""
    cells = _grid(spark, d)
    marker = F.when(F.col("q") <= 20, F.col("node"))
    nodes = cells.select(F.col("case_id").alias("case"), "node", F.col("q").alias("height"), marker.alias("marker"))
    return R.watershed(nodes, R.grid_edges(cells, "case_id", AXES, "node")).select(F.col("case").alias("case_id"), "node", "marker")


def _bucketed(spark, d):
    """Cells by their distance to those with much sold: within, near and far."""
    far = G.distance_transform(_grid(spark, d), "case_id", AXES, F.col("q") >= 260)
    bucket = F.when(F.col("d2") == 0, "within").when(F.col("d2") <= 2, "near").otherwise("far")
    return far.select(F.col("case_id").alias("case"), bucket.alias("bucket"), F.col("node").alias("point"), *AXES)


@query(f"""with recursive {_GRID},
far as (
  select a.case_id as "case", a.node as point, a.s, a.y, a.m, coalesce(min((a.s - b.s) ** 2 + (a.y - b.y) ** 2 + (a.m - b.m) ** 2), 'inf'::double) as d2
  from g a left join g b on a.case_id = b.case_id and b.q >= 260 group by all),
p as (select "case", case when d2 = 0 then 'within' when d2 <= 2 then 'near' else 'far' end as bucket, point, s, y, m from far),
w(bucket, w) as (values ('within', 5), ('near', 3), ('far', 2)),
sizes as (select "case", bucket, count(*) as n from p group by all),
e as (select "case", bucket, n, 14.0::double * w / sum(w) over (partition by "case") as x from sizes join w using (bucket)),
budgets as (
  select "case", bucket, least(floor(x)::bigint + case when row_number() over (partition by "case" order by floor(x) - x, bucket) <= 14 - sum(floor(x)) over (partition by "case") then 1 else 0 end, n) as budget from e),
f(k, "case", bucket, budget, chosen) as (
  select 1, "case", bucket, any_value(budget), [arg_min({{'p': point, 's': s, 'y': y, 'm': m}}, point)] from p join budgets using ("case", bucket) group by "case", bucket
  union all
  select f.k + 1, "case", bucket, any_value(f.budget), list_append(any_value(chosen), arg_min({{'p': point, 's': s, 'y': y, 'm': m}}, (-list_min(list_transform(chosen, lambda c: (c.s - s) ** 2 + (c.y - y) ** 2 + (c.m - m) ** 2)), point)))
  from f join p using ("case", bucket) where f.k < f.budget group by f.k, "case", bucket)
select "case" as case_id, bucket, unnest(chosen).p as point, generate_subscripts(chosen, 1) - 1 as place from f where k = budget""")
def strategic_seeds(spark, d):
    """Fourteen seeds a case over three buckets of distance, each the farthest from those before in its whole group."""
    points = saved(_bucketed(spark, d))
    sizes = points.groupBy("case", "bucket").agg(F.count(F.lit(1)).alias("n"))
    budgets = S.share_budgets(sizes, 14, {"within": 5.0, "near": 3.0, "far": 2.0})
    return S.farthest_cover(points, budgets, AXES).select(F.col("case").alias("case_id"), "bucket", "point", "place")
