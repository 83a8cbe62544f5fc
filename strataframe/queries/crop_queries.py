"""Objects, surfaces, crops and patches of the grids of suppliers, years and months."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataframe.operators import crops as C
from strataframe.operators import grids as G
from strataframe.queries.grid_queries import _GRID, _REACH, AXES, _grid
from strataframe.queries.registry import query, rounded

_SIZED = _REACH + ", sizes as (select case_id, component, count(*) as n from found group by all)"


@query(_SIZED + "\nselect g.case_id, g.node, coalesce(n < 4, false) as small from g left join found using (case_id, node) left join sizes using (case_id, component)")
def grid_small_objects(spark, d):
    return G.small_objects(_grid(spark, d), "case_id", AXES, "label", 4, side=4).select("case_id", "node", "small")


@query(f"""with recursive {_GRID},
l as (select * from g where q < 200),
near as (select a.case_id, a.node as a, b.node as b from l a join l b on a.case_id = b.case_id and abs(a.s - b.s) + abs(a.y - b.y) + abs(a.m - b.m) = 1),
ends as (select l.case_id, l.node from l join (select case_id, min(s) as s0, max(s) as s1 from g group by all) using (case_id) where s in (s0, s1) or y in (0, 6) or m in (0, 11)),
reach(case_id, node) as (select case_id, node from ends union select r.case_id, near.b from reach r join near on near.case_id = r.case_id and near.a = r.node)
select g.case_id, g.node, q < 200 and r.node is null as hole from g left join reach r using (case_id, node)""")
def grid_holes(spark, d):
    """Cells of little that those of much enclose."""
    return G.holes(_grid(spark, d), "case_id", AXES, F.col("q") >= 200, side=4).select("case_id", "node", "hole")


@query(f"""with {_GRID},
pe as (select a.* from g a where a.q >= 230 and (select count(*) from g b where b.case_id = a.case_id and b.q >= 230 and abs(a.s - b.s) + abs(a.y - b.y) + abs(a.m - b.m) = 1) < 6),
te as (select a.* from g a where a.c >= 9 and (select count(*) from g b where b.case_id = a.case_id and b.c >= 9 and abs(a.s - b.s) + abs(a.y - b.y) + abs(a.m - b.m) = 1) < 6),
dp as (select p.case_id, p.node, min(sqrt((p.s - t.s) ** 2 + 2.25 * (p.y - t.y) ** 2 + (p.m - t.m) ** 2)) as d from pe p join te t using (case_id) group by all),
dt as (select t.case_id, t.node, min(sqrt((p.s - t.s) ** 2 + 2.25 * (p.y - t.y) ** 2 + (p.m - t.m) ** 2)) as d from pe p join te t using (case_id) group by all),
p as (select case_id, count(*) as n, sum(d) as s, max(d) as m, quantile_cont(d, 0.95) as q, count(*) filter (d <= 1) as k from dp group by all),
t as (select case_id, count(*) as n, sum(d) as s, max(d) as m, quantile_cont(d, 0.95) as q, count(*) filter (d <= 1) as k from dt group by all)
select case_id, p.n as n_pred, t.n as n_truth, round(p.s / p.n, 4) as average, round((p.s + t.s) / (p.n + t.n), 4) as average_both, round(greatest(p.m, t.m), 4) as hausdorff,
  round(greatest(p.q, t.q), 4) as hausdorff_percent, round((p.k + t.k) / (p.n + t.n), 4) as surface_dice from p join t using (case_id)""")
def grid_surface_metrics(spark, d):
    """Cells of much against those of many lines, years half as long again as the rest."""
    return rounded(G.surface_metrics(_grid(spark, d), "case_id", AXES, F.col("q") >= 230, F.col("c") >= 9, (1.0, 1.5, 1.0)))


@query(_REACH + """, votes as (select case_id, component, c % 5 as k, count(*) as v from found join l using (case_id, node) group by all),
won as (select * from votes qualify row_number() over (partition by case_id, component order by k = 0, v desc, k) = 1),
own as (select case_id, component, count(*) as n_cells, avg(s) as sm, min(s) as s0, max(s) as s1, avg(y) as ym, min(y) as y0, max(y) as y1, avg(m) as mm, min(m) as m0, max(m) as m1 from found join l using (case_id, node) group by all)
select case_id, component, n_cells, round(sm, 4) as s_mean, s0 as s_low, s1 as s_high, round(ym, 4) as y_mean, y0 as y_low, y1 as y_high, round(mm, 4) as m_mean, m0 as m_low, m1 as m_high, k as kind, round(v / n_cells, 4) as kind_share
from own join won using (case_id, component)""")
def grid_instances(spark, d):
    """Instances with their centres, boxes and most frequent kind, the kind being the number of lines modulo five."""
    found = G.grid_components(_grid(spark, d), "case_id", AXES, "label")
    return rounded(G.instance_table(found, "case_id", AXES, F.col("c") % 5))


@query(f"with {_GRID} select case_id, label, y, count(*) as n_cells from g where label is not null group by all")
def grid_slices(spark, d):
    return G.slices_with(_grid(spark, d), "case_id", "y", "label")


@query(f"""with {_GRID}, e as (select case_id, max(s) + 1 as n from g group by all)
select case_id, s - ss as s, y - 1 as y, m - 3 as m, node from (select g.*, greatest(n // 2 - least(6, n) // 2, 0) as ss, least(6, n) as sz from g join e using (case_id)) where s >= ss and s < ss + sz and y between 1 and 5 and m between 3 and 8""")
def grid_center_crop(spark, d):
    return C.center_crop(_grid(spark, d), "case_id", AXES, (6, 5, 6)).select("case_id", *AXES, "node")


@query(f"""with {_GRID}, b as (select case_id, greatest(min(s) - 1, 0) as s0, max(s) + 1 as s1, greatest(min(y) - 1, 0) as y0, max(y) + 1 as y1, greatest(min(m) - 1, 0) as m0, max(m) + 1 as m1 from g where q >= 420 group by all)
select case_id, s - s0 as s, y - y0 as y, m - m0 as m, node from g join b using (case_id) where s between s0 and s1 and y between y0 and y1 and m between m0 and m1""")
def grid_crop_foreground(spark, d):
    return C.crop_foreground(_grid(spark, d), "case_id", AXES, F.col("q") >= 420, 1).select("case_id", *AXES, "node")


def _pad_sql(to: str) -> str:
    return f"""with {_GRID}, e as (select case_id, max(s) + 1 as n from g group by all), a as (select case_id, n, unnest(range(-2, n + 1)) as s from e)
select case_id, s + 2 as s, y + 1 as y, m, node from (
  select a.case_id, a.s, b.y, c.m, {to} as ts, {to.replace('a.s', 'b.y').replace('n', '7')} as ty, c.m as tm from a, (select unnest(range(-1, 10)) as y) b, range(12) c(m)) x
  join (select case_id, s as ts, y as ty, m as tm, node from g) using (case_id, ts, ty, tm)"""


_REFLECT = "least(((a.s % greatest(2 * n - 2, 1)) + greatest(2 * n - 2, 1)) % greatest(2 * n - 2, 1), greatest(2 * n - 2, 1) - ((a.s % greatest(2 * n - 2, 1)) + greatest(2 * n - 2, 1)) % greatest(2 * n - 2, 1))"


@query(_pad_sql(_REFLECT))
def grid_pad_reflect(spark, d):
    return C.pad(_grid(spark, d), "case_id", AXES, (2, 1, 0), (1, 3, 0), "reflect").select("case_id", *AXES, "node")


@query(_pad_sql("((a.s % n) + n) % n"))
def grid_pad_wrap(spark, d):
    return C.pad(_grid(spark, d), "case_id", AXES, (2, 1, 0), (1, 3, 0), "wrap").select("case_id", *AXES, "node")


@query(f"with {_GRID} select case_id, s + 1 as s, y, m + 2 as m, node, q from g union all select case_id, s, y, m, null, -1 from (select case_id, unnest(range(max(s) + 3)) as s from g group by case_id), range(7) y(y), range(14) m(m) where s = 0 or m < 2 or (s - 1, case_id) not in (select s, case_id from g)")
def grid_pad_constant(spark, d):
    return C.pad(_grid(spark, d), "case_id", AXES, (1, 0, 2), (1, 0, 0), fill={"q": -1}).select("case_id", *AXES, "node", "q")


@query(f"with {_GRID}, e as (select case_id, max(s) as n from g group by all) select case_id, n - s as s, 11 - m as y, y as m, node from g join e using (case_id)")
def grid_flip_rotate(spark, d):
    """Suppliers mirrored, then a quarter turn of years towards months."""
    turned = C.rotate90(C.flip(_grid(spark, d), "case_id", AXES, ["s"]), "case_id", AXES, 1, ("y", "m"))
    return turned.select("case_id", *AXES, "node")


_UNIT = "(('0x' || substr(md5({}), 1, 13))::bigint / 4503599627370496.0::double + pow(2.0, -53))"
_CENTERS = f"""with {_GRID}, e as (select case_id, max(s) + 1 as n from g group by all),
k as (select g.*, i.i as sample, case when q >= 260 then 0 else 1 end as kind from g, range(5) i(i)),
b as (select case_id, sample, kind, s, y, m from k qualify row_number() over (partition by case_id, sample, kind order by -ln({_UNIT.format("'3:' || sample || ':' || case_id || ':' || s || ':' || y || ':' || m")}) / WEIGHT) = 1),
d as (select * from b qualify row_number() over (partition by case_id, sample order by -ln({_UNIT.format("'4:' || sample || ':' || case_id || ':' || kind")}) / [2.0, 1.0][kind + 1]) = 1),
centers as (
  select case_id, sample::int as sample, ['much', 'rest'][kind + 1] as kind, (case when n - 2 < 2 then n // 2 else least(greatest(s, 2), n - 2) end)::bigint as s, least(greatest(y, 1), 5)::bigint as y, least(greatest(m, 3), 9)::bigint as m
  from d join e using (case_id))
"""


def _centers(spark, d, **more):
    kind = F.when(F.col("q") >= 260, "much").otherwise("rest")
    return C.crop_centers(_grid(spark, d), "case_id", AXES, kind, {"much": 2.0, "rest": 1.0}, 5, (4, 3, 6), seed=3, **more)


@query(_CENTERS.replace("WEIGHT", "1.0") + "select * from centers")
def grid_crop_centers(spark, d):
    """Five crops a case, two of three around cells of much."""
    return _centers(spark, d)


@query(_CENTERS.replace("WEIGHT", "(1.0 + q)") + "select * from centers")
def grid_weighted_centers(spark, d):
    return _centers(spark, d, weight=F.col("q") + 1)


@query(_CENTERS.replace("WEIGHT", "1.0") + """select g.case_id, c.sample, g.s - (c.s - 2) as s, g.y - (c.y - 1) as y, g.m - (c.m - 3) as m, node
from g join centers c on c.case_id = g.case_id and g.s >= c.s - 2 and g.s < c.s + 2 and g.y >= c.y - 1 and g.y < c.y + 2 and g.m >= c.m - 3 and g.m < c.m + 3""")
def grid_patches(spark, d):
    return C.patches_at(_grid(spark, d), "case_id", AXES, _centers(spark, d), (4, 3, 6)).select("case_id", "sample", *AXES, "node")
