"""Sparse supervision of the grids of suppliers, years and months: scores, votes, slices, seeds and losses."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataframe.core.storage import table
from strataframe.operators import supervision as S
from strataframe.queries.grid_queries import _GRID, AXES, _grid
from strataframe.queries.registry import query, rounded

_LABELLED = f"""with recursive {_GRID},
l as (select case_id, s, y, m, node, q, c, coalesce(label, 0) as truth, case when c >= 9 then 2 when c <= 4 then 1 when c = 7 then -1 else 0 end as pred, s // 2 * 100 + y // 2 * 10 + m // 3 as segment from g)
"""


def _labelled(spark, d):
    c = F.col("c")
    pred = F.when(c >= 9, 2).when(c <= 4, 1).when(c == 7, -1).otherwise(0)
    segment = (F.floor(F.col("s") / 2) * 100 + F.floor(F.col("y") / 2) * 10 + F.floor(F.col("m") / 3)).cast("long")
    return _grid(spark, d).select("case_id", *AXES, "node", "q", "c", F.coalesce("label", F.lit(0)).alias("truth"), pred.alias("pred"), segment.alias("segment"))


@query(f"""with {_GRID}, e as (select case_id, max(s) + 1 as n from g group by all),
k as (select case_id, s + greatest((8 - n) // 2, 0) - greatest((n - 8) // 2, 0) as s, y + 2 as y, m - 1 as m, node from g join e using (case_id)),
k2 as (select * from k where s between 0 and 7 and y between 0 and 10 and m between 0 and 8)
select case_id, s, y, m, coalesce(node, -1) as node from (select case_id, i.s::bigint as s, j.y::bigint as y, k.m::bigint as m from e, range(8) i(s), range(11) j(y), range(9) k(m)) left join k2 using (case_id, s, y, m)""")
def grid_center_fit(spark, d):
    return S.center_fit(_grid(spark, d).select("case_id", *AXES, "node"), "case_id", AXES, (8, 11, 9), {"node": -1})


_SCORES = _LABELLED + """, k as (
  select case_id, cl as class, count(*) filter (pred = cl) as n_pred, count(*) filter (truth = cl) as n_truth, count(*) filter (pred = cl and truth = cl) as n_both from l, (select unnest([0, 1, 2, 3]) as cl) group by all),
f as (select *, case when n_pred + n_truth > 0 then 2 * n_both / (n_pred + n_truth) else 1 end as dice, case when n_pred + n_truth > 0 then n_both / (n_pred + n_truth - n_both) else 1 end as iou, n_both / nullif(n_truth, 0) as recall from k)
"""


@query(_SCORES + "select case_id, class, n_pred, n_truth, n_both, round(dice, 4) as dice, round(iou, 4) as iou, round(recall, 4) as recall from f")
def grid_class_scores(spark, d):
    return rounded(S.class_scores(_labelled(spark, d), "case_id", "pred", "truth", [0, 1, 2, 3]))


@query(_SCORES + """, o as (select case_id, avg((pred = truth)::int) as accuracy, avg((pred >= 0)::int) as coverage from l group by case_id)
select case_id, round(any_value(accuracy), 4) as accuracy, round(any_value(coverage), 4) as coverage, round(avg(dice) filter (class <> 0), 4) as dice_foreground, round(avg(dice), 4) as dice_all from f join o using (case_id) group by case_id""")
def grid_propagated_scores(spark, d):
    return rounded(S.propagated_scores(_labelled(spark, d), "case_id", "pred", "truth", [0, 1, 2, 3]))


@query(_LABELLED + """, v as (select case_id, segment, truth, count(*) as v from l where node % 3 = 0 and truth <> 0 group by all),
won as (select case_id, segment, truth as seeded from v qualify row_number() over (partition by case_id, segment order by v desc, truth) = 1)
select case_id, node, coalesce(seeded, 0) as filled from l left join won using (case_id, segment)""")
def grid_fill_segments(spark, d):
    """Boxes of cells filled with the label that most of their seeds have, every third cell being one."""
    cells = _labelled(spark, d)
    votes = S.segment_votes(cells, "case_id", "segment", "truth", F.col("node") % 3 == 0, 0)
    return S.fill_segments(cells, "case_id", "segment", votes, "truth", "filled").select("case_id", "node", "filled")


@query(_LABELLED + """, n as (select case_id, 's' as axis, s as place, count(*) filter (truth <> 0) as n from l group by all union all select case_id, 'y', y, count(*) filter (truth <> 0) from l group by all union all select case_id, 'm', m, count(*) filter (truth <> 0) from l group by all),
best as (select * from n qualify row_number() over (partition by case_id, axis order by n desc, place) <= greatest(ceil(0.2 * count(*) over (partition by case_id, axis)), 1))
select l.case_id, l.node, exists (select 1 from best b where b.case_id = l.case_id and ((axis = 's' and place = l.s) or (axis = 'y' and place = l.y) or (axis = 'm' and place = l.m))) as supervised from l""")
def grid_supervised_slices(spark, d):
    return S.supervised_by_slices(_labelled(spark, d), "case_id", AXES, F.col("truth") != 0, ratio=0.2).select("case_id", "node", "supervised")


_SLICES = _LABELLED + """, sides as (
  select l.*, (select count(*) from l o where o.case_id = l.case_id and o.truth <> 0 and o.s = l.s and abs(o.y - l.y) + abs(o.m - l.m) = 1) as ns,
    (select count(*) from l o where o.case_id = l.case_id and o.truth <> 0 and o.y = l.y and abs(o.s - l.s) + abs(o.m - l.m) = 1) as ny,
    (select count(*) from l o where o.case_id = l.case_id and o.truth <> 0 and o.m = l.m and abs(o.s - l.s) + abs(o.y - l.y) = 1) as nm from l),
u as (
  select case_id, 's' as axis, s as place, truth, truth <> 0 and ns < 4 as edge from sides union all
  select case_id, 'y', y, truth, truth <> 0 and ny < 4 from sides union all select case_id, 'm', m, truth, truth <> 0 and nm < 4 from sides),
k as (select sqrt(sum((truth <> 0)::int) / sum((truth = 1)::int)) as r1, sqrt(sum((truth <> 0)::int) / sum((truth = 2)::int)) as r2 from l),
f as (
  select case_id, axis, place, avg((truth <> 0)::int) as foreground, avg(edge::int) as boundary, (bool_or(truth = 1)::int * any_value(r1) + bool_or(truth = 2)::int * any_value(r2)) / any_value(r1 + r2) as rarity
  from u, k group by all),
z as (select *, 0.5 * boundary + 0.3 * foreground + 0.2 * rarity as score from f)
"""


@query(_SLICES + "select case_id, axis, place, round(foreground, 4) as foreground, round(boundary, 4) as boundary, round(rarity, 4) as rarity, round(score, 4) as score from z")
def grid_slice_scores(spark, d):
    return rounded(S.slice_scores(_labelled(spark, d), "case_id", AXES, "truth", [1, 2], None, (0.5, 0.3, 0.2)))


@query(_SLICES + """, o as (select *, row_number() over (order by round(score, 9) desc, case_id, axis, place) as k from z),
t(k, used) as (
  select 0::bigint, [{'c': 0::bigint, 'a': '', 'p': 0::bigint}][2:]
  union all
  select o.k, case when len(list_filter(used, lambda x: x.c = o.case_id and x.a = o.axis and abs(x.p - o.place) <= 1)) = 0 and len(list_filter(used, lambda x: x.c = o.case_id)) < 4
    then list_append(used, {'c': o.case_id, 'a': o.axis, 'p': o.place}) else used end
  from t join o on o.k = t.k + 1 where len(used) < (select round(count(*) * 0.1) from z)),
w as (select unnest(used) as x, generate_subscripts(used, 1) - 1 as rank from t qualify row_number() over (order by k desc) <= len(used) and k = max(k) over ())
select x.c as case_id, x.a as axis, x.p as place, rank from w where rank < (select greatest(round(count(*) * 0.1), 1) from z)""")
def grid_select_slices(spark, d):
    """A tenth of all slices, none next to another, four a case at most."""
    scores = S.slice_scores(_labelled(spark, d), "case_id", AXES, "truth", [1, 2], None, (0.5, 0.3, 0.2))
    return S.select_slices(scores.withColumn("score", F.round("score", 9)), "case_id", 0.1, 1, 4).select("case_id", "axis", "place", "rank")


_SEEDS = _LABELLED + """, n as (select case_id, sum((truth = 1)::int) as n1, sum((truth = 2)::int) as n2 from l group by case_id),
fl as (select *, floor(30.0::double * (n1 / (n1 + n2)))::int as f1, floor(30.0::double * (n2 / (n1 + n2)))::int as f2 from n),
b as (
  select case_id, 0 as truth, 10 as budget from fl union all
  select case_id, 1, f1 + case when (n2 > n1)::int < 30 - f1 - f2 then 1 else 0 end from fl union all
  select case_id, 2, f2 + case when (n1 >= n2)::int < 30 - f1 - f2 then 1 else 0 end from fl)
"""


@query(_SEEDS + "select case_id, truth, budget::bigint as budget from b")
def grid_seed_budgets(spark, d):
    return S.seed_budgets(_labelled(spark, d), "case_id", "truth", [1, 2], 40, 0.25)


@query(_SEEDS + """, seeds as (
  select l.* from l join b using (case_id, truth) qualify row_number() over (partition by case_id, truth order by md5('5:' || case_id || ':' || s || ':' || y || ':' || m)) <= budget)
select l.case_id, l.node, exists (select 1 from seeds o where o.case_id = l.case_id and abs(o.s - l.s) <= 1 and abs(o.y - l.y) <= 1 and abs(o.m - l.m) <= 1) as supervised from l""")
def grid_point_supervision(spark, d):
    """Forty seeds a case, grown by a cell on every side."""
    cells = _labelled(spark, d)
    seeds = S.point_seeds(cells, "case_id", AXES, "truth", S.seed_budgets(cells, "case_id", "truth", [1, 2], 40, 0.25), seed=5)
    return S.dilated(cells, seeds, "case_id", AXES, 1).select("case_id", "node", "supervised")


@query("""
with e as (select label, vec_id % 4 as target, (vec_id % 7)::double as w, [list_sum(list_transform(embedding[k * 16 + 1:k * 16 + 16], lambda x: x::double)) for k in [0, 1, 2, 3]] as z from embeddings),
p as (select *, list_max(z) as t, list_sum(list_transform(z, lambda x: exp(x - list_max(z)))) as d from e where target <> 3),
c as (select label, target, w, w * (t + ln(d) - z[target + 1]) as ce, unnest(range(4)) as k, unnest(list_transform(z, lambda x: exp(x - t) / d)) as prob from p),
s as (select label, k, sum(w * prob * (k = target)::int) as i, sum(w * (prob + (k = target)::int)) as d from c group by all),
o as (select label, sum(ce) / sum(w) as ce from c where k = 0 group by label)
select label, round(1 - avg((2 * i + 1e-6) / (d + 1e-6)), 4) as dice_loss, round(any_value(ce), 4) as cross_entropy from s join o using (label) group by label""")
def masked_losses(spark, d):
    """Vectors folded into four scores against their id modulo four, the last of which is to be ignored."""
    zero = F.lit(0.0)
    fold = [F.aggregate(F.slice("embedding", k * 16 + 1, 16), zero, lambda s, x: s + x.cast("double")) for k in range(4)]
    rows = table(spark, d, "embeddings").select("label", (F.col("vec_id") % 4).alias("target"), (F.col("vec_id") % 7).alias("w"), F.array(*fold).alias("z"))
    return rounded(S.masked_losses(rows, "label", "z", "target", F.col("w"), 4, ignore=3))


@query("select o_orderpriority, round(case when count(*) filter (o_orderstatus = 'F' and o_totalprice > 1000) > 0 and count(*) filter (o_orderstatus <> 'F' and o_totalprice > 1000) > 0 then count(*) filter (o_orderstatus = 'F' and o_totalprice > 1000) / count(*) filter (o_orderstatus <> 'F' and o_totalprice > 1000) else 1 end, 4) as ratio from orders group by all")
def source_ratio(spark, d):
    return rounded(S.source_ratio(table(spark, d, "orders"), "o_orderpriority", F.col("o_orderstatus") == "F", F.col("o_totalprice") > 1000))


@query("""
with f as (select c_custkey, ((row_number() over (order by md5('9:' || c_custkey), c_custkey) - 1) % 5)::int as fold from customer)
select c_custkey, fold, split from f, (select unnest(['training', 'validation']) as split) where (split = 'training' and fold in (0, 1, 2, 3)) or (split = 'validation' and fold in (3, 4))""")
def cross_validation(spark, d):
    """Five folds of customers in hash order; the fourth is in both lists."""
    rows = table(spark, d, "customer").select("c_custkey")
    return S.cross_validation(rows, 5, [0, 1, 2, 3], [3, 4], S.hash_order(9, "c_custkey"), "c_custkey").select("c_custkey", "fold", "split")
