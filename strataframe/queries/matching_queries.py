"""Anchors and true boxes; draws by weight."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataframe.core.storage import table
from strataframe.operators import boxes as B
from strataframe.operators import matching as M
from strataframe.operators import partition as P
from strataframe.queries.registry import query, rounded

_ATSS = """
with t as (
  select p_partkey // 10 as image, p_partkey as truth, (p_partkey * 37 % 200)::double as cx, (p_partkey * 53 % 150)::double as cy, (10 + p_partkey * 7 % 40)::double as w, (10 + p_partkey * 11 % 30)::double as h from part),
tb as (select image, truth, cx, cy, cx - w / 2 as xmin, cy - h / 2 as ymin, cx + w / 2 as xmax, cy + h / 2 as ymax from t),
a as (
  select image, l as level, l * 10000 + i * 100 + j as anchor, (i + 0.5) * 20 * 2 ** l as cx, (j + 0.5) * 20 * 2 ** l as cy, 28.0 * 2 ** l as w
  from (select distinct image from t), range(0, 3) r(l), range(0, 10) x(i), range(0, 8) y(j) where i < floor(10 / 2 ** l) and j < floor(8 / 2 ** l)),
ab as (select image, level, anchor, cx, cy, cx - w / 2 as xmin, cy - w / 2 as ymin, cx + w / 2 as xmax, cy + w / 2 as ymax from a),
near as (
  select *, row_number() over (partition by image, truth, level order by (tcx - cx) * (tcx - cx) + (tcy - cy) * (tcy - cy), anchor) as place from (
    select ab.*, truth, tb.cx as tcx, tb.cy as tcy, tb.xmin as x0, tb.ymin as y0, tb.xmax as x1, tb.ymax as y1 from ab join tb using (image))),
c as (
  select *, greatest(least(xmax, x1) - greatest(xmin, x0), 0) * greatest(least(ymax, y1) - greatest(ymin, y0), 0) as inter,
    least(cx - x0, x1 - cx, cy - y0, y1 - cy) > 0.01 as inside from near where place <= 4),
s as (select *, inter / ((xmax - xmin) * (ymax - ymin) + (x1 - x0) * (y1 - y0) - inter) as iou from c),
"""


def _truths_and_anchors(spark, d):
    k, number = F.col("p_partkey"), lambda c: c.cast("double")
    corners = B.from_center(number(k * 37 % 200), number(k * 53 % 150), number(10 + k * 7 % 40), number(10 + k * 11 % 30))
    truths = table(spark, d, "part").select(F.floor(k / 10).cast("long").alias("image"), k.alias("truth"), *[c.alias(n) for n, c in corners.items()])
    places = truths.select("image").distinct().withColumn("level", F.explode(F.array(*map(F.lit, range(3)))))
    reach = lambda n: F.explode(F.sequence(F.lit(0), F.floor(F.lit(n) / F.pow(F.lit(2), F.col("level"))).cast("int") - 1))
    places = places.withColumn("i", reach(10)).withColumn("j", reach(8))
    stride = 20.0 * F.pow(F.lit(2.0), F.col("level"))
    half = 14.0 * F.pow(F.lit(2.0), F.col("level"))
    cx, cy = (F.col("i") + 0.5) * stride, (F.col("j") + 0.5) * stride
    sides = {"xmin": cx - half, "ymin": cy - half, "xmax": cx + half, "ymax": cy + half}
    return truths, places.select("image", "level", (F.col("level") * 10000 + F.col("i") * 100 + F.col("j")).cast("long").alias("anchor"), *[c.alias(n) for n, c in sides.items()])


@query(_ATSS.rstrip().rstrip(",") + "\nselect image, truth, level, anchor::bigint as anchor, (tcx - cx) * (tcx - cx) + (tcy - cy) * (tcy - cy) as d2 from near where place <= 4")
def nearest_anchors(spark, d):
    return M.nearest_anchors(*_truths_and_anchors(spark, d), 4)


@query(_ATSS + """
bar as (select image, truth, avg(iou) + stddev_samp(iou) as bar from s group by all),
best as (
  select image, anchor, truth, iou from s join bar using (image, truth) where iou >= bar - 1e-9 and inside
  qualify row_number() over (partition by image, anchor order by iou desc, truth) = 1)
select image, anchor::bigint as anchor, truth, round(iou, 4) as iou from ab left join best using (image, anchor)""")
def atss_match(spark, d):
    return rounded(M.atss_match(*_truths_and_anchors(spark, d), candidates=4))


@query("""
with r as (select o_orderkey, o_totalprice, -ln(('0x' || substr(md5('7:' || o_orderkey), 1, 13))::bigint::double / 4503599627370496.0 + pow(2.0, -53)) / o_totalprice as k from orders where o_totalprice > 0),
n as (select count(*) // 20 as n from orders)
select o_orderkey, round(o_totalprice, 4) as o_totalprice from r, n qualify row_number() over (order by k, o_orderkey) <= n""")
def weighted_sample(spark, d):
    """A twentieth of all orders, drawn by price."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return rounded(P.weighted_sample(orders, "o_totalprice", orders.count() // 20, "o_orderkey", seed=7).drop("sample_key"))


_CROWD = """with recursive b as (
  select p_partkey // 5 as image, p_partkey as box, (p_partkey * 37 % 31)::double as x, (p_partkey * 53 % 29)::double as y, (12 + p_partkey * 7 % 17)::double as w, (12 + p_partkey * 11 % 13)::double as h from part),
pairs as (
  select image, t.box as truth, p.box as pred, i / (t.w * t.h + p.w * p.h - i) as iou from (
    select image, t, p, greatest(least(t.x + t.w, p.x + 5 + p.w) - greatest(t.x, p.x + 5), 0) * greatest(least(t.y + t.h, p.y + 4 + p.h) - greatest(t.y, p.y + 4), 0) as i
    from (select image, b as t from b) join (select image, b as p from b) using (image)) where i > 0),
k as (select image, truth, row_number() over (partition by image order by truth) as k from (select distinct image, truth from pairs)),
m(image, k, used, total) as (
  select distinct image, 0::bigint, [0::bigint][2:], 0.0::double from pairs
  union all
  select m.image, k.k, list_append(used, coalesce(o.pred, -k.k)), total + coalesce(o.iou, 0)
  from m join k on k.image = m.image and k.k = m.k + 1 join (select image, truth, pred, iou from pairs union all select image, truth, null, 0 from k) o on o.image = k.image and o.truth = k.truth
  where o.pred is null or not list_contains(used, o.pred)),
best as (select image, arg_max(used, total) as used from m where k = (select max(k) from k where k.image = m.image) group by image)"""


@query(_CROWD + "\nselect image, truth, pred, round(iou, 4) as iou from best join k using (image) join pairs using (image, truth) where used[k.k] = pred and iou > 0.2")
def optimal_match(spark, d):
    """Five boxes an image against themselves, moved: the matching of greatest total overlap, then overlaps over 0.2."""
    k, number = F.col("p_partkey"), lambda c: c.cast("double")
    x, y, w, h = number(k * 37 % 31), number(k * 53 % 29), number(12 + k * 7 % 17), number(12 + k * 11 % 13)
    base = table(spark, d, "part").select(F.floor(k / 5).cast("long").alias("image"), k.alias("box"), x.alias("xmin"), y.alias("ymin"), (x + w).alias("xmax"), (y + h).alias("ymax"))
    moved = base.withColumns({"xmin": F.col("xmin") + 5, "xmax": F.col("xmax") + 5, "ymin": F.col("ymin") + 4, "ymax": F.col("ymax") + 4})
    met = B.overlap_join(base, moved, "image", 32.0).select(F.col("a_image").alias("image"), F.col("a_box").alias("truth"), F.col("b_box").alias("pred"), "iou")
    return rounded(M.optimal_match(met, "image", "truth", "pred", "iou", 0.2))
