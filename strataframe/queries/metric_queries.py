"""Evaluation metrics over documents and labels, and over line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataframe.core.storage import table
from strataframe.operators import detection as T
from strataframe.operators import metrics as M
from strataframe.queries.registry import query, r4, rounded


def _scored(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang", "n_chars").join(table(spark, d, "labels"), "doc_id")


_COUNTS = """
with s as (select lang, n_chars > 1500 as p, quality = 1 as t from documents join labels using (doc_id)),
c as (select lang, sum((p and t)::int)::double as tp, sum((p and not t)::int)::double as fp, sum((not p and not t)::int)::double as tn, sum((not p and t)::int)::double as fn from s group by lang),
m as (select *, tp / nullif(tp + fn, 0) as tpr, tn / nullif(fp + tn, 0) as tnr, tp / nullif(tp + fp, 0) as ppv, tn / nullif(tn + fn, 0) as npv, fp / nullif(fp + tn, 0) as fpr, fn / nullif(tp + fn, 0) as fnr from c)
"""


@query(_COUNTS + """
select lang, tp::bigint as tp, fp::bigint as fp, tn::bigint as tn, fn::bigint as fn, round(tpr, 4) as tpr, round(tnr, 4) as tnr, round(ppv, 4) as ppv, round(npv, 4) as npv, round(fnr, 4) as fnr, round(fpr, 4) as fpr,
  round(fp / nullif(fp + tp, 0), 4) as fdr, round(fn / nullif(fn + tn, 0), 4) as for_, round((sqrt(tpr * fpr) - fpr) / nullif(tpr - fpr, 0), 4) as pt, round(tp / nullif(tp + fn + fp, 0), 4) as ts,
  round((tp + tn) / nullif(tp + tn + fp + fn, 0), 4) as acc, round((tpr + tnr) / 2, 4) as ba, round(2 * tp / nullif(2 * tp + fn + fp, 0), 4) as f1,
  round((tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 4) as mcc, round(sqrt(ppv * tpr), 4) as fm, round(tpr + tnr - 1, 4) as bm, round(ppv + npv - 1, 4) as mk
from m""")
def confusion_metrics_17(spark, d):
    counts = M.confusion(_scored(spark, d), ["lang"], F.col("n_chars") > 1500, F.col("quality") == 1)
    return counts.select("lang", "tp", "fp", "tn", "fn", *[r4(c).alias(n) for n, c in M.confusion_metrics().items()])


@query(_COUNTS + "select lang, round(5 * tp / nullif(5 * tp + 4 * fn + fp, 0), 4) as f2, round(1.25 * tp / nullif(1.25 * tp + 0.25 * fn + fp, 0), 4) as f05 from m")
def fbeta(spark, d):
    counts = M.confusion(_scored(spark, d), ["lang"], F.col("n_chars") > 1500, F.col("quality") == 1)
    return counts.select("lang", r4(M.f_beta(2.0)).alias("f2"), r4(M.f_beta(0.5)).alias("f05"))


_AUC = """
with s as (select lang, n_chars, quality as t from documents join labels using (doc_id)),
r as (select lang, t, rank() over (partition by lang order by n_chars) + (count(*) over (partition by lang, n_chars) - 1) / 2.0 as r from s),
a as (select lang, sum(t)::bigint as n_pos, (count(*) - sum(t))::bigint as n_neg, (sum(r) filter (t = 1) - sum(t) * (sum(t) + 1) / 2.0) / nullif(sum(t) * (count(*) - sum(t)), 0) as auc from r group by lang)
"""


@query(_AUC + "select lang, n_pos, n_neg, round(auc, 4) as auc from a")
def roc_auc_by_class(spark, d):
    return rounded(M.roc_auc(_scored(spark, d), ["lang"], "n_chars", "quality"))


@query(_AUC + "select round(avg(auc), 4) as macro, round(sum(auc * n_pos) / sum(n_pos) filter (auc is not null), 4) as weighted from a")
def roc_auc_averages(spark, d):
    return rounded(M.averaged(M.roc_auc(_scored(spark, d), ["lang"], "n_chars", "quality"), "auc", "n_pos"))


@query("""
with s as (select n_chars, quality as t from documents join labels using (doc_id) union all select n_chars, toxic from documents join labels using (doc_id)),
r as (select t, rank() over (order by n_chars) + (count(*) over (partition by n_chars) - 1) / 2.0 as r from s)
select sum(t)::bigint as n_pos, (count(*) - sum(t))::bigint as n_neg, round((sum(r) filter (t = 1) - sum(t) * (sum(t) + 1) / 2.0) / nullif(sum(t) * (count(*) - sum(t)), 0), 4) as auc from r""")
def roc_auc_micro(spark, d):
    rows = _scored(spark, d)
    flat = rows.select("n_chars", F.col("quality").alias("t")).union(rows.select("n_chars", "toxic"))
    return rounded(M.roc_auc(flat, [], "n_chars", "t"))


@query("""
with s as (select lang, n_chars, sum(quality) as pos, count(*) as n from documents join labels using (doc_id) group by all),
c as (select lang, pos, sum(pos) over (partition by lang order by n_chars desc) * 1.0 / sum(n) over (partition by lang order by n_chars desc) as p from s)
select lang, sum(pos)::bigint as n_pos, round(sum(p * pos) / nullif(sum(pos), 0), 4) as ap from c group by lang""")
def avg_precision(spark, d):
    return rounded(M.average_precision(_scored(spark, d), ["lang"], "n_chars", "quality"))


_OVERLAP = """
with s as (select l_suppkey, l_returnflag, sum(((l_quantity > 25) and (l_discount > 0.04))::int) as i, sum((l_quantity > 25)::int) as p, sum((l_discount > 0.04)::int) as t from lineitem group by all),
o as (select *, case when t = 0 then null else 2.0 * i / nullif(p + t, 0) end as dice, case when t = 0 then null else i * 1.0 / nullif(p + t - i, 0) end as iou from s)
"""


def _overlap(spark, d):
    return M.overlaps(table(spark, d, "lineitem"), ["l_suppkey", "l_returnflag"], F.col("l_quantity") > 25, F.col("l_discount") > 0.04)


@query(_OVERLAP + "select l_suppkey, l_returnflag, i::bigint as inter, p::bigint as n_pred, t::bigint as n_true, round(dice, 4) as dice, round(iou, 4) as iou from o")
def dice_iou(spark, d):
    return rounded(_overlap(spark, d))


@query(_OVERLAP + """, w as (select *, coalesce(1.0 / nullif(t * t, 0), max(1.0 / nullif(t * t, 0)) over (partition by l_suppkey), 0) as w from o)
select l_suppkey, round(sum(2.0 * i * w) / nullif(sum((p + t) * w), 0), 4) as gds from w group by l_suppkey""")
def generalized_dice(spark, d):
    return rounded(M.generalized_dice(_overlap(spark, d), ["l_suppkey"]))


@query(_OVERLAP + """, a as (select l_suppkey, avg(dice) as m, sum(dice) as s, count(dice) as n from o group by l_suppkey), b as (select l_returnflag, avg(dice) as m, sum(dice) as s from o group by l_returnflag)
select round(coalesce((select avg(m) from a), 0), 4) as mean, round(coalesce((select sum(s) from a), 0), 4) as sum, round(coalesce((select avg(coalesce(s, 0)) from a), 0), 4) as mean_batch_of_sums, (select sum(n) from a)::bigint as not_nans,
  round(coalesce((select avg(coalesce(m, 0)) from b), 0), 4) as mean_of_class_means, round((select max(s) from b), 4) as largest_class_sum""")
def reduction_modes(spark, d):
    return rounded(M.reduce_metric(_overlap(spark, d), "l_suppkey", "l_returnflag", "dice"))


@query("""
with e as (select l_suppkey, l_extendedprice - l_quantity * p_retailprice as e from lineitem join part on l_partkey = p_partkey)
select l_suppkey, round(avg(e * e), 4) as mse, round(avg(abs(e)), 4) as mae, round(sqrt(avg(e * e)), 4) as rmse, round(20 * log10(100000.0) - 10 * log10(nullif(avg(e * e), 0)), 4) as psnr from e group by l_suppkey""")
def regression_errors(spark, d):
    both = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rounded(M.regression(both, ["l_suppkey"], F.col("l_extendedprice"), F.col("l_quantity") * F.col("p_retailprice"), 100000.0))


@query("select event_type, round(var_pop(value), 4) as variance from events group by event_type")
def variance_score(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(r4(F.var_pop("value")).alias("variance"))


@query("select l_returnflag, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) as average, round(sum(l_quantity), 4) as weight from lineitem group by l_returnflag")
def cumulative_average(spark, d):
    return rounded(M.cumulative_average(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", "l_quantity"))


@query("""
with g as (select n_chars, sum(toxic) as pos, count(*) - sum(toxic) as neg from documents join labels using (doc_id) group by n_chars),
c as (select n_chars, sum(pos) over w as tp, sum(neg) over w as fp from g window w as (order by n_chars desc)), t as (select sum(pos) as total, min(n_chars) as low from g)
select n_chars::double as threshold, round(fp / 50.0, 4) as fps_per_image, round(tp / nullif(total, 0), 4) as sensitivity from c, t where n_chars > low
union all select null, 0.0, 0.0""")
def froc_curve(spark, d):
    return rounded(M.froc_curve(_scored(spark, d), "n_chars", "toxic", 50))


@query("""
with x as (select l_suppkey as img, floor(l_quantity / 10)::int as p, floor((l_quantity + 3) / 10)::int as t from lineitem),
i as (select img, p, t, count(*) as n from x where p > 0 and t > 0 group by all), a as (select img, p, count(*) as n from x where p > 0 group by all), b as (select img, t, count(*) as n from x where t > 0 group by all),
h as (select img, count(*) as tp, sum(i.n * 1.0 / (a.n + b.n - i.n)) as s from i join a using (img, p) join b using (img, t) where i.n * 1.0 / (a.n + b.n - i.n) > 0.5 group by img),
z as (select e.img, coalesce(tp, 0) as tp, coalesce(s, 0) as s, (select count(*) from a where a.img = e.img) as np, (select count(*) from b where b.img = e.img) as nt from (select distinct img from x) e left join h using (img))
select img as l_suppkey, tp::bigint as tp, (np - tp)::bigint as fp, (nt - tp)::bigint as fn, round(coalesce(s / nullif(tp + (np - tp) * 0.5 + (nt - tp) * 0.5, 0), 0), 4) as pq from z""")
def panoptic_pairs(spark, d):
    q = F.col("l_quantity")
    rows = table(spark, d, "lineitem").select("l_suppkey", F.floor(q / 10).cast("int").alias("p"), F.floor((q + 3) / 10).cast("int").alias("t"))
    return rounded(M.panoptic_quality(rows, "l_suppkey", "p", "t"))


@query("""
with g as (select lang, n_chars, sum(quality) as pos, count(*) as n from documents join labels using (doc_id) group by all),
c as (select lang, n_chars, sum(pos) over w as tp, sum(n) over w as n, sum(pos) over (partition by lang) as total from g window w as (partition by lang order by n_chars desc)),
p as (select lang, tp / nullif(total, 0) as recall, max(tp * 1.0 / n) over (partition by lang order by n_chars desc rows between current row and unbounded following) as best from c)
select l.lang, s::int as step, round(coalesce(max(best), 0), 4) as precision from (select distinct lang from g) l cross join range(0, 11) r(s) left join p on p.lang = l.lang and recall >= s / 10.0 group by l.lang, s""")
def coco_precision_envelope(spark, d):
    return rounded(M.precision_envelope(_scored(spark, d), ["lang"], "n_chars", "quality"))


@query("""
with m as (select l_suppkey, avg(l_quantity) as a, avg(l_discount) as b, avg(l_tax) as c from lineitem group by l_suppkey),
u as (select 'a' as class, a as v from m union all select 'b', b from m union all select 'c', c from m union all select 'mean', (a + b + c) / 3 from m)
select class, round(avg(v), 4) as mean, round(median(v), 4) as median, round(max(v), 4) as max, round(min(v), 4) as min, round(quantile_cont(v, 0.9), 4) as "90percentile", round(stddev_pop(v), 4) as std, count(v)::bigint as notnans from u group by class""")
def metrics_report(spark, d):
    by = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.avg("l_quantity").alias("a"), F.avg("l_discount").alias("b"), F.avg("l_tax").alias("c"))
    return rounded(M.report(by, ["a", "b", "c"]))


def _detections(spark, d):
    """Line items as points on the masks of their suppliers; four targets each, the third left out."""
    points = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("image"), (F.col("l_linenumber") % 5).alias("label"), (F.col("l_partkey") % 97 / 97).alias("score"))
    targets = table(spark, d, "supplier").select(F.col("s_suppkey").alias("image"), F.explode(F.array(*[F.lit(i) for i in range(1, 5)])).alias("label"))
    return T.hits_and_misses(points, targets, "image", "label", "score", exclude=[3])


_FOUND = """
with x as (select l_suppkey as image, l_linenumber % 5 as label, l_partkey % 97 / 97.0 as score from lineitem),
t as (select s_suppkey as image, unnest([1, 2, 3, 4]) as label from supplier),
b as (select image, label, max(score) as best from x group by all),
f as (
  select score, 0 as hits, 1 as alarms from x where label = 0
  union all
  select case when label = 3 then 0 else coalesce(best, 0) end, (label <> 3)::int, 0 from t left join b using (image, label)),
g as (select score, sum(hits) as hits, sum(alarms) as alarms from f group by score),
p as (
  select score as threshold, (select sum(alarms) from f where f.score >= g.score) / 1000.0 as fps_per_image,
    (select sum(hits) from f where f.score >= g.score)::double / (select sum(hits) from f) as sensitivity
  from g where score > (select min(score) from g)
  union all select null, 0, 0)
"""


@query(_FOUND + "select round(threshold, 4) as threshold, round(fps_per_image, 4) as fps_per_image, round(sensitivity, 4) as sensitivity from p")
def froc_detections(spark, d):
    return rounded(T.froc_points(_detections(spark, d), 1000))


@query(_FOUND + """, r as (select unnest([0.0625, 0.125, 0.25, 0.5, 1, 2])::double as r),
l as (select r, max({'x': fps_per_image, 'y': sensitivity}) as lo from r join p on fps_per_image <= r group by r),
h as (select r, min({'x': fps_per_image, 'y': sensitivity}) as hi from r join p on fps_per_image > r group by r)
select round(avg(case when hi is null then lo.y else lo.y + (hi.y - lo.y) * (r - lo.x) / (hi.x - lo.x) end), 4) as froc_score from l left join h using (r)""")
def froc_score(spark, d):
    return rounded(T.froc_score(T.froc_points(_detections(spark, d), 1000), (0.0625, 0.125, 0.25, 0.5, 1, 2)))
