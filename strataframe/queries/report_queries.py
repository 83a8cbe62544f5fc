"""Queries of label reports: line items as labelled cells, with parts as segments and suppliers as cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataframe.core.storage import table
from strataframe.operators import label_reports as R
from strataframe.queries.registry import query, rounded

_C = """with c as (select l_suppkey % 8 as case_id, l_partkey as segment, l_orderkey * 8 + l_linenumber as place, (l_linenumber * 3 + l_orderkey) % 5 as pred, l_quantity::bigint % 7 as truth, l_extendedprice as value, l_discount, l_tax from lineitem)
"""


def _cells(spark, d):
    c = F.col
    return table(spark, d, "lineitem").select(
        (c("l_suppkey") % 8).alias("case_id"), c("l_partkey").alias("segment"), (c("l_orderkey") * 8 + c("l_linenumber")).alias("place"),
        ((c("l_linenumber") * 3 + c("l_orderkey")) % 5).alias("pred"), (c("l_quantity").cast("long") % 7).alias("truth"), c("l_extendedprice").alias("value"), "l_discount", "l_tax",
    )


@query(_C + "select case_id, truth, pred, count(*) as cells from c where truth <> 6 group by all")
def confusion_matrix(spark, d):
    return R.confusion_matrix(_cells(spark, d), ["case_id"], "pred", "truth", 6)


_SCORES = _C + """, k as (select case_id, class, count(*) filter (truth = class and pred = class) as hits, count(*) filter (truth = class) as in_truth, count(*) filter (pred = class) as in_pred
  from c, unnest(range(6)) t(class) where truth <> 6 group by all),
s as (select *, case when in_truth + in_pred = 0 then 1 else 2.0::double * hits / (in_truth + in_pred) end as dice, case when in_truth + in_pred = 0 then 1 else hits::double / (in_truth + in_pred - hits) end as iou from k)
"""


def _scores(spark, d):
    return R.class_scores(R.confusion_matrix(_cells(spark, d), ["case_id"], "pred", "truth", 6), ["case_id"], range(6))


@query(_SCORES + "select case_id, class, hits, in_truth, in_pred, round(dice, 4) as dice, round(iou, 4) as iou from s")
def class_scores(spark, d):
    return rounded(_scores(spark, d))


@query(_SCORES + """select class, count(*) as n, round(avg(dice), 4) as dice_mean, round(stddev_pop(dice), 4) as dice_std, round(min(dice), 4) as dice_min, round(max(dice), 4) as dice_max,
  round(avg(iou), 4) as iou_mean, round(stddev_pop(iou), 4) as iou_std, round(min(iou), 4) as iou_min, round(max(iou), 4) as iou_max from s group by class""")
def score_summary(spark, d):
    return rounded(R.score_summary(_scores(spark, d), ["class"], ["dice", "iou"]))


_PURITY = _C + """, t as (select segment, truth, count(*) as k, count(*) filter (pred <> truth) as off from c where truth <> 6 group by all),
n as (select segment, sum(k) as cells, max(k) as top, sum(off) as off from t group by segment),
p as (select segment, cells::bigint as cells, top / cells::double as purity, greatest((select -sum(k / cells::double * ln(k / cells::double)) from t where t.segment = n.segment) / ln(6), 0) as entropy, off / cells::double as mismatch from n)
"""


def _purity(spark, d):
    return R.segment_purity(_cells(spark, d), ["segment"], "pred", "truth", 6, 6)


@query(_PURITY + "select segment, cells, round(purity, 4) as purity, round(entropy, 4) as entropy, round(mismatch, 4) as mismatch from p")
def segment_purity(spark, d):
    return rounded(_purity(spark, d))


@query(_PURITY + """select segment % 5 as part, count(*) as segments, sum(cells)::bigint as cells, round(avg(purity), 4) as purity, round(avg(entropy), 4) as entropy, round(sum(purity * cells) / sum(cells), 4) as cell_purity,
  round(sum(entropy * cells) / sum(cells), 4) as cell_entropy, round(corr(entropy, mismatch), 4) as corr, round(avg((entropy >= 0.8)::int), 4) as segments_over_0_8, round(sum(cells) filter (entropy >= 0.8) / sum(cells), 4) as cells_over_0_8 from p group by all""")
def purity_report(spark, d):
    rows = _purity(spark, d).withColumn("part", F.col("segment") % 5)
    return rounded(R.purity_report(rows, ["part"], [0.8]))


@query(_C + """, v as (select segment, truth, count(*) as k from c where truth > 3 and truth <> 6 group by all), w as (select segment, arg_min(truth, -k * 10 + truth) as best from v group by segment)
select case_id, segment, place, coalesce(best, 0) as voted from c left join w using (segment)""")
def vote_segments(spark, d):
    rows = _cells(spark, d).withColumn("kept", F.when(F.col("truth") > 3, F.col("truth")).otherwise(6))
    return R.vote_segments(rows, ["segment"], "kept", ignore=6, fallback=0).select("case_id", "segment", "place", "voted")


@query(_C + """, s as (select segment, arg_min(pred, place * 10 + pred) as seeded, count(*) as seeds from c where place % 13 = 0 group by segment),
v as (select segment, truth, count(*) as k from c group by all), w as (select segment, arg_min(truth, -k * 10 + truth) as common from v group by segment)
select segment, seeded, seeds, common, seeded <> common as corrected from s join w using (segment)""")
def correct_seeds(spark, d):
    rows = _cells(spark, d).withColumn("seed", R.seed_labels(F.col("place") % 13 == 0, F.col("pred")))
    found = R.correct_seeds(rows, ["segment"], "place", "seed", "truth")
    return found.select("segment", "seeded", "seeds", "common", "corrected")


@query(_C + "select case_id, place, case when place % 3 = 0 and truth not in (0, 6) then truth else -1 end as seed, case when truth <> 6 then pred <> truth end as wrong from c")
def seed_and_error_cells(spark, d):
    rows = R.error_cells(_cells(spark, d), "pred", "truth", 6)
    return rows.select("case_id", "place", R.seed_labels(F.col("place") % 3 == 0, F.col("truth"), [0, 6]).alias("seed"), "wrong")


@query(_C + """, h as (select *, md5('3:' || case_id || ':' || place) as h from c), f as (select case_id, truth, arg_min(place, h) as first from h group by all)
select case_id, place, truth, h < '199999999999a' as by_share from h join f using (case_id, truth) where h < '199999999999a' or place = first""")
def random_seeds(spark, d):
    from strataframe.operators.partition import hash_unit

    found = R.random_seeds(_cells(spark, d), "case_id", "place", 0.1, 3, "truth")
    return found.select("case_id", "place", "truth", (hash_unit(3, "case_id", "place") < 0.1).alias("by_share"))


@query(_C + "select segment, count(*) as cells, round(avg(l_discount), 4) as l_discount, round(avg(l_tax), 4) as l_tax from c group by segment")
def segment_centers(spark, d):
    return rounded(R.segment_centers(_cells(spark, d), ["segment"], ["l_discount", "l_tax"]))


@query(_C + """, b as (select segment, least(floor((least(greatest(value, 5000), 50000) - 5000) * (8 / 45000::double)), 7)::int as b from c), n as (select segment, b, count(*) as k from b group by all)
select s.segment, i as bin, round(coalesce(k, 0) / (select sum(k) from n z where z.segment = s.segment)::double, 4) as share from (select distinct segment from n) s, unnest(range(8)) t(i) left join n on n.segment = s.segment and n.b = i""")
def histogram_descriptor(spark, d):
    found = R.histogram_descriptor(_cells(spark, d), ["segment"], "value", 8, 5000.0, 50000.0)
    return rounded(found.select("segment", F.posexplode("descriptor").alias("bin", "share")).withColumn("bin", F.col("bin").cast("long")))


@query(_C + """, e as (select case_id, quantile_cont(value, 0.01) as a, quantile_cont(value, 0.99) as b from c group by case_id), x as (select case_id, place, least(greatest(value, a), b) as v from c join e using (case_id)),
m as (select case_id, avg(v) as m, stddev_pop(v) as s from x group by case_id) select case_id, place, round((v - m) / s, 4) as value from x join m using (case_id)""")
def clip_score(spark, d):
    return rounded(R.clip_score(_cells(spark, d).select("case_id", "place", "value"), ["case_id"], "value"))


@query(_C + """, r as (select segment % 50 as g, quantile_cont(pred, 0.01) as a, quantile_cont(pred, 0.99) as b, min(pred) as c, max(pred) as e from c group by all)
select g, round(case when b <= a then c else a end, 4) as low, round(case when b <= a then e else b end, 4) as high from r""")
def robust_range(spark, d):
    rows = _cells(spark, d).select((F.col("segment") % 50).alias("g"), F.col("pred").cast("double").alias("pred"))
    return rounded(R.robust_range(rows, ["g"], "pred"))


_A = _C + """, a as (select case_id, place, case when place % 17 = 0 then 255 else truth end as agree from c)
"""


def _agreement(spark, d):
    return _cells(spark, d).select("case_id", "place", F.when(F.col("place") % 17 == 0, 255).otherwise(F.col("truth")).alias("agree"))


@query(_A + "select case_id, place, case agree when 255 then 2 when 1 then 0.25 when 3 then 0.75 else 0 end::double as weight from a")
def agreement_weight(spark, d):
    return _agreement(spark, d).select("case_id", "place", R.agreement_weight(F.col("agree"), R.weight_table("1:0.25, 3: 0.75"), sure_weight=2.0).alias("weight"))


@query(_A + """, n as (select case_id, count(*) filter (agree = 255) as g, count(*) filter (agree = 1) as n1, count(*) filter (agree = 3) as n3 from a group by case_id)
select case_id, place, round(case agree when 255 then 1 when 1 then 0.5 * g / n1 when 3 then 0.8 * g / n3 else 0 end::double, 4) as weight from a join n using (case_id)""")
def balanced_weight(spark, d):
    return rounded(R.balanced_weight(_agreement(spark, d), ["case_id"], "agree", {1: 0.5, 3: 0.8}, fallback={1: 0.1}).select("case_id", "place", "weight"))


@query(_A + ", n as (select case_id, agree, count(*) as cells from a group by all) select case_id, agree, cells, round(cells / sum(cells) over (partition by case_id), 4) as share from n")
def source_shares(spark, d):
    return rounded(R.source_shares(_agreement(spark, d), ["case_id"], "agree"))
