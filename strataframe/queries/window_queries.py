"""Sliding windows, smoothing, running values, best-of selections, and windows over time."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strataframe.core.storage import table
from strataframe.operators import windows as W
from strataframe.queries.registry import query, r4, rounded

_EVENTS = "with e as (select event_id, user_id, ts, value, (row_number() over (partition by user_id order by ts, event_id) - 1)::bigint as i from events)"


def _series(spark, d):
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return table(spark, d, "events").select("event_id", "user_id", "ts", "value", place.cast("long").alias("i"))


@query(_EVENTS + """,
n as (select user_id, max(i) + 1 as n from e group by user_id),
w as (select distinct user_id, least(k * 8, greatest(n - 16, 0)) as start from n, range(0, 100000) r(k) where k <= ceil(greatest(n - 16, 0) / 8.0)),
m as (select e.user_id, e.i, w.start, value from e join w on e.user_id = w.user_id and e.i >= w.start and e.i < w.start + 16),
s as (select user_id, start, avg(value) as score from m group by all)
select m.user_id, m.i, round(sum(score / (1 + abs(m.i - m.start - 7.5))) / sum(1 / (1 + abs(m.i - m.start - 7.5))) + 1e-9, 4) as merged, count(*)::bigint as n_windows from m join s using (user_id, start) group by m.user_id, m.i""")
def sliding_window_merge(spark, d):
    merged = W.sliding_merge(_series(spark, d), ["user_id"], "i", "value", 16, 0.5, F.avg("value"))
    return rounded(merged.withColumn("merged", F.col("merged") + 1e-9))  # sixteenths end in a 5 often


_PATCH = _EVENTS + ", p as (select user_id, i // 10 as patch, sum(value) as total, count(*) as n from e group by all)"


@query(_PATCH + " select user_id, patch::bigint as patch, round(total, 4) as total, n::bigint as n, place::int as place from (select *, row_number() over (partition by user_id order by total desc, patch) as place from p) where place <= 2")
def patch_topk(spark, d):
    return rounded(W.top_patches(W.patches(_series(spark, d), ["user_id"], "i", "value", 10), ["user_id"], 2))


@query(_PATCH + " select user_id, patch::bigint as patch, round(total, 4) as total, n::bigint as n from p where total < 300")
def patch_filter(spark, d):
    return rounded(W.filter_patches(W.patches(_series(spark, d), ["user_id"], "i", "value", 10), 300.0))


@query("select event_id, round(median(value) over (partition by user_id order by ts, event_id rows between 2 preceding and 2 following), 4) as smoothed from events")
def moving_median(spark, d):
    return rounded(W.median_smooth(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "value", 2).select("event_id", "smoothed"))


@query("select event_id, round(avg(value) over (partition by user_id order by ts, event_id rows between 3 preceding and 3 following), 4) as smoothed from events")
def moving_mean(spark, d):
    return rounded(W.mean_smooth(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "value", 3).select("event_id", "smoothed"))


@query("""
select event_id, round(sum(value) over w, 4) as running_sum, round(max(value) over w, 4) as running_max from events window w as (partition by user_id order by ts, event_id rows unbounded preceding)""")
def cumsum_signal(spark, d):
    return rounded(W.cumulative(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "value").select("event_id", "running_sum", "running_max"))


@query("select event_id, round(coalesce(lag(value, 3) over (partition by user_id order by ts, event_id), 0), 4) as shifted from events")
def signal_shift(spark, d):
    return rounded(W.shift(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "value", 3).select("event_id", "shifted"))


@query(_EVENTS + """,
b as (select user_id, i + 1 as place, value, max(value) over (partition by user_id order by i rows between unbounded preceding and 1 preceding) as best from e),
g as (select *, max(case when best is null or value > best then place end) over (partition by user_id order by place rows unbounded preceding) as since from b)
select user_id, min(place)::int as stop_place from g where place - since >= 5 group by user_id""")
def early_stop(spark, d):
    return W.early_stop(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "value", 5)


@query(_EVENTS + " select user_id, round(value, 4) as best_value, (i + 1)::int as best_place from (select *, row_number() over (partition by user_id order by value desc, i) as k from e) where k = 1")
def best_epoch(spark, d):
    return rounded(W.best_place(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "value"))


@query("select p_brand, p_partkey, round(p_retailprice, 4) as p_retailprice, place::int as place from (select *, row_number() over (partition by p_brand order by p_retailprice desc, p_partkey) as place from part) where place <= 3")
def best_n_models(spark, d):
    return rounded(W.best_n(table(spark, d, "part").select("p_brand", "p_partkey", "p_retailprice"), ["p_brand"], "p_retailprice", "p_partkey", 3))


@query("select (p_partkey % 5)::bigint as fold, arg_max(p_partkey, p_retailprice * 1000000 - p_partkey)::bigint as best from part group by 1")
def best_by_fold(spark, d):
    best = W.best_n(table(spark, d, "part").withColumn("fold", F.col("p_partkey") % 5), ["fold"], "p_retailprice", "p_partkey", 1)
    return best.select("fold", F.col("p_partkey").alias("best"))


@query("select event_type, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') as start, count(*)::bigint as n, round(sum(value), 4) as total from events group by all")
def tumbling_window(spark, d):
    counted = table(spark, d, "events").groupBy("event_type", F.window("ts", "1 hour")).agg(F.count(F.lit(1)).alias("n"), r4(F.sum("value")).alias("total"))
    return counted.select("event_type", F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n", "total")


@query("""
with g as (select *, case when ts < lag(ts) over (partition by user_id order by ts, event_id) + interval 6 hour then 0 else 1 end as new from events),
s as (select *, sum(new) over (partition by user_id order by ts, event_id rows unbounded preceding) as sess from g)
select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as start, count(*)::bigint as n, round(sum(value), 4) as total from s group by user_id, sess""")
def session_window(spark, d):
    counted = table(spark, d, "events").groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count(F.lit(1)).alias("n"), r4(F.sum("value")).alias("total"))
    return counted.select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n", "total")
