"""Two-level statistics, histograms, scaling and segments."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataframe.core.storage import table
from strataframe.operators import intensity, segments, stats
from strataframe.queries.registry import query, r4, rounded

_STATS = """
  round(max(l_extendedprice), 4) as max, round(avg(l_extendedprice), 4) as mean, round(quantile_cont(l_extendedprice, 0.5), 4) as median,
  round(min(l_extendedprice), 4) as min, round(stddev_pop(l_extendedprice), 4) as stdev,
  round(quantile_cont(l_extendedprice, 0.005), 4) as percentile_00_5, round(quantile_cont(l_extendedprice, 0.1), 4) as percentile_10_0,
  round(quantile_cont(l_extendedprice, 0.9), 4) as percentile_90_0, round(quantile_cont(l_extendedprice, 0.995), 4) as percentile_99_5"""


@query(f"select l_returnflag, l_linestatus, {_STATS} from lineitem group by l_returnflag, l_linestatus")
def sample_stats_by_flag(spark, d):
    return rounded(stats.sample_stats(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice"))


@query("""
with s as (select l_suppkey, l_suppkey % 5 as grp, max(l_extendedprice) as a, avg(l_extendedprice) as b, quantile_cont(l_extendedprice, 0.5) as c, min(l_extendedprice) as d,
  stddev_pop(l_extendedprice) as e, quantile_cont(l_extendedprice, 0.005) as f, quantile_cont(l_extendedprice, 0.1) as g, quantile_cont(l_extendedprice, 0.9) as h, quantile_cont(l_extendedprice, 0.995) as i
  from lineitem group by l_suppkey)
select grp::bigint as grp, count(*)::bigint as n_cases, round(max(a), 4) as max, round(avg(b), 4) as mean, round(avg(c), 4) as median, round(min(d), 4) as min, round(avg(e), 4) as stdev,
  round(avg(f), 4) as percentile_00_5, round(avg(g), 4) as percentile_10_0, round(avg(h), 4) as percentile_90_0, round(avg(i), 4) as percentile_99_5 from s group by grp""")
def summary_of_stats(spark, d):
    cases = stats.sample_stats(table(spark, d, "lineitem"), ["l_suppkey"], "l_extendedprice")
    return rounded(stats.summarise(cases.withColumn("grp", F.col("l_suppkey") % 5), ["grp"]))


@query("""
with c as (select c_nationkey, o_orderpriority, count(*) as n from orders join customer on o_custkey = c_custkey group by all)
select c_nationkey, o_orderpriority, n::bigint as n, round(n / sum(n) over (partition by c_nationkey), 4) as share from c""")
def label_share(spark, d):
    both = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rounded(stats.label_share(both, ["c_nationkey"], "o_orderpriority"))


@query("""
with c as (select c_nationkey, o_orderpriority, count(*) as n from orders join customer on o_custkey = c_custkey group by all),
s as (select *, n / sum(n) over (partition by c_nationkey) as share from c)
select o_orderpriority, count(*)::bigint as n_groups, sum(n)::bigint as n, round(avg(share), 4) as mean_share from s group by o_orderpriority""")
def label_summary(spark, d):
    both = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rounded(stats.label_summary(stats.label_share(both, ["c_nationkey"], "o_orderpriority"), "o_orderpriority"))


_HIST = """
with b as (select f.l_returnflag, i::int as bin, i * 0.5 as edge from (select distinct l_returnflag from lineitem) f, range(0, 100) r(i)),
c as (select l_returnflag, least(floor(l_quantity / 0.5), 99)::int as bin, count(*) as n from lineitem where l_quantity between 0 and 50 group by all),
h as (select b.l_returnflag, b.bin, coalesce(n, 0)::bigint as n, round(edge, 4)::double as edge from b left join c using (l_returnflag, bin))
"""


@query(_HIST + "select * from h")
def intensity_histogram(spark, d):
    return rounded(stats.histogram(table(spark, d, "lineitem"), ["l_returnflag"], "l_quantity", 100, 0.0, 50.0))


@query(_HIST + "select bin, sum(n)::bigint as n, min(edge) as edge from h group by bin")
def histogram_merge(spark, d):
    counts = stats.histogram(table(spark, d, "lineitem"), ["l_returnflag"], "l_quantity", 100, 0.0, 50.0)
    return rounded(stats.merge_histograms(counts))


@query("""
with e as (select user_id, event_type, value, row_number() over (partition by user_id order by ts, event_id) - 1 as i from events)
select user_id, min(i)::bigint as i_start, (max(i) + 1)::bigint as i_end from e where value > 50 group by user_id""")
def fg_bounding_box(spark, d):
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    rows = table(spark, d, "events").select("user_id", "value", place.cast("long").alias("i"))
    return stats.bounding_box(rows, ["user_id"], ["i"], F.col("value") > 50)


@query("""
select l_suppkey, count(*)::bigint as n, round(sum(l_quantity), 4) as sum, round(sum(l_quantity * l_quantity), 4) as sum_sq, round(avg(l_quantity), 4) as mean,
  round(sqrt(greatest(sum(l_quantity * l_quantity) / count(*) - (sum(l_quantity) / count(*)) * (sum(l_quantity) / count(*)), 0)), 4) as std from lineitem group by l_suppkey""")
def moment_sums(spark, d):
    return rounded(stats.moments(table(spark, d, "lineitem"), ["l_suppkey"], "l_quantity"))


@query("""
with s as (select quantile_cont(l_quantity, 0.5) as a, quantile_cont(l_discount, 0.5) as b, quantile_cont(l_tax, 0.5) as c, quantile_cont(l_quantity, 0.1) as al, quantile_cont(l_discount, 0.1) as bl, quantile_cont(l_tax, 0.1) as cl from lineitem)
select round(case when greatest(a, b, c) / least(a, b, c) >= 3 and a = greatest(a, b, c) then greatest(al, least(a, b, c)) else a end, 4) as l_quantity,
  round(case when greatest(a, b, c) / least(a, b, c) >= 3 and b = greatest(a, b, c) then greatest(bl, least(a, b, c)) else b end, 4) as l_discount,
  round(case when greatest(a, b, c) / least(a, b, c) >= 3 and c = greatest(a, b, c) then greatest(cl, least(a, b, c)) else c end, 4) as l_tax from s""")
def target_spacing(spark, d):
    return rounded(stats.target_spacing(table(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"]))


@query("""
with g as (select l_suppkey, min(l_quantity) as lo, max(l_quantity) as hi from lineitem group by l_suppkey)
select l_orderkey, l_linenumber, round(case when hi = lo then 0 else (l_quantity - lo) / nullif(hi - lo, 0) end, 4) as scaled from lineitem join g using (l_suppkey)""")
def scale_minmax(spark, d):
    return rounded(intensity.scale_min_max(table(spark, d, "lineitem"), ["l_suppkey"], "l_quantity").select("l_orderkey", "l_linenumber", "scaled"))


@query("select l_orderkey, l_linenumber, round(least(greatest((l_extendedprice - 1000.0) / 49000.0 * 2 - 1, -1), 1), 4) as scaled from lineitem")
def scale_range_clip(spark, d):
    scaled = intensity.scale_range(F.col("l_extendedprice"), 1000.0, 50000.0, -1.0, 1.0, clip=True)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", r4(scaled).alias("scaled"))


@query("""
with g as (select p_brand, quantile_cont(p_retailprice, 0.1) as lo, quantile_cont(p_retailprice, 0.9) as hi from part group by p_brand)
select p_partkey, round(case when hi = lo then p_retailprice - lo else least(greatest((p_retailprice - lo) / nullif(hi - lo, 0), 0), 1) end, 4) as scaled from part join g using (p_brand)""")
def scale_percentile(spark, d):
    return rounded(intensity.scale_percentiles(table(spark, d, "part"), ["p_brand"], "p_retailprice", 10, 90, 0.0, 1.0, True).select("p_partkey", "scaled"))


@query("""
with g as (select l_suppkey, avg(l_discount) filter (l_discount <> 0) as mu, stddev_pop(l_discount) filter (l_discount <> 0) as sd from lineitem group by l_suppkey)
select l_orderkey, l_linenumber, round(case when l_discount = 0 then 0 else (l_discount - mu) / case when sd = 0 then 1 else sd end end, 4) as normalized from lineitem join g using (l_suppkey)""")
def normalize_nonzero(spark, d):
    return rounded(intensity.normalize(table(spark, d, "lineitem"), ["l_suppkey"], "l_discount", nonzero=True).select("l_orderkey", "l_linenumber", "normalized"))


@query("""
with g as (select l_suppkey, quantile_cont(l_extendedprice, 0.05) as lo, quantile_cont(l_extendedprice, 0.95) as hi from lineitem group by l_suppkey)
select l_orderkey, l_linenumber, round(least(greatest(l_extendedprice, lo), hi), 4) as clipped from lineitem join g using (l_suppkey)""")
def clip_percentiles(spark, d):
    return rounded(intensity.clip_percentiles(table(spark, d, "lineitem"), ["l_suppkey"], "l_extendedprice", 5, 95).select("l_orderkey", "l_linenumber", "clipped"))


@query("select l_orderkey, l_linenumber, round(case when l_quantity > 25 then l_quantity else -1 end, 4) as kept from lineitem")
def threshold_fill(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", r4(intensity.threshold(F.col("l_quantity"), 25.0, True, -1.0)).alias("kept"))


@query("select o_orderkey, case o_orderstatus when 'O' then 'F' when 'F' then 'O' else o_orderstatus end as status from orders")
def relabel_map(spark, d):
    return table(spark, d, "orders").select("o_orderkey", intensity.relabel(F.col("o_orderstatus"), {"O": "F", "F": "O"}).alias("status"))


@query("""
with g as (select p_brand, min(p_retailprice) as lo, max(p_retailprice) - min(p_retailprice) as span from part group by p_brand)
select p_partkey, round(pow((p_retailprice - lo) / (span + 1e-7), 1.5) * span + lo, 4) as adjusted from part join g using (p_brand)""")
def adjust_contrast(spark, d):
    return rounded(intensity.adjust_contrast(table(spark, d, "part"), ["p_brand"], "p_retailprice", 1.5).select("p_partkey", "adjusted"))


@query("""
with e as (select min(p_retailprice) as lo, max(p_retailprice) as hi from part),
c as (select least(floor((p_retailprice - lo) / ((hi - lo) / 32)), 31)::int as bin, count(*) as n from part, e group by 1),
b as (select i::int as bin, coalesce(n, 0) as n from range(0, 32) r(i) left join c on c.bin = i),
s as (select bin, sum(n) over (order by bin) as c from b),
y as (select bin, (c - min(c) over ()) / (max(c) over () - min(c) over ()) * 255.0 as y from s),
z as (select bin, y, coalesce(lead(y) over (order by bin), y) as y2 from y)
select p_partkey, round(y + least((p_retailprice - lo - bin * ((hi - lo) / 32)) / ((hi - lo) / 32), 1.0) * (y2 - y), 4) as equalized
from part, e join z on z.bin = least(floor((p_retailprice - lo) / ((hi - lo) / 32)), 31)::int""")
def hist_equalize(spark, d):
    return rounded(intensity.equalize_histogram(table(spark, d, "part").select("p_partkey", "p_retailprice"), "p_retailprice", 32).select("p_partkey", "equalized"))


@query("""
with c as (select l_suppkey, l_returnflag, count(*) as votes from lineitem group by all),
r as (select *, row_number() over (partition by l_suppkey order by votes desc, l_returnflag) as place, sum(votes) over (partition by l_suppkey) as n from c)
select l_suppkey, l_returnflag as label, votes::bigint as votes, n::bigint as n from r where place = 1""")
def vote_majority(spark, d):
    return segments.majority(table(spark, d, "lineitem"), ["l_suppkey"], "l_returnflag")


@query("""
with c as (select l_partkey, l_returnflag, count(*) as votes from lineitem group by all),
m as (select *, max(votes) over (partition by l_partkey) as most from c)
select l_partkey, case when count(*) > 1 then '?' else min(l_returnflag) end as label, max(votes)::bigint as votes, count(*)::bigint as ties from m where votes = most group by l_partkey""")
def majority_fill_ties(spark, d):
    return segments.majority_without_ties(table(spark, d, "lineitem"), ["l_partkey"], "l_returnflag", "?")


@query("select l_partkey, round(sum(l_discount * l_quantity) / nullif(sum(l_quantity), 0), 4) as mean from lineitem group by l_partkey")
def mean_ensemble(spark, d):
    return rounded(segments.mean_ensemble(table(spark, d, "lineitem"), ["l_partkey"], "l_discount", "l_quantity"))


@query("""
with b as (select l_suppkey, avg(l_extendedprice) as mean, stddev_pop(l_extendedprice) as std, median(l_extendedprice) as med, count(*) as n from lineitem group by l_suppkey),
m as (select l_suppkey, median(abs(l_extendedprice - med)) as mad from lineitem join b using (l_suppkey) group by l_suppkey),
t as (select l_suppkey, avg(l_extendedprice) as tm from (select l_suppkey, l_extendedprice, row_number() over (partition by l_suppkey order by l_extendedprice) as i, count(*) over (partition by l_suppkey) as n from lineitem)
  where i > floor(n * 0.1) and i <= n - floor(n * 0.1) group by l_suppkey)
select l_suppkey, round(mean, 4) as mean, round(std, 4) as std, round(med, 4) as median, n::bigint as n, round(mad, 4) as mad, round(tm, 4) as trimmed_mean from b join m using (l_suppkey) join t using (l_suppkey)""")
def segment_moments(spark, d):
    return rounded(segments.robust_moments(table(spark, d, "lineitem"), ["l_suppkey"], "l_extendedprice"))


@query("select l_suppkey, round(quantile_cont(l_quantity, 0.1), 4) as q10, round(quantile_cont(l_quantity, 0.5), 4) as q50, round(quantile_cont(l_quantity, 0.9), 4) as q90 from lineitem group by l_suppkey")
def segment_quantiles(spark, d):
    return rounded(segments.quantiles(table(spark, d, "lineitem"), ["l_suppkey"], "l_quantity", [0.1, 0.5, 0.9]))


@query("select o_orderkey, dense_rank() over (order by o_custkey)::bigint as dense from orders")
def dense_relabel(spark, d):
    return segments.dense_labels(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey").select("o_orderkey", "dense")


@query("""
with s as (select l_suppkey, sum(l_tax) as w, sum(l_tax * l_quantity) as wx, sum(l_tax * l_extendedprice) as wy, sum(l_tax * l_quantity * l_quantity) as wxx, sum(l_tax * l_extendedprice * l_extendedprice) as wyy, sum(l_tax * l_quantity * l_extendedprice) as wxy from lineitem group by l_suppkey)
select l_suppkey, round((wxy / w - wx / w * (wy / w)) / nullif(sqrt(greatest(wxx / w - wx / w * (wx / w), 0) * greatest(wyy / w - wy / w * (wy / w), 0)), 0), 4) as corr from s""")
def running_correlation(spark, d):
    return rounded(segments.running_correlation(table(spark, d, "lineitem"), ["l_suppkey"], F.col("l_quantity"), F.col("l_extendedprice"), F.col("l_tax")))
