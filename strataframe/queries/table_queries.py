"""Joins, defaults, row selection, partitioning and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataframe.core.storage import table
from strataframe.functions import text as T
from strataframe.operators import partition, tables
from strataframe.queries.registry import query, r4


@query("""
select o_orderkey, c_name, n_name, round(o_totalprice, 4) as o_totalprice
from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey""")
def csv_join_select(spark, d):
    orders = table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    nation = table(spark, d, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    joined = tables.join_tables([orders, table(spark, d, "customer"), nation])
    return joined.select("o_orderkey", "c_name", "n_name", r4("o_totalprice").alias("o_totalprice"))


@query("""
select c_custkey, coalesce(o_orderkey, -1)::bigint as o_orderkey, floor(coalesce(o_totalprice, 0.0))::int as price, coalesce(o_orderstatus, 'none') as o_orderstatus
from customer full join orders on c_custkey = o_custkey""")
def csv_outer_default(spark, d):
    orders = table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    joined = tables.join_tables([table(spark, d, "customer"), orders], ["c_custkey"], "full")
    filled = tables.with_defaults(joined, {"o_orderkey": -1, "o_totalprice": 0.0, "o_orderstatus": "none"})
    return filled.select("c_custkey", "o_orderkey", F.floor("o_totalprice").cast("int").alias("price"), "o_orderstatus")


@query("select l_orderkey, l_linenumber, l_quantity || '|' || l_discount || '|' || l_tax as features from lineitem")
def csv_group_columns(spark, d):
    grouped = tables.group_columns(table(spark, d, "lineitem"), "features", ["l_quantity", "l_discount", "l_tax"])
    text = F.array_join(F.transform("features", lambda x: x.cast("string")), "|")
    return grouped.select("l_orderkey", "l_linenumber", text.alias("features"))


@query("""
with n as (select c_custkey, c_name, row_number() over (order by c_custkey) - 1 as i from customer)
select c_custkey, c_name, i::bigint as row_index from n where i >= 3 and i < 20
union all select c_custkey, c_name, i from n where i = 7
union all select c_custkey, c_name, i from n where i >= 100 and i < 105""")
def row_index_ranges(spark, d):
    return tables.select_rows(table(spark, d, "customer").select("c_custkey", "c_name"), [(3, 20), 7, (100, 105)], "c_custkey")


@query("""
select s_suppkey, n_nationkey, a.i::bigint as row_index
from (select s_suppkey, row_number() over (order by s_suppkey) - 1 as i from supplier) a
join (select n_nationkey, row_number() over (order by n_nationkey) - 1 as i from nation) b on a.i = b.i""")
def zip_positional(spark, d):
    return tables.zip_tables(table(spark, d, "supplier").select("s_suppkey"), "s_suppkey", table(spark, d, "nation").select("n_nationkey"), "n_nationkey")


@query("""
with o as (select o_orderkey, (row_number() over (order by o_orderkey) - 1) // 500 as c from orders),
l as (select l_orderkey, l_linenumber, (row_number() over (order by l_orderkey, l_linenumber) - 1) // 500 as c from lineitem)
select o_orderkey, l_linenumber, o.c::bigint as chunk from o join l on o_orderkey = l_orderkey and o.c = l.c""")
def chunk_join(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey")
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    return tables.chunk_join(orders, ["o_orderkey"], lines, ["l_orderkey", "l_linenumber"], ("o_orderkey", "l_orderkey"), 500).select("o_orderkey", "l_linenumber", "chunk")


@query("select p_partkey, p_name from part where not exists (select 1 from lineitem where l_partkey = p_partkey and l_quantity > 45)")
def missing_refs(spark, d):
    heavy = table(spark, d, "lineitem").where("l_quantity > 45")
    return tables.missing_references(table(spark, d, "part").select("p_partkey", "p_name"), "p_partkey", heavy, "l_partkey")


@query("select user_id, event_type, count(*)::bigint as n from events where exists (select 1 from customer where c_custkey = user_id) group by all")
def semi_join_counts(spark, d):
    known = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"))
    return table(spark, d, "events").join(known, "user_id", "left_semi").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("select c_custkey, round(coalesce(n_nationkey * 10.0, 0), 4) as c_acctbal from customer join nation on c_nationkey = n_nationkey")
def override_join(spark, d):
    fresh = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), (F.col("n_nationkey") * 10.0).alias("v"))
    return tables.override_column(table(spark, d, "customer"), "c_nationkey", "c_acctbal", fresh, "v").select("c_custkey", r4("c_acctbal").alias("c_acctbal"))


@query("select o_orderkey, (row_number() over (order by o_orderkey) - 1)::bigint as row_index, ((row_number() over (order by o_orderkey) - 1) % 4)::int as part from orders")
def partition_round_robin(spark, d):
    return partition.round_robin(table(spark, d, "orders").select("o_orderkey"), 4, "o_orderkey")


@query("""
with n as (select o_orderkey, row_number() over (order by o_orderkey) - 1 as i, count(*) over () as n from orders),
c as (select *, least(floor(0.6 * n + 0.5), n) as e1 from n),
e as (select *, least(e1 + floor(0.3 * n + 0.5), n) as e2, least(least(e1 + floor(0.3 * n + 0.5), n) + floor(0.1 * n + 0.5), n) as e3 from c)
select o_orderkey, i::bigint as row_index, (case when i < e1 then 0 when i < e2 then 1 else 2 end)::int as part from e where i < e3""")
def partition_ratio(spark, d):
    return partition.by_ratio(table(spark, d, "orders").select("o_orderkey"), [6.0, 3.0, 1.0], "o_orderkey")


@query("""
with n as (select o_orderkey, md5('7:' || o_orderkey) as h from orders),
i as (select o_orderkey, row_number() over (order by h, o_orderkey) - 1 as i from n)
select o_orderkey, i::bigint as row_index, (i % 5)::int as part from i""")
def partition_hash_shuffled(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey")
    return partition.round_robin(orders, 5, partition.hash_order(7, "o_orderkey"), "o_orderkey")


@query("""
with n as (select o_orderkey, row_number() over (order by o_orderkey) - 1 as i, count(*) over () as n from orders),
p as (select o_orderkey, i from n union all select o_orderkey, i + n from n where i < (7 - n % 7) % 7)
select o_orderkey, i::bigint as row_index, (i % 7)::int as part from p""")
def partition_even_pad(spark, d):
    return partition.even_padded(table(spark, d, "orders").select("o_orderkey"), 7, "o_orderkey")


@query("""
select o_orderkey, o_orderstatus, ((row_number() over (partition by o_orderstatus order by o_orderkey) - 1) % 3)::int as part from orders""")
def partition_stratified(spark, d):
    return partition.stratified(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", 3, "o_orderkey").drop("row_index")


@query("""
with n as (select c_custkey, row_number() over (order by c_custkey) - 1 as i, count(*) over () as n from customer)
select c_custkey, i::bigint as row_index, k::int as copy from n, range(0, 3) r(k) where k < 2 or i < floor(0.25 * n + 0.5)""")
def resample_factor(spark, d):
    return partition.resample(table(spark, d, "customer").select("c_custkey"), 2.25, "c_custkey")


@query("""
select c_custkey, i::bigint as row_index, (i % 5)::int as part from (select c_custkey, row_number() over (order by c_custkey) - 1 as i from customer) where i % 5 in (0, 3)""")
def cv_folds(spark, d):
    return partition.folds(table(spark, d, "customer").select("c_custkey"), 5, [0, 3], "c_custkey")


@query("""
with c as (select p_partkey, p_size::double as w, row_number() over (order by p_partkey) - 1 as i, sum(p_size) over (order by p_partkey)::double as high, (sum(p_size) over ())::double as total from part),
p as (select d.draw, ('0x' || substr(md5('5:' || d.draw), 1, 12))::bigint::double / 281474976710656.0 * (select max(total) from c) as point from range(0, 40) d(draw))
select draw::bigint as draw, p_partkey, round(point, 4) as point from p join c on high - w <= point and point < high""")
def weighted_pick(spark, d):
    parts = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("w"))
    return partition.weighted_pick(parts, "w", 40, "p_partkey", seed=5).select("draw", "p_partkey", r4("point").alias("point"))


@query("""
select n_nationkey, levenshtein(n_name, 'ALGIERIA')::int as distance, len(n_name)::int as n from nation""")
def edit_distance(spark, d):
    return table(spark, d, "nation").select("n_nationkey", F.levenshtein("n_name", F.lit("ALGIERIA")).alias("distance"), F.length("n_name").alias("n"))


@query("""
select page_id, string_split(url, '/')[-1] as name, string_split(string_split(url, '/')[-1], '.')[1] as stem,
  'out/' || string_split(string_split(url, '/')[-1], '.')[1] || '/' || string_split(string_split(url, '/')[-1], '.')[1] || '_seg.nii' as target
from pages""")
def path_names(spark, d):
    url = F.col("url")
    return table(spark, d, "pages").select("page_id", T.basename(url).alias("name"), T.stem(url).alias("stem"), T.output_name(url, "seg", ".nii", "out").alias("target"))


@query("select event_type, count(*)::bigint as n, round(avg(cast(json_extract_string(props, '$.k') as double)), 4) as mean_k from events group by event_type")
def json_props(spark, d):
    k = T.json_number(F.col("props"), "$.k")
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), r4(F.avg(k)).alias("mean_k"))


@query("select conv_id, string_agg(distinct role, ',' order by role) as roles, count(*)::bigint as turns from conversations group by conv_id")
def label_union(spark, d):
    roles = F.array_join(F.sort_array(F.array_distinct(F.flatten(F.collect_list(F.array("role"))))), ",")
    return table(spark, d, "conversations").groupBy("conv_id").agg(roles.alias("roles"), F.count(F.lit(1)).alias("turns"))


@query("select c_nationkey::int as k from customer except select s_nationkey::int from supplier where s_acctbal > 5000")
def set_difference(spark, d):
    rich = table(spark, d, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("k"))
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).subtract(rich)


@query("select c_nationkey::int as k from customer intersect select s_nationkey::int from supplier")
def set_intersection(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(spark, d, "supplier").select(F.col("s_nationkey").alias("k")))
