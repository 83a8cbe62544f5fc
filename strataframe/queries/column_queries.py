"""Queries of column operators and array functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataframe.core.storage import table, with_row_index
from strataframe.functions.text import edit_distance_with_swaps
from strataframe.operators import columns as C
from strataframe.operators import elements as E
from strataframe.queries.registry import query, rounded


def _vectors(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))


_V = "with e as (select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings)\n"


@query("select c_name, c_custkey, c_acctbal from customer")
def select_columns(spark, d):
    return C.select_columns(table(spark, d, "customer"), ["c_name", "c_custkey", "c_acctbal", "absent"], allow_missing=True)


@query("select c_custkey, c_name, c_acctbal as rest from customer")
def delete_columns(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment", F.struct("c_nationkey", "c_acctbal").alias("s"))
    left = C.delete_columns(C.delete_columns(rows, ["c_mkt.*"], pattern=True), ["s.c_nationkey", "absent"])
    return left.select("c_custkey", "c_name", F.col("s.c_acctbal").alias("rest"))


@query("select c_custkey, c_nationkey, c_custkey as k1, c_nationkey as n1, c_custkey as k2, c_nationkey as n2 from customer")
def copy_columns(spark, d):
    return C.copy_columns(table(spark, d, "customer").select("c_custkey", "c_nationkey"), ["c_custkey", "c_nationkey"], ["k1", "n1", "k2", "n2"], 2)


@query("select p_partkey, p_size::varchar || '|' || (p_partkey % 7)::varchar || '|' || p_size::varchar as both from part")
def concat_columns(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.array("p_size", (F.col("p_partkey") % 7).cast("int")).alias("a"), F.array("p_size").alias("b"))
    return C.concat_columns(rows, ["a", "b"], "c").select("p_partkey", F.array_join(F.col("c").cast("array<string>"), "|").alias("both"))


@query("select o_orderkey, try_cast(o_totalprice as bigint) as o_totalprice, try_cast(o_orderstatus as int) as o_orderstatus from (select o_orderkey, trunc(o_totalprice) as o_totalprice, o_orderstatus from orders)")
def cast_columns(spark, d):
    return C.cast_columns(table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus"), {"o_totalprice": "long", "o_orderstatus": "int"})


@query("""select n_nationkey, md5('{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}') as hash from nation""")
def item_hash(spark, d):
    rows = table(spark, d, "nation").select("n_regionkey", "n_nationkey", "n_name")
    return rows.select("n_nationkey", C.item_hash(rows).alias("hash"))


@query("select lang, count(*) as n from documents group by lang")
def distinct_values(spark, d):
    return C.distinct_values(table(spark, d, "documents"), "lang")


@query("select vec_id, v[1] as x, v[2] as y, v[3] as z from (select vec_id, list_transform(embedding, lambda x: round(x::double, 4)) as v from embeddings)")
def split_column(spark, d):
    return rounded(C.split_column(_vectors(spark, d), "v", ["x", "y", "z"]))


@query("select p_partkey, row_number() over (order by p_size desc, p_partkey) - 1 as place from part")
def argsort_rows(spark, d):
    return with_row_index(table(spark, d, "part").select("p_partkey", "p_size"), F.desc("p_size"), F.asc("p_partkey"), name="place").select("p_partkey", "place")


@query("select l_orderkey, l_linenumber, round(ln(1 + exp(-abs(x))) + greatest(x, 0), 4) as softplus, floor(l_extendedprice / l_quantity)::bigint as whole from (select *, l_discount * 100 - 5 as x from lineitem)")
def softplus_floor_divide(spark, d):
    rows = table(spark, d, "lineitem")
    return rounded(rows.select("l_orderkey", "l_linenumber", E.softplus(F.col("l_discount") * 100 - 5).alias("softplus"), E.floor_divide(F.col("l_extendedprice"), F.col("l_quantity")).alias("whole")))


@query(_V + """select vec_id, len(list_filter(list_sort(v), lambda x: x < 0.1)) as place, len(list_filter(v, lambda x: x > 0.1)) as above,
  round(list_max(v), 4) as max, round(list_avg(v), 4) as mean, round(list_min(v), 4) as min, round(list_sum(v), 4) as sum, round(list_stddev_pop(v), 4) as std,
  round(quantile_cont(x, 0.9), 4) as p90 from e, unnest(v) u(x) group by vec_id, v""")
def array_summary(spark, d):
    v = F.col("v")
    made = _vectors(spark, d).select(
        "vec_id", E.searchsorted(F.array_sort(v), F.lit(0.1)).alias("place"), F.aggregate(E.foreground(v, 0.1), F.lit(0), lambda a, x: a + x).alias("above"),
        *[c.alias(n) for n, c in E.summary(v).items()], E.percentile(v, 90.0).alias("p90"),
    )
    return rounded(made)


@query(_V + """select vec_id, array_to_string(list_filter(list_transform(range(len(v)), lambda i: case when v[i + 1] > 0.15 then i else -1 end), lambda i: i >= 0), ',') as places,
  array_to_string(list_transform(range(len(v)), lambda i: case when v[i + 1] > 0 then (round(v[i + 1], 2) * 100)::bigint else 0 end), ',') as masked from e""")
def nonzero_mask(spark, d):
    v = F.col("v")
    fore = E.foreground(v, 0.15)
    kept = E.mask_values(v, E.foreground(v, 0.0))
    hundred = F.transform(kept, lambda x: F.round(F.round(x, 2) * 100).cast("long"))
    return _vectors(spark, d).select("vec_id", F.array_join(E.nonzero(fore).cast("array<string>"), ",").alias("places"), F.array_join(hundred.cast("array<string>"), ",").alias("masked"))


_L = "with l as (select l_orderkey, list(l_linenumber * 7 % 5 order by l_linenumber) as v from lineitem group by l_orderkey)\n"


def _lists(spark, d):
    pairs = F.sort_array(F.collect_list(F.struct("l_linenumber", ((F.col("l_linenumber") * 7) % 5).alias("v"))))
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(pairs.alias("x")).select("l_orderkey", F.col("x.v").alias("v"))


def _text(c):
    return F.array_join(c.cast("array<string>"), ",")


@query(_L + """select l_orderkey, array_to_string(list_sort(list_distinct(v)), ',') as distinct_labels, array_to_string(list_transform(v, lambda x: case when x in (1, 2, 4) then x else 0 end), ',') as filtered,
  array_to_string(list_transform(v, lambda x: case when x in (1, 4) then 1 else 0 end), ',') as core, array_to_string(list_transform(v, lambda x: case when x in (1, 2, 4) then 1 else 0 end), ',') as whole,
  array_to_string(list_transform(v, lambda x: case when x = 4 then 1 else 0 end), ',') as enhancing, array_to_string(list_transform(v, lambda x: x in (0, 3)), ',') as chosen from l""")
def label_arrays(spark, d):
    v = F.col("v")
    channels = E.brats_channels(v)
    return _lists(spark, d).select(
        "l_orderkey", _text(E.unique(v)).alias("distinct_labels"), _text(E.label_filter(v, [1, 2, 4])).alias("filtered"),
        *[_text(channels[i]).alias(n) for i, n in enumerate(("core", "whole", "enhancing"))], _text(E.is_in(v, [0, 3])).alias("chosen"),
    )


@query(_L + """, o as (select l_orderkey, list(i order by x, i) as places from (select l_orderkey, unnest(v) as x, generate_subscripts(v, 1) - 1 as i from l) group by l_orderkey),
m as (select l_orderkey, arg_min(x, (-n) * 100 + x) as common from (select l_orderkey, x, count(*) as n from (select l_orderkey, unnest(v) as x from l) group by all) group by l_orderkey)
select l_orderkey, array_to_string(places, ',') as places, common, array_to_string(flatten(list_transform(v, lambda x: [x, x, x])), ',') as again, array_to_string(v, ',') as back,
  array_to_string(flatten(list_transform(v, lambda x: [x, x + 1])), ',') as swapped from l join o using (l_orderkey) join m using (l_orderkey)""")
def array_rearranged(spark, d):
    v = F.col("v")
    more = F.transform(v, lambda x: x + 1)
    return _lists(spark, d).select(
        "l_orderkey", _text(E.argsort(v)).alias("places"), E.mode(v).alias("common"), _text(E.repeat(v, 3)).alias("again"),
        _text(E.remove_repeated(E.repeat(v, 3), 3)).alias("back"), _text(F.flatten(E.channel_last(E.stack(v, more)))).alias("swapped"),
    )


@query("""select n_nationkey, damerau_levenshtein(n_name, substr(n_name, 2, 1) || substr(n_name, 1, 1) || substr(n_name, 3) || 'X')::int as swapped,
  damerau_levenshtein(n_name, 'ALGIERIA')::int as distance from nation""")
def edit_distance_swaps(spark, d):
    name = F.col("n_name")
    other = F.concat(F.substring(name, 2, 1), F.substring(name, 1, 1), F.substring(name, 3, 1000), F.lit("X"))
    return table(spark, d, "nation").select("n_nationkey", edit_distance_with_swaps(name, other).alias("swapped"), edit_distance_with_swaps(name, F.lit("ALGIERIA")).alias("distance"))
