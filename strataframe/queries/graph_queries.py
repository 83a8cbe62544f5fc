"""Nearest neighbours, affinities and propagation over embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataframe.core.storage import table
from strataframe.operators import graph as G
from strataframe.queries.registry import query, rounded

_KNN = """
with p as (select a.vec_id as src, b.vec_id as dst, sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: (x[1]::double - x[2]::double) * (x[1]::double - x[2]::double)))) as distance from embeddings a join embeddings b on a.label = b.label and a.vec_id <> b.vec_id),
k as (select *, row_number() over (partition by src order by distance, dst) as place from p)
"""


@query(_KNN + "select src, dst, place::int as place, round(distance, 4) as distance from k where place <= 5")
def knn_edges(spark, d):
    return rounded(G.knn(table(spark, d, "embeddings"), "vec_id", "embedding", "label", 5).select("src", "dst", "place", "distance"))


@query(_KNN + """, e as (select src, dst, exp(-distance * distance / (2 * 1.2 * 1.2)) as w from k where place <= 5),
s as (select src, dst, max(w) as w from (select * from e union all select dst, src, w from e) group by all), g as (select src, sum(w) as d from s group by src)
select s.src, s.dst, round(w, 4) as w, round(w / sqrt(a.d * b.d), 4) as norm from s join g a on a.src = s.src join g b on b.src = s.dst""")
def affinity_matrix(spark, d):
    return rounded(G.affinity(G.knn(table(spark, d, "embeddings"), "vec_id", "embedding", "label", 5), 1.2).select("src", "dst", "w", "norm"))


_NORM = _KNN.replace("with p as", "with recursive p as") + """, w as (select src, dst, exp(-distance * distance / (2 * 1.2 * 1.2)) as w from k where place <= 5),
s as (select src, dst, max(w) as w from (select * from w union all select dst, src, w from w) group by all), g as (select src, sum(w) as d from s group by src),
e as materialized (select s.src, s.dst, w / sqrt(a.d * b.d) as norm from s join g a on a.src = s.src join g b on b.src = s.dst),
seeds as (select vec_id as node, (vec_id % 3)::int as label from embeddings where vec_id % 10 = 0)"""


def _seeded(spark, d):
    nodes = table(spark, d, "embeddings")
    seeds = nodes.select(F.col("vec_id").alias("node"), F.when(F.col("vec_id") % 10 == 0, F.col("vec_id") % 3).otherwise(-1).cast("int").alias("label"))
    return seeds, G.affinity(G.knn(nodes, "vec_id", "embedding", "label", 5), 1.2)


@query(_NORM + """,
held as (select * from e where src not in (select node from seeds) union all select node, node, 1 / 0.9::double from seeds),
f(k, node, label, score) as (
  select 0, node, label, 1.0::double from seeds
  union all
  select k + 1, src, label, sum(0.9::double * norm * score) from f join held on dst = node where k < 5 group by k, src, label)
select node, arg_min(label, (-score, label)) as label, round(max(score), 4) as score from f where k = 5 group by node""")
def label_propagation(spark, d):
    return rounded(G.propagate(*_seeded(spark, d), 0.9, 5))


@query(_NORM + """,
f(k, node, label, score) as (
  select 0, node, label, 0.4::double from seeds
  union all
  select k + 1, src, label, sum(0.6::double * norm * score) from f join e on dst = node where k < 60 group by k, src, label),
total as (select node, label, sum(score) as score from f group by all)
select vec_id as node, t.label, round(score, 4) as score
from embeddings left join (select * from total qualify row_number() over (partition by node order by score desc, label) = 1) t on node = vec_id""")
def label_propagation_limit(spark, d):
    """The limit of propagation; the SQL adds up sixty terms of its series."""
    nodes, edges = _seeded(spark, d)
    return rounded(G.best_labels(nodes, G.propagate_fully(nodes, edges, 0.6).scores))


@query("""
with c as (select label < 5 as g, unnest(embedding)::double as v, generate_subscripts(embedding, 1) as i from embeddings),
m as (select i, avg(v) filter (g) as a, avg(v) filter (not g) as b from c group by i) select round(sum((a - b) * (a - b)), 4) as mmd from m""")
def mmd_linear(spark, d):
    return rounded(G.mmd_linear(table(spark, d, "embeddings"), "embedding", F.col("label") < 5))
