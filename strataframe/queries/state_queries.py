"""Queries whose state outlives a job: a cache of rows, sums that grow batch by batch."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from strataframe.core.storage import shared_dir, table
from strataframe.plans.cache import NamedStep, RowCache
from strataframe.queries.registry import query, rounded
from strataframe.streaming.cumulative import CumulativeSums, counts_of_agreement


@query("select p_partkey, p_size, round(p_retailprice * 1.5, 4) as p_retailprice, p_size > 25 as large from part")
def cached_rows(spark, d):
    """Parts through two steps that are cached and one that isn't: a third of them first, then all, of which the third is found."""
    steps = [
        NamedStep("scale", lambda df, by: df.withColumn("p_retailprice", F.col("p_retailprice") * by), {"by": 1.5}),
        NamedStep("large", lambda df, over: df.withColumn("large", F.col("p_size") > over), {"over": 25}),
        NamedStep("keep", lambda df: df, random=True),
    ]
    cache = RowCache(spark, f"{shared_dir(spark)}/cache-{uuid.uuid4().hex}", steps)
    parts = table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice")
    cache.fetch(parts.where("p_partkey % 3 = 0"))
    return rounded(cache.fetch(parts).drop("item_hash"))


@query("""
select l_returnflag, sum((l_discount >= 0.05 and l_tax >= 0.04)::int)::bigint as tp, sum((l_discount >= 0.05 and l_tax < 0.04)::int)::bigint as fp,
  sum((l_discount < 0.05 and l_tax >= 0.04)::int)::bigint as fn, sum((l_discount < 0.05 and l_tax < 0.04)::int)::bigint as tn from lineitem group by all""")
def cumulative_counts(spark, d):
    """Confusion counts of two columns' thresholds, added in batches by line number, one of which comes twice."""
    folder = f"{shared_dir(spark)}/sums-{uuid.uuid4().hex}"
    sums = CumulativeSums(spark, folder, ["l_returnflag"], counts_of_agreement(F.col("l_discount") >= 0.05, F.col("l_tax") >= 0.04))
    lines = table(spark, d, "lineitem").select("l_linenumber", "l_returnflag", "l_discount", "l_tax")
    for number in (0, 1, 2, 1):
        sums.add(lines.where(F.pmod(F.col("l_linenumber"), F.lit(3)) == number), number)
    return sums.current()
