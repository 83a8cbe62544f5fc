"""Queries of box transforms, anchors, sample choice, complex arrays, mixing and traced steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataframe.core.storage import table
from strataframe.operators import box_transforms as T
from strataframe.operators import boxes as B
from strataframe.operators import complex_arrays as Z
from strataframe.operators import mixers as M
from strataframe.plans import trace
from strataframe.queries.box_queries import _BOXES, _boxes
from strataframe.queries.registry import query, rounded


def _array_boxes(spark, d):
    return _boxes(spark, d).select("box", F.array("xmin", "ymin", "xmax", "ymax").alias("q"))


def _spread(df, **arrays):
    """Elements of arrays as columns: ``name=(column, length)``."""
    return rounded(df.select("box", *[F.get(c, F.lit(i)).alias(f"{n}{i}") for n, (c, size) in arrays.items() for i in range(size)]))


@query(_BOXES + """, m as (select box, 2 * xmin + ymin / 2 + 1 as a, 3 + ymin - xmin as b, 2 * xmax + ymax / 2 + 1 as e, 3 + ymax - xmax as f, xmin, ymin, xmax, ymax from c)
select box, round(least(a, e), 4) as t0, round(least(b, f), 4) as t1, round(greatest(a, e), 4) as t2, round(greatest(b, f), 4) as t3,
  round(xmin * 100 / 200, 4) as r0, round(ymin * 300 / 150, 4) as r1, round(xmax * 100 / 200, 4) as r2, round(ymax * 300 / 150, 4) as r3 from m""")
def box_affine(spark, d):
    q = F.col("q")
    return _spread(_array_boxes(spark, d), t=(T.affine_box(q, [[2, 0.5, 1], [-1, 1, 3], [0, 0, 1]]), 4), r=(T.resize_box(q, (200, 150), (100, 300)), 4))


@query(_BOXES + """select box, round(200 - xmax, 4) as f0, round(ymin, 4) as f1, round(200 - xmin, 4) as f2, round(ymax, 4) as f3,
  round(150 - ymax, 4) as a0, round(xmin, 4) as a1, round(150 - ymin, 4) as a2, round(xmax, 4) as a3, round(ymin, 4) as b0, round(200 - xmax, 4) as b1, round(ymax, 4) as b2, round(200 - xmin, 4) as b3,
  round(ymin, 4) as s0, round(xmin, 4) as s1, round(ymax, 4) as s2, round(xmax, 4) as s3 from c""")
def box_flip_rotate(spark, d):
    q, size = F.col("q"), (200, 150)
    return _spread(_array_boxes(spark, d), f=(T.flip_box(q, size, [0]), 4), a=(T.rotate_box(q, size), 4), b=(T.rotate_box(q, size, 3), 4), s=(T.swap_box_axes(q, 2, 0, 1), 4))


@query(_BOXES + "select box, array_to_string([xmin, ymin, xmin, ymax, xmax, ymin, xmax, ymax], ',') as points, round(xmin, 4) as q0, round(ymin, 4) as q1, round(xmax, 4) as q2, round(ymax, 4) as q3 from c")
def box_corner_points(spark, d):
    points = T.box_points(F.col("q"), 2)
    rows = _array_boxes(spark, d).withColumn("p", points)
    text = rows.select("box", F.array_join(F.flatten("p").cast("array<string>"), ",").alias("points"))
    return text.join(_spread(rows, q=(T.points_box(F.col("p"), 2), 4)), "box")


@query("""with b as (select p_partkey as box, p_partkey % 5 as x0, p_partkey % 3 as y0, p_partkey % 5 + 2 + p_partkey % 4 as x1, p_partkey % 3 + 1 + p_partkey % 5 as y1, p_partkey % 3 as label from part)
select box, array_to_string(list_transform(range(120), lambda i: case when i // 10 >= x0 and i // 10 < x1 and i % 10 >= y0 and i % 10 < y1 then label else -1 end), ',') as mask,
  x0::double as q0, y0::double as q1, x1::double as q2, y1::double as q3, label::int as label from b""")
def box_masks(spark, d):
    k = F.col("p_partkey")
    box = F.array(*[c.cast("double") for c in (k % 5, k % 3, k % 5 + 2 + k % 4, k % 3 + 1 + k % 5)])
    # A file of keys is small for its rows, so it would be few tasks.
    parts = table(spark, d, "part").select("p_partkey").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = parts.select(k.alias("box"), T.box_mask(box, k % 3, (12, 10)).alias("m")).withColumn("f", T.mask_box(F.col("m"), (12, 10)))
    corners = [F.get("f.box", F.lit(i)).alias(f"q{i}") for i in range(4)]
    return rows.select("box", F.array_join(F.col("m").cast("array<string>"), ",").alias("mask"), *corners, F.col("f.label").alias("label"))


@query(_BOXES + """, p as (select *, xmin + 3 as x0, ymin - 2 as y0, xmax + 8 as x1, ymax + 1 as y1 from c)
select box, round(10 * ((xmin + xmax) - (x0 + x1)) / 2 / (x1 - x0), 4) as e0, round(10 * ((ymin + ymax) - (y0 + y1)) / 2 / (y1 - y0), 4) as e1,
  round(5 * ln((xmax - xmin) / (x1 - x0)), 4) as e2, round(5 * ln((ymax - ymin) / (y1 - y0)), 4) as e3, round(xmin, 4) as d0, round(ymin, 4) as d1, round(xmax, 4) as d2, round(ymax, 4) as d3 from p""")
def box_codes(spark, d):
    at = lambda i, by: F.get("q", F.lit(i)) + by
    proposal, weights = F.array(at(0, 3.0), at(1, -2.0), at(2, 8.0), at(3, 1.0)), (10.0, 10.0, 5.0, 5.0)
    rows = _array_boxes(spark, d).withColumn("p", proposal).withColumn("code", T.encode_box(F.col("q"), F.col("p"), weights))
    return _spread(rows, e=(F.col("code"), 4), d=(T.decode_box(F.col("code"), F.col("p"), weights), 4))


@query("""with i as (select distinct p_partkey // 10 as image, 64 + 16 * (p_partkey // 10 % 5) as wide, 48 + 12 * (p_partkey // 10 % 3) as high from part),
s as (select * from (values (0, 16, 12, 16.0::double), (1, 8, 6, 32.0::double)) v(level, n, m, z)),
r as (select * from (values (0, 0.5::double), (1, 1.0::double), (2, 2.0::double)) v(k, ratio)),
g as (select image, level, x, y, wide // n as a, high // m as b, z, (x * m + y) as cell from i, s, unnest(range(n)) t(x), unnest(range(m)) u(y))
select image, level, cell * 3 + k as anchor, x * a - round_even(z / sqrt(ratio) / 2, 0) as q0, y * b - round_even(z * sqrt(ratio) / 2, 0) as q1, x * a + round_even(z / sqrt(ratio) / 2, 0) as q2, y * b + round_even(z * sqrt(ratio) / 2, 0) as q3
from g, r""")
def anchor_grid(spark, d):
    """Anchors of two levels for each of a table of images of different sizes."""
    number = F.floor(F.col("p_partkey") / 10).cast("long")
    images = table(spark, d, "part").select(number.alias("image"), F.array(64 + number % 5 * 16, 48 + number % 3 * 12).alias("size")).distinct()
    shapes = [T.anchor_shapes([z], [0.5, 1.0, 2.0]) for z in (16.0, 32.0)]
    made = T.image_anchors(images, [(16, 12), (8, 6)], shapes)
    return made.select("image", "level", "anchor", *[F.get("box", F.lit(i)).alias(f"q{i}") for i in range(4)])


_MATCHES = _BOXES + """, p as (select a.image, a.box as anchor, b.box as truth, (least(a.xmax, b.xmax) - greatest(a.xmin, b.xmin)) * (least(a.ymax, b.ymax) - greatest(a.ymin, b.ymin)) as inter,
  (a.xmax - a.xmin) * (a.ymax - a.ymin) + (b.xmax - b.xmin) * (b.ymax - b.ymin) as areas
  from c a join c b on a.image = b.image and a.box % 3 <> 0 and b.box % 3 = 0 and least(a.xmax, b.xmax) > greatest(a.xmin, b.xmin) and least(a.ymax, b.ymax) > greatest(a.ymin, b.ymin)),
u as (select image, anchor, truth, inter / (areas - inter) as iou from p),
w as (select *, row_number() over (partition by image, anchor order by iou desc, truth) as k, iou = max(iou) over (partition by image, truth) as top from u)
"""


@query(_MATCHES + """select image, anchor, round(iou, 4) as iou, case when (select bool_or(top) from w z where z.image = w.image and z.anchor = w.anchor) or iou >= 0.5 then truth when iou >= 0.2 then -2 else -1 end as matched from w where k = 1""")
def anchor_match(spark, d):
    rows = _boxes(spark, d)
    return rounded(T.match_anchor_boxes(rows.where("box % 3 <> 0"), rows.where("box % 3 = 0"), "image", "box", 0.2, 0.5, 64.0))


@query(_BOXES.replace("with b as", "with recursive b as") + """, s as (select box, image, label, 1 / (1 + exp(-(score - 1400) / 300)) as score, box % 2 as level, greatest(xmin, 0) as xmin, greatest(ymin, 0) as ymin, least(xmax, 180) as xmax, least(ymax, 120) as ymax from c),
l as (select *, row_number() over (partition by image, level order by score desc, box) as r from s where score > 0.2),
o as (select *, row_number() over (partition by image, label order by score desc, box) as k, [xmin, ymin, xmax, ymax] as q from l where r <= 25 and xmax > xmin and ymax > ymin),
n(image, label, k, kept, box, stays) as (
  select distinct image, label, 0::bigint, [[0.0::double]][2:], null::bigint, false from o
  union all
  select image, label, k, case when stays then list_append(kept, q) else kept end, box, stays from (
    select o.image, o.label, o.k, n.kept, o.q, o.box, len(list_filter(n.kept, lambda z:
      greatest(least(z[3], xmax) - greatest(z[1], xmin), 0) * greatest(least(z[4], ymax) - greatest(z[2], ymin), 0)
      / ((z[3] - z[1]) * (z[4] - z[2]) + (xmax - xmin) * (ymax - ymin) - greatest(least(z[3], xmax) - greatest(z[1], xmin), 0) * greatest(least(z[4], ymax) - greatest(z[2], ymin), 0)) > 0.3)) = 0 as stays
    from n join o on o.image = n.image and o.label = n.label and o.k = n.k + 1)),
f as (select o.*, row_number() over (partition by o.image order by score desc, o.box) as place from n join o using (box) where n.stays)
select image, level, label, box, round(score, 4) as score from f where place <= 20""")
def box_selector(spark, d):
    rows = _boxes(spark, d).withColumn("level", F.col("box") % 2).withColumn("score", (F.col("score") - 1400) / 300)
    kept = T.select_boxes(rows, "image", "level", "score", "label", "box", (180, 120), least=0.2, per_level=25, most=0.3, per_image=20)
    return rounded(kept.select("image", "level", "label", "box", "score"))


@query("""with s as (select p_partkey as sample, p_partkey % 20 as image, case when p_partkey % 11 = 0 then 1 + p_partkey % 3 when p_partkey % 13 = 0 then -1 else 0 end as label, p_retailprice as score from part),
c as (select image, least(count(*) filter (label >= 1), 4) as p from s group by image),
n as (select image, p, greatest(1, trunc(greatest(p, 1) * abs(1 - 1 / 0.25::double)))::bigint as n from c),
h as (select s.*, p, n, row_number() over (partition by image, label >= 1 order by case when label >= 1 then 0 else -score end, sample) as hard from s join n using (image) where label >= 0),
t as (select *, row_number() over (partition by image, label >= 1 order by md5('7:' || image || ':' || sample), sample) as draw from h where label >= 1 or hard <= n * 2)
select image, sample, label, label >= 1 as positive from t where draw <= case when label >= 1 then p else n end""")
def hard_negatives(spark, d):
    k = F.col("p_partkey")
    label = F.when(k % 11 == 0, 1 + k % 3).when(k % 13 == 0, -1).otherwise(0)
    rows = table(spark, d, "part").select(k.alias("sample"), (k % 20).alias("image"), label.alias("label"), F.col("p_retailprice").alias("score"))
    return T.hard_negatives(rows, "image", "sample", "label", "score", 16, 0.25, pool=2.0, seed=7).select("image", "sample", "label", "positive")


_Z = """with z as (select vec_id, i, v[2 * i + 1]::double as re, v[2 * i + 2]::double as im, v[2 * ((i + 1) % (len(v) // 2)) + 1]::double as ra, v[2 * ((i + 1) % (len(v) // 2)) + 2]::double as ia, len(v) // 2 as n
  from (select vec_id, embedding as v, unnest(range(len(embedding) // 2)) as i from embeddings))
"""


def _complex(spark, d):
    return table(spark, d, "embeddings").select("vec_id", Z.from_pairs(F.col("embedding").cast("array<double>")).alias("z"))


@query(_Z + "select vec_id, i, round(sqrt(re * re + im * im), 4) as size, round(re * ra + im * ia, 4) as re, round(im * ra - re * ia, 4) as im, round(re, 4) as a, round(im, 4) as b from z")
def complex_products(spark, d):
    z, n = F.col("z"), F.size("z")
    turned = F.concat(F.slice(z, F.lit(2), n - 1), F.slice(z, F.lit(1), F.lit(1)))
    back = Z.from_channels(Z.to_channels(z))
    rows = _complex(spark, d).select("vec_id", F.posexplode(F.arrays_zip(Z.magnitude(z).alias("size"), Z.multiply(z, Z.conjugate(turned)).alias("p"), back.alias("back"))).alias("i", "x"))
    return rounded(rows.select("vec_id", F.col("i").cast("long").alias("i"), "x.size", "x.p.re", "x.p.im", F.col("x.back.re").alias("a"), F.col("x.back.im").alias("b")))


def _coils(spark, d):
    rows = _complex(spark, d).select("vec_id", F.posexplode("z").alias("place", "value"))
    v = F.col("vec_id")
    weight = Z.number(F.cos((v % 4).cast("double")), F.sin((v % 4).cast("double")))
    named = rows.select(F.floor(v / 4).alias("image"), (v % 4).alias("coil"), F.col("place").cast("long").alias("place"), "value", weight.alias("weight"))
    return named.drop("weight"), named.drop("value")


@query(_Z + """select vec_id // 4 as image, i as place, round(sqrt(sum(re * re + im * im)), 4) as rss,
  round(sum(re * cos(vec_id % 4) + im * sin(vec_id % 4)), 4) as re, round(sum(im * cos(vec_id % 4) - re * sin(vec_id % 4)), 4) as im from z group by all""")
def coil_combination(spark, d):
    values, maps = _coils(spark, d)
    one = Z.reduce_coils(values, maps, ["image"], "coil", "place", "value", "weight")
    return rounded(Z.root_sum_of_squares(values, ["image"], "place", "value").join(one, ["image", "place"]).select("image", "place", "rss", "value.re", "value.im"))


@query(_Z + """, o as (select vec_id // 4 as image, i as place, sum(re * cos(vec_id % 4) + im * sin(vec_id % 4)) as a, sum(im * cos(vec_id % 4) - re * sin(vec_id % 4)) as b from z group by all)
select image, vec_id % 4 as coil, place, round(a * cos(vec_id % 4) - b * sin(vec_id % 4), 4) as re, round(a * sin(vec_id % 4) + b * cos(vec_id % 4), 4) as im from z join o on o.image = z.vec_id // 4 and o.place = z.i""")
def coil_expansion(spark, d):
    values, maps = _coils(spark, d)
    one = Z.reduce_coils(values, maps, ["image"], "coil", "place", "value", "weight")
    return rounded(Z.expand(one, maps, ["image"], "place", "value", "weight").select("image", "coil", "place", "value.re", "value.im"))


@query(_Z + """, s as (select vec_id, avg(re) as a, stddev_pop(re) as b, avg(im) as c, stddev_pop(im) as e from z group by vec_id)
select vec_id, i as place, round((re - a) / b, 4) as re, round((im - c) / e, 4) as im from z join s using (vec_id)""")
def complex_normalized(spark, d):
    rows = _complex(spark, d).select("vec_id", F.posexplode("z").alias("place", "value"))
    return rounded(Z.normalize(rows, ["vec_id"], "value").select("vec_id", F.col("place").cast("long").alias("place"), "value.re", "value.im"))


@query("""with m as (select p_partkey as slice, c from part, unnest(range(64)) t(c))
select slice, c as place, (c between 30 and 34) or ('0x' || substr(md5('3:' || slice || ':' || c), 1, 13))::bigint / 4503599627370496::double < (64 / 4 - 5) / (64 - 5)::double as random,
  (c between 30 and 34) or c in (select round_even(2 + k * (4 * (5 - 64) / (5 * 4 - 64)::double), 0) from range(64) r(k) where 2 + k * (4 * (5 - 64) / (5 * 4 - 64)::double) < 63) as even from m""")
def kspace_masks(spark, d):
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("slice"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(63).cast("long"))).alias("place"))
    c = F.col("place")
    return rows.select("slice", "place", Z.random_mask(c, 64, 0.08, 4.0, 3, "slice").alias("random"), Z.even_mask(c, 64, 0.08, 4.0, 2).alias("even"))


_PAIRED = """with i as (select vec_id, embedding as v, row_number() over (order by vec_id) as k, row_number() over (order by md5('5:' || vec_id), vec_id) as h from embeddings),
p as (select a.vec_id, b.vec_id as other, a.v, b.v as w from i a join i b on b.h = a.k),
u as (select *, ('0x' || substr(md5('8:' || vec_id), 1, 13))::bigint / 4503599627370496::double as x, ('0x' || substr(md5('9:' || vec_id), 1, 13))::bigint / 4503599627370496::double as y from p),
e as (select *, floor(x * 8) - floor(sqrt(0.4::double) * 8 / 2) as x0, floor(x * 8) + floor(sqrt(0.4::double) * 8 / 2) as x1, floor(y * 8) - floor(sqrt(0.4::double) * 8 / 2) as y0, floor(y * 8) + floor(sqrt(0.4::double) * 8 / 2) as y1 from u),
c as (select vec_id, other, v, w, greatest(x0, 0) as x0, least(x1, 8) as x1, greatest(y0, 0) as y0, least(y1, 8) as y1 from e)
"""


@query(_PAIRED + """select vec_id, other, i as place, round(0.7 * v[i + 1]::double + 0.3 * w[i + 1]::double, 4) as mixed,
  round(case when i // 8 >= x0 and i // 8 < x1 and i % 8 >= y0 and i % 8 < y1 then w[i + 1] else v[i + 1] end::double, 4) as cut,
  round(case when i // 8 >= x0 and i // 8 < x1 and i % 8 >= y0 and i % 8 < y1 then 0 else v[i + 1] end::double, 4) as blank,
  round(1 - greatest(x1 - x0, 0) * greatest(y1 - y0, 0) / 64, 4) as kept from c, unnest(range(64)) t(i)""")
def mixed_pairs(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    both = M.paired(rows, "vec_id", 5)
    v, w, size = F.col("v"), F.col("v_other"), (8, 8)
    arrays = F.arrays_zip(M.mix_up(v, w, F.lit(0.7)).alias("mixed"), M.cut_mix(v, w, size, F.lit(0.6), 8, "vec_id").alias("cut"), M.cut_out(v, size, 0.4, 8, "vec_id").alias("blank"))
    made = both.select("vec_id", F.col("vec_id_other").alias("other"), M.kept_share(size, F.lit(0.6), 8, "vec_id").alias("kept"), F.posexplode(arrays).alias("place", "x"))
    return rounded(made.select("vec_id", "other", F.col("place").cast("long").alias("place"), "x.mixed", "x.cut", "x.blank", "kept"))


@query("""with u as (select o_orderkey, o_totalprice as v, ('0x' || substr(md5('1:' || o_orderkey), 1, 13))::bigint / 4503599627370496::double < 0.5 as a, ('0x' || substr(md5('2:' || o_orderkey), 1, 13))::bigint / 4503599627370496::double < 0.3 as b from orders)
select o_orderkey, round((case when a then v * 2 else v end) + (case when b then 100 else 0 end), 4) as changed, concat_ws(',', case when a then 'double' end, case when b then 'add' end) as applied, round(v, 4) as undone from u""")
def traced_undo(spark, d):
    key = ("o_orderkey",)
    steps = [
        trace.Traced("double", ["v"], lambda c: c * 2, lambda c: c / 2, 0.5, 1, key),
        trace.Traced("add", ["v"], lambda c: c + 100, lambda c: c - 100, 0.3, 2, key),
    ]
    made = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("v"))
    for step in steps:
        made = step(made)
    shown = made.withColumns({"changed": F.col("v"), "names": F.array_join(trace.TRACE, ",")})
    back = trace.undo(shown, steps)
    return rounded(back.select("o_orderkey", "changed", F.col("names").alias("applied"), F.col("v").alias("undone")))


_U = lambda seed: f"('0x' || substr(md5('{seed}:' || o_orderkey), 1, 13))::bigint / 4503599627370496::double"


@query(f"""with recursive u as (select o_orderkey, o_totalprice as v, list_transform(list_sort([{{'h': {_U(5)}, 'i': 0}}, {{'h': {_U(6)}, 'i': 1}}, {{'h': {_U(7)}, 'i': 2}}]), lambda x: x.i)[1:1 + floor({_U(4)} * 3)::int] as o from orders),
s as (select o_orderkey, v, o, 0 as k from u union all select o_orderkey, case o[k + 1] when 0 then v * 2 when 1 then v + 100 else -v end, o, k + 1 from s where k < len(o))
select o_orderkey, round(v, 4) as v from s where k = len(o)""")
def some_in_random_order(spark, d):
    step = trace.some_of([lambda c: c * 2, lambda c: c + 100, lambda c: -c], ["v"], 4, "o_orderkey", least=1)
    return rounded(step(table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("v"))))
