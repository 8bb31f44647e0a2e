"""Queries of the raster operators."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import pixels as P
from ..operators import raster as R
from ..operators import tiles as TL
from ..workspace import Workspace
from .fixtures import duck, view
from .registry import query


def _px(spark, d):
    return view(spark, d, "px").select("image_id", "x", "y", "val")


@query(duck("select px.image_id, x, y, r, g, b from px join luts on lut = 'tri' and idx = val", "px", "luts"))
def apply_lut(spark, d):
    return R.apply_lut(_px(spark, d), view(spark, d, "luts"), "tri").drop("val")


@query(duck("select px.image_id, x, y, r, g, b from px join luts on lut = 'tri' and 255 - idx = val", "px", "luts"))
def invert_lut(spark, d):
    return R.apply_lut(_px(spark, d), R.invert_lut(view(spark, d, "luts")), "tri").drop("val")


@query(duck("""select stack_id, x, y, round(avg(val), 6) average, max(val) as max, min(val) as min, cast(sum(val) as bigint) as sum, round(stddev_samp(val),
6) standard_deviation, median(val::double) median
from stack
group by all""", "stack"))
def z_project(spark, d):
    return R.z_project(view(spark, d, "stack"), ["stack_id"], ["Average", "Max", "Min", "Sum", "Standard Deviation", "Median"])


@query(duck("""select stack_id, x, y, max(cast(round(r * val / 255.0::double) as int)) r, max(cast(round(g * val / 255.0::double) as int)) g,
max(cast(round(b * val / 255.0::double) as int)) b
from stack
join luts on lut = 'tri' and idx = cast(floor(256.0::double / 10 * (t - 1)) as int)
where t between 1 and 10
group by stack_id, x, y""", "stack", "luts"))
def temporal_color_code(spark, d):
    return R.temporal_color_code(view(spark, d, "stack"), view(spark, d, "luts"), "tri", 1, 10, ["stack_id"])


_NEXT = "rgb a join rgb o on a.image_id + 1 = o.image_id and a.x = o.x and a.y = o.y"


def _pair(spark, d):
    rgb = view(spark, d, "rgb")
    return rgb, rgb.withColumn("image_id", F.col("image_id") - 1)


@query(duck(f"select a.image_id, a.x, a.y, least(127, (a.r+o.r)//2) r, least(127, (a.g+o.g)//2) g, least(127, (a.b+o.b)//2) b from {_NEXT}", "rgb"))
def blend_average(spark, d):
    return R.blend_average(*_pair(spark, d), ["image_id", "x", "y"])


def _mix(f: str) -> str:
    one = lambda c: f"cast(round(round(0.6::double * least(255.0::double, greatest(0.0::double, {f.replace('S', f'o.{c}').replace('T', f'a.{c}')})) + 0.4::double * a.{c}, 6)) as int) {c}"
    return f"select a.image_id, a.x, a.y, {', '.join(map(one, 'rgb'))} from {_NEXT}"


_LUMA = "(0.299::double*{0}.r + 0.587::double*{0}.g + 0.114::double*{0}.b)"


@query(duck(" union all ".join(f"select '{m}' as mode, * from ({_mix(f)})" for m, f in (("Add", "(S+T)"), ("Subtract", "(T-S)"), ("Multiply", "(S*T/255.0::double)"), ("Difference", "abs(S-T)"), ("Normal", "S"), ("Color-YCbCr", f"({_LUMA.format('a')} + S - {_LUMA.format('o')})"))), "rgb"))
def compose(spark, d):
    target, source = _pair(spark, d)
    keys = ["image_id", "x", "y"]
    return R.union_all([R.compose(source, target, keys, m, 0.6).withColumn("mode", F.lit(m)) for m in ("Add", "Subtract", "Multiply", "Difference", "Normal", "Color-YCbCr")])


def _blur_sql(sigma: float, src: str = "px") -> str:
    w = R.kernel(sigma)
    r = len(w) // 2
    rows = ", ".join(f"({i - r}, {x!r}::double)" for i, x in enumerate(w))
    return f"""with k(o, w) as (values {rows}),
h as (select p.image_id, q.q x, p.y, sum(w * p.val) val from range(8) q(q), k, {src} p where p.x = least(7, greatest(0, q.q + o)) group by all),
v as (select p.image_id, p.x, q.q y, sum(w * p.val) val from range(8) q(q), k, h p where p.y = least(7, greatest(0, q.q + o)) group by all)"""


@query(duck(_blur_sql(0.8) + " select image_id, cast(x as int) x, cast(y as int) y, round(val, 6) val from v", "px"))
def gaussian_blur(spark, d):
    return R.gaussian_blur(_px(spark, d), 0.8, ["image_id"], 8, 8).withColumn("val", F.round("val", 6))


_SIGMA = math.sqrt((0.5 * 8 / 4) ** 2 - 0.25)


@query(duck(_blur_sql(_SIGMA) + """, n as (select cast(i as int) i, cast(floor((i + 0.5) * 2) as int) s
from range(4) q(i)) select image_id, a.i x, b.i y, round(val, 6) val
from v
join n a on a.s = v.x
join n b on b.s = v.y""", "px"))
def downsample(spark, d):
    return R.downsample(_px(spark, d), 8, 8, 4, 4, ["image_id"]).withColumn("val", F.round("val", 6))


@query(duck("select image_id, cast(x * 3 // 8 as int) x, cast(y * 3 // 8 as int) y, round(avg(val), 6) val from px group by all", "px"))
def resize(spark, d):
    return R.resize(_px(spark, d), 8, 8, 3, 3, ["image_id"])


@query(duck("select image_id, cast(x // 4 * 2 + y // 4 + 1 as int) tile, x % 4 x, y % 4 y, val from px", "px"))
def split_tiles(spark, d):
    return R.split_tiles(_px(spark, d), 4, 4, 8)


@query(duck("select image_id, x, y, val from px", "px"))
def assemble_tiles(spark, d):
    return R.assemble_tiles(R.split_tiles(_px(spark, d), 4, 4, 8), 4, 4, 2)


def _tiles(spark, d):
    """Images with an id that 50 divides, all images, and their size."""
    px = _px(spark, d)
    return px.filter("image_id % 50 = 0").withColumnRenamed("image_id", "tile"), px.withColumnRenamed("image_id", "db"), Workspace(spark, "tiles"), 8, 8


_DISTANCE = """select a.image_id tile, b.image_id db, cast(sum((a.val-b.val)*(a.val-b.val)) as bigint) distance
from px a
join px b on a.x = b.x and a.y = b.y
where a.image_id % 50 = 0 and b.image_id <> a.image_id
group by all"""


@query(duck(_DISTANCE, "px"))
def tile_distance(spark, d):
    return TL.tile_distance(*_tiles(spark, d))


@query(duck(f"select tile, db, distance from ({_DISTANCE}) qualify row_number() over (partition by tile order by distance, db) = 1", "px"))
def best_match(spark, d):
    return TL.best_match(*_tiles(spark, d))


@query(duck(f"""with recursive d as materialized (select *, dense_rank() over (order by tile) i from ({_DISTANCE})),
r(i, tile, db, distance, used) as (select 0::bigint, null::bigint, null::bigint, null::bigint, []::bigint[]
 union all select d.i, d.tile, d.db, d.distance, list_append(used, d.db) from r join d on d.i = r.i + 1 where not list_contains(used, d.db) qualify row_number() over (order by d.distance, d.db) = 1)
select tile, db, distance from r where i > 0""", "px"))
def best_match_unique(spark, d):
    return TL.best_match_unique(*_tiles(spark, d))


def _rois(spark, d):
    return view(spark, d, "rois")


def _polygons(spark, d):
    return _rois(spark, d).select("roi_id", "image_id", R.rectangle("x0", "y0", "x1", "y1").alias("verts"))


_UNDER = "px join rois using (image_id) where x >= x0 and x < x1 and y >= y0 and y < y1"


@query(duck(f"select image_id, roi_id, x, y, val from {_UNDER}", "px", "rois"))
def mask_polygon(spark, d):
    return R.mask_polygon(_px(spark, d), _polygons(spark, d), ("image_id",)).select("image_id", "roi_id", "x", "y", "val")


@query(duck("""with l as (select *, cast(dense_rank() over (partition by stack_id order by z) as int) layer_index from (select distinct stack_id, t, t * 2.5::double z from stack where t % 3 <> 1)),
r as (select roi_id, image_id // 10 stack_id, cast(image_id % 10 + 1 as int) t, x0, y0, x1, y1 from rois)
select roi_id, stack_id, layer_index, z, round(count(*) * 0.25::double, 6) area, round(avg(val), 6) mean from stack join r using (stack_id, t) join l using (stack_id, t)
where x >= x0 and x < x1 and y >= y0 and y < y1 group by all""", "px", "stack", "rois"))
def measure_regions(spark, d):
    stack = view(spark, d, "stack").filter("t % 3 <> 1")
    layers = stack.select("stack_id", "t").distinct().withColumn("z", F.col("t") * 2.5)
    regions = _polygons(spark, d).select("roi_id", F.expr("image_id div 10").alias("stack_id"), (F.col("image_id") % 10 + 1).cast("int").alias("t"), "verts")
    return R.measure_regions(stack, regions, layers, "t", ["stack_id"], 0.25)


@query(duck("select roi_id, concat_ws(',', x0*2.0::double+1, y0*0.5::double-1, x1*2.0::double+1, y1*0.5::double-1) box from rois", "rois"))
def affine_transform(spark, d):
    moved = R.affine_transform(R.rectangle("x0", "y0", "x1", "y1"), (2, 0, 0, 0.5, 1, -1))
    return view(spark, d, "rois").select("roi_id", moved.alias("v")).select("roi_id", F.concat_ws(",", *(F.expr(c).cast("string") for c in ("v[0].x", "v[0].y", "v[2].x", "v[2].y"))).alias("box"))


_LINE = """select roi_id, image_id, cast(i as int) i, cast(round(round(ax + (bx - ax) * i / n, 6)) as int) x, cast(round(round(ay + (by_ - ay) * i / n, 6)) as int) y
from (select *, unnest(range(cast(n as bigint) + 1))::double i from (select *, greatest(1, round(sqrt((bx-ax)*(bx-ax) + (by_-ay)*(by_-ay)))) n from ({src})))"""


def profiled_regions(spark, d):
    """Lines, two kinds of bent lines, rectangles and ovals."""
    v = lambda x, y: F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    k = F.col("roi_id") % 5
    kind = F.element_at(F.array(*(F.lit(x) for x in ("line", "polyline", "freeline", "rectangle", "oval"))), (k + 1).cast("int"))
    verts = F.when(k == 0, F.array(v("x0", "y0"), v("x1", "y1"))).when(k < 3, F.array(v("x0", "y0"), v("x1", "y0"), v("x1", "y1"))).otherwise(R.rectangle("x0", "y0", "x1", "y1"))
    return _rois(spark, d).select("roi_id", "image_id", kind.alias("kind"), verts.alias("verts"))


_SEGMENTS = """select roi_id * 4 roi_id, image_id, x0::double ax, y0::double ay, x1::double bx, case when roi_id % 5 = 0 then y1 else y0 end::double by_ from rois where roi_id % 5 < 3
union all select roi_id * 4 + 1, image_id, x1, y0, x1, y1 from rois where roi_id % 5 between 1 and 2"""
#: The profiles of all regions; ``on`` joins the pixels by image.
PROFILES = f"""with s as ({_LINE.format(src=_SEGMENTS)}), u as (select * from s qualify i < max(i) over (partition by roi_id) or roi_id // 4 % 5 = 0 or roi_id % 4 = 1)
select {{key}} u.roi_id // 4 roi_id, cast(u.roi_id % 4 as int) edge, u.i, val::double val from {{image}} p join u on {{on}} p.x = u.x and p.y = u.y
union all select {{key}} roi_id, 0, x, round(avg(val), 6) from {{image}} p join rois u on {{on}} u.roi_id % 5 = 3 and x >= x0 and x < x1 and y >= y0 and y < y1 group by all
union all select {{none}} roi_id, null, null, null from rois u where roi_id % 5 = 4"""


@query(duck(PROFILES.format(key="u.image_id,", image="px", on="p.image_id = u.image_id and", none="u.image_id,"), "px", "rois"))
def line_profile(spark, d):
    return R.profile(_px(spark, d), profiled_regions(spark, d), ["image_id"], on=("image_id",))


@query(duck(f"select image_id, roi_id, x, round(avg(val), 6) mean from {_UNDER} group by all", "px", "rois"))
def column_profile(spark, d):
    return R.column_profile(_px(spark, d), _rois(spark, d), ["image_id"], on=("image_id",))


_EDGES = """select roi_id * 4 + e roi_id, image_id, case e when 0 then x0 when 1 then x1 when 2 then x1 else x0 end::double ax,
case e when 0 then y0 when 1 then y0 when 2 then y1 else y1 end::double ay, case e when 0 then x1 when 1 then x1 when 2 then x0 else x0 end::double bx,
case e when 0 then y0 when 1 then y1 when 2 then y1 else y0 end::double by_
from rois, range(4) q(e)"""


@query(duck(f"with s as ({_LINE.format(src=_EDGES)}), u as (select * from s qualify i < max(i) over (partition by roi_id)) select image_id, roi_id // 4 roi_id, cast(roi_id % 4 as int) edge, i, val from px join u using (image_id, x, y)", "px", "rois"))
def outline_profile(spark, d):
    return R.outline_profile(_px(spark, d), _polygons(spark, d), ["image_id"], on=("image_id",))


#: Rings of an area: a rectangle, a diamond that is a hole in it, and a triangle that overlaps it and leaves the image.
_RINGS = [
    [("x0", "y0"), ("x0 + 5", "y0"), ("x0 + 5", "y0 + 6"), ("x0", "y0 + 6")],
    [("x0 + 2.5", "y0 + 1.2"), ("x0 + 4.1", "y0 + 3.1"), ("x0 + 2.5", "y0 + 4.9"), ("x0 + 0.8", "y0 + 3.1")],
    [("x0 + 3", "y0 + 4.2"), ("x0 + 7.3", "y0 + 5.1"), ("x0 + 4.1", "y0 + 8.7")],
]
_AREA_EDGES = ", ".join(f"({r}, {a[0]}, {a[1]}, {b[0]}, {b[1]})" for r, ring in enumerate(_RINGS) for a, b in zip(ring, ring[1:] + ring[:1], strict=True)).replace("x0", "x0::double").replace("y0", "y0::double")


@query(duck(f"""with l as (select roi_id // 10 as roi, roi_id % 10 + 1 as t, x0, y0 from rois where (roi_id // 10) % 3 <> 0 or roi_id % 10 <> 4),
e as (select roi, t, v.ax, v.ay, v.bx, v.by_ from l, lateral (values {_AREA_EDGES}) v(ring, ax, ay, bx, by_)),
bx as (select roi, floor(min(ax)) a, floor(min(ay)) b, ceil(max(ax)) c, ceil(max(ay)) d, min(t) t0, max(t) t1 from e group by roi),
g as (select roi, unnest(range(t0, t1 + 1)) t, a, b, c, d from bx), gx as (select roi, t, b, d, unnest(range(cast(a as bigint), cast(c as bigint))) x from g), gy as (select roi, t, x, unnest(range(cast(b as bigint), cast(d as bigint))) y from gx),
i as (select gy.roi, gy.t, gy.x, gy.y from gy join e on e.roi = gy.roi and e.t = gy.t and (ay > gy.y + 0.5::double) <> (by_ > gy.y + 0.5::double) and (bx - ax) * ((gy.y + 0.5::double) - ay) / (by_ - ay) + ax > gy.x + 0.5::double group by all having count(*) % 2 = 1)
select gy.roi as roi_id, gy.t as layer, cast(gy.x as int) x, cast(gy.y as int) y, cast(case when i.x is not null then coalesce(val, 0) else 0 end as int) val
from gy left join i on i.roi = gy.roi and i.t = gy.t and i.x = gy.x and i.y = gy.y left join stack s on s.stack_id = gy.roi and s.t = gy.t and s.x = gy.x and s.y = gy.y""", "px", "stack", "rois"))
def crop_masked_stack(spark, d):
    v = lambda x, y: F.struct(F.expr(f"cast({x} as double)").alias("x"), F.expr(f"cast({y} as double)").alias("y"))
    rings = F.array(*(F.array(*(v(x.replace("x0", "cast(x0 as double)"), y.replace("y0", "cast(y0 as double)")) for x, y in ring)) for ring in _RINGS))
    areas = _rois(spark, d).select(F.expr("roi_id div 10").alias("roi_id"), (F.col("roi_id") % 10 + 1).alias("layer"), rings.alias("rings")).filter("roi_id % 3 <> 0 or layer <> 5")
    stack = view(spark, d, "stack").select(F.col("stack_id").alias("roi_id"), F.col("t").cast("long").alias("layer"), "x", "y", "val")
    return R.crop_masked_stack(stack, areas, "layer", on=("roi_id",))


def _mask(spark, d):
    return _px(spark, d).filter("val >= 140")


_LABELS = """with recursive m as (select image_id, x, y, y * 8 + x node from px where val >= 140),
reach(image_id, node, other) as (select image_id, node, node from m union select r.image_id, r.node, b.node from reach r join m a on a.image_id = r.image_id and a.node = r.other join m b on b.image_id = a.image_id and abs(a.x - b.x) <= 1 and abs(a.y - b.y) <= 1),
lab as (select m.image_id, m.x, m.y, l.label from m join (select image_id, node, min(other) as label from reach group by all) l on l.image_id = m.image_id and l.node = m.node)"""


@query(duck(f"{_LABELS} select * from lab", "px"))
def label_components(spark, d):
    return R.label_components(_mask(spark, d), ["image_id"], Workspace(spark, "components"), 8)


@query(duck(f"{_LABELS} select lab.* from lab join (select image_id, label from lab where x = 3 and y = 3) s on s.image_id = lab.image_id and s.label = lab.label", "px"))
def wand(spark, d):
    return R.wand(R.label_components(_mask(spark, d), ["image_id"], Workspace(spark, "components"), 8), ["image_id"], 3, 3)


@query(duck(f"{_LABELS} select image_id, label, arg_min(x, y * 8 + x) x_start, min(y) y_start, count(*) area, min(x) min_x, min(y) min_y, max(x) max_x, max(y) max_y from lab group by image_id, label having min(x) > 0 and min(y) > 0 and max(x) < 7 and max(y) < 7", "px"))
def measure_particles(spark, d):
    return R.measure_particles(R.label_components(_mask(spark, d), ["image_id"], Workspace(spark, "components"), 8), ["image_id"], 8, 8)


_FILL = """with recursive q as (select image_id, x, y, val // 64 as val from px),
f(image_id, x, y, val) as (select image_id, x, y, val from q where x = 4 and y = 4 union select b.image_id, b.x, b.y, b.val from f a join q b on b.image_id = a.image_id and b.val = a.val and abs(a.x - b.x) + abs(a.y - b.y) = 1)
select q.image_id, q.x, q.y, cast(case when f.x is not null then 9 else q.val end as int) val from q left join f on f.image_id = q.image_id and f.x = q.x and f.y = q.y"""


@query(duck(_FILL, "px"))
def flood_fill(spark, d):
    quartered = _px(spark, d).withColumn("val", F.expr("cast(val div 64 as int)"))
    return R.flood_fill(quartered, ["image_id"], 4, 4, 9, Workspace(spark, "fill"), 8).select("image_id", "x", "y", "val")


#: A directed edge of the hull has no point on its right, and those on its line between its ends.
@query(duck("""with e as (select a.image_id, a.x, a.y, b.x bx, b.y by_ from points a join points b on a.image_id = b.image_id and (a.x <> b.x or a.y <> b.y)
 where not exists (select 1 from points c where c.image_id = a.image_id and ((b.x-a.x)*(c.y-a.y) - (b.y-a.y)*(c.x-a.x) < 0
  or (b.x-a.x)*(c.y-a.y) - (b.y-a.y)*(c.x-a.x) = 0 and ((c.x-a.x)*(b.x-a.x) + (c.y-a.y)*(b.y-a.y) < 0 or (c.x-a.x)*(b.x-a.x) + (c.y-a.y)*(b.y-a.y) > (b.x-a.x)*(b.x-a.x) + (b.y-a.y)*(b.y-a.y))))),
t as (select *, case when atan2(by_ - y, bx - x) < 0 then atan2(by_ - y, bx - x) + 2 * pi() else atan2(by_ - y, bx - x) end turn from e),
single as (select image_id, min(x) x, min(y) y from points group by image_id having count(*) = 1)
select image_id, cast(row_number() over (partition by image_id order by turn) - 1 as int) seq, x, y from t union all select image_id, 0, x, y from single""", "points"))
def convex_hull(spark, d):
    return R.convex_hull(view(spark, d, "points"), "image_id", 3)


@query(duck("with p as (" + PROFILES.format(key="u.image_id,", image="px", on="p.image_id = u.image_id and", none="u.image_id,").replace("with s as", "with s as", 1) + """) select image_id, roi_id, 0 x_min, case when count(i) = 0 then 1 else count(i) end x_max, case when count(i) = 0 then 0.0::double else min(val) end y_min,
case when count(i) = 0 then 1.0::double else max(val) end y_max
from p
group by image_id, roi_id""", "px", "rois"))
def profile_limits(spark, d):
    return R.profile_limits(R.profile(_px(spark, d), profiled_regions(spark, d), ["image_id"], on=("image_id",)), ["image_id", "roi_id"])


@query()
def spline_profile(spark, d):
    return R.spline_profile(_px(spark, d), _polygons(spark, d), ["image_id"], on=("image_id",))


@query(duck("""with n as (select cast(i as int) i, cast(floor((i + 0.5::double) * 8 / 12) as int) s from range(12) q(i)), m as (select cast(i as int) i, cast(i * 5 // 8 as int) t from range(8) q(i))
select image_id, n.i x, m.t y, round(avg(val), 6) val, 'inch' as unit, round(1.0::double / 6, 6) pixel_width from px join n on n.s = px.x join m on m.i = px.y group by all""", "px"))
def resample_to_dpi(spark, d):
    images = _px(spark, d).select("image_id").distinct().withColumns({"width": F.lit(8), "height": F.lit(8)})
    sized = P.scale_to_dpi(images, 6, 2.0, 5 / 6)
    return R.resample(_px(spark, d), sized, ["image_id"], "average").join(sized.select("image_id", "unit", "pixel_width"), "image_id")


def _turned(sign: str) -> str:
    c, s = math.cos(math.radians(2)), math.sin(math.radians(2))
    return f"select stack_id, cast(round(round(3.5::double + (x - 3.5::double) * {c!r}::double {sign} (t - 5.5::double) * {s!r}::double, 6)) as int) x, y, max(val) val from stack group by all"


@query(duck(_turned("+"), "stack"))
def rotated_projection(spark, d):
    return R.rotated_projection(view(spark, d, "stack"), 2.0, ["stack_id"], 3.5, 5.5)


@query(duck(f"select stack_id, x, y, l.val as r, q.val as g, q.val as b from ({_turned('-')}) l join ({_turned('+')}) q using (stack_id, x, y)", "stack"))
def anaglyph(spark, d):
    return R.anaglyph(view(spark, d, "stack"), ["stack_id"], 3.5, 5.5)


@query(duck("""select i.image_id, cast(v as int) val, coalesce(n, 0) n
from (select distinct image_id
from px) i
cross
join range(256) q(v)
left
join (select image_id, val, count(*) n
from px
group by all) h on h.image_id = i.image_id and h.val = v""", "px"))
def histogram(spark, d):
    return R.histogram(_px(spark, d), ["image_id"])


@query(duck("""with c as (select 'Red' channel, r val
from rgb
union all select 'Green', g
from rgb
union all select 'Blue', b
from rgb) select i.channel, cast(v as int) val, coalesce(n, 0) n
from (select distinct channel
from c) i
cross
join range(256) q(v)
left
join (select channel, val, count(*) n
from c
group by all) h on h.channel = i.channel and h.val = v""", "rgb"))
def rgb_histogram(spark, d):
    parts = F.array(*(F.struct(F.lit(n).alias("channel"), F.col(c).alias("val")) for n, c in (("Red", "r"), ("Green", "g"), ("Blue", "b"))))
    return R.histogram(view(spark, d, "rgb").select(F.explode(parts).alias("p")).select("p.*"), ["channel"])


_GRAYS = " union all ".join(f"select image_id, '{n}' as label, r*{a!r}::double + g*{b!r}::double + b*{c!r}::double v from rgb" for n, a, b, c in R.S.GRAY_WEIGHTS)


@query(duck(f"select image_id, label, count(v) area, round(avg(v) + 1e-9::double, 4) mean, round(min(v), 6) min, round(max(v), 6) max, round(stddev_samp(v) + 1e-9::double, 4) std from ({_GRAYS}) group by all", "rgb"))
def measure_rgb(spark, d):
    return R.measure_rgb(view(spark, d, "rgb"), ["image_id"])


@query(duck("select width, height, count(*) n, round(width::double / height, 2) ratio from images group by all", "images"))
def dimension_census(spark, d):
    return R.dimension_census(view(spark, d, "images"))


@query(duck("select image_id, width, height, title from images where round(width::double / height, 2) = 10.0", "images"))
def aspect_filter(spark, d):
    return R.aspect_filter(view(spark, d, "images"), 10.0)


@query(duck("""with p as (select stack_id, t, dense_rank() over (partition by stack_id
order by t) as layer_index
from (select distinct stack_id, t
from stack
where t % 3 <> 1)) select stack_id, t, cast(layer_index as int) layer_index
from p""", "stack"))
def layer_index(spark, d):
    from pyspark.sql import Window

    layers = view(spark, d, "stack").filter("t % 3 <> 1").select("stack_id", "t").distinct()
    return layers.withColumn("layer_index", F.dense_rank().over(Window.partitionBy("stack_id").orderBy("t")))
