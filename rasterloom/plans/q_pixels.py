"""Queries of the scalar functions and point operators."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import pixels as P
from .fixtures import duck, view
from .registry import query


@query(duck("select image_id, x, y, (r::int << 16) | (g << 8) | b as rgb from rgb", "rgb"))
def pack_rgb(spark, d):
    return view(spark, d, "rgb").select("image_id", "x", "y", S.pack_rgb(F.col("r"), F.col("g"), F.col("b")).alias("rgb"))


@query(duck("select image_id, x, y, r, g, b from rgb", "rgb"))
def unpack_rgb(spark, d):
    df = view(spark, d, "rgb").select("image_id", "x", "y", S.pack_rgb(F.col("r"), F.col("g"), F.col("b")).alias("rgb"))
    r, g, b = S.unpack_rgb(F.col("rgb"))
    return df.select("image_id", "x", "y", r.alias("r"), g.alias("g"), b.alias("b"))


@query("select event_id, cast(least(255, greatest(0, round(value * 3 - 20))) as int) as v from events")
def to_byte(spark, d):
    return view(spark, d, "events").select("event_id", S.to_byte(F.col("value") * 3 - 20).alias("v"))


@query(duck("""select image_id, x, y, round(r*0.299::double + g*0.587::double + b*0.114::double, 6) as gray, round(r*(1/3.0::double) + g*(1/3.0::double) + b*(1/3.0::double),
6) as mean_gray
from rgb""", "rgb"))
def rgb_weighted_gray(spark, d):
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    df = view(spark, d, "rgb")
    return df.select("image_id", "x", "y", F.round(S.weighted_gray(r, g, b, 0.299, 0.587, 0.114), 6).alias("gray"), F.round(S.weighted_gray(r, g, b, 1 / 3, 1 / 3, 1 / 3), 6).alias("mean_gray"))


@query("""
with w as (select event_id, 370 + (value - floor(value)) * 420 as nm from events),
p as (select *, case when nm < 440 then (440-nm)/60 when nm < 510 then 0.0 when nm < 580 then (nm-510)/70 else 1.0 end as rr,
 case when nm < 440 then 0.0 when nm < 490 then (nm-440)/50 when nm < 580 then 1.0 when nm < 645 then (645-nm)/65 else 0.0 end as gg,
 case when nm < 490 then 1.0 when nm < 510 then (510-nm)/20 else 0.0 end as bb,
 case when nm > 700 then 0.3+0.7*((780-nm)/80) when nm < 420 then 0.3+0.7*((nm-380)/40) else 1.0 end as pw from w)
select event_id, cast(case when nm between 380 and 780 then round(rr*pw*255) end as int) as r, cast(case when nm between 380 and 780 then round(gg*pw*255) end as int) as g, cast(case when nm between 380 and 780 then round(bb*pw*255) end as int) as b from p""")
def wavelength_to_rgb(spark, d):
    df = view(spark, d, "events").select("event_id", (F.lit(370) + (F.col("value") - F.floor("value")) * 420).alias("nm"))
    r, g, b = S.wavelength_to_rgb(F.col("nm"))
    return df.select("event_id", r.alias("r"), g.alias("g"), b.alias("b"))


@query("""
with s as (select event_id, case when event_id % 11 = 0 then '' when event_id % 7 = 0 then event_type else cast(cast(floor(value) as bigint) as varchar) end as c from events)
select event_id, case when c = '' then 'Enter a number' when try_cast(c as double) is null then 'Not a number' else printf('%.2f', 32 + 1.8 * try_cast(c as double)) end as f from s""")
def celsius_to_fahrenheit(spark, d):
    text = F.when(F.col("event_id") % 11 == 0, "").when(F.col("event_id") % 7 == 0, F.col("event_type")).otherwise(F.floor("value").cast("string"))
    return view(spark, d, "events").select("event_id", S.celsius_to_fahrenheit(text).alias("f"))


@query(duck("select image_id, x, y, 1 as c, r as val from rgb union all select image_id, x, y, 2, g from rgb union all select image_id, x, y, 3, b from rgb", "rgb"))
def split_channels(spark, d):
    return P.split_channels(view(spark, d, "rgb"))


@query(duck("select image_id, x, y, r, b as g, b from rgb", "rgb"))
def merge_channels(spark, d):
    planes = P.split_channels(view(spark, d, "rgb"))
    one = {c: planes.filter(F.col("c") == c) for c in (1, 3)}
    return P.merge_channels(one[1], one[3], one[3], ["image_id", "x", "y"])


_RANGE = """with e as (select image_id, min(val) lo, max(val) hi
from px
group by 1) select px.image_id, x, y, cast(case when hi = lo then 0 else round({hi}::double * (val - lo) / (hi - lo)) end as int) as val
from px
join e on px.image_id = e.image_id"""


@query(duck(_RANGE.format(hi=200), "px"))
def normalize_range(spark, d):
    return P.normalize_range(view(spark, d, "px").select("image_id", "x", "y", "val"), 200, ["image_id"])


@query(duck(_RANGE.format(hi=255), "px"))
def to_8bit(spark, d):
    return P.to_8bit(view(spark, d, "px").select("image_id", "x", "y", "val"), ["image_id"])


@query("select vec_id, generate_subscripts(embedding, 1) - 1 as p, cast(least(255, greatest(0, round((unnest(embedding)::double + 0.5) * 255))) as int) as v from embeddings")
def scale_unit_to_u8(spark, d):
    df = view(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("p", "e"))
    return df.select("vec_id", F.col("p").cast("long").alias("p"), P.scale_unit_to_u8(F.col("e").cast("double") + 0.5).alias("v"))


@query(duck("select image_id, x, y, cast(least(255, greatest(0, round((val - 60.0::double) / 120.0::double * 255))) as int) as val from px", "px"))
def display_range(spark, d):
    return P.display_range(view(spark, d, "px").select("image_id", "x", "y", "val"), 60, 180)


@query(duck("select image_id, x, y, val, val between 125 and 248 as mask from px", "px"))
def threshold(spark, d):
    return P.threshold(view(spark, d, "px").select("image_id", "x", "y", "val"), 125, 248)


@query(duck("select image_id, x, y, 255 - val as val from px", "px"))
def invert(spark, d):
    return P.invert(view(spark, d, "px").select("image_id", "x", "y", "val"))


@query(duck("""select image_id, x, y, printf('%x', cast(least(15, greatest(0, round(r/16.0::double))) as int)) as r, printf('%x', cast(least(15, greatest(0,
round(g/16.0::double))) as int)) as g, printf('%x', cast(least(15, greatest(0, round(b/16.0::double))) as int)) as b
from rgb""", "rgb"))
def quantize_hex4(spark, d):
    return view(spark, d, "rgb").select("image_id", "x", "y", *(S.quantize_hex4(F.col(c)).alias(c) for c in "rgb"))


@query(duck("select image_id, x, 7 - y as y, val from px", "px"))
def flip(spark, d):
    return P.flip(view(spark, d, "px").select("image_id", "x", "y", "val"), "y", 8)


@query(duck("select stack_id, x, t as y, y as z, val from stack", "stack"))
def reslice(spark, d):
    return P.reslice(view(spark, d, "stack").withColumnRenamed("t", "z"), "Top", 8).select("stack_id", "x", "y", "z", "val")


@query(duck("select stack_id, x, y, t, 1 as c, 1 as z, val from stack", "stack"))
def permute_dims(spark, d):
    df = view(spark, d, "stack").withColumnsRenamed({"y": "d1", "x": "d2", "t": "d3"})
    return P.permute_dims(df, "YXT").select("stack_id", "x", "y", "t", "c", "z", "val")


@query(duck("select stack_id, x, y, t, 1 as z, val from stack", "stack"))
def swap_slices_frames(spark, d):
    df = view(spark, d, "stack").withColumnRenamed("t", "z").withColumn("t", F.lit(1))
    return P.swap_slices_frames(df, 1, 10, 1).select("stack_id", "x", "y", "t", "z", "val")


@query(duck("select * from stack where t between 1 and 6", "stack"))
def select_frames(spark, d):
    return P.select_frames(view(spark, d, "stack"), -3, 6, 10)


@query(duck("""select s.stack_id, s.x, s.y, s.t, case when s.t between 3 and 7 then coalesce(p.val, s.val) else s.val end as val
from stack s
left
join (select x, y, val
from px
where image_id = 0) p on s.x = p.x and s.y = p.y""", "px", "stack"))
def paste_slices(spark, d):
    plane = view(spark, d, "px").filter("image_id = 0")
    return P.paste_slices(view(spark, d, "stack"), plane, 3, 7).select("stack_id", "x", "y", "t", "val")


@query(duck("select stack_id, x, y, t, val from stack where t = 4", "stack"))
def same_slice(spark, d):
    return P.same_slice(view(spark, d, "stack"), 4, "stack_id", "t").select("stack_id", "x", "y", "t", "val")


@query(duck("select image_id, x, y, val from px where x < 6 and y < 6", "px"))
def crop_to_multiple(spark, d):
    return P.crop_to_multiple(view(spark, d, "px").select("image_id", "x", "y", "val"), 3, 3, 8, 8)


@query("""select image_id, width, height, cast(round(6.5 * 300) as int) as width_px, cast(round(9.0 * 300) as int) as height_px, 'inch' as unit, round(1.0::double / 300,
6) as pixel_width, round(1.0::double / 300, 6) as pixel_height, 1.0::double as pixel_depth
from (select p_partkey image_id, cast(p_size * 10 as int) width, cast(p_partkey % 50 + 1 as int) height
from part
where p_size > 0)""")
def scale_to_dpi(spark, d):
    return P.scale_to_dpi(view(spark, d, "images").drop("title"), 300, 6.5, 9.0)


@query(duck("select image_id, width, cast(round(width / 1.5::double) as int) as height from images", "images"))
def aspect_size(spark, d):
    return view(spark, d, "images").select("image_id", "width", S.aspect_height(F.col("width"), F.lit(1.5)).alias("height"))


@query(duck("""with m as (select object_id, 0.25::double * (1 + min(seq) % 4) pixel_width
from balls
group by 1) select object_id, seq, x, y, z, 12.5::double / pixel_width as r
from balls
join m using (object_id)""", "balls"))
def homogenize_radius(spark, d):
    balls = view(spark, d, "balls")
    metadata = balls.groupBy("object_id").agg((F.lit(0.25) * (1 + F.min("seq") % 4)).alias("pixel_width"))
    return P.homogenize_radius(balls, metadata, 12.5, "object_id").select("object_id", "seq", "x", "y", "z", "r")


@query(duck("select roi_id, '1.0,0.0,0.0,1.0,0.0,0.0' as affine from rois", "rois"))
def reset_transforms(spark, d):
    moved = view(spark, d, "rois").withColumn("affine", F.array(*(F.col(c).cast("double") for c in ("x1", "y0", "x0", "y1", "x0", "y0"))))
    return P.reset_transforms(moved).select("roi_id", F.array_join(F.col("affine").cast("array<string>"), ",").alias("affine"))


@query(duck("select roi_id, x0, y0, x1, y1 from rois where roi_id % 5 = 2", "rois"))
def select_layer(spark, d):
    return view(spark, d, "rois").transform(lambda rois: P.select_layer(rois.withColumn("layer", F.col("roi_id") % 5), 2)).drop("layer", "image_id")


@query("""select p_partkey, p_name as old, regexp_replace(p_name, '[\\]\\[\\\\ \\t"'']', '_', 'g') as new from part where regexp_replace(p_name, '[\\]\\[\\\\ \\t"'']', '_', 'g') <> p_name""")
def sanitize_names(spark, d):
    return view(spark, d, "part").select("p_partkey", F.col("p_name").alias("old"), S.sanitized(F.col("p_name")).alias("new")).filter("old <> new")


@query("select c_custkey, concat('Cust ', c_name) as person from customer")
def clean_person(spark, d):
    raw = F.concat(F.lit("  "), (F.col("c_custkey") % 90).cast("string"), F.lit("\tCust "), F.col("c_name"), F.lit(" (the owner) <a@b.org>)"))
    return view(spark, d, "customer").select("c_custkey", S.clean_person(raw).alias("person"))


@query(duck("select entry_id, case when name like '%$%' then null when ext = '.jar' then 'archive' when name like '%\\_%' escape '\\' then case ext when '.py' then 'Jython script' when '.txt' then 'macro' end end as kind from catalog", "catalog"))
def file_kind(spark, d):
    return view(spark, d, "catalog").select("entry_id", S.file_kind(F.col("name"), F.col("ext")).alias("kind"))


@query(duck("""select entry_id, case when entry_id % 9 = 0 then 'Plugins' when entry_id % 4 = 0 then menu_path else concat('Plugins>', menu_path) end as menu, replace(name,
'_', ' ') as label
from catalog""", "catalog"))
def menu_path(spark, d):
    folder = F.when(F.col("entry_id") % 9 == 0, "").when(F.col("entry_id") % 4 == 0, F.concat(F.lit("Scripts/"), F.replace("menu_path", F.lit(">"), F.lit("/")))).otherwise(F.replace("menu_path", F.lit(">"), F.lit("/")))
    return view(spark, d, "catalog").select("entry_id", S.menu_path(folder).alias("menu"), S.menu_label(F.concat("name", "ext")).alias("label"))


@query(duck("""select doc_id, regexp_extract(path, '^(.*)-[0-9]{14}$', 1) as name, strftime(strptime(regexp_extract(path, '([0-9]{14})$', 1), '%Y%m%d%H%M%S'),
'%Y-%m-%d %H:%M:%S') as stamped
from files""", "files"))
def version_stamp(spark, d):
    name, at = S.version_stamp(F.col("path"))
    return view(spark, d, "files").select("doc_id", name.alias("name"), F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("stamped"))


@query(duck("""with q as (select image_id, x, y, printf('%x', cast(least(15, greatest(0, round(r/16.0::double))) as int)) c from rgb),
s as (select *, case when lag(c) over w is null or lag(c) over w <> c then 1 else 0 end s from q window w as (partition by image_id, y order by x)),
n as (select *, sum(s) over (partition by image_id, y order by x) run from s),
u as (select image_id, y, min(x) as x0, max(x) as x1, min(c) as c, case when min(x) = max(x) then 'D' else 'L' end as token from n group by image_id, y, run)
select *, case when lag(c) over (partition by image_id order by y, x0) is not distinct from c then '' else 'C' || c end as colour_token from u where c <> '8'""", "rgb"))
def run_length_encode(spark, d):
    df = view(spark, d, "rgb").select("image_id", "x", "y", S.quantize_hex4(F.col("r")).alias("c"))
    return P.run_length_encode(df, ["image_id"], "c", background="8").select("image_id", "y", "x0", "x1", "c", "token", "colour_token")


@query(duck("select image_id, x, y, cast(val - sum(val) over (partition by image_id, y // 3) // count(*) over (partition by image_id, y // 3) as int) as val from px", "px"))
def map_blocks(spark, d):
    def less_mean(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.assign(val=(pdf["val"] - pdf["val"].sum() // len(pdf)).astype("int32"))[["image_id", "x", "y", "val"]]

    return P.map_blocks(view(spark, d, "px").select("image_id", "x", "y", "val"), less_mean, "image_id long, x int, y int, val int", 3)
