"""Neighbourhood, geometry, joins and measures on long pixel tables.

Colour maps, kernels and weights are small by definition (at most a few hundred rows) and are
broadcast; images are never on the broadcast side unless the optimizer finds them small.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..workspace import Workspace
from .components import label_components

# --- stacks and colour maps


def apply_lut(df: DataFrame, luts: DataFrame, lut: str, value: str = "val") -> DataFrame:
    table = luts.filter(F.col("lut") == lut).select(F.col("idx").alias(value), "r", "g", "b")
    return df.join(F.broadcast(table), value)


def invert_lut(luts: DataFrame) -> DataFrame:
    return luts.withColumn("idx", F.lit(255) - F.col("idx"))


_METHODS = {
    "Average": lambda v: F.round(F.avg(v), 6),
    "Max": F.max,
    "Min": F.min,
    "Sum": lambda v: F.sum(v).cast("long"),
    "Standard Deviation": lambda v: F.round(F.stddev_samp(v), 6),
    "Median": lambda v: F.percentile(v, F.lit(0.5)),
}


def z_project(df: DataFrame, keys: list[str], methods: list[str], value: str = "val") -> DataFrame:
    """One row per pixel with a column for each method, over all frames or slices."""
    return df.groupBy(*keys, "x", "y").agg(*(_METHODS[m](F.col(value)).alias(m.lower().replace(" ", "_")) for m in methods))


def temporal_color_code(stack: DataFrame, luts: DataFrame, lut: str, first: int, last: int, keys: list[str], value: str = "val") -> DataFrame:
    """Frame i of n takes row floor(256 / n * i) of the map, scales it by its pixel, and the frames are projected by maximum."""
    n = last - first + 1
    table = luts.filter(F.col("lut") == lut).select("idx", F.col("r").alias("_r"), F.col("g").alias("_g"), F.col("b").alias("_b"))
    frames = stack.filter(F.col("t").between(first, last)).withColumn("idx", F.floor(F.lit(256.0) / n * (F.col("t") - first)).cast("int"))
    coded = frames.join(F.broadcast(table), "idx")
    return coded.groupBy(*keys, "x", "y").agg(*(F.max(S.half_up(F.col(f"_{c}") * F.col(value) / 255)).alias(c) for c in "rgb"))


def blend_average(a: DataFrame, b: DataFrame, keys: list[str], cap: int = 127) -> DataFrame:
    """min(cap, trunc((a + b) / 2)) for each channel."""
    right = b.select(*keys, *(F.col(c).alias(f"_{c}") for c in "rgb"))
    return a.join(right, keys).select(*keys, *(F.least(F.lit(cap), F.floor((F.col(c) + F.col(f"_{c}")) / 2).cast("int")).alias(c) for c in "rgb"))


def compose(source: DataFrame, target: DataFrame, keys: list[str], mode: str, alpha: float = 1.0) -> DataFrame:
    """out = alpha * f(source, target) + (1 - alpha) * target, clamped and rounded; f by mode.

    Color-YCbCr keeps the target's Y = .299 R + .587 G + .114 B and takes the source's Cb and Cr.
    """
    alpha = min(1.0, max(0.0, alpha))
    both = target.join(source.select(*keys, *(F.col(c).alias(f"_{c}") for c in "rgb")), keys)
    t, s = {c: F.col(c).cast("double") for c in "rgb"}, {c: F.col(f"_{c}").cast("double") for c in "rgb"}
    if mode == "Color-YCbCr":
        luma = lambda p: 0.299 * p["r"] + 0.587 * p["g"] + 0.114 * p["b"]
        f = {c: luma(t) + s[c] - luma(s) for c in "rgb"}
    else:
        rule = {"Normal": lambda a, b: a, "Add": lambda a, b: a + b, "Subtract": lambda a, b: b - a, "Multiply": lambda a, b: a * b / 255, "Difference": lambda a, b: F.abs(a - b)}[mode]
        f = {c: rule(s[c], t[c]) for c in "rgb"}
    clamp = lambda v: F.least(F.lit(255.0), F.greatest(F.lit(0.0), v))
    return both.select(*keys, *(S.half_up(F.round(alpha * clamp(f[c]) + (1 - alpha) * t[c], 6)).alias(c) for c in "rgb"))


# --- neighbourhood


def kernel(sigma: float) -> list[float]:
    """Normalised Gaussian weights for -r..r, r = ceil(3 sigma)."""
    r = math.ceil(3 * sigma)
    w = [math.exp(-i * i / (2 * sigma * sigma)) for i in range(-r, r + 1)]
    return [x / sum(w) for x in w]


def gaussian_blur(df: DataFrame, sigma: float, keys: list[str], width: int, height: int, value: str = "val") -> DataFrame:
    """Separable blur, edges repeated: a weighted sum by column, then by row."""
    w = kernel(sigma)
    r = len(w) // 2
    for axis, size in (("x", width), ("y", height)):
        # pixel p adds to q with all weights whose clamped source is p
        place = F.explode(F.sequence(F.greatest(F.lit(0), F.when(F.col(axis) == 0, 0).otherwise(F.col(axis) - r)), F.least(F.lit(size - 1), F.when(F.col(axis) == size - 1, size - 1).otherwise(F.col(axis) + r))))
        inner = F.array(*map(F.lit, w))
        total = [sum(w[:i]) for i in range(len(w) + 1)]
        upto = F.array(*map(F.lit, total))
        off = F.col(axis) - F.col("_q")  # source minus place
        clip = lambda i: F.least(F.lit(len(w)), F.greatest(F.lit(0), i))
        first = upto[clip(off + r + 1)]
        last = F.lit(1.0) - upto[clip(off + r)]
        one = F.when(F.abs(off) <= r, inner[clip(off + r)]).otherwise(0.0)
        weight = F.when(F.lit(size == 1), 1.0).when(F.col(axis) == 0, first).when(F.col(axis) == size - 1, last).otherwise(one)
        other = "y" if axis == "x" else "x"
        df = df.withColumn("_q", place).groupBy(*keys, F.col("_q").alias("_new"), other).agg(F.sum(F.col(value) * weight).alias(value)).withColumnRenamed("_new", axis)
    return df.select(*keys, "x", "y", value)


def resize(df: DataFrame, w: int, h: int, new_w: int, new_h: int, keys: list[str], mode: str = "average", value: str = "val") -> DataFrame:
    """``average``: the mean of the pixels that fall in each new one.  ``nearest``: floor((x + 0.5) * w / new_w)."""
    if mode == "average":
        x, y = F.floor(F.col("x") * new_w / w).cast("int"), F.floor(F.col("y") * new_h / h).cast("int")
        return df.groupBy(*keys, x.alias("x"), y.alias("y")).agg(F.round(F.avg(value), 6).alias(value))
    near = lambda axis, n, new: F.filter(F.array(*map(F.lit, range(new))), lambda i: F.floor((i + 0.5) * n / new) == F.col(axis))
    return df.withColumn("_x", F.explode(near("x", w, new_w))).withColumn("_y", F.explode(near("y", h, new_h))).select(*keys, F.col("_x").alias("x"), F.col("_y").alias("y"), value)


def resample(df: DataFrame, sizes: DataFrame, keys: list[str], mode: str = "nearest", value: str = "val") -> DataFrame:
    """Pixels of images of many sizes, each to its own new size (keys, width, height, width_px, height_px).

    ``nearest`` takes pixel floor((x + 0.5) * w / new_w); ``average`` does so where an axis grows, and
    takes the mean of the pixels that fall in a new one where it shrinks.
    """
    both = df.join(sizes.select(*keys, "width", "height", "width_px", "height_px"), keys)
    for axis, old, new in (("x", "width", "width_px"), ("y", "height", "height_px")):
        a, w, n = F.col(axis), F.col(old), F.col(new)
        # the new places X with floor((X + 0.5) * w / n) = a, which is a * n <= (X + 0.5) * w < (a + 1) * n
        least, beyond = (F.ceil(k * n / w - 0.5) for k in (a, a + 1))
        taken = F.filter(F.sequence(least - 1, beyond + 1), lambda k: (k >= 0) & (k < n) & (F.floor((k + 0.5) * w / n) == a))  # noqa: B023
        if mode == "average":
            taken = F.when(n < w, F.array(F.floor(a * n / w))).otherwise(taken)
        both = both.withColumn(axis, F.explode(taken)).withColumn(axis, F.col(axis).cast("int"))
    if mode == "average":
        return both.groupBy(*keys, "x", "y").agg(F.round(F.avg(value), 6).alias(value))
    return both.select(*keys, "x", "y", value)


def downsample(df: DataFrame, w: int, h: int, new_w: int, new_h: int, keys: list[str], s0: float = 0.5, s1: float = 0.5, value: str = "val") -> DataFrame:
    """Blur by sqrt((s1 W / w)^2 - s0^2), then the nearest pixels; larger sizes are refused."""
    if new_w > w or new_h > h:
        raise ValueError("the new size must not be larger")
    sigma = math.sqrt(max(0.0, (s1 * w / new_w) ** 2 - s0 * s0))
    blurred = gaussian_blur(df, sigma, keys, w, h, value) if sigma > 0 else df
    return resize(blurred, w, h, new_w, new_h, keys, "nearest", value)


def split_tiles(df: DataFrame, tw: int, th: int, h: int) -> DataFrame:
    """Tiles numbered from 1, down the columns first; x and y become those in the tile."""
    rows = h // th
    tile = F.floor(F.col("x") / tw) * rows + F.floor(F.col("y") / th) + 1
    return df.withColumn("tile", tile.cast("int")).withColumns({"x": F.col("x") % tw, "y": F.col("y") % th})


def assemble_tiles(tiles: DataFrame, tw: int, th: int, rows: int) -> DataFrame:
    k = F.col("tile") - 1
    return tiles.withColumns({"x": (F.floor(k / rows) * tw + F.col("x")).cast("int"), "y": (k % rows * th + F.col("y")).cast("int")}).drop("tile")


# --- regions

CELL = 64


def mask_polygon(df: DataFrame, rois: DataFrame, on: tuple[str, ...] = ()) -> DataFrame:
    """Pixels (x, y) inside each polygon (roi_id, verts): a join on grid cells of the bounding box, then the even-odd rule on pixel centres.

    ``on`` names columns of both sides that must agree, such as the image that a region belongs to; without them each region is applied to all images.
    """
    box = rois.select("roi_id", "verts", *on, *(F.expr(f"array_{f}(transform(verts, v -> v.{n}))").alias(f"_{k}{n}") for n in "xy" for k, f in (("lo", "min"), ("hi", "max"))))
    cells = lambda n: F.explode(F.sequence(F.floor(F.col(f"_lo{n}") / CELL), F.floor(F.col(f"_hi{n}") / CELL)))
    box = box.withColumn("_cx", cells("x")).withColumn("_cy", cells("y"))
    dealt = df.withColumns({"_cx": F.floor(F.col("x") / CELL), "_cy": F.floor(F.col("y") / CELL)})
    near = dealt.join(box, [*on, "_cx", "_cy"]).filter("x >= _lox and x < _hix and y >= _loy and y < _hiy")
    px, py = "(x + 0.5)", "(y + 0.5)"
    crossing = f"((a.y > {py}) != (b.y > {py}) and {px} < (b.x - a.x) * ({py} - a.y) / (b.y - a.y) + a.x)"
    inside = f"aggregate(zip_with(verts, concat(slice(verts, 2, size(verts) - 1), slice(verts, 1, 1)), (a, b) -> {crossing}), false, (s, c) -> s != c)"
    return near.filter(F.expr(inside)).drop("_cx", "_cy", "_lox", "_hix", "_loy", "_hiy", "verts")


def rectangle(x0: str, y0: str, x1: str, y1: str):
    """Vertices of a rectangle as an array of (x, y)."""
    v = lambda x, y: F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    return F.array(v(x0, y0), v(x1, y0), v(x1, y1), v(x0, y1))


def affine_transform(verts, m: tuple[float, float, float, float, float, float]):
    """x' = m00 x + m01 y + m02, y' = m10 x + m11 y + m12, with m = (m00, m10, m01, m11, m02, m12)."""
    a, b, c, d, e, f = (F.lit(float(v)) for v in m)
    return F.transform(verts, lambda v: F.struct((a * v["x"] + c * v["y"] + e).alias("x"), (b * v["x"] + d * v["y"] + f).alias("y")))


def line_points(rois: DataFrame) -> DataFrame:
    """Sample points of (roi_id, ax, ay, bx, by) at unit steps, rounded to pixels; i counts from 0 to n."""
    length = F.sqrt(F.pow(F.col("bx") - F.col("ax"), 2) + F.pow(F.col("by") - F.col("ay"), 2))
    n = F.greatest(F.lit(1), S.half_up(length))
    rest = [c for c in rois.columns if c not in ("roi_id", "ax", "ay", "bx", "by")]
    out = rois.withColumn("n", n).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n"))))
    at = lambda k: S.half_up(F.round(F.col(f"a{k}") + (F.col(f"b{k}") - F.col(f"a{k}")) * F.col("i") / F.col("n"), 6)).alias(k)
    return out.select("roi_id", *rest, "i", "n", at("x"), at("y"))


def line_profile(df: DataFrame, rois: DataFrame, keys: list[str], value: str = "val", on: tuple[str, ...] = ()) -> DataFrame:
    """Values along each line (roi_id, ax, ay, bx, by) at unit steps; ``on`` as in mask_polygon."""
    return line_points(rois).join(df, [*on, "x", "y"]).select(*keys, "roi_id", "i", value)


def column_profile(df: DataFrame, rois: DataFrame, keys: list[str], value: str = "val", on: tuple[str, ...] = ()) -> DataFrame:
    """Column means of rectangles (roi_id, x0, y0, x1, y1)."""
    masked = mask_polygon(df, rois.select("roi_id", *on, rectangle("x0", "y0", "x1", "y1").alias("verts")), on)
    return masked.groupBy(*keys, "roi_id", "x").agg(F.round(F.avg(value), 6).alias("mean"))


def at_points(points: DataFrame, df: DataFrame, on: tuple[str, ...]) -> DataFrame:
    """The pixels at points (on, x, y).

    The points are shuffled: by the optimizer's estimate, which does not count what is laid out, all
    of them would go through the driver.  An image that the caller broadcasts stays so.
    """
    return points.hint("merge").join(df, [*on, "x", "y"])


def outline_profile(df: DataFrame, rois: DataFrame, keys: list[str], value: str = "val", on: tuple[str, ...] = (), closed: bool = True) -> DataFrame:
    """The profile along the polygon (roi_id, verts), or along the open line through its vertices, edge after edge; a vertex is sampled once."""
    if closed:
        heads, tails = F.col("verts"), F.concat(F.expr("slice(verts, 2, size(verts))"), F.slice("verts", 1, 1))
    else:
        heads, tails = (F.expr(f"slice(verts, {k}, greatest(size(verts) - 1, 0))") for k in (1, 2))
    final = F.lit(False) if closed else F.col("edge") == F.col("_size") - 2
    edges = rois.select("roi_id", *on, F.size("verts").alias("_size"), F.posexplode(F.arrays_zip(heads.alias("a"), tails.alias("b"))).alias("edge", "e"))
    edges = edges.select("roi_id", "edge", final.alias("final"), *on, *(F.col(f"e.{p}.{k}").alias(f"{p}{k}") for p in "ab" for k in "xy"))
    points = line_points(edges).filter("i < n or final").drop("n", "final")
    return at_points(points, df, on).select(*keys, "roi_id", "edge", "i", value)


def spline(x: np.ndarray, y: np.ndarray, step: float = 1.0, fine: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """Points at steps of equal arc length, ``step`` or a little less, on the closed interpolating cubic spline through the vertices.

    The spline is periodic in the number of the vertex, with continuous second derivatives; its
    length is measured on ``fine`` chords a vertex and pixel of its edge.
    """
    n = len(x)
    if n < 3:
        return x.astype(float), y.astype(float)
    # second derivatives m: m[i-1] + 4 m[i] + m[i+1] = 6 (v[i-1] - 2 v[i] + v[i+1]), cyclic, solved by its Fourier series
    weight = 4 + 2 * np.cos(2 * np.pi * np.arange(n) / n)
    edges = np.hypot(np.roll(x, -1) - x, np.roll(y, -1) - y)
    parts = np.maximum(1, np.ceil(edges)).astype(int) * fine
    at = np.repeat(np.arange(n), parts)
    t = (np.arange(len(at)) - np.repeat(np.cumsum(parts) - parts, parts)) / np.repeat(parts, parts)

    def curve(v: np.ndarray) -> np.ndarray:
        m = np.fft.ifft(np.fft.fft(6 * (np.roll(v, 1) - 2 * v + np.roll(v, -1))) / weight).real
        a, b, c, d = v[at], np.roll(v, -1)[at], m[at], np.roll(m, -1)[at]
        return a * (1 - t) + b * t + ((1 - t) ** 3 - (1 - t)) * c / 6 + (t**3 - t) * d / 6

    cx, cy = (np.append(c, c[0]) for c in (curve(x.astype(float)), curve(y.astype(float))))
    length = np.concatenate([[0.0], np.cumsum(np.hypot(np.diff(cx), np.diff(cy)))])
    n_steps = max(1, math.ceil(length[-1] / step - 1e-9))
    places = length[-1] * np.arange(n_steps) / n_steps
    return np.interp(places, length, cx), np.interp(places, length, cy)


def spline_points(rois: DataFrame, on: tuple[str, ...] = (), step: float = 1.0) -> DataFrame:
    """(roi_id, on, i, px, py): points along the closed spline through each polygon (roi_id, verts, on)."""
    kinds = dict(rois.dtypes)
    names = ["roi_id", *on]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            verts = batch.column("verts")
            flat, sizes = verts.flatten(), pc.fill_null(verts.value_lengths(), 0).to_numpy(zero_copy_only=False)
            x, y = (flat.field(n).to_numpy(zero_copy_only=False) for n in "xy")
            ends = np.cumsum(sizes)
            found = [spline(x[e - n : e], y[e - n : e], step) for e, n in zip(ends, sizes, strict=True)]
            counts = [len(p[0]) for p in found]
            at = pa.array(np.repeat(np.arange(len(found)), counts))
            i = np.concatenate([np.arange(c) for c in counts] or [np.zeros(0, int)]).astype(np.int32)
            px, py = (np.concatenate([p[k] for p in found] or [np.zeros(0)]) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in names), pa.array(i), pa.array(px, pa.float64()), pa.array(py, pa.float64())], [*names, "i", "px", "py"])

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in names), "i int, px double, py double"])
    return rois.select(*names, "verts").mapInArrow(run, schema)


def spline_profile(df: DataFrame, rois: DataFrame, keys: list[str], value: str = "val", on: tuple[str, ...] = (), step: float = 1.0) -> DataFrame:
    """The profile along the closed spline through each polygon (roi_id, verts); ``on`` as in mask_polygon.

    A point takes the pixel nearest to it; a polygon of less than three vertices gives those, one without any gives nothing.
    """
    near = lambda c: S.half_up(F.round(F.col(c), 6)).alias(c[1])
    points = spline_points(rois, on, step).select("roi_id", *on, "i", near("px"), near("py"))
    return at_points(points, df, on).select(*keys, "roi_id", "i", value)


def profile_limits(profiles: DataFrame, keys: list[str], value: str = "val") -> DataFrame:
    """(keys, x_min, x_max, y_min, y_max) to display each profile (keys, i, value) in: 0 to its number of values, least to greatest; 0 to 1 for an empty one."""
    empty = F.count("i") == 0
    one = lambda v, other: F.when(empty, F.lit(other)).otherwise(v)
    return profiles.groupBy(*keys).agg(F.lit(0).alias("x_min"), one(F.count("i"), 1).alias("x_max"), one(F.min(value), 0.0).alias("y_min"), one(F.max(value), 1.0).alias("y_max"))


#: Kinds of regions that are profiled along their vertices.
LINE_KINDS = ("line", "polyline", "freeline")


def profile(df: DataFrame, rois: DataFrame, keys: list[str], value: str = "val", on: tuple[str, ...] = ()) -> DataFrame:
    """(keys, roi_id, edge, i, value) of each region (roi_id, kind, verts).

    Lines of all kinds give the values along them at unit steps, rectangles the mean of each
    column i (edge 0); any other kind, or null, gives one row with nulls.
    """
    along = outline_profile(df, rois.filter(F.col("kind").isin(*LINE_KINDS)), keys, value, on, closed=False)
    along = along.withColumn(value, F.col(value).cast("double"))
    under = mask_polygon(df, rois.filter("kind = 'rectangle'").select("roi_id", "verts", *on), on)
    means = under.groupBy(*keys, "roi_id", F.lit(0).alias("edge"), F.col("x").alias("i")).agg(F.round(F.avg(value), 6).alias(value))
    refused = rois.filter(~F.coalesce(F.col("kind").isin(*LINE_KINDS, "rectangle"), F.lit(False)))
    kinds = dict(df.dtypes)
    refused = refused.select(*(F.col(k) if k in on else F.lit(None).cast(kinds[k]).alias(k) for k in keys), "roi_id", *(F.lit(None).cast(t).alias(n) for n, t in (("edge", "int"), ("i", "int"), (value, "double"))))
    return along.unionByName(means).unionByName(refused)


# --- components


def wand(labelled: DataFrame, keys: list[str], x: int, y: int) -> DataFrame:
    """The region of the start pixel in each image."""
    seed = labelled.filter((F.col("x") == x) & (F.col("y") == y)).select(*keys, "label")
    return labelled.join(seed, [*keys, "label"], "left_semi")


def flood_fill(df: DataFrame, keys: list[str], x: int, y: int, colour: int, work: Workspace, width: int, eight: bool = False, value: str = "val") -> DataFrame:
    """Recolours the equal-valued region of the seed pixel."""
    seed = df.filter((F.col("x") == x) & (F.col("y") == y)).select(*keys, F.col(value).alias("_seed"))
    same = df.join(seed, keys).filter(F.col(value) == F.col("_seed")).select(*keys, "x", "y")
    region = wand(label_components(same, keys, work, width, eight), keys, x, y).select(*keys, "x", "y", F.lit(True).alias("_in"))
    return df.join(region, [*keys, "x", "y"], "left").withColumn(value, F.when(F.col("_in"), colour).otherwise(F.col(value))).drop("_in")


def measure_particles(labelled: DataFrame, keys: list[str], w: int, h: int, exclude_edges: bool = True) -> DataFrame:
    """Start point, area and bounds of each region; those at the edge are left out."""
    out = labelled.groupBy(*keys, "label").agg(F.min(F.struct("y", "x")).alias("_s"), F.count("*").alias("area"), *(f(a).alias(f"{n}_{a}") for a in "xy" for n, f in (("min", F.min), ("max", F.max))))
    if exclude_edges:
        out = out.filter((F.col("min_x") > 0) & (F.col("min_y") > 0) & (F.col("max_x") < w - 1) & (F.col("max_y") < h - 1))
    return out.select(*keys, "label", F.col("_s.x").alias("x_start"), F.col("_s.y").alias("y_start"), "area", "min_x", "min_y", "max_x", "max_y")


#: Rows of points that one task turns to a partial hull.
HULL_ROWS = 4096


def _hull(x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
    """The hull from the lowest y (then x) on, anticlockwise, without collinear points."""
    pts = sorted(set(zip(x.tolist(), y.tolist(), strict=True)), key=lambda p: (p[1], p[0]))

    def half(seq: list) -> list:
        out: list = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out

    return half(pts)[:-1] + half(pts[::-1])[:-1] if len(pts) > 1 else pts


def convex_hull(points: DataFrame, key: str, rows: int = HULL_ROWS) -> DataFrame:
    """(key, seq, x, y) of the hull, from the lowest y (then x) on, anticlockwise in x-y; collinear points are left out.

    Only the ends of each row of points can be on the hull, so rows are cut to those; bands of
    ``rows`` rows give partial hulls, and the hull of an object is that of its bands' hulls, so a
    large object is many tasks.
    """
    ends = points.groupBy(key, "y").agg(F.min("x").alias("a"), F.max("x").alias("b"))
    ends = ends.select(key, F.floor(F.col("y") / rows).alias("_band"), "y", F.explode(F.array_distinct(F.array("a", "b"))).alias("x"))

    def hull(group: tuple[pa.Scalar, ...], got: pa.Table) -> pa.Table:
        ring = _hull(got["x"].to_numpy(), got["y"].to_numpy())
        n = len(ring)
        return pa.table({key: got[key].take(pa.array([0] * n, pa.int64())), "seq": pa.array(range(n), pa.int32()), "x": pa.array([p[0] for p in ring], pa.int32()), "y": pa.array([p[1] for p in ring], pa.int32())})

    schema = f"`{key}` {dict(points.dtypes)[key]}, seq int, x int, y int"
    return ends.groupBy(key, "_band").applyInArrow(hull, schema).groupBy(key).applyInArrow(hull, schema)


# --- projections


def rotated_projection(df: DataFrame, degrees: float, keys: list[str], cx: float, cz: float, z: str = "t", value: str = "val") -> DataFrame:
    """Brightest point along the view rotated about the y axis."""
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    x = S.half_up(F.round(F.lit(cx) + (F.col("x") - cx) * c + (F.col(z) - cz) * s, 6))
    return df.groupBy(*keys, x.alias("x"), "y").agg(F.max(value).alias(value))


def anaglyph(df: DataFrame, keys: list[str], cx: float, cz: float, degrees: float = 4.0, z: str = "t", value: str = "val") -> DataFrame:
    """Left view as red, right view as green and blue."""
    views = [rotated_projection(df, a, keys, cx, cz, z, value) for a in (-degrees / 2, degrees / 2)]
    left, right = views[0].withColumnRenamed(value, "r"), views[1].withColumnRenamed(value, "g")
    return left.join(right, [*keys, "x", "y"]).withColumn("b", F.col("g"))


# --- measures


def histogram(df: DataFrame, keys: list[str], value: str = "val") -> DataFrame:
    """256 bins for each key, empty ones too."""
    bins = df.select(*keys).distinct().withColumn(value, F.explode(F.sequence(F.lit(0), F.lit(255))))
    return bins.join(df.groupBy(*keys, value).count(), [*keys, value], "left").select(*keys, value, F.coalesce("count", F.lit(0)).cast("long").alias("n"))


def measures(value: str) -> list:
    v = F.col(value)
    return [F.count(v).alias("area"), F.round(F.avg(v) + 1e-9, 4).alias("mean"), F.round(F.min(v), 6).alias("min"), F.round(F.max(v), 6).alias("max"), F.round(F.stddev_samp(v) + 1e-9, 4).alias("std")]


def measure_rgb(df: DataFrame, keys: list[str]) -> DataFrame:
    """A row of measures for each gray conversion."""
    rows = F.array(*(F.struct(F.lit(n).alias("label"), S.weighted_gray(F.col("r"), F.col("g"), F.col("b"), *w).cast("double").alias("gray")) for n, *w in S.GRAY_WEIGHTS))
    return df.withColumn("_g", F.explode(rows)).groupBy(*keys, F.col("_g.label").alias("label")).agg(*measures("_g.gray"))


def numbered_layers(layers: DataFrame, keys: list[str]) -> DataFrame:
    """Layers (keys, z) with layer_index, from 1 in the order of z."""
    return layers.withColumn("layer_index", F.dense_rank().over(Window.partitionBy(*keys).orderBy("z")))


def measure_regions(df: DataFrame, rois: DataFrame, layers: DataFrame, layer: str, keys: list[str], pixel_area: float = 1.0, value: str = "val") -> DataFrame:
    """Layer index, z, area and mean under each region (roi_id, keys, layer, verts), for each layer of (keys, layer, z) where it exists."""
    masked = mask_polygon(df, rois, (*keys, layer))
    found = masked.groupBy("roi_id", *keys, layer).agg(F.round(F.count("*") * F.lit(pixel_area), 6).alias("area"), F.round(F.avg(value), 6).alias("mean"))
    return found.join(numbered_layers(layers, keys), [*keys, layer]).select("roi_id", *keys, "layer_index", "z", "area", "mean")


def area_spans(areas: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, y, x0, x1): the horizontal spans x0 <= x < x1 of pixels whose centres lie in an area (keys, rings).

    ``rings`` are closed polygons of (x, y), several pieces and holes among them, by the even-odd rule:
    each row of an area crosses its edges at sorted places, which are taken two by two.
    """
    lo, hi = (F.expr(f"array_{f}(transform(flatten(rings), v -> v.y))") for f in ("min", "max"))
    rows = areas.withColumn("_edges", F.expr("flatten(transform(rings, r -> zip_with(r, concat(slice(r, 2, greatest(size(r) - 1, 0)), slice(r, 1, 1)), (a, b) -> struct(a.x as ax, a.y as ay, b.x as bx, b.y as by))))"))
    rows = rows.select(*keys, "_edges", F.explode(F.sequence(F.floor(lo).cast("int"), F.floor(hi).cast("int"))).alias("y"))
    py = "(y + 0.5)"
    crossings = f"array_sort(transform(filter(_edges, e -> (e.ay > {py}) != (e.by > {py})), e -> (e.bx - e.ax) * ({py} - e.ay) / (e.by - e.ay) + e.ax))"
    pairs = rows.select(*keys, "y", F.expr(crossings).alias("_x")).filter(F.size("_x") > 0)
    cut = "transform(sequence(0, size(_x) div 2 - 1), i -> struct(cast(ceil(_x[2 * i] - 0.5) as int) as x0, cast(ceil(_x[2 * i + 1] - 0.5) as int) as x1))"
    spans = pairs.select(*keys, "y", F.explode(F.expr(f"filter({cut}, s -> s.x0 < s.x1)")).alias("s"))
    return spans.select(*keys, "y", "s.x0", "s.x1")


def crop_masked_stack(df: DataFrame, areas: DataFrame, layer: str, value: str = "val", on: tuple[str, ...] = ()) -> DataFrame:
    """(roi_id, layer, x, y, value): the bounds of each region over its first to last layer; 0 outside its area, and on layers where it has none.

    ``areas`` (roi_id, layer, rings, on) has a row for each layer that a region is on; the area is laid
    out as spans, which meet the pixels of their row.  A pixel under the area that the image lacks is 0.
    """
    side = lambda f, n: F.expr(f"array_{f}(transform(flatten(rings), v -> v.{n}))")
    least = {f"_{n}0": F.floor(F.min(side("min", n))).cast("int") for n in "xy"}
    most = {f"_{n}1": F.ceil(F.max(side("max", n))).cast("int") for n in "xy"}
    box = areas.groupBy("roi_id").agg(*(v.alias(c) for c, v in {**least, **most}.items()), F.min(layer).alias("_a"), F.max(layer).alias("_b"))
    grid = box.withColumn(layer, F.explode(F.sequence("_a", "_b")))
    for n in "xy":
        grid = grid.filter(f"_{n}0 < _{n}1").withColumn(n, F.explode(F.sequence(F.col(f"_{n}0"), F.col(f"_{n}1") - 1)))
    keys = list(dict.fromkeys(["roi_id", layer, *on]))
    spans = area_spans(areas.select(*keys, "rings"), keys)
    # spans are shuffled, as points are in at_points
    inside = spans.hint("merge").join(df, list(dict.fromkeys([*on, layer, "y"]))).filter("x >= x0 and x < x1").select("roi_id", layer, "x", "y", value)
    return grid.select("roi_id", layer, "x", "y").join(inside, ["roi_id", layer, "x", "y"], "left").withColumn(value, F.coalesce(value, F.lit(0)))


def dimension_census(images: DataFrame) -> DataFrame:
    return images.groupBy("width", "height").agg(F.count("*").alias("n")).withColumn("ratio", F.round(F.col("width") / F.col("height"), 2))


def aspect_filter(images: DataFrame, ratio: float) -> DataFrame:
    return images.filter(F.round(F.col("width") / F.col("height"), 2) == ratio)


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
