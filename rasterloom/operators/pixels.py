"""Point operators on long pixel tables: one row per pixel, x and y 0-based, c, z and t 1-based."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S


def _range(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``df`` with _lo and _hi of each image; the aggregate is pre-summed before the shuffle, unlike a window."""
    ends = df.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    return df.join(ends, keys)


def normalize_range(df: DataFrame, hi: float, keys: list[str], value: str = "val") -> DataFrame:
    """uint8(hi * (v - min) / (max - min)) for each image; a constant image becomes 0."""
    v = F.when(F.col("_hi") == F.col("_lo"), 0.0).otherwise(F.lit(float(hi)) * (F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))
    return _range(df, keys, value).withColumn(value, S.to_byte(v)).drop("_lo", "_hi")


def to_8bit(df: DataFrame, keys: list[str], value: str = "val") -> DataFrame:
    return normalize_range(df, 255, keys, value)


def scale_unit_to_u8(v: Column) -> Column:
    return S.to_byte(v * 255)


def display_range(df: DataFrame, lo: float | None = None, hi: float | None = None, keys: list[str] | None = None, value: str = "val") -> DataFrame:
    """[lo, hi] to [0, 255] with clamping; without limits each image's own."""
    if lo is None or hi is None:
        return to_8bit(df, keys or ["image_id"], value)
    return df.withColumn(value, S.to_byte((F.col(value) - F.lit(float(lo))) / F.lit(float(hi - lo)) * 255))


def threshold(df: DataFrame, lo: float, hi: float, value: str = "val") -> DataFrame:
    return df.withColumn("mask", F.col(value).between(lo, hi))


def invert(df: DataFrame, value: str = "val") -> DataFrame:
    return df.withColumn(value, F.lit(255) - F.col(value))


def flip(df: DataFrame, axis: str, size: int) -> DataFrame:
    return df.withColumn(axis, F.lit(size - 1) - F.col(axis))


def split_channels(df: DataFrame) -> DataFrame:
    """r, g, b columns to a row for each channel c."""
    parts = F.array(*(F.struct(F.lit(i + 1).alias("c"), F.col(n).alias("val")) for i, n in enumerate("rgb")))
    return df.withColumn("_p", F.explode(parts)).select(*[x for x in df.columns if x not in "rgb"], "_p.c", "_p.val")


def merge_channels(r: DataFrame, g: DataFrame, b: DataFrame, keys: list[str], value: str = "val") -> DataFrame:
    """Three planes to r, g, b columns; a plane may be used twice."""
    named = [p.select(*keys, F.col(value).alias(n)) for p, n in zip((r, g, b), "rgb", strict=True)]
    return named[0].join(named[1], keys).join(named[2], keys)


def select_frames(df: DataFrame, first: int, last: int, frames: int, t: str = "t") -> DataFrame:
    return df.filter(F.col(t).between(max(1, first), min(frames, last)))


def swap_slices_frames(df: DataFrame, channels: int, slices: int, frames: int) -> DataFrame:
    """Slices taken as frames where there is one frame only; several channels are refused."""
    if channels > 1:
        raise ValueError("a stack with several channels can't be colour-coded by time")
    if slices > 1 and frames == 1:
        return df.withColumns({"t": F.col("z"), "z": F.col("t")})
    return df


def permute_dims(df: DataFrame, order: str = "YXCZT") -> DataFrame:
    """Columns d1, d2, ... named by ``order`` become x, y, c, z, t; missing axes are 1."""
    order = order.upper()
    if order[:2] not in ("XY", "YX") or set(order[2:]) - set("CZT") or len(set(order)) != len(order):
        raise ValueError(f"no such order of dimensions: {order}")
    named = df.withColumnsRenamed({f"d{i + 1}": a.lower() for i, a in enumerate(order)})
    for a in "czt":
        if a.upper() not in order:
            named = named.withColumn(a, F.lit(1))
    return named


def reslice(df: DataFrame, start: str, width: int) -> DataFrame:
    """Top: (x, y, z) to (x, z, y).  Right: to (y, z, width - 1 - x)."""
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    new = (x, z, y) if start == "Top" else (y, z, F.lit(width - 1) - x)
    return df.withColumns(dict(zip("xyz", new, strict=True)))


def paste_slices(stack: DataFrame, plane: DataFrame, lo: int, hi: int, t: str = "t", value: str = "val") -> DataFrame:
    """Slices lo..hi overwritten with one plane (x, y, value); the plane is one image, broadcast by the optimizer where small."""
    over = plane.select("x", "y", F.col(value).alias("_over"))
    v = F.when(F.col(t).between(lo, hi), F.coalesce("_over", value)).otherwise(F.col(value))
    return stack.join(over, ["x", "y"], "left").withColumn(value, v).drop("_over")


def same_slice(df: DataFrame, z: int, image: str, axis: str) -> DataFrame:
    """Slice z of every image; running it fails where an image's size differs from the first one's."""
    size = df.groupBy(image).agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))
    first = size.agg(F.min_by(F.struct("width", "height"), image).alias("_s"))
    fits = (F.col("width") == F.col("_s.width")) & (F.col("height") == F.col("_s.height"))
    checked = F.when(fits, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("another size: image "), F.col(image).cast("string"))))
    size = size.crossJoin(F.broadcast(first)).select(image, checked.alias("_fits"))  # one row
    return df.filter(F.col(axis) == z).join(size, image).filter("_fits").drop("_fits")


def crop_to_multiple(df: DataFrame, tw: int, th: int, w: int, h: int) -> DataFrame:
    return df.filter((F.col("x") < w // tw * tw) & (F.col("y") < h // th * th))


def scale_to_dpi(images: DataFrame, dpi: float, width_inches: float, height_inches: float) -> DataFrame:
    """The size in pixels at so many dots an inch, and the calibration that goes with it."""
    px = {f"{n}_px": S.half_up(F.lit(float(inches)) * dpi) for n, inches in (("width", width_inches), ("height", height_inches))}
    return images.withColumns({**px, "unit": F.lit("inch"), "pixel_width": F.round(F.lit(1.0) / dpi, 6), "pixel_height": F.round(F.lit(1.0) / dpi, 6), "pixel_depth": F.lit(1.0)})


def homogenize_radius(balls: DataFrame, metadata: DataFrame, radius: float, key: str) -> DataFrame:
    """One calibrated radius for all balls, in pixels of the object that they belong to (key, pixel_width)."""
    return balls.join(metadata.select(key, "pixel_width"), key).withColumn("r", F.lit(float(radius)) / F.col("pixel_width")).drop("pixel_width")


def reset_transforms(df: DataFrame) -> DataFrame:
    """Every affine map becomes the identity (m00, m10, m01, m11, m02, m12)."""
    return df.withColumn("affine", F.array(*(F.lit(float(v)) for v in (1, 0, 0, 1, 0, 0))))


def select_layer(df: DataFrame, value: int, layer: str = "layer") -> DataFrame:
    """All objects of one layer."""
    return df.filter(F.col(layer) == value)


def run_length_encode(df: DataFrame, keys: list[str], colour: str, background: str | None = None) -> DataFrame:
    """Maximal runs of one colour in each row: x0, x1, and token D for single pixels, L for runs.

    Runs of the background are not drawn; ``colour_token`` is C and the colour where it differs
    from the run drawn before in the image, and empty where it stays.
    """
    w = Window.partitionBy(*keys, "y").orderBy("x")
    start = (F.lag(colour).over(w).isNull() | (F.lag(colour).over(w) != F.col(colour)) | (F.lag("x").over(w) != F.col("x") - 1)).cast("int")
    runs = df.withColumn("_s", start).withColumn("_run", F.sum("_s").over(w))
    out = runs.groupBy(*keys, "y", "_run").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.first(colour).alias(colour))
    if background is not None:
        out = out.filter(F.col(colour) != background)
    before = F.lag(colour).over(Window.partitionBy(*keys).orderBy("y", "x0"))
    token = F.when(F.col("x0") == F.col("x1"), "D").otherwise("L")
    return out.drop("_run").withColumns({"token": token, "colour_token": F.when(before.eqNullSafe(F.col(colour)), "").otherwise(F.concat(F.lit("C"), F.col(colour)))})


def map_blocks(df: DataFrame, fn, schema: str, rows_per_block: int, image: str = "image_id") -> DataFrame:
    """A pandas function over blocks of image rows, in parallel."""
    blocks = df.withColumn("block", F.floor(F.col("y") / rows_per_block).cast("int"))
    return blocks.groupBy(image, "block").applyInPandas(fn, schema)
