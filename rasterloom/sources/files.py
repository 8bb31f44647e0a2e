"""Readers, generators and writers: delimited tables, colour maps, commit logs, feeds, listings."""

from __future__ import annotations

import codecs
import datetime
import itertools
import math
import os
import re
from collections.abc import Iterator
from functools import reduce
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..workspace import Workspace

# --- readers


def read_results_table(spark: SparkSession, path: str) -> DataFrame:
    """A table separated by commas or tabs; its first data row decides whether it is numeric (bad cells NaN) or text.

    A blank first header drops the first column; a single column is refused.  Only the first two lines go to the driver.
    """
    lines = spark.read.text(path, wholetext=False)
    head = [r.value for r in lines.limit(2).collect()]
    names = head[0].replace("\t", ",").split(",") if head else []
    if len(names) < 2:
        raise ValueError("a results table has at least two columns")
    skip = 1 if names[0].strip() == "" else 0
    first = (head[1].replace("\t", ",").split(",") if len(head) > 1 else [])[skip:]

    def number(s: str) -> bool:
        try:
            float(s)
        except ValueError:
            return False
        return True

    numeric = bool(first) and all(map(number, first))
    cells = F.split("value", "[,\t]", -1)
    cell = lambda i: F.get(cells, F.lit(i))
    cols = [(F.coalesce(cell(i).try_cast("double"), F.lit(float("nan"))) if numeric else cell(i)).alias(n.strip()) for i, n in enumerate(names) if i >= skip]
    # the reader of delimited text leaves out the first line of each file, and no later line that is equal to it
    body = spark.read.options(header=True, sep="\x01", quote="", escape="", enforceSchema=True).schema("value string").csv(path)
    return body.select(*cols)


def read_luts(spark: SparkSession, path: str) -> DataFrame:
    """(lut, path, idx, r, g, b) from colour-map text files: r g b; Index Red Green Blue; or floats in 0..1.  The name is the file's, less 4 characters."""
    text = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_path").alias("path"), F.replace("value", F.lit("\x1a"), F.lit("")).alias("value"))
    rows = text.select("file", "path", F.posexplode(F.filter(F.transform(F.split("value", "\r?\n"), lambda s: F.regexp_extract_all(s, F.lit("([-0-9.]+)"), F.lit(1))), lambda a: F.size(a) >= 3)).alias("idx", "v"))
    rows = rows.withColumn("v", F.slice("v", F.size("v") - 2, F.lit(3)))
    unit = rows.groupBy("path").agg((F.max(F.array_max(F.transform("v", lambda x: x.cast("double")))) <= 1).alias("unit"))
    out = rows.join(unit, "path")
    level = lambda i: F.round(F.col("v")[i].cast("double") * F.when(F.col("unit"), 255).otherwise(1)).cast("int")
    return out.select(F.expr("substring(file, 1, length(file) - 4)").alias("lut"), "path", "idx", level(0).alias("r"), level(1).alias("g"), level(2).alias("b"))


#: Rows of a listing that one Arrow batch holds.
LISTED_ROWS = 8192


def _entries(folder: str) -> Iterator[tuple[str, bool, int, datetime.datetime]]:
    """(path, whether it is a folder, length, modification time) of what is in a folder; names that begin with . or _ are passed over.

    A local folder is read entry by entry; of any other store pyarrow holds one folder's entries at a time.
    """
    folder = folder.rstrip("/")
    if folder.startswith(("file:", "/")):
        root = re.sub("^(file:)?/+", "/", folder)
        with os.scandir(root) as found:
            for e in found:
                if e.name[0] not in "._":
                    known = e.stat()
                    yield f"file:{root}/{e.name}", e.is_dir(), known.st_size, datetime.datetime.fromtimestamp(known.st_mtime, datetime.UTC)
        return
    scheme, rest = folder.split("://", 1)
    store, root = pafs.FileSystem.from_uri(f"{scheme}://{quote(rest)}")  # Spark's paths are not escaped
    head = folder.removesuffix(root)
    for f in store.get_file_info(pafs.FileSelector(root)):
        if f.base_name[0] not in "._":
            yield head + f.path, f.type == pafs.FileType.Directory, f.size or 0, f.mtime or datetime.datetime.fromtimestamp(0, datetime.UTC)


def _list_folders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.string(), pa.bool_(), pa.int64(), pa.timestamp("us", "UTC"))
    for batch in batches:
        for folder in batch.column("path").to_pylist():
            entries = _entries(folder)
            while rows := list(itertools.islice(entries, LISTED_ROWS)):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["path", "folder", "length", "modificationTime"])


def listed(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, modificationTime) of all files below a folder; each folder is listed by a task, and no name goes to the driver."""
    work = Workspace(spark, "listing")
    level, tables = spark.createDataFrame([(path,)], "path string"), []
    while True:
        found = level.mapInArrow(_list_folders, "path string, folder boolean, length long, modificationTime timestamp")
        tables.append(work.table(found, f"level-{len(tables)}"))
        folders = tables[-1].filter("folder").select("path")
        if folders.isEmpty():
            return reduce(DataFrame.unionByName, tables).filter("not folder").drop("folder")
        level = folders.repartition("path")


def list_files(spark: SparkSession, path: str, suffixes: list[str]) -> DataFrame:
    """(path, length, modificationTime) of the files below a folder whose names end in one of the suffixes, in any case."""
    return listed(spark, path).filter(F.lower("path").rlike("(" + "|".join(s.replace(".", "[.]") for s in suffixes) + ")$"))


def read_commit_log(spark: SparkSession, path: str, prefix: str = "") -> DataFrame:
    """(sha, author, epoch, zone, subject, path) of a raw log; a row for each path, null where a commit has none."""
    records = spark.read.option("lineSep", "\ncommit ").text(path).select(F.regexp_replace("value", "^commit ", "").alias("v"))
    get = lambda pattern: F.regexp_extract("v", pattern, 1)
    rows = records.select(get("^([0-9a-f]+)").alias("sha"), get(r"\nauthor ([^<\n]*) <").alias("author"), get(r"\ncommitter [^\n]*> ([0-9]+) ").cast("long").alias("epoch"), get(r"\ncommitter [^\n]*> [0-9]+ ([-+][0-9]{4})").alias("zone"), get(r"\n\n    ([^\n]*)").alias("subject"), F.regexp_extract_all("v", F.lit(r"\n:[^\t\n]*\t([^\n]+)"), F.lit(1)).alias("paths"))
    return rows.select("sha", "author", "epoch", "zone", "subject", F.explode_outer("paths").alias("path")).withColumn("path", F.concat(F.lit(prefix), "path"))


def parse_change_feed(lines: DataFrame) -> DataFrame:
    """(feed, line_no, line) to day, time, title and author of each change."""
    day = F.when(F.col("line").contains("<h4>"), F.regexp_extract("line", "<h4>(.*?)(?:</h4>)?$", 1))
    lines = lines.withColumn("day", F.last(day, ignorenulls=True).over(Window.partitionBy("feed").orderBy("line_no")))
    item = lines.filter(F.col("line").contains("<li") & ~F.col("line").contains("<h4>"))
    get = lambda p: F.regexp_extract("line", p, 1)
    user, talk = F.col("line").contains("mw-userlink"), F.col("line").contains(">Talk</a>")
    time = F.coalesce(F.nullif(F.regexp_extract("line", r"(\d\d:\d\d)", 1), F.lit("")), F.lit("<notime>"))
    author = F.when(user, get("mw-userlink[^>]*>([^<]*)<")).when(talk, get(">([^<>]*)</a>[^<]*<a[^>]*>Talk</a>")).otherwise("<unknown>")
    title = F.when(user, get(">([^<>]*)</a>(?:(?!</a>).)*mw-userlink")).when(talk, get('">([^<>]*)</a>')).otherwise("<unknown>")
    new, up = F.col("line").contains('uploaded a new version of "'), F.col("line").contains('uploaded "<a href=')
    title = F.when(new, F.concat(F.lit(" ->> "), get('uploaded a new version of "[^>]*>([^<]*)'))).when(up, F.concat(F.lit(" -> "), get('uploaded "<a[^>]*>([^<]*)'))).otherwise(title)
    return item.select("feed", "line_no", "day", F.when(user | talk, time).otherwise("<sometime>").alias("time"), title.alias("title"), author.alias("author"))


def extract_listing(pages: DataFrame) -> DataFrame:
    """Anchors in list items: href, title, whether the page exists, type, file, package, and the nearest header before."""
    part = pages.select("page_id", F.posexplode(F.split("html", "<li>")).alias("pos", "piece"))
    header = F.regexp_extract_all("piece", F.lit("<h[1-6][^>]*>([^<]*)"), F.lit(1))
    w = Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    part = part.withColumn("section", F.last(F.when(F.size(header) > 0, F.element_at(header, -1)), ignorenulls=True).over(w)).filter("pos > 0 and piece like '<a %'")
    get = lambda p: F.nullif(F.regexp_extract("piece", p, 1), F.lit(""))
    return part.select("page_id", (F.col("pos") - 1).alias("pos"), get('href="([^"]*)"').alias("href"), get("^<a [^>]*>([^<]*)").alias("title"), F.when(F.col("piece").rlike('^<a [^>]*class="new"'), "no").otherwise("yes").alias("has_page"), get("<i>([^<]*)").alias("type"), get("<tt>([^<]*)").alias("file"), get("<b><a [^>]*>([^<]*)").alias("package"), "section")


def manifest_attribute(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    pattern = f"(?m)^{key}: *(.*)$"
    value = F.when(F.col(text).isNull(), "no manifest").when(F.col(text).rlike(pattern), F.regexp_extract(text, pattern, 1)).otherwise("no attribute")
    return df.withColumn("attribute", value)


def find_maintainer(html: Column) -> Column:
    """The cell after a label that names a maintainer, inside an infobox; its text, else that of a child, else a fixed message; null without one."""
    cell = F.regexp_extract(html, r"""(?is)<table[^>]*class="infobox".*?<t[hd][^>]*>[^<]*maintainer[^<]*</t[hd]>\s*<td[^>]*>(.*?)</td>""", 1)
    own, child = F.trim(F.regexp_extract(cell, "^([^<]*)", 1)), F.trim(F.regexp_extract(cell, r"<[^>]*>\s*([^<\s][^<]*)", 1))
    has = html.rlike("""(?is)<table[^>]*class="infobox".*maintainer""")
    return F.when(has & (cell != ""), F.coalesce(F.nullif(own, F.lit("")), F.nullif(child, F.lit("")), F.lit("Could not parse maintainer name.")))


def candidate_widths(n: Column) -> Column:
    """int(sqrt(n / 16)) to 16 times that."""
    a = F.floor(F.sqrt(n / 16)).cast("int")
    return F.sequence(a, a * 16)


# --- generators: a pixel table for each row of (image_id, width, height)


def grid(images: DataFrame) -> DataFrame:
    xy = images.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("width") - 1)))
    return xy.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("height") - 1)))


def gen_bulls_eye(images: DataFrame) -> DataFrame:
    dx, dy = F.col("x") - F.col("width") / 2, F.col("y") - F.col("height") / 2
    v = F.floor(F.round((F.sin(F.sqrt(dx * dx + dy * dy) / 10) + 1) * 128, 6)).cast("int")
    return grid(images).select("image_id", "x", "y", F.shiftleft(v, 16).alias("rgb"))


#: Colours and number of bands of the spirals; fixed values.
YELLOW, RED, GREEN = 150 << 16 | 250 << 8, 240 << 16 | 20 << 8, 70 << 16 | 190 << 8
BANDS = 8 * 16
#: The same of the other palette.
OTHER_YELLOW, OTHER_RED, OTHER_GREEN = 0x0096BE, 0xFA14A0, 0xC8C864
OTHER_BANDS = 8 * 8


def gen_spirals(images: DataFrame, other: bool = False, count: int = 8) -> DataFrame:
    """Two sets of spiral bands; ``other`` takes the second palette, which has fewer."""
    yellow, red, green, bands = (OTHER_YELLOW, OTHER_RED, OTHER_GREEN, OTHER_BANDS) if other else (YELLOW, RED, GREEN, BANDS)
    dx, dy = F.col("x") - F.col("width") / 2, F.col("y") - F.col("height") / 2
    turn, angle = F.sqrt(dx * dx + dy * dy) * (2 * math.pi) / F.col("width"), F.atan2(dy, dx)
    band = lambda a, n: F.pmod(F.floor(F.round(n + a * n / (2 * math.pi), 9)), F.lit(n // 2))
    one, two = band(turn - angle, count), band(turn + angle, bands)
    colour = F.when(two % 2 == 0, F.when(one == 0, yellow).otherwise(red)).otherwise(F.when(one == 2, yellow).otherwise(green))
    return grid(images).select("image_id", "x", "y", colour.alias("rgb"))


def gen_noise(images: DataFrame, seed: int = 0) -> DataFrame:
    """Uniform bytes (val) and floats below 1 (unit) that depend on seed and place only, so a recomputed task gives the same."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), "image_id", "x", "y").cast("binary"))
    number = lambda at, n: F.conv(F.substring(digest, at, n), 16, 10).cast("long")
    return grid(images).select("image_id", "x", "y", number(1, 2).cast("int").alias("val"), (number(3, 8) / float(1 << 32)).alias("unit"))


def gen_solids(objects: DataFrame, size: int, shape: str = "octahedron") -> DataFrame:
    """Voxels of each object (object_id, cx, cy, cz, r) within a cube: 255 inside, 0 outside."""
    axis = lambda: F.explode(F.sequence(F.lit(0), F.lit(size - 1)))
    d = [F.col(a) - F.col(f"c{a}") for a in "xyz"]
    inside = F.abs(d[0]) + F.abs(d[1]) + F.abs(d[2]) < F.col("r") if shape == "octahedron" else d[0] * d[0] + d[1] * d[1] + d[2] * d[2] < F.col("r") * F.col("r")
    return objects.withColumn("x", axis()).withColumn("y", axis()).withColumn("z", axis()).select("object_id", "x", "y", "z", F.when(inside, 255).otherwise(0).alias("val"))


# --- writers


def write_results_table(df: DataFrame, path: str) -> None:
    df.write.csv(path, sep="\t", header=True)


def format_lut_text(luts: DataFrame) -> DataFrame:
    """A line for each index: three values in fields of four."""
    return luts.select("lut", "idx", F.concat(*(F.lpad(F.col(c).cast("string"), 4, " ") for c in "rgb")).alias("line"))


def write_planes_by_size(planes: DataFrame, path: str) -> None:
    planes.write.partitionBy("tile_w").parquet(path)


# --- bytes


#: Charsets that Spark decodes itself, by the names that Python has for them.
BUILT_IN = {"ascii": "US-ASCII", "iso8859-1": "ISO-8859-1", "utf-8": "UTF-8", "utf-16-be": "UTF-16BE", "utf-16-le": "UTF-16LE", "utf-16": "UTF-16"}


def _decoded(content: Column, charset: str) -> Column:
    """The text of bytes in any charset, null where they are none; a charset that nobody knows is an error at once."""
    name = codecs.lookup(charset).name
    if name == "iso8859-1":
        return F.decode(content, BUILT_IN[name])
    if name in ("utf-8", "ascii"):
        text = F.try_validate_utf8(content.cast("string"))
        return text if name == "utf-8" else F.when(F.octet_length(text) == F.length(text), text)

    @F.pandas_udf("string")
    def decode(data: pd.Series) -> pd.Series:
        def one(b: bytes) -> str | None:
            try:
                return bytes(b).decode(name)
            except UnicodeDecodeError:
                return None

        return pd.Series([None if b is None else one(b) for b in data], dtype=object)

    return decode(content)


def reencode(df: DataFrame, content: str, charset: str = "ISO-8859-1") -> DataFrame:
    """``text``: all of the bytes as text, or an error where some are no text in the charset; null stays null."""
    text = _decoded(F.col(content), charset)
    failed = F.raise_error(F.lit(f"bytes that are not {charset}")).cast("string")
    return df.withColumn("text", text).withColumn("text", F.when(F.col(content).isNotNull() & F.col("text").isNull(), failed).otherwise(F.col("text")))


def charset_groups(df: DataFrame, content: str, charsets: list[str]) -> DataFrame:
    """Charsets whose strict decoding of each content gives the same text, without regex characters; failures are left out."""
    tried = F.array(*(F.struct(F.lit(c).alias("charset"), F.sha2(F.regexp_replace(_decoded(F.col(content), c), r"[\[\]\\.*^$+?(){}|]", "").cast("binary"), 256).alias("sha")) for c in charsets))
    key = [c for c in df.columns if c != content]
    rows = df.select(*key, F.explode(tried).alias("t")).filter("t.sha is not null")
    return rows.groupBy(*key, F.col("t.sha").alias("text_sha256")).agg(F.array_join(F.array_sort(F.collect_list("t.charset")), ",").alias("charsets"))


def file_checksum(df: DataFrame, content: str) -> DataFrame:
    return df.withColumn("checksum", F.sha2(content, 256))
