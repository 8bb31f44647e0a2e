"""Queries of readers, generators and writers; files they read are written from the given tables first."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import files as S
from ..sources import images as I
from ..workspace import Workspace
from .fixtures import duck, view
from .registry import query


def _spot(spark, name: str) -> str:
    return Workspace(spark, name).path


def _sizes(spark, d):
    return view(spark, d, "part").filter("p_size > 0").select(F.col("p_partkey").alias("image_id"), F.col("p_size").alias("width"), (F.col("p_partkey") % 8 + 3).cast("int").alias("height"))


_GRID = """g as (select image_id, width, height, x, unnest(range(height)) y
from (select *, unnest(range(width)) x
from (select p_partkey image_id, p_size width, cast(p_partkey % 8 + 3 as int) height
from part
where p_size > 0))), c as (select *, x - width / 2.0::double dx, y - height / 2.0::double dy
from g)"""


@query(f"with {_GRID} select image_id, cast(x as int) x, cast(y as int) y, cast(floor(round((sin(sqrt(dx*dx + dy*dy) / 10) + 1) * 128, 6)) as int) << 16 as rgb from c")
def gen_bulls_eye(spark, d):
    return S.gen_bulls_eye(_sizes(spark, d))


def _spirals_sql(other: bool) -> str:
    yellow, red, green, n = (S.OTHER_YELLOW, S.OTHER_RED, S.OTHER_GREEN, S.OTHER_BANDS) if other else (S.YELLOW, S.RED, S.GREEN, S.BANDS)
    bands = f"select *, floor(round(8 + (t - a) * 8 / (2 * pi()), 9)) o, floor(round({n} + (t + a) * {n} / (2 * pi()), 9)) w from b"
    colour = f"case when two % 2 = 0 then case when one = 0 then {yellow} else {red} end else case when one = 2 then {yellow} else {green} end end"
    return f"select image_id, cast(x as int) x, cast(y as int) y, {colour} as rgb, {str(other).lower()} as other from (select *, o - 4 * floor(o / 4) one, w - {n // 2} * floor(w / {n // 2}) two from ({bands}))"


@query(f"with {_GRID}, b as (select *, sqrt(dx*dx + dy*dy) * (2 * pi()) / width t, atan2(dy, dx) a from c) {_spirals_sql(False)} union all {_spirals_sql(True)}")
def gen_spirals(spark, d):
    sizes = _sizes(spark, d)
    return S.gen_spirals(sizes).withColumn("other", F.lit(False)).unionByName(S.gen_spirals(sizes, other=True).withColumn("other", F.lit(True)))


@query(f"with {_GRID}, m as (select *, md5(concat_ws(':', 7, image_id, x, y)) h from g) select image_id, cast(x as int) x, cast(y as int) y, ('0x' || substr(h, 1, 2))::int val, ('0x' || substr(h, 3, 8))::bigint / 4294967296.0::double unit from m")
def gen_noise(spark, d):
    return S.gen_noise(_sizes(spark, d), 7)


@query("""with o as (select s_suppkey object_id, s_suppkey % 9 + 2 cx, s_suppkey % 7 + 3 cy, s_suppkey % 5 + 4 cz, s_suppkey % 4 + 2 r
from supplier) select object_id, cast(x as int) x, cast(y as int) y, cast(z as int) z, case when abs(x - cx) + abs(y - cy) + abs(z - cz) < r then 255 else 0 end val
from o, range(12) a(x), range(12) b(y), range(12) c(z)""")
def gen_solids(spark, d):
    s = F.col("s_suppkey")
    o = view(spark, d, "supplier").select(s.alias("object_id"), (s % 9 + 2).alias("cx"), (s % 7 + 3).alias("cy"), (s % 5 + 4).alias("cz"), (s % 4 + 2).alias("r"))
    return S.gen_solids(o, 12)


@query("select p_partkey::double as part, p_size::double as size, p_retailprice as price from part")
def read_results_table(spark, d):
    at = _spot(spark, "results")
    S.write_results_table(view(spark, d, "part").select(F.col("p_partkey").alias("part"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price")), at)
    return S.read_results_table(spark, at)


@query("select o_orderkey, o_orderstatus, o_orderpriority from orders")
def write_results_table(spark, d):
    at = _spot(spark, "results")
    S.write_results_table(view(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), at)
    return spark.read.csv(at, sep="\t", header=True, schema="o_orderkey long, o_orderstatus string, o_orderpriority string")


@query("select n_nationkey as nation, cast(i as int) idx, cast((i * (n_nationkey + 1)) % 256 as int) r, cast(255 - i as int) g, cast(i as int) b from nation, range(256) q(i)")
def read_luts(spark, d):
    at = _spot(spark, "luts")
    luts = view(spark, d, "nation").select(F.col("n_nationkey").alias("lut"), F.explode(F.sequence(F.lit(0), F.lit(255))).alias("idx"))
    luts = luts.select("lut", "idx", (F.col("idx") * (F.col("lut") + 1) % 256).alias("r"), (255 - F.col("idx")).alias("g"), F.col("idx").alias("b"))
    lines = S.format_lut_text(luts).groupBy("lut").agg(F.array_sort(F.collect_list(F.struct("idx", "line"))).alias("l"))
    lines.select("lut", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text")).write.partitionBy("lut").text(at)
    found = S.read_luts(spark, at)
    # a map's number is its second row's red value, less one
    second = found.filter("idx = 1").select("path", F.pmod(F.col("r") - 1, F.lit(256)).cast("int").alias("nation"))
    return found.join(second, "path").select("nation", "idx", "r", "g", "b")


@query(duck("""select lut, idx, concat(lpad(r::varchar, 4, ' '), lpad(g::varchar, 4, ' '), lpad(b::varchar, 4, ' ')) line
from (select concat(lut, p_size) lut, idx, r, (g + p_size) % 256 g, b
from luts, (select distinct p_size
from part))""", "luts"))
def format_lut_text(spark, d):
    luts = view(spark, d, "part").select("p_size").distinct().crossJoin(F.broadcast(view(spark, d, "luts")))  # 512 fixed rows
    return S.format_lut_text(luts.select(F.concat("lut", F.col("p_size").cast("string")).alias("lut"), "idx", "r", ((F.col("g") + F.col("p_size")) % 256).alias("g"), "b"))


@query("select doc_id || case doc_id % 4 when 0 then '.jpg' when 1 then '.JPEG' else '.lut' end as name, strlen(text) as length, true as recent from documents where doc_id % 4 <> 3")
def list_files(spark, d):
    """A file for each document, of four kinds in two folders, three of which are asked for."""
    at = _spot(spark, "listed")
    k = F.col("doc_id") % 4
    suffix = F.when(k == 0, ".jpg").when(k == 1, ".JPEG").when(k == 2, ".lut").otherwise(".txt")
    files = view(spark, d, "documents").select("doc_id", F.concat(F.col("doc_id").cast("string"), suffix).alias("name"), F.lit(0).alias("width"), F.lit(0).alias("height"), F.lit(0).alias("channels"), F.encode("text", "UTF-8").alias("data"))
    for half in (0, 1):
        I.write_files(files.filter(F.col("doc_id") % 2 == half).drop("doc_id"), f"{at}/half-{half}", "raw")
    found = S.list_files(spark, at, [".jpg", ".jpeg", ".lut"])
    recent = F.col("modificationTime") > F.current_timestamp() - F.expr("interval 1 day")
    return found.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", recent.alias("recent"))


def _image_folder(spark, d) -> str:
    """A folder with a gray image file for every image, a colour one for every three, and files that are no images among them."""
    at = _spot(spark, "images")
    px, rgb = view(spark, d, "px"), view(spark, d, "rgb")
    gray = I.pack_images(px.select(F.concat(F.lit("gray "), "image_id", F.lit(".png")).alias("name"), F.lit(8).alias("w"), F.lit(8).alias("h"), "x", "y", "val"), ["name"], "w", "h", ["val"])
    colour = I.pack_images(rgb.select(F.concat(F.lit("rgb-"), "image_id", F.lit(".png")).alias("name"), F.lit(8).alias("w"), F.lit(8).alias("h"), "x", "y", "r", "g", "b"), ["name"], "w", "h", ["r", "g", "b"])
    I.write_files(gray.unionByName(colour), at, "png")
    junk = view(spark, d, "embeddings").filter("vec_id % 7 = 0").select(F.concat(F.lit("junk"), "vec_id", F.lit(".png")).alias("name"), F.concat(F.lit("no image "), "label").cast("binary").alias("data"))
    I.write_files(junk.selectExpr("name", "0 width", "0 height", "0 channels", "data"), at, "raw")
    return at


@query(duck("select 'gray ' || image_id || '.png' as name, x, y, val r, val g, val b from px union all select 'rgb-' || image_id || '.png', x, y, r, g, b from rgb", "px", "rgb"))
def read_images(spark, d):
    return I.pixels_of(I.read_folder(spark, _image_folder(spark, d)))


@query(duck("""select 'gray ' || image_id || '.png.tif' as name, 8 width, 8 height, 1 channels, string_agg(printf('%02X', val), '' order by y, x) as bytes from px group by image_id
union all select 'rgb-' || image_id || '.png.tif', 8, 8, 3, string_agg(printf('%02X%02X%02X', r, g, b), '' order by y, x) from rgb group by image_id""", "px", "rgb"))
def batch_convert(spark, d):
    at = _spot(spark, "converted")
    I.batch_convert(spark, _image_folder(spark, d), at, "tif")
    return I.read_folder(spark, at).select("name", "width", "height", "channels", F.hex("data").alias("bytes"))


@query(duck("select stack_id, t, x, y, val, cast(t % 3 + 1 as int) tile_w from stack", "stack"))
def write_planes_by_size(spark, d):
    at = _spot(spark, "by-size")
    S.write_planes_by_size(view(spark, d, "stack").withColumn("tile_w", (F.col("t") % 3 + 1).cast("int")), at)
    return spark.read.parquet(at).select("stack_id", "t", "x", "y", "val", "tile_w")


@query(duck("select lower(sha256(cast(sha as varchar))) as sha, author, epoch_us(committed_at) // 1000000 as epoch, concat('change ', sha) subject, concat('lib/', path) path from commits", "commits"))
def read_commit_log(spark, d):
    at = _spot(spark, "log")
    c = view(spark, d, "commits")
    epoch = F.floor(F.unix_micros(F.col("committed_at").cast("timestamp")) / 1000000)
    text = F.concat(F.lit("commit "), F.sha2(F.col("sha").cast("string"), 256), F.lit("\nauthor "), "author", F.lit(" <a@b.c> 1 +0000\ncommitter x <x@y.z> "), epoch.cast("string"), F.lit(" +0100\n\n    change "), F.col("sha").cast("string"), F.lit("\n    of a commit here\n\n:100644 100644 a b M\t"), "path")
    c.select(text.alias("value")).write.text(at)
    return S.read_commit_log(spark, at, "lib/").select("sha", "author", "epoch", "subject", "path")


_FEED = """select user_id % 20 as feed, event_id, user_id, ts, event_type, coalesce(max(case when event_id % 40 = 0 then event_id end) over (partition by user_id % 20
order by event_id), null) day_id
from events"""


@query(f"select feed, event_id as line_no, 'Day ' || day_id as day, case when event_id % 5 = 4 then '<sometime>' when event_id % 5 = 3 then '<notime>' else strftime(ts, '%H:%M') end as time, case event_id % 5 when 0 then 'T' || event_id when 1 then ' -> F' || event_id when 2 then ' ->> F' || event_id when 3 then 'T' || event_id else '<unknown>' end title, case event_id % 5 when 4 then '<unknown>' else 'user' || user_id end author from ({_FEED}) where event_id % 40 <> 0")
def parse_change_feed(spark, d):
    e = view(spark, d, "events")
    i, who = F.col("event_id").cast("string"), F.concat(F.lit("user"), F.col("user_id"))
    time, link = F.date_format("ts", "HH:mm"), F.concat(F.lit('<li><a href="/p">T'), i, F.lit("</a>; "))
    user = F.concat(F.lit(' <a class="mw-userlink" href="/u">'), who, F.lit("</a>"))
    kinds = [
        F.concat(link, time, user, F.lit("</li>")),
        F.concat(link, time, user, F.lit(' uploaded "<a href="/f">F'), i, F.lit('</a>"</li>')),
        F.concat(link, time, user, F.lit(' uploaded a new version of "<a href="/f">F'), i, F.lit('</a>"</li>')),
        F.concat(F.lit('<li><a href="/p">T'), i, F.lit('</a>; by <a href="/u">'), who, F.lit('</a> (<a href="/t">Talk</a>)</li>')),
        F.lit("<li>nothing known</li>"),
    ]
    line = F.when(F.col("event_id") % 40 == 0, F.concat(F.lit("<h4>Day "), i, F.lit("</h4>")))
    for k, text in enumerate(kinds):
        line = line.when(F.col("event_id") % 5 == k, text)
    return S.parse_change_feed(e.select((F.col("user_id") % 20).alias("feed"), F.col("event_id").alias("line_no"), line.alias("line")))


@query("""select page_id, cast(pos - 1 as int) pos, l[1] href, l[2] title, 'yes' has_page, null::varchar as "type", null::varchar as file, null::varchar package, null::varchar section from (select page_id, unnest(a) s, generate_subscripts(a, 1) pos from (select page_id, regexp_extract_all(html, '<li>(<a href="[^"]*"[^>]*>[^<]*)', 1) a from pages)), lateral (select [regexp_extract(s, 'href="([^"]*)"', 1), regexp_extract(s, '>([^<]*)$', 1)] l)""")
def extract_listing(spark, d):
    return S.extract_listing(view(spark, d, "pages"))


@query("select conv_id, turn, case when text is null then 'no manifest' when turn % 2 = 0 then role else 'no attribute' end as attribute from conversations")
def manifest_attribute(spark, d):
    c = view(spark, d, "conversations")
    text = F.when(F.col("text").isNotNull(), F.when(F.col("turn") % 2 == 0, F.concat(F.lit("Version: 1\nMain-Class: "), "role", F.lit("\nBuilt: x"))).otherwise("Version: 2"))
    return S.manifest_attribute(c.select("conv_id", "turn", text.alias("text")), "Main-Class").select("conv_id", "turn", "attribute")


@query("select page_id, case page_id % 4 when 0 then null when 1 then url when 2 then url else 'Could not parse maintainer name.' end maintainer from pages")
def find_maintainer(spark, d):
    box = lambda cell: F.concat("html", F.lit('<table class="infobox"><tr><th>Project Maintainer</th>\n<td>'), cell, F.lit("</td></tr></table>"))
    k = F.col("page_id") % 4
    html = F.when(k == 0, F.col("html")).when(k == 1, box(F.col("url"))).when(k == 2, box(F.concat(F.lit(' <a href="/u"> '), "url", F.lit(" </a>")))).otherwise(box(F.lit("<i></i>")))
    return view(spark, d, "pages").select("page_id", S.find_maintainer(html).alias("maintainer"))


@query("select doc_id, y, substr(h, cast(y * 74 + 1 as bigint), 74) as bytes from (select doc_id, h, unnest(range((length(h) + 73) // 74)) y from (select doc_id, hex(encode(text)) h from documents))")
def restride_raw(spark, d):
    """Whole texts as raw files, read again in rows of 37 bytes."""
    at = _spot(spark, "raw")
    docs = view(spark, d, "documents")
    I.write_files(docs.select(F.concat(F.col("doc_id").cast("string"), F.lit(".raw")).alias("name"), F.octet_length("text").alias("width"), F.lit(1).alias("height"), F.lit(1).alias("channels"), F.encode("text", "UTF-8").alias("data")), at, "raw")
    rows = I.read_records(spark, at, 37, split=1 << 20)
    return rows.select(F.regexp_extract("path", "([0-9]+)[.]raw$", 1).cast("long").alias("doc_id"), F.col("record").alias("y"), F.hex("bytes").alias("bytes"))


@query("select doc_id, cast(unnest(range(cast(a as bigint), cast(a * 16 + 1 as bigint))) as int) width from (select doc_id, floor(sqrt(strlen(text) / 16.0::double)) a from documents)")
def candidate_widths(spark, d):
    return view(spark, d, "documents").select("doc_id", F.explode(S.candidate_widths(F.octet_length("text"))).alias("width"))


@query("""select doc_id, sha256(array_to_string(list_transform(range(strlen(text)), lambda i: chr(('0x' || substr(h, 2 * i + 1, 2))::int)), '')) as text_sha256
from (select doc_id, text, hex(encode(text)) h
from documents)""")
def reencode(spark, d):
    """The bytes of all texts, read as ISO-8859-1: a character for each byte."""
    docs = view(spark, d, "documents").select("doc_id", F.encode("text", "UTF-8").alias("content"))
    return S.reencode(docs, "content").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


@query()
def charset_groups(spark, d):
    docs = view(spark, d, "documents").select("doc_id", F.encode("text", "UTF-8").alias("content"))
    return S.charset_groups(docs, "content", ["utf-8", "ascii", "latin-1", "cp1252"])


@query("select doc_id, sha256(text) as checksum from documents")
def file_checksum(spark, d):
    docs = view(spark, d, "documents").select("doc_id", F.encode("text", "UTF-8").alias("content"))
    return S.file_checksum(docs, "content").select("doc_id", "checksum")


@query(duck("select path, checksum from files", "files"))
def sorted_listing(spark, d):
    return view(spark, d, "files").select("path", "checksum").orderBy("path")
