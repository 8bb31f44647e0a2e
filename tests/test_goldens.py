"""Hand-computed rasters, algebraic properties, readers, and streams against their batch forms."""

import hashlib
import math
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.functions import scalar as S
from rasterloom.operators import history as H
from rasterloom.operators import pixels as P
from rasterloom.operators import raster as R
from rasterloom.operators import relational as L
from rasterloom.operators import scans
from rasterloom.operators import tiles as T2
from rasterloom.plans.fixtures import view
from rasterloom.sources import files, images
from rasterloom.streaming import streams as T
from rasterloom.workspace import Workspace

SF = "/root/testdata/sf0.001"


def image(spark, rows):
    return spark.createDataFrame([(0, x, y, v) for y, row in enumerate(rows) for x, v in enumerate(row)], "image_id long, x int, y int, val int")


def raster(df):
    got = {(r.x, r.y): r.val for r in df.collect()}
    return [[got[x, y] for x in range(1 + max(k[0] for k in got))] for y in range(1 + max(k[1] for k in got))]


NINE = [[0, 1, 2], [3, 4, 5], [6, 7, 8]]


def test_flip_and_invert_undo_themselves(spark):
    df = image(spark, NINE)
    assert raster(P.flip(df, "x", 3)) == [r[::-1] for r in NINE]
    assert raster(P.flip(P.flip(df, "y", 3), "y", 3)) == NINE
    assert raster(P.invert(P.invert(df))) == NINE


def test_blur_and_resize_keep_a_constant(spark):
    df = image(spark, [[100] * 8] * 8)
    for out in (R.gaussian_blur(df, 1.2, ["image_id"], 8, 8), R.resize(df, 8, 8, 3, 3, ["image_id"]), R.downsample(df, 8, 8, 4, 4, ["image_id"])):
        assert {round(r.val, 6) for r in out.collect()} == {100}
    with pytest.raises(ValueError):
        R.downsample(df, 8, 8, 9, 9, ["image_id"])


BLOBS = ["........", ".##.....", ".##.....", "........", ".....###", ".....###", "......##", "........"]


def test_components_particles_and_fill(spark):
    mask = image(spark, [[int(c == "#") for c in row] for row in BLOBS]).filter("val = 1")
    labelled = R.label_components(mask, ["image_id"], Workspace(spark, "t"), 8)
    assert sorted(r.n for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()) == [4, 8]
    [p] = R.measure_particles(labelled, ["image_id"], 8, 8).collect()  # the other touches the edge
    assert (p.x_start, p.y_start, p.area) == (1, 1, 4)
    filled = R.flood_fill(image(spark, [[int(c == "#") for c in row] for row in BLOBS]), ["image_id"], 0, 0, 5, Workspace(spark, "t"), 8)
    assert filled.filter("val = 5").count() == 64 - 12
    hull = R.convex_hull(mask.filter("x < 4").select("image_id", "x", "y"), "image_id")
    assert [(r.x, r.y) for r in hull.orderBy("seq").collect()] == [(1, 1), (2, 1), (2, 2), (1, 2)]


def test_wavelengths(spark):
    df = spark.createDataFrame([(float(n),) for n in (379, 380, 440, 490, 510, 580, 645, 780, 781)], "nm double")
    got = [tuple(r) for r in df.select(*S.wavelength_to_rgb(F.col("nm"))).collect()]
    assert got == [(None,) * 3, (77, 0, 77), (0, 0, 255), (0, 255, 255), (0, 255, 0), (255, 255, 0), (255, 0, 0), (77, 0, 0), (None,) * 3]


def test_runs_decode_to_the_image(spark):
    rgb = view(spark, SF, "rgb").select("image_id", "x", "y", S.quantize_hex4(F.col("r")).alias("c"))
    runs = P.run_length_encode(rgb, ["image_id"], "c")
    back = runs.withColumn("x", F.explode(F.sequence("x0", "x1"))).select("image_id", "x", "y", "c")
    assert back.exceptAll(rgb).isEmpty() and rgb.exceptAll(back).isEmpty()


def test_histogram_counts_every_pixel(spark):
    px = view(spark, SF, "px")
    assert R.histogram(px.select("image_id", "val"), ["image_id"]).agg(F.sum("n")).first()[0] == px.count()


def test_closure_meets_cycles_once(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("a", "c"), ("x", "y")], "src string, dst string")
    got = L.transitive_dependents(edges, spark.createDataFrame([("a",)], "root string"), Workspace(spark, "t")).collect()
    assert sorted(r.file for r in got) == ["a", "b", "c"]


def greedy(d):
    """Each tile in turn takes its nearest db that is left."""
    used, out = set(), {}
    for t in sorted({t for t, _, _ in d}):
        left = sorted((x, b) for a, b, x in d if a == t and b not in used)
        if left:
            out[t] = left[0][1]
            used.add(left[0][1])
    return out


@pytest.mark.parametrize("tiles, dbs, k", [(4, 6, 16), (12, 12, 2), (9, 5, 1), (10, 40, 3)])
def test_unique_matches_equal_the_greedy_choice(spark, tiles, dbs, k):
    rnd = random.Random(tiles)
    d = [(t, b, rnd.randint(0, 6)) for t in range(tiles) for b in range(dbs)]
    pairs = spark.createDataFrame(d, "tile long, db long, distance long")
    got = T2.assign(pairs.select("tile").distinct(), T2.listed(pairs), Workspace(spark, "t"), k).collect()
    assert {r.tile: r.db for r in got} == greedy(d) and len(got) == min(tiles, dbs)
    assert {(r.tile, r.db, r.distance) for r in got} <= set(d)


def test_tile_search_equals_all_pairs(spark, monkeypatch):
    rnd = random.Random(8)
    base = [[rnd.randint(0, 255) for _ in range(48)] for _ in range(6)]
    tiles = [[min(255, max(0, v + rnd.randint(-3, 3))) for v in base[rnd.randrange(6)]] for _ in range(300)] + [base[0]] * 5
    px = spark.createDataFrame([(i, k % 8, k // 8, v) for i, t in enumerate(tiles) for k, v in enumerate(t)], "db long, x int, y int, val int").repartition(5)
    own = px.filter("db % 10 = 0").withColumnRenamed("db", "tile")
    want = [(a, b, sum((p - q) ** 2 for p, q in zip(tiles[a], tiles[b], strict=True))) for a in range(0, 305, 10) for b in range(305) if a != b]
    monkeypatch.setattr(T2, "PASS_PIXELS", 500)  # several passes
    monkeypatch.setattr(T2, "CELLS", 2000)
    assert sorted((r.tile, r.db, r.distance) for r in T2.tile_distance(own, px, Workspace(spark, "t"), 8, 6).collect()) == want
    nearest = {a: min((d, b) for t, b, d in want if t == a) for a, _, _ in want}
    assert {r.tile: (r.distance, r.db) for r in T2.best_match(own, px, Workspace(spark, "t"), 8, 6).collect()} == nearest
    assert {r.tile: r.db for r in T2.best_match_unique(own, px, Workspace(spark, "t"), 8, 6, k=2).collect()} == greedy(want)
    with pytest.raises(Exception, match="not a whole tile"):
        T2.best_match(own, px.filter("db <> 7 or x < 5"), Workspace(spark, "t"), 8, 6).collect()


@pytest.mark.parametrize("eight", [True, False])
def test_components_over_many_blocks(spark, eight):
    rnd = random.Random(4)
    on = {(x, y) for x in range(-70, 200) for y in range(-3, 140) if rnd.random() < (0.42 if eight else 0.62)} | {(x, 150) for x in range(300)} | {(299, y) for y in range(150, 290)}
    on |= {(k, 160 + k) for k in range(60, 70)}  # through a corner of blocks
    width, left, want = 1000, set(on), {}
    steps = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (eight or not (a and b))]
    while left:
        stack, region = [left.pop()], []
        while stack:
            x, y = stack.pop()
            region.append((x, y))
            for a, b in steps:
                if (x + a, y + b) in left:
                    left.discard((x + a, y + b))
                    stack.append((x + a, y + b))
        want |= dict.fromkeys(region, min(y * width + x for x, y in region))
    mask = spark.createDataFrame([(k, x, y) for k in ("a", "b") for x, y in on], "image_id string, x int, y int")
    mask = mask.unionByName(mask.filter("x = 5")).repartition(4)
    got = R.label_components(mask, ["image_id"], Workspace(spark, "t"), width, eight).collect()
    assert len(got) == 2 * len(want) and all(want[r.x, r.y] == r.label for r in got)
    assert R.label_components(mask.limit(0), ["image_id"], Workspace(spark, "t"), width).isEmpty()


def test_results_table_kinds(spark, tmp_path):
    (tmp_path / "a.txt").write_text(" \tx,y\n1\t2,3.5\n2\tn/a,4\n")
    got = files.read_results_table(spark, f"file://{tmp_path}/a.txt")
    assert got.dtypes == [("x", "double"), ("y", "double")] and got.filter("isnan(x)").count() == 1
    (tmp_path / "b.txt").write_text("x\ty\none\t2\n3\t4\n")
    assert files.read_results_table(spark, f"file://{tmp_path}/b.txt").dtypes == [("x", "string"), ("y", "string")]
    (tmp_path / "c.txt").write_text("x\n1\n")
    with pytest.raises(ValueError):
        files.read_results_table(spark, f"file://{tmp_path}/c.txt")


def test_three_colour_map_dialects(spark, tmp_path):
    (tmp_path / "plain.lut").write_bytes(b"  1   2   3\r\n255 0 9\r\n\x1a")
    (tmp_path / "index.lut").write_text("Index Red Green Blue\n0 4 5 6\n1 7 8 9\n")
    (tmp_path / "float.txt").write_text("0.0 0.5 1.0\n1.0 0.2 0.0\n")
    got = sorted(tuple(r) for r in files.read_luts(spark, f"file://{tmp_path}").drop("path").collect())
    assert got == [("float", 0, 0, 128, 255), ("float", 1, 255, 51, 0), ("index", 0, 4, 5, 6), ("index", 1, 7, 8, 9), ("plain", 0, 1, 2, 3), ("plain", 1, 255, 0, 9)]


def test_commit_log_zones(spark, tmp_path):
    one = "{}commit {}\nauthor A <a@b> 1 +0000\ncommitter C <c@d> {} {}\n\n    say commit here\n    commit inside\n\n:1 1 a b M\tsrc/x.txt\n"
    (tmp_path / "log").write_text(one.format("", "aa11", 100, "+0100") + one.format("", "bb22", 200, "-0500"))
    got = [tuple(r) for r in files.read_commit_log(spark, f"file://{tmp_path}/log", "lib/").orderBy("sha").collect()]
    assert got == [("aa11", "A", 100, "+0100", "say commit here", "lib/src/x.txt"), ("bb22", "A", 200, "-0500", "say commit here", "lib/src/x.txt")]


@pytest.mark.parametrize("fmt", ["png", "tif"])
def test_image_files_round_trip_and_junk_is_skipped(spark, tmp_path, fmt):
    rnd = random.Random(2)
    raw = lambda n: bytes(rnd.randrange(256) for _ in range(n))
    rows = [(f"a+ %{c}x{w}é.{fmt}", w, h, c, raw(w * h * c)) for c in (1, 3, 4) for w, h in ((1, 1), (5, 3), (2, 7))]
    at = f"file://{tmp_path}/in"
    images.write_files(spark.createDataFrame(rows, images.IMAGE), at, fmt)
    (tmp_path / "in" / f"junk.{fmt}").write_bytes(b"no image")
    (tmp_path / "in" / f"empty.{fmt}").write_bytes(b"")
    found = images.read_folder(spark, at)
    assert sorted(tuple(r) for r in found.select("name", "width", "height", "channels", "data").collect()) == sorted(rows)
    assert (tmp_path / "in" / "_SUCCESS").read_text() == "9" and not [p for p in (tmp_path / "in").iterdir() if p.name.startswith(".") and not p.name.endswith(".crc")]
    px = {(r.x, r.y): (r.r, r.g, r.b) for r in images.pixels_of(found.filter(F.col("name") == rows[4][0])).collect()}
    data = rows[4][4]
    assert px == {(i % 5, i // 5): tuple(data[3 * i : 3 * i + 3]) for i in range(15)}
    images.batch_convert(spark, at, f"file://{tmp_path}/out", "tif")
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if p.name[0] not in "._") == sorted(f"{r[0]}.tif" for r in rows)
    back = images.read_folder(spark, f"file://{tmp_path}/out").select("name", "data")
    assert sorted(tuple(r) for r in back.collect()) == sorted((r[0] + ".tif", r[4]) for r in rows)
    with pytest.raises(Exception, match="no file name"):
        images.write_files(spark.createDataFrame([("../x", 1, 1, 1, b"a")], images.IMAGE), at, "raw")


def test_raw_files_are_read_by_byte_ranges(spark, tmp_path):
    data = bytes(k % 251 for k in range(10_007))
    (tmp_path / "one.raw").write_bytes(data)
    (tmp_path / "none.raw").write_bytes(b"")
    rows = images.read_records(spark, str(tmp_path), 64, split=1000)
    assert rows.rdd.getNumPartitions() == 11
    got = sorted((r.record, bytes(r.bytes)) for r in rows.collect())
    assert got == [(k, data[k * 64 : k * 64 + 64]) for k in range(157)]
    # a canvas of 100 x 80 seen at a trial width, as copied row by row
    for trial in (64, 130):
        canvas = {r.y: bytes(r.bytes) for r in images.restride(images.read_records(spark, str(tmp_path / "one.raw"), trial), trial, 100, 80).collect()}
        assert canvas == {y: data[y * trial : y * trial + min(100, trial)] for y in range(min(80, 8000 // trial))}


def test_throttle_keeps_the_first(spark):
    assert [t for t, k in zip((0, 1, 2, 3, 5, 9), T.throttle([0, 1, 2, 3, 5, 9], None, 2)[0], strict=True) if k] == [0, 2, 5, 9]


@pytest.mark.parametrize("seconds", [0.0, 0.5, 7.0, 400.0])
def test_throttle_of_a_key_over_many_partitions(spark, seconds):
    rnd = random.Random(6)
    rows = [(7, i, rnd.choice([rnd.randint(0, 3_000), 1_000 + i % 5]) * 1_000_000 + rnd.choice([0, 500_000])) for i in range(4000)]
    rows += [(k, 10_000 + i, rnd.randint(0, 900) * 1_000_000) for i in range(400) for k in (rnd.choice([1, 2, 9, 10, None]),)]
    frames = spark.createDataFrame(rows, "user_id long, event_id long, us long").select("user_id", "event_id", F.timestamp_micros("us").alias("ts"))
    want, last = set(), {}
    for k, i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[2], r[1])):
        if k not in last or t - last[k] >= int(seconds * 1e6):
            want.add((k, i, t))
            last[k] = t
    got = H.throttle_frames(frames.repartition(5), seconds, Workspace(spark, "t")).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert H.throttle_frames(frames.limit(0), seconds, Workspace(spark, "t")).isEmpty()


def test_running_values_and_ranks_over_partitions(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice(["a", "a", "a", "b", None]), i, rnd.choice([None, rnd.randint(0, 99)])) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, at long, v long").repartition(6)
    got = scans.running(df, ["k"], [F.col("at")], {"hi": (F.max, "v"), "lo": (F.min, "v"), "sum": (F.sum, "v")}, Workspace(spark, "t")  , "r").collect()
    so_far = {}
    want = set()
    for k, at, v in sorted(rows, key=lambda r: r[1]):
        seen = so_far.setdefault(k, [])
        if v is not None:
            seen.append(v)
        want.add((k, at, v, max(seen, default=None), min(seen, default=None), sum(seen) if seen else None))
    assert {tuple(r) for r in got} == want and len(got) == 2000
    ranked = scans.rank(df, [F.col("k").desc_nulls_last(), F.col("at")], Workspace(spark, "t"), "r").collect()
    order = sorted(rows, key=lambda r: ({"b": 0, "a": 1, None: 2}[r[0]], r[1]))
    assert {(r["k"], r["at"]): r["rank"] for r in ranked} == {(k, at): i for i, (k, at, _) in enumerate(order)}


def test_throttle_stream_equals_batch(spark, tmp_path):
    frames = view(spark, SF, "frames")
    frames.repartition(1).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(frames.schema).parquet(f"file://{tmp_path}/in")
    q = T.throttle_stream(stream, 3600.0).writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(180)
    got = spark.read.parquet(f"file://{tmp_path}/out")
    want = H.throttle_frames(frames, 3600.0, Workspace(spark, "t"))
    assert sorted(r.event_id for r in got.collect()) == sorted(r.event_id for r in want.collect())


def test_change_stream_emits_once_and_again_after_a_new_checkpoint(spark, tmp_path):
    feed = view(spark, SF, "frames").select("user_id", "event_id")
    schema, seen = feed.schema, []

    def run(checkpoint):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
        T.new_changes_stream(stream, f"file://{tmp_path}/state", ["user_id"], "event_id", lambda df: seen.extend(r.event_id for r in df.collect()), f"file://{tmp_path}/{checkpoint}").awaitTermination(120)

    for lo in range(0, 4):
        feed.filter(F.expr(f"event_id div 150 = {lo}")).repartition(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    run("ck")
    want = sorted(r.event_id for r in feed.filter("event_id < 600").collect())
    assert sorted(seen) == want
    run("other")  # reads all from the start
    assert sorted(seen) == want
    store = T.MarkerStore(spark, f"file://{tmp_path}/state", ["user_id"], "event_id", compact_after=2)
    before = sorted(map(tuple, store.read(schema).collect()))
    feed.filter("event_id >= 600").unionByName(feed.filter("event_id >= 600")).repartition(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    run("other")
    assert sorted(seen) == sorted(r.event_id for r in feed.collect())
    for k in range(4):  # marks are merged, and stay
        store.advance(spark.createDataFrame([(-1, k)], schema))
    assert len(list((tmp_path / "state").glob("marks-*"))) <= 3
    after = {r.user_id: r._mark for r in store.read(schema).collect()}
    assert after.pop(-1) == 3 and all(after[u] >= m for u, m in before) and after == {r.user_id: r.m for r in feed.groupBy("user_id").agg(F.max("event_id").alias("m")).collect()}


def test_new_changes_by_the_two_line_marker(spark):
    feeds = {
        "day goes on": (["Day 2", "c", "b", "Day 1", "a"], ("Day 2", "b"), 2),
        "nothing new": (["Day 2", " b ", "a"], ("Day 2", "b"), 0),
        "next day": (["Day 3", "d", "Day 2", "b"], ("Day 2", "b"), 2),
        "marker gone": (["Day 9", "z", "y"], ("Day 2", "b"), 3),
        "first run": (["Day 1", "a"], None, 2),
        "one line": (["Day 1"], ("Day 1", None), 0),
    }
    lines = spark.createDataFrame([(f, i, x) for f, (text, _, _) in feeds.items() for i, x in enumerate(text)], "feed string, line_no int, line string")
    stored = spark.createDataFrame([(f, *m) for f, (_, m, _) in feeds.items() if m], "feed string, first string, second string")
    got = [tuple(r) for r in T.new_changes(lines, stored).collect()]
    assert sorted(got) == sorted((f, i, x) for f, (text, _, n) in feeds.items() for i, x in enumerate(text[:n]))
    again = T.new_changes(lines, T.markers(lines))
    assert again.isEmpty()


def test_results_table_keeps_rows_that_equal_the_header(spark, tmp_path):
    (tmp_path / "t.csv").write_text(' ,"a",b\n1,"x",2\n ,"a",b\n3,y z,\n')
    got = files.read_results_table(spark, str(tmp_path / "t.csv"))
    assert [tuple(r) for r in got.collect()] == [('"x"', "2"), ('"a"', "b"), ("y z", "")]


def test_runs_skip_the_background_and_name_a_colour_on_change(spark):
    row = spark.createDataFrame([(0, x, y, c) for y, line in enumerate(("aabb8a", "a8888a")) for x, c in enumerate(line)], "image_id int, x int, y int, c string")
    got = P.run_length_encode(row, ["image_id"], "c", background="8").orderBy("y", "x0").select("y", "x0", "x1", "token", "colour_token")
    assert [tuple(r) for r in got.collect()] == [(0, 0, 1, "L", "Ca"), (0, 2, 3, "L", "Cb"), (0, 5, 5, "D", "Ca"), (1, 0, 0, "D", ""), (1, 5, 5, "D", "")]


def test_profiles_of_each_kind(spark):
    image = spark.createDataFrame([(x, y, 10 * x + y) for x in range(4) for y in range(4)], "x int, y int, val int")
    v = lambda *p: [(float(x), float(y)) for x, y in p]
    rois = spark.createDataFrame(
        [(1, "line", v((0, 0), (2, 0))), (2, "polyline", v((0, 0), (1, 0), (1, 2))), (3, "rectangle", v((1, 0), (3, 0), (3, 2), (1, 2))), (4, "oval", v((0, 0))), (5, None, None), (6, "freeline", [])],
        "roi_id int, kind string, verts array<struct<x: double, y: double>>",
    )
    got = sorted((tuple(r) for r in R.profile(image, rois, []).collect()), key=repr)
    assert got == sorted(
        [(1, 0, 0, 0.0), (1, 0, 1, 10.0), (1, 0, 2, 20.0), (2, 0, 0, 0.0), (2, 1, 0, 10.0), (2, 1, 1, 11.0), (2, 1, 2, 12.0), (3, 0, 1, 10.5), (3, 0, 2, 20.5), (4, None, None, None), (5, None, None, None)], key=repr
    )


def test_get_result_refuses_rows_that_are_not_there(spark):
    df = spark.createDataFrame([(1, 5.0), (2, None)], "at int, v double")
    assert [tuple(L.get_result(df, "v", k, "at").first()) for k in (0, 1, -1)] == [(2, 5.0), (2, None), (2, None)]
    assert tuple(L.get_result(df, "w", 0, "at").first()) == (2, None)
    for bad in (lambda: L.get_result(df, "v", 2, "at").collect(), lambda: L.get_result(df.limit(0), "v", -1, "at").collect(), lambda: L.get_result(df, "w", 2, "at").collect(), lambda: L.get_result(df, "v", -2, "at")):
        with pytest.raises(Exception, match="out of range|is empty"):
            bad()


def test_messages_skip_merges_and_count_a_top_level_name_for_its_module(spark):
    rows = [("modules/a", 3, "s3", 1), ("a", 1, "s1", 1), ("modules/a", 2, "merge", 2), ("src-plugins/B/f", 4, "s4", 1), ("tests/x", 5, "s5", 1), ("c", 6, "s6", 1)]
    commits = spark.createDataFrame(rows, "path string, sha int, subject string, n_parents int").withColumn("committed_at", F.timestamp_seconds("sha"))
    got = H.messages_by_component(commits, "^tests/").select("component", "subject").collect()
    assert [tuple(r) for r in got] == [("B", "s4"), ("Submodule 'a'", "s1"), ("Submodule 'a'", "s3"), ("c", "s6")]


def test_hull_of_a_few_points(spark):
    pts = [(1, x, y) for x, y in ((0, 0), (4, 0), (2, 0), (4, 3), (0, 3), (2, 2), (2, 5), (4, 3))] + [(2, 7, 7)]
    got = R.convex_hull(spark.createDataFrame(pts, "image_id long, x int, y int"), "image_id").orderBy("image_id", "seq").select("image_id", "seq", "x", "y")
    assert [tuple(r) for r in got.collect()] == [(1, 0, 0, 0), (1, 1, 4, 0), (1, 2, 4, 3), (1, 3, 2, 5), (1, 4, 0, 3), (2, 0, 7, 7)]


def test_area_spans_of_pieces_and_holes(spark):
    rnd = random.Random(5)
    ring = lambda n: [(rnd.uniform(-3, 20), rnd.uniform(-3, 15)) for _ in range(n)]
    areas = {k: [ring(rnd.randint(3, 7)) for _ in range(rnd.randint(1, 4))] for k in range(12)}
    areas[12] = [[(0.0, 0.0), (6.0, 0.0), (6.0, 6.0), (0.0, 6.0)], [(2.0, 2.0), (4.0, 2.0), (4.0, 4.0), (2.0, 4.0)], [(9.0, 1.0), (10.0, 1.0), (10.0, 2.0), (9.0, 2.0)]]
    areas[13] = [[(0.2, 0.2), (0.4, 0.2), (0.4, 0.4)], []]  # holds no pixel's centre
    want = set()
    for k, rings in areas.items():
        for x in range(-5, 25):
            for y in range(-5, 20):
                n = 0
                for r in rings:
                    for (ax, ay), (bx, by) in zip(r, r[1:] + r[:1], strict=True):
                        n += (ay > y + 0.5) != (by > y + 0.5) and x + 0.5 < (bx - ax) * (y + 0.5 - ay) / (by - ay) + ax
                if n % 2:
                    want.add((k, x, y))
    df = spark.createDataFrame(list(areas.items()), "roi_id int, rings array<array<struct<x: double, y: double>>>")
    got = [(r.roi_id, x, r.y) for r in R.area_spans(df, ["roi_id"]).collect() for x in range(r.x0, r.x1)]
    assert len(got) == len(set(got)) and set(got) == want


def test_cropped_stack_has_blank_layers_and_zeros_outside(spark):
    stack = spark.createDataFrame([(t, x, y, 100 * t + 10 * x + y) for t in (1, 2, 3) for x in range(4) for y in range(4)], "layer int, x int, y int, val int")
    square = [[(1.0, 1.0), (3.0, 1.0), (3.0, 3.0), (1.0, 3.0)]]
    areas = spark.createDataFrame([(5, 1, square), (5, 3, [square[0], [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 2.0)]])], "roi_id int, layer int, rings array<array<struct<x: double, y: double>>>")
    got = {(r.layer, r.x, r.y): r.val for r in R.crop_masked_stack(stack, areas, "layer").collect()}
    full = {(t, x, y): 100 * t + 10 * x + y for t in (1, 2, 3) for x in (1, 2) for y in (1, 2)}
    assert got == {k: 0 if k[0] == 2 or k == (3, 1, 1) else v for k, v in full.items()}


def test_hull_of_bands_equals_the_hull(spark):
    rnd = random.Random(9)
    pts = [(k, int(rnd.gauss(0, 50)), int(rnd.gauss(0, 50))) for k in range(5) for _ in range(400)]
    df = spark.createDataFrame(pts, "image_id int, x int, y int")
    one = {(r.image_id, r.seq): (r.x, r.y) for r in R.convex_hull(df, "image_id").collect()}
    assert one == {(r.image_id, r.seq): (r.x, r.y) for r in R.convex_hull(df, "image_id", 7).collect()}
    for k in range(5):
        ring = [one[k, i] for i in range(sum(a == k for a, _ in one))]
        inside = lambda a, b, p: (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])
        assert all(inside(a, b, (x, y)) >= 0 for a, b in zip(ring, ring[1:] + ring[:1], strict=True) for i, x, y in pts if i == k)
        assert set(ring) <= {(x, y) for i, x, y in pts if i == k}


def test_closed_spline_passes_its_vertices_at_equal_steps(spark):
    rnd = np.random.default_rng(3)
    for n in (3, 4, 9):
        x, y = rnd.uniform(0, 60, n), rnd.uniform(0, 60, n)
        a = np.eye(n) * 4 + np.roll(np.eye(n), 1, 0) + np.roll(np.eye(n), -1, 0)  # the cyclic system, solved plainly
        t = np.linspace(0, 1, 400, endpoint=False)[None, :]
        dense = []
        for v in (x, y):
            m = np.linalg.solve(a, 6 * (np.roll(v, 1) - 2 * v + np.roll(v, -1)))
            dense.append((v[:, None] * (1 - t) + np.roll(v, -1)[:, None] * t + ((1 - t) ** 3 - (1 - t)) * m[:, None] / 6 + (t**3 - t) * np.roll(m, -1)[:, None] / 6).ravel())
        px, py = R.spline(x, y)
        gap = np.hypot(px[:, None] - dense[0][None], py[:, None] - dense[1][None])
        assert gap.min(axis=1).max() < 0.2  # every point is on the curve
        assert np.hypot(px[:, None] - x[None], py[:, None] - y[None]).min(axis=0).max() < 0.6  # every vertex is met within half a step
        closed = np.hypot(np.diff(dense[0], append=dense[0][0]), np.diff(dense[1], append=dense[1][0])).sum()
        assert len(px) in (math.ceil(closed - 0.1), math.ceil(closed + 0.01))
        steps = np.hypot(np.diff(px, append=px[0]), np.diff(py, append=py[0]))
        assert steps.max() <= 1.001 and np.median(steps) > 0.9
    image = spark.createDataFrame([(x, y, 10 * x + y) for x in range(12) for y in range(12)], "x int, y int, val int")
    v = [(2.0, 2.0), (8.0, 2.0), (8.0, 8.0), (2.0, 8.0)]
    rois = spark.createDataFrame([(1, v), (2, []), (3, None), (4, v[:1])], "roi_id int, verts array<struct<x: double, y: double>>")
    got = {(r.roi_id, r.i): r.val for r in R.spline_profile(image, rois, []).collect()}
    px, py = R.spline(np.array([p[0] for p in v]), np.array([p[1] for p in v]))
    half = lambda c: int(math.floor(c + 0.5))
    assert got == {(1, i): 10 * half(a) + half(b) for i, (a, b) in enumerate(zip(np.round(px, 6), np.round(py, 6), strict=True))} | {(4, 0): 22}


@pytest.mark.parametrize("charset", ["cp1252", "shift_jis", "utf-16-le", "koi8-r", "latin-1", "utf-8", "ascii"])
def test_reencode_reads_all_or_fails(spark, charset):
    text = {"shift_jis": "\u65e5\u672c x", "koi8-r": "\u043f\u0440", "ascii": "plain", "latin-1": "\u00e9\u00df", "cp1252": "\u20ac5"}.get(charset, "a\u00e9\u4e2d")
    df = spark.createDataFrame([(1, text.encode(charset)), (2, b""), (3, None)], "id int, content binary")
    assert {r.id: r.text for r in files.reencode(df, "content", charset).collect()} == {1: text, 2: "", 3: None}
    if charset not in ("latin-1", "koi8-r"):
        bad = spark.createDataFrame([(1, {"utf-16-le": b"abc", "cp1252": b"a\x81"}.get(charset, b"a\xff\xfe"))], "id int, content binary")
        with pytest.raises(Exception, match="bytes that are not"):
            files.reencode(bad, "content", charset).collect()
    with pytest.raises(LookupError):
        files.reencode(df, "content", "no-such-charset")


def test_charset_groups_equal_plain_decoding(spark):
    content = {1: b"plain (text)*", 2: "caf\u00e9".encode(), 3: "caf\u00e9".encode("latin-1"), 4: b"\x80\x99", 5: b"\x81", 6: b"", 7: None}
    charsets = ["utf-8", "ascii", "latin-1", "cp1252"]
    want = {}
    for i, b in content.items():
        for c in charsets if b is not None else []:
            try:
                want.setdefault((i, hashlib.sha256(re.sub(r"[\[\]\\.*^$+?(){}|]", "", b.decode(c)).encode()).hexdigest()), []).append(c)
            except UnicodeDecodeError:
                pass
    df = spark.createDataFrame(list(content.items()), "id int, content binary")
    got = {(r.id, r.text_sha256): r.charsets for r in files.charset_groups(df, "content", charsets).collect()}
    assert got == {k: ",".join(sorted(v)) for k, v in want.items()}


def test_quoted_names_in_texts(spark):
    texts = spark.createDataFrame([(1, '"a" "b" x "c d"'), (2, '"a""a"'), (3, "a"), (4, 'x "q"r" s'), (5, ""), (6, None)], "archive int, text string")
    names = spark.createDataFrame([("a",), ("b",), ("c d",), ('q"r',), ("r",), (" ",)], "name string")
    got = {(r.archive, r.name) for r in L.archives_with_entry(texts, names).collect()}
    assert got == {(i, n) for i, t in ((1, '"a" "b" x "c d"'), (2, '"a""a"'), (4, 'x "q"r" s')) for n in ("a", "b", "c d", 'q"r', "r", " ") if t.find(f'"{n}"') > 0}


def test_resample_of_many_sizes(spark):
    sizes = [(0, 5, 4, 8, 2), (1, 3, 3, 3, 7), (2, 6, 2, 1, 1)]
    px = [(i, x, y, 10 * x + y + i) for i, w, h, _, _ in sizes for x in range(w) for y in range(h)]
    at = {p[:3]: p[3] for p in px}
    df, sized = spark.createDataFrame(px, "image_id int, x int, y int, val int"), spark.createDataFrame(sizes, "image_id int, width int, height int, width_px int, height_px int")
    want = {(i, x, y): at[i, int((x + 0.5) * w / nw), int((y + 0.5) * h / nh)] for i, w, h, nw, nh in sizes for x in range(nw) for y in range(nh)}
    assert {(r.image_id, r.x, r.y): r.val for r in R.resample(df, sized, ["image_id"]).collect()} == want


def test_common_names_meet_once_and_their_rows_are_dealt_to_all_tasks(spark):
    names = spark.createDataFrame([("pkg.a",)] * 300 + [("pkg.b",)] * 2 + [("gone",), (None,)], "name string")
    archives = spark.createDataFrame([("one", "pkg/a.class")] * 300 + [("two", "pkg/b.class"), (None, "pkg/b.class")], "archive string, entry string")
    found = L.locate_class(names, archives, copies=1000)
    rows = {(r.name, r.archive): r.n for r in found.groupBy("name", "archive").agg(F.count("*").alias("n")).collect()}
    assert rows == {("pkg.a", "one"): 90_000, ("pkg.b", "two"): 2, ("pkg.b", "not found: pkg.b"): 2, ("gone", "not found: gone"): 1, (None, None): 1}
    tasks = [r.n for r in found.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert max(tasks) < 30_000  # all 90,000 rows in one task before


def joins(df):
    """Kinds of the joins in the plan, and the side that is broadcast."""
    return re.findall(r"(SortMergeJoin|BroadcastHashJoin|BroadcastNestedLoopJoin)[^\n]*?(BuildLeft|BuildRight|$)", df._jdf.queryExecution().executedPlan().toString(), re.M)


def test_points_of_outlines_are_not_broadcast(spark):
    px = view(spark, SF, "px").select("image_id", "x", "y", "val")
    rois = view(spark, SF, "rois").select("roi_id", "image_id", R.rectangle("x0", "y0", "x1", "y1").alias("verts"))
    assert joins(R.outline_profile(px, rois, ["image_id"], on=("image_id",))) == [("SortMergeJoin", "")]
    asked = R.outline_profile(F.broadcast(px), rois, ["image_id"], on=("image_id",))  # as the live profile does with a small image
    assert joins(asked) == [("BroadcastHashJoin", "BuildRight")]


def test_points_of_splines_are_not_broadcast(spark):
    px = view(spark, SF, "px").select("image_id", "x", "y", "val")
    rois = view(spark, SF, "rois").select("roi_id", "image_id", R.rectangle("x0", "y0", "x1", "y1").alias("verts"))
    assert joins(R.spline_profile(px, rois, ["image_id"], on=("image_id",))) == [("SortMergeJoin", "")]


def test_spans_of_areas_are_not_broadcast(spark):
    stack = view(spark, SF, "stack").select(F.col("stack_id").alias("roi_id"), F.col("t").alias("layer"), "x", "y", "val")
    rings = F.array(R.rectangle("x0", "y0", "x1", "y1"))
    areas = view(spark, SF, "rois").select(F.expr("roi_id div 10").alias("roi_id"), (F.col("roi_id") % 10 + 1).cast("int").alias("layer"), rings.alias("rings"))
    assert joins(R.crop_masked_stack(stack, areas, "layer", on=("roi_id",))) == [("SortMergeJoin", "")] * 2


def test_closure_of_many_roots_goes_along_an_edge_once_a_group(spark):
    rnd = random.Random(5)
    names = [f"n{i}" for i in range(600)]
    pairs = {(a, rnd.choice(names)) for a in names[:500] for _ in range(2)} | {("tail", "n0"), ("tip", "tail")}
    up: dict = {}
    for src, dst in pairs:
        up.setdefault(dst, []).append(src)
    want = set()
    for root in names:
        todo, met = [root], {root}
        while todo:
            todo = [s for f in todo for s in up.get(f, []) if s not in met and not met.add(s)]
        want |= {(root, f) for f in met}
    work = Workspace(spark, "t")
    got = L.transitive_dependents(spark.createDataFrame(sorted(pairs), "src string, dst string"), spark.createDataFrame([(n,) for n in [*names, "n1"]], "root string"), work).collect()
    assert len(got) == len(want) and {(r.root, r.file) for r in got} == want
    groups = spark.read.parquet(f"{work.path}/roots").select("_g").distinct().count()
    assert groups == 2
    for step in range(1, 4):  # a row for each root before
        assert spark.read.parquet(f"{work.path}/front-{step}").count() <= 602 * groups


def test_files_are_listed_by_tasks(spark, tmp_path):
    for name in ("a b/c%20d.JPG", "a b/deep/e.jpg", "a b/_no/f.jpg", "a b/.g.jpg", "h.txt", "i.jpg", "_SUCCESS"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * len(name))
    os.utime(tmp_path / "i.jpg", (1_700_000_000.25,) * 2)
    plain = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(tmp_path)).select("path", "length", "modificationTime")
    for root in (str(tmp_path), f"file://{tmp_path}"):
        found = files.list_files(spark, root, [".jpg"])
        assert sorted(found.select("path", "length").collect()) == sorted(plain.filter("lower(path) like '%.jpg'").select("path", "length").collect())
        assert found.filter("path like '%i.jpg'").first().modificationTime == plain.filter("path like '%i.jpg'").first().modificationTime
        assert found.count() == 3 and files.list_files(spark, root, [".txt"]).count() == 1
        assert not any("i.jpg" in f for f in found.inputFiles())  # the driver held each file's name before
