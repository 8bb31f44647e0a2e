"""Commit histories, uploads and frame clocks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..workspace import Workspace
from . import scans
from .throttling import throttle_frames  # noqa: F401  one of the clocks


def change_totals(commits: DataFrame) -> DataFrame:
    """Lines added and removed; entries without numbers (binary files) do not count."""
    return commits.agg(F.sum("added").cast("long").alias("added"), F.sum("removed").cast("long").alias("removed"))


def commits_per_author(commits: DataFrame) -> DataFrame:
    return commits.groupBy("author").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "author")


def author_tags(text: DataFrame, pattern: str) -> DataFrame:
    return text.select(F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(1))).alias("author")).groupBy("author").agg(F.count("*").alias("n"))


def recent_maintainers(commits: DataFrame, days: int = 60) -> DataFrame:
    """Commits by author in the days up to the last commit."""
    last = commits.agg(F.max("committed_at").alias("_until"))  # one row
    recent = commits.crossJoin(F.broadcast(last)).filter(F.col("committed_at") >= F.col("_until") - F.make_dt_interval(F.lit(days)))
    return recent.groupBy("author").agg(F.count("*").alias("n"))


def founder(commits: DataFrame) -> DataFrame:
    """Author of the oldest commit of each repository; ties go to the lowest sha."""
    return commits.groupBy("repo").agg(F.min_by("author", F.struct("committed_at", "sha")).alias("founder"))


def component(path: Column) -> Column:
    return F.substring_index(path, "/", 2)


def messages_by_component(commits: DataFrame, excluded: str) -> DataFrame:
    """(component, committed_at, sha, subject): what was done to each component, oldest first.

    Left out are merges (more than one parent), paths that ``excluded`` matches, and top-level
    names that are modules too, whose commits count for the module.  Components that were only
    touched through excluded paths do not appear.  A row for each message, so that a busy
    component is split by the sort as any other.
    """
    c = commits.filter("n_parents < 2").filter(~F.col("path").rlike(excluded)).withColumn("_c", component(F.col("path")))
    modules = c.filter(F.col("_c").startswith("modules/")).select(F.substring_index("_c", "/", -1).alias("_c"), F.col("_c").alias("_module")).distinct()
    c = c.join(modules, "_c", "left").withColumn("_c", F.coalesce("_module", "_c"))
    label = F.regexp_replace(F.regexp_replace("_c", "^src-plugins/", ""), "^modules/(.*)$", "Submodule '$1'")
    told = c.select(label.alias("component"), "committed_at", "sha", "subject").distinct()
    return told.orderBy("component", "committed_at", "sha", "subject")


def merge_logs(commits: DataFrame, work: Workspace) -> DataFrame:
    """Place of each commit in the merged log: by the running latest time of its repository, then repository, then own order.

    The running time is a scan over range partitions, so one large repository is many tasks.
    """
    run = scans.running(commits.select("repo", "sha", "committed_at"), ["repo"], [F.col("sha")], {"merged_at": (F.max, "committed_at")}, work, "logs")
    return run.orderBy("merged_at", "repo", "sha").select("repo", "sha", "merged_at")


def union_histories(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def branch_heads(commits: DataFrame) -> DataFrame:
    return commits.groupBy("repo").agg(F.max_by("sha", F.struct("committed_at", "sha")).alias("sha"))


def topic_branches(heads: DataFrame) -> DataFrame:
    """Heads of neither main nor packaging branches."""
    return heads.filter((F.col("repo") != "main") & ~F.col("repo").startswith("debian-"))


def merged_branches(heads: DataFrame, main: DataFrame, left_out: str = "contrib") -> DataFrame:
    """Topic branches whose head is one of main's commits (repo, sha), which is when the merge base is the head."""
    return topic_branches(heads).filter(F.col("repo") != left_out).join(main.select("sha"), "sha", "left_semi")


def unmerged_branches(heads: DataFrame, main: DataFrame, commits: DataFrame) -> DataFrame:
    """(repo, sha, author, subject) of the commits that are not in main, for topic branches whose head is not."""
    open_ = topic_branches(heads).join(main.select("sha"), "sha", "left_anti").select("repo")
    return commits.join(open_, "repo", "left_semi").join(main.select("sha"), "sha", "left_anti").select("repo", "sha", "author", "subject")


def commits_since_upload(commits: DataFrame, uploads: DataFrame, fuzz_minutes: int) -> DataFrame:
    """Commits that touch a component after its last upload, less some minutes."""
    c = commits.withColumn("component", component(F.col("path"))).join(uploads, "component")
    return c.filter(F.col("committed_at") > F.col("uploaded_at") - F.make_dt_interval(mins=F.lit(fuzz_minutes))).select("component", "sha", "author")


def frame_clock(frames: DataFrame, work: Workspace, key: str = "user_id") -> DataFrame:
    """Seconds since the first frame of the key, 3 decimals: the least time so far is a scan over range partitions."""
    run = scans.running(frames.withColumn("_us", F.unix_micros("ts")), [key], [F.col("ts"), F.col("event_id")], {"_first": (F.min, "_us")}, work, "clock")
    return run.withColumn("label", F.round((F.col("_us") - F.col("_first")) / 1e6, 3)).drop("_us", "_first")


def frame_limit(frames: DataFrame, n: int, seconds: float, key: str = "user_id") -> DataFrame:
    """The first n frames of each key within so many seconds; 0 is no limit."""
    w = Window.partitionBy(key).orderBy("ts", "event_id")
    out = frames.withColumn("_i", F.row_number().over(w)).withColumn("_s", (F.unix_micros("ts") - F.min(F.unix_micros("ts")).over(Window.partitionBy(key))) / 1e6)
    return out.filter(((F.lit(n) == 0) | (F.col("_i") <= n)) & ((F.lit(seconds) == 0) | (F.col("_s") <= seconds))).drop("_i", "_s")
