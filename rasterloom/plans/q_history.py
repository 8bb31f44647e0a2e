"""Queries of histories, clocks and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import history as H
from ..streaming import streams as T
from ..workspace import Workspace
from .fixtures import duck, view
from .q_raster import PROFILES, profiled_regions
from .registry import query


def _commits(spark, d):
    return view(spark, d, "commits")


@query(duck("select cast(sum(added) as bigint) added, cast(sum(removed) as bigint) removed from commits", "commits"))
def change_totals(spark, d):
    return H.change_totals(_commits(spark, d))


@query(duck("select author, count(*) n from commits group by 1", "commits"))
def commits_per_author(spark, d):
    return H.commits_per_author(_commits(spark, d))


@query("with a as (select unnest(regexp_extract_all(text, '([A-Z][a-z]+) ', 1)) author from documents) select author, count(*) n from a group by 1")
def author_tags(spark, d):
    return H.author_tags(view(spark, d, "documents"), "([A-Z][a-z]+) ")


@query(duck("select author, count(*) n from commits where committed_at >= (select max(committed_at) from commits) - interval 3 day group by 1", "commits"))
def recent_maintainers(spark, d):
    return H.recent_maintainers(_commits(spark, d), 3)


@query(duck("select repo, author as founder from commits qualify row_number() over (partition by repo order by committed_at, sha) = 1", "commits"))
def founder(spark, d):
    return H.founder(_commits(spark, d))


@query(duck("""with c as (select *, regexp_extract(path, '^([^/]*/?[^/]*)', 1) c from changes where n_parents < 2 and not regexp_matches(path, '^tests/')),
m as (select distinct replace(c, 'modules/', '') c, c as module from c where starts_with(c, 'modules/'))
select distinct regexp_replace(regexp_replace(coalesce(module, c.c), '^src-plugins/', ''), '^modules/(.*)$', 'Submodule ' || chr(39) || '\\1' || chr(39)) component, committed_at, sha, subject from c left join m on m.c = c.c""", "changes"))
def messages_by_component(spark, d):
    return H.messages_by_component(view(spark, d, "changes"), "^tests/")


@query(duck("select repo, sha, max(committed_at) over (partition by repo order by sha) merged_at from commits", "commits"))
def merge_logs(spark, d):
    return H.merge_logs(_commits(spark, d), Workspace(spark, "logs"))


@query(duck("select sha, author, 'old' as era from commits where sha % 2 = 0 union all select sha, author, 'recent' from commits where sha % 2 = 1", "commits"))
def union_histories(spark, d):
    c = _commits(spark, d).select("sha", "author")
    return H.union_histories(c.filter("sha % 2 = 0").withColumn("era", F.lit("old")), c.filter("sha % 2 = 1").withColumn("era", F.lit("recent")))


_HEADS = """c as (select * replace (case repo when 'repo_signup' then 'debian-signup' when 'repo_view' then 'contrib' when 'repo_error' then 'main' else repo end as repo)
from changes), heads as (select repo, sha
from c
where repo <> 'main' and not starts_with(repo, 'debian-')
qualify row_number() over (partition by repo
order by committed_at desc, sha desc) = 1), main as (select sha
from changes
where added >= 10)"""


def _branches(spark, d):
    """Changes on topic branches, main, a packaging branch and contributions."""
    repo = F.col("repo")
    return view(spark, d, "changes").withColumn("repo", F.when(repo == "repo_signup", "debian-signup").when(repo == "repo_view", "contrib").when(repo == "repo_error", "main").otherwise(repo))


def _main(commits):
    return commits.filter("added >= 10").select("sha")


@query(duck(f"with {_HEADS} select repo, sha from heads where repo <> 'contrib' and sha in (select sha from main)", "changes"))
def merged_branches(spark, d):
    c = _branches(spark, d)
    return H.merged_branches(H.branch_heads(c), _main(c)).select("repo", "sha")


@query(duck(f"with {_HEADS} select repo, sha, author, subject from c where repo in (select repo from heads where sha not in (select sha from main)) and sha not in (select sha from main)", "changes"))
def unmerged_branches(spark, d):
    c = _branches(spark, d)
    return H.unmerged_branches(H.branch_heads(c), _main(c), c)


@query(duck("""select u.component, sha, author
from commits c
join uploads u on u.component = regexp_extract(path, '^([^/]*/[^/]*)', 1)
where committed_at > uploaded_at - interval 5 minute""", "commits", "uploads"))
def commits_since_upload(spark, d):
    return H.commits_since_upload(_commits(spark, d), view(spark, d, "uploads"), 5)


@query(duck("select user_id, event_id, round((epoch_us(ts) - min(epoch_us(ts)) over (partition by user_id)) / 1e6::double, 3) label from frames", "frames"))
def frame_clock(spark, d):
    return H.frame_clock(view(spark, d, "frames"), Workspace(spark, "clock")).select("user_id", "event_id", "label")


@query(duck("""select user_id, event_id
from (select *, row_number() over (partition by user_id
order by ts, event_id) i, (epoch_us(ts) - min(epoch_us(ts)) over (partition by user_id)) / 1e6::double s
from frames)
where i <= 7 and s <= 500000""", "frames"))
def frame_limit(spark, d):
    return H.frame_limit(view(spark, d, "frames"), 7, 500000.0).select("user_id", "event_id")


@query(duck("""with recursive o as (select user_id, event_id, epoch_us(ts) us, row_number() over (partition by user_id order by ts, event_id) i from frames),
k(user_id, i, event_id, us, last, kept) as (select user_id, i, event_id, us, us, true from o where i = 1
 union all select o.user_id, o.i, o.event_id, o.us, case when o.us - k.last >= 3600000000 then o.us else k.last end, o.us - k.last >= 3600000000 from k join o on o.user_id = k.user_id and o.i = k.i + 1)
select user_id, event_id, us from k where kept""", "frames"))
def throttle_frames(spark, d):
    return H.throttle_frames(view(spark, d, "frames"), 3600.0, Workspace(spark, "throttle"))


#: Feeds of lines, newest first: a headline stands above each run of changes.
_LINES = "select user_id % 20 feed, -event_id line_no, event_id, case when event_id % 8 = 7 then concat('Day ', cast(floor(event_id / 200) as bigint)) else concat('\t', event_id, ' by user', user_id, ' ') end line from events"
_OLD = "(select max(event_id) from events) * (feed % 3 + 1) / 4"


@query(f"""with l as ({_LINES.replace("/ 200", "/ 200.0")}), n as (select feed, line_no, trim(line, chr(9) || ' ') t, row_number() over (partition by feed order by line_no) i from l),
o as (select feed, trim(line, chr(9) || ' ') t, row_number() over (partition by feed order by line_no) i from l where event_id <= {_OLD} and feed % 5 <> 0),
s as (select feed, max(t) filter (i = 1) a, max(t) filter (i = 2) b from o group by feed), h as (select feed, max(t) filter (i = 1) a, max(t) filter (i = 2) b from n group by feed),
c as (select h.feed, case when h.a = s.a then s.b else s.a end stop, h.a = s.a and h.b is not distinct from s.b seen from h join s using (feed)),
k as (select c.feed, seen, min(line_no) filter (t = stop) at_line from c join n using (feed) group by all)
select l.feed, l.line_no, l.line from l left join k using (feed) where not coalesce(seen, false) and (at_line is null or l.line_no < at_line)""")
def new_changes(spark, d):
    events = view(spark, d, "events")
    lines = spark.sql(_LINES.replace("from events", "from {events}"), events=events)
    old = lines.crossJoin(F.broadcast(events.agg(F.max("event_id").alias("last")))).filter("event_id <= last * (feed % 3 + 1) / 4 and feed % 5 <> 0")  # one row
    return T.new_changes(lines.select("feed", "line_no", "line"), T.markers(old))


@query(duck(PROFILES.format(key="", image="(select x, y, val from px where image_id = 0)", on="", none=""), "px", "rois"))
def live_profile(spark, d):
    image = view(spark, d, "px").filter("image_id = 0").select("x", "y", "val")
    return T.live_profile(profiled_regions(spark, d), image)
