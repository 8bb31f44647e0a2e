"""Queries of the relational jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import relational as L
from ..workspace import Workspace
from .fixtures import duck, view
from .registry import query


@query(duck("""with n as (select p_partkey, case when p_partkey % 5 = 0 then concat('gone.C', p_partkey) else concat('pkg.', replace(p_name, ' ', '.')) end as name
from part) select n.name, coalesce(archive, concat('not found: ', n.name)) archive
from n
left
join archives a on a.entry = concat(replace(n.name, '.', '/'), '.class')""", "archives"))
def locate_class(spark, d):
    name = F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("gone.C"), F.col("p_partkey"))).otherwise(F.concat(F.lit("pkg."), F.replace("p_name", F.lit(" "), F.lit("."))))
    return L.locate_class(view(spark, d, "part").select(name.alias("name")), view(spark, d, "archives"))


@query(duck("select entry, count(distinct archive) n from archives group by entry having count(distinct archive) > 1", "archives"))
def shadowed_classes(spark, d):
    return L.shadowed_classes(view(spark, d, "archives"))


@query(duck("""with a as (select archive, string_agg(concat('x "', entry, '"'), ';' order by entry) t from archives group by archive), n as (select distinct entry as name from archives) select archive, name from a join n on instr(t, concat('"', name, '"')) > 1""", "archives"))
def archives_with_entry(spark, d):
    base = view(spark, d, "archives")
    texts = base.groupBy("archive").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit('x "'), "entry", F.lit('"')))), ";").alias("text"))
    names = base.select(F.col("entry").alias("name")).distinct()
    return L.archives_with_entry(texts, names)


@query(duck("with f as (select distinct concat('lib', p_partkey) file from part) select f.file, coalesce(dst, 'Not found') dependency from f left join edges on src = f.file", "edges"))
def direct_dependencies(spark, d):
    files = view(spark, d, "part").select(F.concat(F.lit("lib"), "p_partkey").alias("file")).distinct()
    return L.direct_dependencies(files, view(spark, d, "edges"))


@query(duck("""with recursive up(root, file) as (select concat('lib', s_suppkey), concat('lib', s_suppkey)
from supplier
where s_suppkey % 50 = 0 union select root, src
from up
join edges on dst = file) select root, file
from up""", "edges"))
def transitive_dependents(spark, d):
    roots = view(spark, d, "supplier").filter("s_suppkey % 50 = 0").select(F.concat(F.lit("lib"), "s_suppkey").alias("root"))
    return L.transitive_dependents(view(spark, d, "edges"), roots, Workspace(spark, "closure"))


@query(duck("select dst, string_agg(src, ',' order by src) dependents from edges group by dst", "edges"))
def reverse_index(spark, d):
    return L.reverse_index(view(spark, d, "edges"))


@query(duck("""with known as (select distinct tok, concat('org.', lower(left(tok, 1))) package from tokens where length(tok) < 6), imp as (select distinct doc_id, tok from tokens where doc_id % 3 = 0 and length(tok) = 4),
m as (select t.doc_id, t.tok from tokens t anti join imp on imp.doc_id = t.doc_id and imp.tok = t.tok) select doc_id, package, string_agg(m.tok, ',' order by m.tok) names from m join known on known.tok = m.tok group by all""", "tokens"))
def missing_imports(spark, d):
    tokens = view(spark, d, "tokens")
    known = tokens.filter("length(tok) < 6").select(F.col("tok").alias("name"), F.concat(F.lit("org."), F.lower(F.substring("tok", 1, 1))).alias("package")).distinct()
    return L.missing_imports(tokens, tokens.filter("doc_id % 3 = 0 and length(tok) = 4"), known)


@query(duck("""select distinct concat('/m', doc_id % 5, '/', case when length(tok) = 5 then concat('#', tok) else tok end) line
from tokens
where length(tok) <> 5 except select concat('/m1/', tok)
from tokens""", "tokens"))
def new_ignore_rules(spark, d):
    tokens = view(spark, d, "tokens")
    rules = tokens.select(F.concat(F.lit("m"), F.col("doc_id") % 5).alias("module"), F.when(F.length("tok") == 5, F.concat(F.lit("#"), "tok")).otherwise(F.col("tok")).alias("line"))
    return L.new_ignore_rules(rules, tokens.select(F.concat(F.lit("/m1/"), "tok").alias("line")))


@query(duck("""with p as (select menu_path, name
from catalog
where entry_id % 10 <> 0), g as (select menu_path, name
from catalog
where entry_id % 13 <> 0) select *, '+' as change
from (select *
from g except all select *
from p)
union all select *, '-'
from (select *
from p except all select *
from g)""", "catalog"))
def listing_diff(spark, d):
    c = view(spark, d, "catalog")
    return L.listing_diff(c.filter("entry_id % 10 <> 0").select("menu_path", "name"), c.filter("entry_id % 13 <> 0").select("menu_path", "name"))


_TREE = """select distinct array_to_string(p[1:i], '>') path, case when i > 1 then array_to_string(p[1:i-1], '>') end as parent
from (select p, unnest(range(1, len(p) + 1)) i
from (select string_split(menu_path, '>') p
from catalog))"""


@query(duck(_TREE, "catalog"))
def menu_tree(spark, d):
    paths = view(spark, d, "catalog").withColumn("menu_path", F.when(F.col("entry_id") % 2 == 0, F.concat("menu_path", F.lit(">"))).otherwise(F.col("menu_path")))
    return L.menu_tree(paths)


@query(duck("select entry_id, name, first_id as kept_id from (select *, min(entry_id) over (partition by name) first_id from catalog) where entry_id > first_id", "catalog"))
def name_conflicts(spark, d):
    return L.name_conflicts(view(spark, d, "catalog"))


@query(duck(f"""select concat(replace(path, '>', '>~'), '>!') as key, '' as name, concat(repeat('=', len(string_split(path, '>'))), ' ', regexp_replace(path, '^.*>', ''), ' ', repeat('=', len(string_split(path, '>')))) line from ({_TREE})
union all select concat(replace(menu_path, '>', '>~'), '>!'), name, concat('* ', name) from catalog""", "catalog"))
def render_listing(spark, d):
    return L.render_listing(view(spark, d, "catalog"))


_ITEMS = "it as (select case when pos = 0 then 'Package' else 'Plugin' end kind, href from page_links), doc as (select href from page_links where page_id % 3 = 0)"


def _items(links):
    return links.select(F.when(F.col("pos") == 0, "package").otherwise("plugin").alias("kind"), "href")


@query(duck(f"with {_ITEMS} select distinct kind || 's without documentation page' as list, href from it where href not in (select href from doc)", "page_links"))
def undocumented(spark, d):
    links = view(spark, d, "page_links")
    return L.undocumented(_items(links), links.filter("page_id % 3 = 0"))


def _maintainers(links):
    return links.groupBy("href").agg(F.min("page_id").alias("p")).select("href", F.when(F.col("p") % 4 != 0, F.concat(F.lit("user"), F.col("p") % 17)).alias("maintainer"))


_MAINTAINERS = "mt as (select href, case when min(page_id) % 4 <> 0 then concat('user', min(page_id) % 17) end maintainer from page_links group by href)"


@query(duck(f"with {_ITEMS}, {_MAINTAINERS} select distinct kind || 's without maintainer' as list, href from it where href in (select href from doc) and href not in (select href from mt where maintainer is not null)", "page_links"))
def unmaintained(spark, d):
    links = view(spark, d, "page_links")
    return L.unmaintained(_items(links), links.filter("page_id % 3 = 0"), _maintainers(links))


@query(duck(f"with {_MAINTAINERS}, it as (select distinct maintainer, case when pos = 0 then 'package' else 'plugin' end kind, l.href item from page_links l join mt on mt.href = l.href where maintainer is not null) select maintainer, kind, string_agg(item, ',' order by item) items from it group by all", "page_links"))
def items_by_maintainer(spark, d):
    links = view(spark, d, "page_links")
    items = links.join(_maintainers(links), "href").select("maintainer", F.when(F.col("pos") == 0, "package").otherwise("plugin").alias("kind"), F.col("href").alias("item"))
    return L.items_by_maintainer(items)


@query(duck("select left(href, 3) as package, page_id, pos from page_links qualify row_number() over (partition by left(href, 3) order by page_id, pos) = 1", "page_links"))
def first_package(spark, d):
    return L.first_package(view(spark, d, "page_links").withColumn("package", F.substring("href", 1, 3)))


@query("""with n as (select distinct p_name as old, replace(p_name, ' ', '_') as new
from part union select distinct replace(p_name, ' ', '_'), replace(p_name, ' ', '_')
from part
where p_partkey % 6 = 0) select old, new, new in (select old
from n) as collides
from n
where old <> new""")
def rename_collisions(spark, d):
    part = view(spark, d, "part")
    names = part.select("p_name").union(part.filter("p_partkey % 6 = 0").select(S.sanitized(F.col("p_name"))))
    return L.rename_plan(names, "p_name", S.sanitized(F.col("p_name")))


@query(duck("""with c as (select regexp_replace(path, '-[0-9]{14}$', '') file, checksum
from files), k as (select *
from c
where length(file) % 2 = 0), n as (select *
from c anti
join k on k.file = c.file and k.checksum = c.checksum) select file, checksum, case when file in (select file
from k) then 'add' else 'ignore' end as action
from n""", "files"))
def missing_versions(spark, d):
    c = view(spark, d, "files").select(F.regexp_replace("path", "-[0-9]{14}$", "").alias("file"), "checksum")
    return L.missing_versions(c, c.filter("length(file) % 2 = 0"))


@query(duck("""with l as (select distinct z, cast(z + 1 as int) layer_id
from balls
where z < 3), n as (select z, cast((select max(layer_id)
from l) + row_number() over (order by z) as int) layer_id
from (select distinct z
from balls
where z >= 3)) select object_id, seq, x, y, b.z, r, layer_id
from balls b
join (select *
from l
union all select *
from n) a on a.z = b.z""", "balls"))
def ensure_layers(spark, d):
    balls = view(spark, d, "balls")
    layers = balls.filter("z < 3").select("z", (F.col("z") + 1).cast("int").alias("layer_id")).distinct()
    return L.ensure_layers(balls, layers)


@query(duck("select (select count(*) from px) as n_rows, val as value from px order by image_id * 64 + y * 8 + x desc limit 1", "px"))
def get_result(spark, d):
    px = view(spark, d, "px").withColumn("row", F.col("image_id") * 64 + F.col("y") * 8 + F.col("x"))
    return L.get_result(px, "val", -1, "row")


@query("""with p as (select l_orderkey, l_linenumber i, row_number() over (partition by l_orderkey
order by l_extendedprice, l_linenumber) p, count(*) over (partition by l_orderkey) n
from lineitem) select l_orderkey, cast(sum(case when p > 1 and p < n then abs(i - p) else 0 end) as bigint) displacement
from p
group by 1""")
def rank_displacement(spark, d):
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_extendedprice", "l_linenumber"))
    return L.rank_displacement(view(spark, d, "lineitem"), "l_orderkey", "l_linenumber", place)
