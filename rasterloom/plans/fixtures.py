"""Views over the given tables that the queries work on, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: name: (Spark SQL, DuckDB SQL); a view may use those before it.
VIEWS: dict[str, tuple[str, str]] = {
    "px": (
        """select vec_id image_id, label, cast(p % 8 as int) x, cast(p div 8 as int) y, cast(least(255,greatest(0,floor((cast(v as double)+0.5)*255))) as int) val
from (select vec_id,label,posexplode(embedding) as (p,v)
from embeddings)""",
        """select image_id,label,cast(p % 8 as int) x, cast(p // 8 as int) y, cast(least(255,greatest(0,floor((v::double+0.5)*255))) as int) val
from (select vec_id image_id,label,generate_subscripts(embedding,1)-1 p,unnest(embedding) v
from embeddings)""",
    ),
    "stack": (
        "select image_id div 10 stack_id, cast(image_id % 10 + 1 as int) t, x, y, val from px",
        "select image_id // 10 stack_id, cast(image_id % 10 + 1 as int) t, x, y, val from px",
    ),
    "rgb": (
        """select image_id div 3 image_id, x, y, max(case when image_id%3=0 then val end) r, max(case when image_id%3=1 then val end) g, max(case when image_id%3=2 then val end) b
from px
group by image_id div 3,x,y
having count(*)=3""",
        """select px.image_id // 3 image_id, x, y, max(case when px.image_id%3=0 then val end) r, max(case when px.image_id%3=1 then val end) g,
max(case when px.image_id%3=2 then val end) b
from px
group by px.image_id // 3,x,y
having count(*)=3""",
    ),
    "luts": (
        """select 'grays' lut, cast(id as int) idx, cast(id as int) r, cast(id as int) g, cast(id as int) b
from range(256)
union all select 'tri', cast(id as int), cast(id as int), cast(255-id as int), cast((id*2)%256 as int)
from range(256)""",
        """select 'grays' lut, cast(id as int) idx, cast(id as int) r, cast(id as int) g, cast(id as int) b
from range(256) q(id)
union all select 'tri', cast(id as int), cast(id as int), cast(255-id as int), cast((id*2)%256 as int)
from range(256) q(id)""",
    ),
    "commits": (
        *[
            """select event_id sha, concat('repo_', event_type) repo, concat('user', user_id) author, ts committed_at, cast(floor(value) as bigint) added,
cast(regexp_extract(props,'([0-9]+)',1) as bigint) removed, concat('dir',user_id%7,'/mod',user_id%11,'/f',event_id%5,'.txt') path
from events"""
        ]
        * 2,
    ),
    "changes": (
        *[
            """select event_id sha, concat('repo_', event_type) repo, concat('user', user_id) author, ts committed_at, cast(floor(value) as bigint) added, concat('Change ',
event_id % 97, ' of ', event_type) subject, case when event_id % 10 = 0 then 2 else 1 end n_parents, case event_id % 4 when 0 then concat('modules/m',
user_id % 11) when 1 then concat('src-plugins/P', user_id % 7, '/f', event_id % 5, '.txt') when 2 then concat('m', user_id % 13) else concat('tests/t',
user_id % 5) end path
from events"""
        ]
        * 2,
    ),
    "uploads": (
        *["select concat('dir',user_id%7,'/mod',user_id%11) component, max(ts) uploaded_at from events where event_type='signup' group by concat('dir',user_id%7,'/mod',user_id%11)"] * 2,
    ),
    "edges": (*["select distinct concat('lib',l_suppkey) src, concat('lib',l_partkey % (select count(*) from supplier)) dst from lineitem"] * 2,),
    "archives": (*["select p_brand archive, concat('pkg/', replace(p_name,' ','/'), '.class') entry from part"] * 2,),
    "catalog": (
        """select p_partkey entry_id, concat(p_brand,'>',p_type,'>',split(p_name,' ')[0]) menu_path, replace(p_name,' ','_') name,
case when p_size%3=0 then '.py' when p_size%3=1 then '.txt' else '.jar' end ext
from part""",
        """select p_partkey entry_id, concat(p_brand,'>',p_type,'>',split_part(p_name,' ',1)) menu_path, replace(p_name,' ','_') name,
case when p_size%3=0 then '.py' when p_size%3=1 then '.txt' else '.jar' end ext
from part""",
    ),
    "rois": (*["""select p_partkey roi_id, p_partkey % (select count(*)
from embeddings) image_id, cast(p_size%5 as int) x0, cast(p_size%4 as int) y0, cast(p_size%5+1+p_partkey%3 as int) x1, cast(p_size%4+1+p_partkey%4 as int) y1
from part"""] * 2,),
    "page_links": (
        """select page_id, href, cast(pos as int) pos from (select page_id, posexplode(regexp_extract_all(html,'<li><a href="([^"]*)"',1)) as (pos,href) from pages)""",
        """select page_id, href, cast(pos as int) pos from (select page_id, unnest(l) href, generate_subscripts(l,1)-1 pos from (select page_id, regexp_extract_all(html,'<li><a href="([^"]*)"',1) l from pages))""",
    ),
    "tokens": (
        "select distinct doc_id, tok from (select doc_id, explode(regexp_extract_all(text,'([A-Z][a-z]+)',1)) tok from documents)",
        "select distinct doc_id, tok from (select doc_id, unnest(regexp_extract_all(text,'([A-Z][a-z]+)',1)) tok from documents)",
    ),
    "files": (
        "select doc_id, concat(source,'/',lang,'-',date_format(timestamp_seconds(1700000000+doc_id),'yyyyMMddHHmmss')) path, sha2(text,256) checksum from documents",
        "select doc_id, concat(source,'/',lang,'-',strftime(make_timestamp((1700000000+doc_id)*1000000),'%Y%m%d%H%M%S')) path, sha256(text) checksum from documents",
    ),
    "frames": ("select user_id, event_id, cast(ts as timestamp) ts from events", "select user_id, event_id, ts from events"),
    "images": (*["select p_partkey image_id, cast(p_size * 10 as int) width, cast(p_partkey % 50 + 1 as int) height, concat(p_brand, ' ', p_name) title from part where p_size > 0"] * 2,),
    "balls": (*["select p_brand object_id, p_partkey seq, cast(p_size as double) x, cast(p_partkey % 100 as double) y, cast(p_size % 7 as int) z, p_retailprice / 100 r from part"] * 2,),
    "points": (*["select image_id, x, y from px where val > 180"] * 2,),
}

NEEDS = {"stack": ["px"], "rgb": ["px"], "points": ["px"]}
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view, or a given table, as a DataFrame; nothing is registered under a name."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = VIEWS[name][0]
    parts = {n: view(spark, sf_dir, n) for n in [*NEEDS.get(name, []), *TABLES] if _mentions(sql, n)}
    for n in parts:
        sql = _named(sql, n)
    return spark.sql(sql, **parts)


def _mentions(sql: str, name: str) -> bool:
    return f"from {name}" in sql


def _named(sql: str, name: str) -> str:
    import re

    return re.sub(rf"from {name}\b", f"from {{{name}}}", sql)


def duck(body: str, *names: str) -> str:
    """DuckDB SQL: ``body`` over the named views."""
    need: list[str] = []
    for n in names:
        for x in [*NEEDS.get(n, []), n]:
            if x not in need:
                need.append(x)
    body = body.strip()
    views = ", ".join(f"{n} as ({VIEWS[n][1]})" for n in need)
    if not views:
        return body
    if body.lower().startswith("with recursive "):
        return f"with recursive {views}, {body[15:]}"
    return f"with {views}, {body[5:]}" if body.lower().startswith("with ") else f"with {views} {body}"
