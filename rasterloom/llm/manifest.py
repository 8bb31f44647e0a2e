"""Merkle manifest of a dataset: a tree of sha-256 hashes a source, one over the sources, and a proof a document.

Documents are ranked within their source, and the base-16 digits of the rank are grouped away
one after the other inside blocks of 16^3 nodes: a block is one row with its nodes in nested
structs, three levels deep.  The heads of the blocks are nodes of the next stage, until a tree
is one block; the trees' heads make a tree of their own.  Then the way down: the path above a
block is put beside it (two rows of one key, grouped, so no join), and transforms and explodes
of the nested structs give every node its path.  A row is bounded by 16^3 nodes, a task by its rows,
and a stage is 4,096 times smaller than the one below.

Defined cases: null and empty values differ (``-`` and ``0:``); null and the empty string are
sources of their own, null first; documents of one doc_id follow each other by leaf, a null doc_id
comes first; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import scans
from ..workspace import Workspace

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FAN_OUT = 16
BLOCK = FAN_OUT**3


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf(fields: list[Column]) -> Column:
    """The hash of a row's fields, each ``-`` if null, else its length in bytes, a colon and itself."""
    one = lambda s: F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))
    return digest(F.concat(*(one(c.cast("string")) for c in fields)))


def _joined(hashes: Column) -> Column:
    return F.array_join(hashes, "")


def _height(n: Column) -> Column:
    """Levels of a block of n nodes that stand alone; three where there are more blocks."""
    return F.when(n <= 1, 0).when(n <= FAN_OUT, 1).when(n <= FAN_OUT**2, 2).otherwise(3)


def _blocks(nodes: DataFrame, work: Workspace, name: str) -> DataFrame:
    """(tree, n, block, hash, kids) from nodes (tree, n, at, hash, load); n is the number of nodes of the tree."""
    at = F.col("at")
    digits = {"block": F.floor(at / BLOCK), "d2": F.floor(at / FAN_OUT**2) % FAN_OUT, "d1": F.floor(at / FAN_OUT) % FAN_OUT, "d0": at % FAN_OUT}
    rows = nodes.withColumns({c: v.cast("long" if c == "block" else "int") for c, v in digits.items()}).withColumn("kids", F.lit(None)).repartition("tree", "block")
    keys = ["tree", "n", "block", "d2", "d1", "d0"]
    for level in (1, 2, 3):
        nested = F.struct(keys[-1], "hash", "load") if level == 1 else F.struct(keys[-1], "hash", "kids")
        keys.pop()
        rows = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(nested)).alias("kids"))
        rows = rows.withColumn("hash", F.when(_height(F.col("n")) >= level, digest(_joined(F.col("kids.hash")))).otherwise(F.col("kids")[0]["hash"]))
    return work.table(rows, name)


def _climb(nodes: DataFrame, most: int, work: Workspace, name: str) -> list[DataFrame]:
    """The stages of blocks, up to one that has all trees' heads; ``most`` is the size of the largest tree."""
    stages = [_blocks(nodes, work, f"{name}-0")]
    while most > BLOCK:
        most = -(-most // BLOCK)
        open_ = stages[-1].filter(F.col("n") > BLOCK).select("tree", F.ceil(F.col("n") / BLOCK).cast("long").alias("n"), F.col("block").alias("at"), "hash", F.lit(0).alias("load"))
        stages.append(_blocks(open_, work, f"{name}-{len(stages)}"))
    return stages


def _heads(stages: list[DataFrame]) -> DataFrame:
    """(tree, stage, hash) of every tree's single block."""
    out = None
    for k, s in enumerate(stages):
        part = s.filter(F.col("n") <= BLOCK).select("tree", F.lit(k).alias("stage"), "hash")
        out = part if out is None else out.unionByName(part)
    return out


def _step(hashes: Column, at: Column) -> Column:
    """The siblings of a node, those before and those after it."""
    return F.struct(_joined(F.slice(hashes, 1, at)).alias("before"), _joined(F.slice(hashes, at + 2, F.lit(FAN_OUT))).alias("after"))


def _descend(stages: list[DataFrame], ends: DataFrame, work: Workspace, name: str) -> DataFrame:
    """(tree, at, hash, load, path, heads) of the nodes of the first stage; ``ends`` (tree, stage, path, heads) has what is above each tree."""
    found = None
    for k in range(len(stages) - 1, -1, -1):
        above = ends.filter(F.col("stage") == k).select("tree", F.lit(0).cast("long").alias("block"), "path", "heads")
        if found is not None:
            above = above.unionByName(found.select("tree", F.col("at").alias("block"), "path", "heads"))
        both = stages[k].select("tree", "n", "block", "kids").unionByName(above, allowMissingColumns=True)
        one = both.groupBy("tree", "block").agg(*(F.first(c, ignorenulls=True).alias(c) for c in ("n", "kids", "path", "heads")))
        rows = one.withColumn("at", F.col("block"))
        for level in (3, 2, 1):
            rows = rows.select("tree", "n", "at", "path", "heads", F.col("kids.hash").alias("hashes"), F.posexplode("kids").alias("pos", "kid"))
            path = F.when(_height(F.col("n")) >= level, F.concat(F.array(_step(F.col("hashes"), F.col("pos"))), F.col("path"))).otherwise(F.col("path"))
            below = F.col("kid.kids").alias("kids") if level > 1 else F.col("kid.load").alias("load")
            rows = rows.select("tree", "n", (F.col("at") * FAN_OUT + F.col("pos")).alias("at"), path.alias("path"), "heads", F.col("kid.hash").alias("hash"), below)
        found = rows.drop("n") if k == 0 else work.table(rows.drop("n", "load"), f"{name}-down-{k}")
    return found


def fold(seen: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, seen, lambda h, s: digest(F.concat(s["before"], h, s["after"])))


def proofs(docs: DataFrame, *, seen: Column | None = None) -> DataFrame:
    """doc_id, source, leaf, subroot, root, path and ``seen`` of every document.

    ``path`` has the siblings level by level, an array of (before, after), hex digests joined;
    ``seen`` is another leaf hash to hold against the manifest, computed in the same pass, and
    the leaf itself where that is null.
    """
    work = Workspace(docs.sparkSession, "manifest")
    own = leaf([F.col(c) for c in FIELDS])
    leaves = work.table(docs.select(F.col("source").cast("string").alias("source"), "doc_id", own.alias("hash"), (F.lit(None).cast("string") if seen is None else seen).alias("seen")), "leaves")
    ranked = scans.rank(leaves, [F.col("source").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("hash"), F.col("seen")], work, "ranked")
    spans = work.table(ranked.groupBy("source").agg(F.min("rank").alias("start"), F.count("*").alias("n")), "spans")
    trees = work.table(scans.rank(spans, [F.col("source").asc_nulls_first()], work, "sources", "tree"), "trees")
    count, most = trees.agg(F.count("*"), F.coalesce(F.max("n"), F.lit(0))).first()
    placed = scans.with_dimension(ranked, trees, ["source"])
    nodes = placed.select("tree", "n", (F.col("rank") - F.col("start")).alias("at"), "hash", F.struct("doc_id", "source", "seen").alias("load"))
    stages = _climb(nodes, most, work, "blocks")
    heads = work.table(_heads(stages), "heads")
    top = _climb(heads.select(F.lit(0).cast("long").alias("tree"), F.lit(count).cast("long").alias("n"), F.col("tree").alias("at"), "hash", F.col("stage").alias("load")), count, work, "top")
    none = F.array().cast("array<struct<before: string, after: string>>")
    apex = _heads(top).select("tree", "stage", none.alias("path"), F.struct(F.lit(None).cast("string").alias("subroot"), F.col("hash").alias("root")).alias("heads"))
    ends = _descend(top, apex, work, "top").select(F.col("at").alias("tree"), F.col("load").alias("stage"), "path", F.struct(F.col("hash").alias("subroot"), F.col("heads.root").alias("root")).alias("heads"))
    found = _descend(stages, work.table(ends, "ends"), work, "blocks")
    return found.select("load.doc_id", "load.source", F.col("hash").alias("leaf"), "heads.subroot", "heads.root", "path", F.coalesce("load.seen", "hash").alias("seen"))


def lowered(text: Column) -> Column:
    """A-Z to a-z."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tampered(docs: DataFrame, every: int = 5) -> Column:
    """The leaf of a document with its text lower-cased where ``every`` divides the crc32 of its id, else null."""
    fields = [lowered(F.col(c)) if c == "text" else F.col(c) for c in FIELDS]
    return F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % every == 0, leaf(fields))


def verify(found: DataFrame) -> DataFrame:
    """The contract's columns from what ``proofs`` returns."""
    siblings = F.array_join(F.flatten(F.transform("path", lambda s: F.array(s["before"], s["after"]))), "")
    out = found.select("doc_id", "leaf", "subroot", "root", digest(siblings).alias("proof_sha256"), fold(F.col("seen"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def duck_sql(levels: int = 6, top_levels: int = 3) -> str:
    """The contract's rows in DuckDB, for sources of 16^levels documents and 16^top_levels sources at most."""
    part = lambda c: f"coalesce(strlen({c}::varchar) || ':' || {c}::varchar, '-')"
    own = " || ".join(part(c) for c in FIELDS)
    low = own.replace(part("text"), part("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"))
    crc = "xor(list_reduce(list_prepend(4294967295::ubigint, list_transform(string_split(doc_id::varchar, ''), lambda ch: ascii(ch)::ubigint)), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)::ubigint[]), lambda x, i: xor(x >> 1, 3988292384::ubigint * (x & 1)))), 4294967295::ubigint)"
    ctes = [
        f"l as (select source, doc_id, sha256({own}) h, case when {crc} % 5 = 0 then sha256({low}) end seen from documents)",
        "n0 as (select source, row_number() over (partition by source order by doc_id nulls first, h, seen) - 1 pos, h, count(*) over (partition by source) n from l)",
        "base as (select *, row_number() over (partition by source order by doc_id nulls first, h, seen) - 1 pos from l)",
    ]

    def tree(src: str, key: str, name: str, height: int) -> str:
        """Adds the levels over ``src``; returns the name of the last."""
        last = src
        for k in range(1, height + 1):
            ctes.append(f"{name}r{k} as (select {key} k, pos // {FAN_OUT} pos, n, list(h order by pos) hs from {last} where n > 1 group by all)")
            ctes.append(f"{name}{k} as (select k as {key}, pos, sha256(array_to_string(hs, '')) h, (n + {FAN_OUT - 1}) // {FAN_OUT} n from {name}r{k} union all select {key}, pos, h, n from {last} where n = 1)")
            last = f"{name}{k}"
        return last

    heads = tree("n0", "source", "s", levels)
    ctes.append(f"t0 as (select 0 as one, source, h, row_number() over (order by source nulls first) - 1 pos, count(*) over () n from {heads})")
    root = tree("t0", "one", "t", top_levels)
    ctes.append("p0 as (select b.doc_id, b.source, b.h leaf, t.h subroot, b.pos, t.pos place, coalesce(b.seen, b.h) up, '' proof from base b join t0 t on t.source is not distinct from b.source)")
    step, last = 0, "p0"
    for name, key, at, height in (("s", "source", "pos", levels), ("t", "one", "place", top_levels)):
        for k in range(1, height + 1):
            i = f"(p.{at} // {FAN_OUT ** (k - 1)} % {FAN_OUT})"
            on = f"r.pos = p.{at} // {FAN_OUT**k}" + (" and r.k is not distinct from p.source" if name == "s" else "")
            before, after = f"array_to_string(hs[1:{i}], '')", f"array_to_string(hs[{i} + 2:], '')"
            step += 1
            ctes.append(f"p{step} as (select p.doc_id, p.source, p.leaf, p.subroot, p.pos, p.place, case when r.pos is null then up else sha256({before} || up || {after}) end up, proof || case when r.pos is null then '' else {before} || {after} end proof from {last} p left join {name}r{k} r on {on})")
            last = f"p{step}"
    return f"with {', '.join(ctes)} select doc_id, leaf, subroot, {root}.h root, sha256(proof) proof_sha256, up folded_root, up = {root}.h verified from {last}, {root}"
