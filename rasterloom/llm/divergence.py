"""Source divergence audit: how the terms of each source differ from those of others in its language.

Texts are tokenised by one translate table: ``bytes.translate`` lowers A-Z and blanks every
separator in one pass, ``bytes.split`` cuts, and a ``Counter`` a document gives term
frequencies, whose number of entries is the document frequency.  A task adds up what its
documents give before anything is shuffled.  All arithmetic after that is in integers.

Pairs of sources are compared on whole vocabularies: terms are dealt to buckets of bounded
size, a bucket holds a dense block of (terms x sources) and adds up its part of every pair,
and Spark adds the buckets.  Where a language has more than ``block_sources`` sources they are
cut into blocks too, and a task has two of them, so its memory is bounded in both directions.

Defined cases: null text, lang and source are the empty string; a group without terms, and a
language without kept terms, gives pairs (of value 0 if nothing is kept) and no terms; repeated
doc_ids are documents each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import scans
from ..workspace import Workspace
from . import _text as tx

MIN_DOCS = 3
TOP = 200
SCALE = 1_000_000_000
#: Kept terms of a bucket on average, sources of a block, and counted rows that a task holds before it passes them on.
BUCKET_TERMS, BLOCK_SOURCES, PENDING_ROWS = 2048, 256, 400_000

#: A-Z to a-z; other separators of terms [^\x00-\x40\x5B-\x60\x7B-\x7F]+ to a blank.
TRANSLATE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _summed(parts: list[pa.Table]) -> Iterator[pa.RecordBatch]:
    table = pa.concat_tables(parts).group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "sum")])
    yield from table.rename_columns(["lang", "source", "term", "n", "docs"]).to_batches(max_chunksize=65536)


def count_terms(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term, by group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending, held = [], 0
        for batch in batches:
            for part in tx.slices(batch, "text"):
                buf, offs = tx.buffer(tx.column(part, "text"))
                raw = buf.tobytes().translate(TRANSLATE)
                terms: list[bytes] = []
                counts: list[int] = []
                sizes = []
                for i, j in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
                    found = Counter(raw[i:j].split())
                    terms.extend(found.keys())
                    counts.extend(found.values())
                    sizes.append(len(found))
                at = pa.array(np.repeat(np.arange(part.num_rows), sizes))
                one = pa.table({"lang": tx.column(part, "lang").take(at), "source": tx.column(part, "source").take(at), "term": pa.array(terms, pa.binary()).cast(pa.string()), "n": pa.array(counts, pa.int64()), "docs": pa.array(np.ones(len(counts), np.int64))})
                pending.append(one)
                held += one.num_rows
                if held >= PENDING_ROWS:
                    yield from _summed(pending)
                    pending, held = [], 0
        if pending:
            yield from _summed(pending)

    sent = docs.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return sent.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _p(count: Column, words: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (words + kept)), in decimals of 31 digits at most."""
    big = lambda c: c.cast("decimal(20,0)")
    top = F.lit(SCALE).cast("decimal(10,0)") * big(count + 1)
    return F.lit(1) + F.call_function("div", top, big(words + kept))


def vocabulary(docs: DataFrame, work: Workspace, min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame]:
    """Two written tables: scored (lang, term, source, p, q) for counts over 0, and groups (lang, source, kept, p0)."""
    plain = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    by_term = count_terms(plain).groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("by_source"))
    kept = work.table(by_term.filter(F.col("docs") >= min_docs).drop("docs"), "kept")
    entries = kept.select("lang", "term", "total", F.explode("by_source").alias("e")).select("lang", "term", "total", "e.source", "e.n")
    langs = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("total").alias("lang_words"))
    words = entries.groupBy("lang", "source").agg(F.sum("n").alias("words"))
    groups = plain.groupBy("lang", "source").agg(F.lit(1).alias("one")).drop("one").join(words, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["words", "kept", "lang_words"])
    zero = F.when(F.col("kept") > 0, _p(F.lit(0), F.col("words"), F.col("kept"))).otherwise(1)
    groups = work.table(groups.withColumn("p0", zero.cast("long")), "groups")
    scored = scans.with_dimension(entries, groups, ["lang", "source"])
    scored = scored.select("lang", "term", "source", _p(F.col("n"), F.col("words"), F.col("kept")).alias("p"), _p(F.col("total"), F.col("lang_words"), F.col("kept")).alias("q"))
    return work.table(scored, "scored"), groups.select("lang", "source", "kept", "p0")


def _partial(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sums over terms of floor((p - q)^2 / q) for each column p of ``left`` and q of ``right``."""
    out = np.empty((left.shape[1], right.shape[1]), np.int64)
    for i in range(left.shape[1]):
        d = left[:, i : i + 1] - right
        out[i] = (d * d // right).sum(axis=0)
    return out


def pair_divergence(scored: DataFrame, groups: DataFrame, *, bucket_terms: int = BUCKET_TERMS, block_sources: int = BLOCK_SOURCES) -> DataFrame:
    """(lang, source, item, value) for every two sources of a language, over all kept terms."""
    most = groups.groupBy("lang").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    blocks = -(-most // block_sources)
    block = F.pmod(F.xxhash64("source"), F.lit(blocks)).cast("int") if blocks > 1 else F.lit(0)
    buckets = F.greatest(F.lit(1), F.ceil(F.col("kept") / bucket_terms)).cast("int")
    # a block of sources meets every block, itself included
    meets = F.explode(F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda j: F.struct(F.least(j, F.col("block")).alias("a"), F.greatest(j, F.col("block")).alias("b"))))
    sides = groups.withColumn("block", block).withColumn("bucket", F.explode(F.sequence(F.lit(0), buckets - 1))).withColumn("m", meets)
    sides = sides.select("lang", "bucket", "m.a", "m.b", "block", "source", "p0")
    by_lang = groups.groupBy("lang").agg(F.max(buckets).alias("buckets"))
    dealt = scans.with_dimension(scored, by_lang, ["lang"]).withColumn("bucket", F.pmod(F.xxhash64("term"), "buckets").cast("int")).withColumn("block", block).withColumn("m", meets)
    dealt = dealt.select("lang", "bucket", "m.a", "m.b", "source", "term", "p")

    def work(key: tuple[pa.Scalar, ...], terms: pa.Table, known: pa.Table) -> pa.Table:
        lang, _, a, b = (k.as_py() for k in key)
        names, p0, own = known["source"].to_pylist(), known["p0"].to_numpy(), known["block"].to_numpy()
        coded = terms["term"].combine_chunks().dictionary_encode()
        p = np.repeat(p0[None, :], len(coded.dictionary), axis=0)
        where = {s: k for k, s in enumerate(names)}
        p[coded.indices.to_numpy(), [where[s] for s in terms["source"].to_pylist()]] = terms["p"].to_numpy()
        left, right = np.flatnonzero(own == a), np.flatnonzero(own == b)
        out = [(left, right, _partial(p[:, left], p[:, right]))]
        if a != b:
            out.append((right, left, _partial(p[:, right], p[:, left])))
        rows = [(names[i], names[j], int(v[x, y])) for r, c, v in out for x, i in enumerate(r) for y, j in enumerate(c) if i != j]
        source, item, value = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.table({"lang": pa.array([lang] * len(rows), pa.string()), "source": pa.array(source, pa.string()), "item": pa.array(item, pa.string()), "value": pa.array(value, pa.int64())})

    keys = ["lang", "bucket", "a", "b"]
    found = dealt.groupBy(*keys).cogroup(sides.groupBy(*keys)).applyInArrow(work, "lang string, source string, item string, value long")
    return found.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def term_divergence(scored: DataFrame, top: int = TOP) -> DataFrame:
    """(lang, source, item, value, rank) of the terms that a group has more of than its language, the first ``top``."""
    over = scored.filter("p > q").selectExpr("lang", "source", "term as item", "(p - q) * (p - q) div q as value")
    return _ranked(over).filter(F.col("rank") <= top)


def _ranked(df: DataFrame) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))))


def audit(docs: DataFrame, *, min_docs: int = MIN_DOCS, top: int = TOP, bucket_terms: int = BUCKET_TERMS, block_sources: int = BLOCK_SOURCES) -> DataFrame:
    """lang, source, part, item, value, rank."""
    scored, groups = vocabulary(docs, Workspace(docs.sparkSession, "divergence"), min_docs)
    pairs = _ranked(pair_divergence(scored, groups, bucket_terms=bucket_terms, block_sources=block_sources)).withColumn("part", F.lit("pair"))
    both = pairs.unionByName(term_divergence(scored, top).withColumn("part", F.lit("term")))
    return both.select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))


#: The contract's rows in DuckDB.
SQL = r"""
with d as (select doc_id, coalesce(lang, '') lang, coalesce(source, '') source, coalesce(text, '') as txt, row_number() over () i from documents),
w as (select i, lang, source, unnest(regexp_extract_all(translate(txt, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) term from d),
c as (select lang, source, term, count(*) n from w group by all),
k as (select lang, term from w group by all having count(distinct i) >= 3),
g as (select distinct lang, source from d),
v as (select g.lang, count(distinct term) v from g left join k on k.lang = g.lang group by g.lang),
full_ as (select g.lang, g.source, k.term, coalesce(c.n, 0) n from g join k on k.lang = g.lang left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
gp as (select lang, source, term, n, 1 + (1000000000::hugeint * (n + 1)) // (sum(n) over (partition by lang, source) + v) p from full_ join v using (lang)),
lp as (select lang, term, 1 + (1000000000::hugeint * (sum(n) + 1)) // (sum(sum(n)) over (partition by lang) + any_value(v)) q from full_ join v using (lang) group by lang, term),
pairs as (select a.lang, a.source, b.source item, coalesce(sum((x.p - y.p) * (x.p - y.p) // y.p), 0) as val from g a join g b on a.lang = b.lang and a.source <> b.source
 left join gp x on x.lang = a.lang and x.source = a.source left join gp y on y.lang = b.lang and y.source = b.source and y.term = x.term where x.term is null or y.term is not null group by all),
terms as (select gp.lang, gp.source, gp.term item, (p - q) * (p - q) // q as val from gp join lp on lp.lang = gp.lang and lp.term = gp.term where n > 0 and p > q),
ranked as (select lang, source, 'pair' part, item, val, row_number() over (partition by lang, source order by val desc, item) r from pairs
 union all select lang, source, 'term', item, val, row_number() over (partition by lang, source order by val desc, item) from terms)
select lang, source, part, item, cast(val as bigint) "value", cast(r as int) "rank" from ranked where part = 'pair' or r <= 200
"""
