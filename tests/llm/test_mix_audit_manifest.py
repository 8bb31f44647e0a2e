"""Source mixing, divergence audit and Merkle manifest against brute force, and on nulls, ties, repeats and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.llm import divergence, manifest, mixing

SF = "/root/testdata/sf0.001"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abCéß") for _ in range(rnd.randint(1, 2)))
    out = [(i, "big" if i % 3 else f"s{i % 4}", rnd.choice(["en", "de"]), i, " ".join(word() for _ in range(rnd.randint(0, 60)))) for i in range(700)]
    out += [(700, None, None, None, None), (None, "big", "en", 3, "no id"), (5, "big", "en", 4, "twice"), (5, "big", "en", 4, "twice"), (701, "", "", 0, ""), (702, "one", "fr", 1, "Ab \x00 c9d, ÄÖ"), (703, "long", "en", 1, "word-And " * 30000)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(3)
    return df.withColumns({c: F.lit("clash") for c in ("size", "rank", "tree", "leaf", "term", "h", "_part")})


def water(size, share=1.5):
    """Targets by raising the sources that are not full, one by one."""
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    full, total = set(), share * sum(size.values())
    while True:
        left, by = total - sum(2 * size[s] for s in full), sum(weight[s] for s in size if s not in full)
        over = {s for s in size if s not in full and left * weight[s] / by > 2 * size[s]}
        if not over:
            return {s: 2.0 * size[s] if s in full else left * weight[s] / by for s in size}
        full |= over


def test_mix_meets_its_targets(docs, rows):
    got = mixing.decide(docs, chunk_rows=32, fan_in=3).collect()
    sizes = defaultdict(int)
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    for _, s, _, _, t in rows:
        sizes[s] += count(t)
    want, taken = water(sizes), Counter()
    assert sorted(((r.doc_id, r.size) for r in got), key=repr) == sorted(((i, count(t)) for i, _, _, _, t in rows), key=repr)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size
        assert r.copies in (int(r.target // r.source_size), int(r.target // r.source_size) + 1) if r.size else r.copies == 0
        taken[r.source] += r.taken
    for s in ("big", "s0", "s1", "s2", "s3"):
        assert abs(taken[s] - want[s]) <= 30  # half of the longest text
    assert sum(want.values()) == pytest.approx(1.5 * sum(sizes.values()))


def test_mix_does_not_depend_on_partitions(docs):
    pick = lambda df: sorted(((r.doc_id, r.source, r.size, r.taken) for r in mixing.decide(df, chunk_rows=64).collect()), key=repr)
    first = pick(docs)
    assert first == pick(docs.repartition(7, "text")) == pick(docs.coalesce(1).orderBy(F.desc("n_chars")))
    assert first != sorted(((r.doc_id, r.source, r.size, r.taken) for r in mixing.decide(docs, chunk_rows=64, seed=99).collect()), key=repr)


def test_meetings_leave_shares_and_sums_as_they_were():
    rnd = np.random.default_rng(4)
    size, rank, h = rnd.integers(1, 500, 300), np.repeat([0, 1], 150), rnd.integers(-(1 << 62), 1 << 62, 300)
    mean = np.zeros(300)
    for seed in range(400):
        mass = mixing.settle(rank, h, size, 0.4 * size, seed)
        for r in (0, 1):
            assert mass[rank == r].sum() == pytest.approx(0.4 * size[rank == r].sum())
        inside = (mass > 0) & (mass < size)
        assert max(Counter(zip(rank[inside].tolist(), np.frexp(size[inside].astype(float))[1].tolist(), strict=True)).values()) == 1
        mean += mass / size / 400
    assert abs(mean - 0.4).max() < 0.12 and abs(mean.mean() - 0.4) < 0.005


def test_mixed_rows_are_repeated(spark, docs):
    times = Counter({(r.doc_id, r.size): r.copies for r in mixing.decide(docs, chunk_rows=64).filter("doc_id > 5 and doc_id < 700").collect()})
    out = mixing.mixed(docs, chunk_rows=64)
    assert out.columns == docs.columns
    got = Counter(r.doc_id for r in out.filter("doc_id > 5 and doc_id < 700").collect())
    assert got == Counter({i: n for (i, _), n in times.items() if n})
    empty = docs.limit(0)
    assert mixing.decide(empty).isEmpty() and mixing.mixed(empty).isEmpty()
    assert mixing.decide(spark.createDataFrame([(1, None, " ")], "doc_id long, source string, text string")).first().taken == 0


def brute_audit(rows, min_docs=3, top=200):
    tf, df, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for _, s, g, _, t in rows:
        s, g = s or "", g or ""
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(lower))
        tf[g, s].update(words)
        df[g].update(set(words))
        groups[g].add(s)
    out = []
    for g, sources in groups.items():
        kept = [w for w, n in df[g].items() if n >= min_docs]
        p = lambda c: {w: 1 + 10**9 * (c[w] + 1) // (sum(c[x] for x in kept) + len(kept)) for w in kept}  # noqa: B023, E731
        own, q = {s: p(tf[g, s]) for s in sources}, p(sum((tf[g, s] for s in sources), Counter()))
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = [(o, sum(f(own[s][w], own[o][w]) for w in kept)) for o in sources if o != s]
            terms = [(w, f(own[s][w], q[w])) for w in kept if tf[g, s][w] and own[s][w] > q[w]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(g, s, part, item, v, k + 1) for k, (item, v) in enumerate(found) if part == "pair" or k < top]
    return sorted(out)


@pytest.mark.parametrize("options", [{}, {"bucket_terms": 3, "block_sources": 2}])
def test_audit_matches_brute_force(docs, rows, options):
    got = sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in divergence.audit(docs, **options).collect())
    assert got == brute_audit(rows)


def test_audit_limits_and_empty_tables(spark, docs, rows):
    assert sorted(tuple(r) for r in divergence.audit(docs, top=2, min_docs=5).collect()) == brute_audit(rows, 5, 2)
    assert divergence.audit(docs.limit(0)).isEmpty()
    bare = spark.createDataFrame([(1, "a", None, None), (2, "b", None, "1 2 3")], "doc_id long, source string, lang string, text string")
    assert sorted(tuple(r) for r in divergence.audit(bare).collect()) == [("", "a", "pair", "b", 0, 1), ("", "b", "pair", "a", 0, 1)]


def test_audit_counts_that_exceed_64_bits(spark):
    n = 5 * 10**13
    got = spark.createDataFrame([(n, 3 * n, 7)], "c long, w long, v long").select(divergence._p(F.col("c"), F.col("w"), F.col("v"))).first()[0]
    assert got == 1 + 10**9 * (n + 1) // (3 * n + 7)


def brute_manifest(rows):
    one = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda i, s, g, n, t: sha("".join(map(one, (i, s, g, n, t))))
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    trees = defaultdict(list)
    for i, s, g, n, t in rows:
        seen = leaf(i, s, g, n, t.translate(lower) if t else t) if i is not None and zlib.crc32(str(i).encode()) % 5 == 0 else None
        trees[s].append(((i is not None, i or 0), leaf(i, s, g, n, t), i, seen))

    def build(hashes):
        """The root, and for each node the runs on its way up with its place in each."""
        ways, at = [[] for _ in hashes], list(range(len(hashes)))
        while len(hashes) > 1:
            runs = [hashes[k : k + 16] for k in range(0, len(hashes), 16)]
            for w, k in zip(ways, at, strict=True):
                w.append((runs[k // 16], k % 16))
            at, hashes = [k // 16 for k in at], [sha("".join(r)) for r in runs]
        return hashes[0], ways

    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    leaves = {s: sorted(trees[s], key=lambda x: (x[0], x[1])) for s in order}
    heads = {s: build([x[1] for x in leaves[s]]) for s in order}
    root, ways = build([heads[s][0] for s in order])
    out = []
    for s, above in zip(order, ways, strict=True):
        for (_, own, i, seen), way in zip(leaves[s], heads[s][1], strict=True):
            up, proof = seen or own, ""
            for run, k in way + above:
                proof += "".join(run[:k] + run[k + 1 :])
                up = sha("".join([*run[:k], up, *run[k + 1 :]]))
            out.append((i, own, heads[s][0], root, sha(proof), up, up == root))
    return sorted(out, key=repr)


COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def proved(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in manifest.verify(manifest.proofs(df, seen=manifest.tampered(df))).collect()), key=repr)


def test_manifest_matches_brute_force(docs, rows):
    got = proved(docs)
    assert got == brute_manifest(rows)
    assert 100 < sum(not r[-1] for r in got) < 200
    assert proved(docs.limit(0)) == []


@pytest.mark.parametrize("n, sources", [(1, 1), (2, 1), (16, 1), (17, 1), (257, 1), (300, 290), (9000, 2)])
def test_manifest_of_all_heights(spark, n, sources):
    rows = [(i, f"s{i % sources:03}" if i % 9 else "s000", "en", 1, f"Text {i}") for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert proved(df) == brute_manifest(rows)


def test_sql_of_the_audit_and_the_manifest(spark):
    from rasterloom.llm import queries

    duck = duckdb.connect()
    duck.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    for name, sql in queries.oracle_sql().items():
        df = queries.queries()[name](spark, SF)
        found = duck.execute(sql)
        names = [x[0] for x in found.description]
        assert sorted(names) == sorted(df.columns)
        assert sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr) == sorted(found.fetchall(), key=repr)
