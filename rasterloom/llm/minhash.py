"""Near-duplicate classes by Order MinHash and banded alignment.

Sketch: the 5-word shingles of a text, numbered by occurrence, are hashed with ``hashes``
functions; each takes the two least and keeps them in text order, which makes a band key
that depends on order and so on edit similarity.  Texts that share a key are candidates.

Similarity: L / (n + m - L) for texts of n and m shingles whose longest common subsequence
of shingles is L, found by bit-parallel alignment inside the band that ``similarity``
allows.  Pairs from ``similarity`` (0.8) on are linked; a class is a connected component.

Equal word sequences are one text first, and only different texts are sketched further.
The pairs of a bucket are never listed:

1. Each bucket's hub, the member that shares most keys with others, meets the bucket's
   members, and then the hub of those that are not in the bucket's largest component.
   A group of near copies joins here, in steps that are linear in its size.
2. Buckets of four and more that still hold several components go through an exact prefix
   filter: with shingles in order from rare to common, texts of similarity ``s`` or more
   share one of the first shingles, n - s (n + m) / (1 + s) + 1 of them for lengths n and m.
   Shingles are looked up by the partner's length class too.  A text that differs from all
   others by more than that has only shingles of its own there and meets nobody.
   Texts meet the hub of such a shingle first; what is left in different components then
   meets, and the positions of the common shingle must allow the similarity, and so must
   the signatures: a bit is set where an odd number of a text's shingles fall on it, so two
   signatures differ in no more bits than the texts have shingles that are not common.
   Pairs that a common passage alone brings together end there, and are not listed.

Only pairs in different components are aligned, each once, and no pair that shares a key
and is similar enough is passed over, so no link that could change a class is left out.

At similarity 0.8 a band agrees with probability of about 0.64, and 16 bands miss a pair
with about 1e-7.  Defined cases: null and blank texts are equal to each other; texts below
five words are one shingle, and so match equal ones only; rows with one doc_id are one
document with several texts, and each of them can link it; a null doc_id has a null class;
an empty table gives no rows; doc_id must be an integer; other columns do not matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..workspace import Workspace
from . import _text as tx

SHINGLE = 5
HASHES = 16
SIMILARITY = 0.8
#: Buckets up to this size have all pairs met after two hubs.
SETTLED = 3
#: Lengths of one class differ by this factor at most.
LENGTH_STEP = 1.05
#: 64-bit words of a signature.
SIGNATURE_WORDS = 8

_K = np.uint64(0x9E3779B97F4A7C15)
_MAX = np.uint64(2**64 - 1)


def shingles(words: tx.Words, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of each shingle in text order; a text below k words is one shingle."""
    h = words.hashes()
    s = tx.windows(h, k)
    at = np.flatnonzero(words.room(k)[: len(s)])
    doc, s = words.doc[at], s[at]
    short = np.flatnonzero((words.counts > 0) & (words.counts < k))
    if len(short):
        own = [tx.windows(h[i:j], j - i)[0] for i, j in zip(words.first[short], words.first[short + 1], strict=True)]
        doc, s = np.concatenate([doc, short]), np.concatenate([s, np.array(own, np.uint64)])
        order = np.argsort(doc, kind="stable")
        doc, s = doc[order], s[order]
    return doc, s


def sketch(doc: np.ndarray, s: np.ndarray, hashes: int = HASHES) -> tuple[np.ndarray, np.ndarray]:
    """The texts that have shingles, and their band keys, a row each."""
    order = np.lexsort((np.arange(len(s)), s, doc))
    so, do = s[order], doc[order]
    new = np.ones(len(s), bool)
    new[1:] = (so[1:] != so[:-1]) | (do[1:] != do[:-1])
    head = np.flatnonzero(new)
    occurrence = np.empty(len(s), np.int64)
    occurrence[order] = np.arange(len(s)) - np.repeat(head, np.diff([*head, len(s)]))
    label = tx.mix(s + occurrence.astype(np.uint64) * _K)
    texts, first = np.unique(doc, return_index=True)
    row = np.repeat(np.arange(len(texts)), np.diff([*first, len(doc)]))
    keys = np.zeros((len(texts), hashes), np.uint64)

    def least(v: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(v == np.minimum.reduceat(v, first)[row])[::-1]
        out = np.zeros(len(texts), np.int64)
        out[row[at]] = at
        return out

    for j in range(hashes if len(texts) else 0):
        seed = tx.mix(np.array([j + 1], np.uint64))
        v = tx.mix(label ^ seed)
        a = least(v)
        v[a] = _MAX
        b = least(v)  # the same one where a text has one shingle
        keys[:, j] = tx.mix(label[np.minimum(a, b)] * np.uint64(3) + tx.mix(label[np.maximum(a, b)] + seed))
    return texts, keys


def _sketches(docs: DataFrame, hashes: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.slices(batch, "text"):
                words = tx.Words(tx.column(part, "text"))
                n = part.num_rows
                whole = []
                for which in range(2):
                    h = words.hashes(which)
                    inside = np.arange(len(h)) - words.first[:-1][words.doc]
                    terms = h * tx.powers(int(inside.max(initial=0)) + 1, which)[inside]
                    total = np.zeros(n, np.uint64)
                    some = np.flatnonzero(words.counts)
                    if len(some):
                        total[some] = np.add.reduceat(terms, words.first[some])
                    whole.append(tx.mix(total + words.counts.astype(np.uint64)).view(np.int64))
                doc, s = shingles(words)
                texts, keys = sketch(doc, s, hashes)
                bands = np.zeros((n, hashes), np.int64)
                bands[texts] = keys.view(np.int64)
                sizes = np.bincount(doc, minlength=n)
                filled = np.where(sizes > 0, hashes, 0)
                flat = bands[sizes > 0].ravel()
                offs = np.concatenate([[0], np.cumsum(filled)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [tx.column(part, "doc_id"), pa.array(whole[0]), pa.array(whole[1]), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(offs), pa.array(flat))],
                    ["doc_id", "d1", "d2", "n", "bands"],
                )

    return docs.mapInArrow(run, "doc_id long, d1 long, d2 long, n long, bands array<long>")


def common(a: np.ndarray, b: np.ndarray, similarity: float) -> int:
    """Length of the longest common subsequence inside the band; below the needed length it may be less than the true one.

    The bits of one row of the band are one integer, which moves along ``a`` with ``b``'s place; memory is that of the band.
    """
    n = min(len(a), len(b))
    head = int(np.argmin(np.append(a[:n] == b[:n], False)))
    a, b = a[head:], b[head:]
    n = min(len(a), len(b))
    tail = int(np.argmin(np.append(a[::-1][:n] == b[::-1][:n], False)))
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not len(a) or not len(b):
        return head + tail
    # at least `need` in common leaves so many insertions and deletions
    total = len(a) + len(b) + 2 * (head + tail)
    band = int(total - 2 * similarity / (1 + similarity) * total) + 1
    order = np.argsort(a, kind="stable")
    lo = np.searchsorted(a[order], b)
    hi = np.searchsorted(a[order], b, "right")
    if head + tail + np.count_nonzero(hi > lo) < similarity / (1 + similarity) * total - 1e-9:
        return head + tail  # too few shingles in common, in any order
    strip = (1 << (2 * band + 1)) - 1
    v, left, found = strip, -band, 0  # bit i is place left + i of a; a zero is a step of the subsequence
    for j in np.flatnonzero(hi > lo).tolist():
        places = order[lo[j] : hi[j]]
        places = places[(places >= j - band) & (places <= j + band)]
        if not len(places):
            continue
        move = j - band - left
        if move > 2 * band:
            found += 2 * band + 1 - v.bit_count()
            v = strip
        elif move:
            found += move - (v & ((1 << move) - 1)).bit_count()
            v = (v >> move) | (strip >> (2 * band + 1 - move) << (2 * band + 1 - move))
        left = j - band
        at = 0
        for x in (places - left).tolist():
            at |= 1 << x
        u = v & at
        v = ((v + u) | (v - u)) & strip
    return head + tail + found + 2 * band + 1 - v.bit_count()


def similarity_of(a: np.ndarray, b: np.ndarray, similarity: float) -> float:
    if not len(a) and not len(b):
        return 1.0
    got = common(a, b, similarity)
    return got / (len(a) + len(b) - got)


def _occurrences(s: np.ndarray) -> np.ndarray:
    """Shingles numbered by occurrence, so that a text has each once."""
    order = np.argsort(s, kind="stable")
    so = s[order]
    head = np.flatnonzero(np.append(True, so[1:] != so[:-1])[: len(s)])
    nth = np.empty(len(s), np.int64)
    nth[order] = np.arange(len(s)) - np.repeat(head, np.diff([*head, len(s)]))
    return tx.mix(s + nth.astype(np.uint64) * _K)


def _shingled(texts: DataFrame) -> DataFrame:
    """(doc_id, n, s) of (doc_id, text): the shingles in text order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.slices(batch, "text"):
                doc, s = shingles(tx.Words(tx.column(part, "text")))
                own = np.split(s, np.searchsorted(doc, np.arange(1, part.num_rows)))
                yield pa.RecordBatch.from_arrays([tx.column(part, "doc_id"), pa.array([len(x) for x in own], pa.int64()), pa.array([x.tobytes() for x in own], pa.binary())], ["doc_id", "n", "s"])

    return texts.mapInArrow(run, "doc_id long, n long, s binary")


def _aligned(pairs: DataFrame, shingled: DataFrame, similarity: float) -> DataFrame:
    """(a, b) of the pairs that are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (tx.column(batch, c).to_pylist() for c in ("x", "y"))
            ok = [similarity_of(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64), similarity) >= similarity for p, q in zip(x, y, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    a, b = (shingled.select(F.col("doc_id").alias(i), F.col("s").alias(s)) for i, s in ("ax", "by"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _tokens(shingled: DataFrame) -> DataFrame:
    """(doc_id, n, token): a row for each shingle, numbered by occurrence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.slices(batch, "s"):
                own = [_occurrences(np.frombuffer(x, np.uint64)).view(np.int64) for x in tx.column(part, "s").to_pylist()]
                row = pa.array(np.repeat(np.arange(len(own)), [len(x) for x in own]))
                yield pa.RecordBatch.from_arrays([tx.column(part, "doc_id").take(row), tx.column(part, "n").take(row), pa.array(np.concatenate([*own, np.zeros(0, np.int64)]))], ["doc_id", "n", "token"])

    return shingled.mapInArrow(run, "doc_id long, n long, token long")


def _signatures(shingled: DataFrame) -> DataFrame:
    """(doc_id, n, bits) of each text: the parity of its shingles on each bit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.slices(batch, "s"):
                own = [_occurrences(np.frombuffer(x, np.uint64)) for x in tx.column(part, "s").to_pylist()]
                at = tx.mix(np.concatenate([*own, np.zeros(0, np.uint64)])) % np.uint64(64 * SIGNATURE_WORDS)
                bits = np.zeros((len(own), SIGNATURE_WORDS), np.uint64)
                np.bitwise_xor.at(bits, (np.repeat(np.arange(len(own)), [len(x) for x in own]), (at >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (at & np.uint64(63)))
                offs = np.arange(len(own) + 1, dtype=np.int32) * SIGNATURE_WORDS
                yield pa.RecordBatch.from_arrays([*tx.pick(part, "doc_id", "n"), pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(bits.ravel().view(np.int64)))], ["doc_id", "n", "bits"])

    return shingled.mapInArrow(run, "doc_id long, n long, bits array<long>")


def components(edges: DataFrame, work: Workspace, name: str) -> DataFrame:
    """(node, label): the least node of each node's component, by least labels and pointer jumps."""
    both = work.table(edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other"))).distinct(), f"{name}-edges")
    labels = work.table(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("label")), f"{name}-0")
    step = 0
    while True:
        step += 1
        near = both.join(labels.select(F.col("node").alias("other"), "label"), "other").groupBy("node").agg(F.min("label").alias("near"))
        moved = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("to"))
        jump = moved.join(labels.select(F.col("node").alias("to"), F.col("label").alias("far")), "to").select("node", F.col("far").alias("label"), (F.col("far") != F.col("label")).alias("moved"))
        new = work.table(jump, f"{name}-{step}")
        if new.filter("moved").isEmpty():
            return new.select("node", "label")
        labels = new.select("node", "label")


class _Rounds:
    """Labels of the texts' components, and the pairs that were aligned."""

    def __init__(self, shingled: DataFrame, label: DataFrame, similarity: float, work: Workspace):
        self.shingled, self.label, self.similarity, self.work = shingled, label, similarity, work
        self.tested: DataFrame | None = None
        self.step = 0

    def meet(self, pairs: DataFrame) -> None:
        """Aligns those of (a, b) that were not aligned before, and joins components."""
        self.step += 1
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a != b").distinct()
        pairs = self.work.table(pairs if self.tested is None else pairs.join(self.tested, ["a", "b"], "left_anti"), f"pairs-{self.step}")
        self.tested = pairs if self.tested is None else self.tested.unionByName(pairs)
        self.link(self.work.table(_aligned(pairs, self.shingled, self.similarity), f"links-{self.step}"))

    def link(self, links: DataFrame) -> None:
        if links.isEmpty():
            return
        at, bt = (self.label.select(F.col("doc_id").alias(x), F.col("label").alias(f"l{x}")) for x in "ab")
        edges = links.join(at, "a").join(bt, "b").select(F.col("la").alias("a"), F.col("lb").alias("b")).filter("a != b").distinct()
        moved = components(edges, self.work, f"round-{self.step}").select(F.col("node").alias("label"), F.col("label").alias("to"))
        self.label = self.work.table(self.label.join(moved, "label", "left").select("doc_id", F.coalesce("to", "label").alias("label")), f"labels-{self.step}")

    def near(self) -> Column:
        """Whether two texts of a bucket can be linked and are not in one component."""
        return (F.col("label") != F.col("other")) & (F.least("n", "m") >= self.similarity * F.greatest("n", "m"))

    def hubs(self, members: DataFrame, key: str, before: DataFrame | None = None) -> DataFrame:
        """Every bucket's hub meets its members; with the hubs of an earlier round, the hub of those outside the largest component.  Returns (key, hub)."""
        now = members.join(self.label, "doc_id")
        if before is not None:
            main = now.groupBy(key, "label").count().groupBy(key).agg(F.max_by("label", F.struct("count", "label")).alias("main"))
            pool = now.join(main, key).filter("label != main").join(before.select(key, F.col("hub").alias("doc_id")), [key, "doc_id"], "left_anti")
        else:
            pool = now
        hub = pool.groupBy(key).agg(F.max_by(F.struct(F.col("doc_id").alias("hub"), F.col("n").alias("m"), F.col("label").alias("other")), F.struct("degree", "doc_id", "n")).alias("h")).select(key, "h.*")
        hub = self.work.table(hub, f"hubs-{self.step}")
        self.meet(now.join(hub, key).filter(self.near()).select(F.col("doc_id").alias("a"), F.col("hub").alias("b")))
        return hub.select(key, "hub")


def _prefixes(shingled: DataFrame, similarity: float) -> DataFrame:
    """(token, doc_id, n, place): the shingles that occur in several texts among each text's first ones, from rare to common."""
    tokens = _tokens(shingled)
    known = tokens.join(tokens.groupBy("token").agg(F.count("*").alias("texts")).filter("texts > 1"), "token")
    first = F.col("n") - F.ceil(similarity * F.col("n") - 1e-9) + 1  # for the shortest partner
    own = known.groupBy("doc_id", "n").agg(F.array_sort(F.collect_list(F.struct("texts", "token"))).alias("tokens")).withColumn("alone", F.col("n") - F.size("tokens"))
    cut = own.filter(F.col("alone") < first).select("doc_id", "n", "alone", F.posexplode(F.slice("tokens", 1, (first - F.col("alone")).cast("int"))).alias("at", "t"))
    return cut.select(F.col("t.token").alias("token"), "doc_id", "n", (F.col("alone") + F.col("at")).alias("place"))


def _prefix_pairs(prefixes: DataFrame, outside: DataFrame, label: DataFrame, similarity: float) -> DataFrame:
    """(a, b) of texts in different components, one of them outside its bucket's largest, whose common first shingle and signatures allow the similarity."""
    share = similarity / (1 + similarity)

    def length_class(x: Column) -> Column:
        return F.floor(F.log(x) / math.log(LENGTH_STEP) + 1e-9)

    rows = prefixes.join(label, "doc_id")
    least, most = F.greatest(F.ceil(similarity * F.col("n") - 1e-9), F.lit(1)), F.floor(F.col("n") / similarity + 1e-9)
    shortest = F.greatest(F.ceil(F.pow(F.lit(LENGTH_STEP), F.col("kind")) - 1e-6), least)
    ask = rows.join(outside, "doc_id", "left_semi").select("*", F.explode(F.sequence(length_class(least), length_class(most))).alias("kind"))
    ask = ask.filter(F.col("place") <= F.col("n") - F.ceil(share * (F.col("n") + shortest) - 1e-9)).select("token", "kind", F.col("doc_id").alias("a"), "n", "place", "label", F.col("bits").alias("own"))
    have = rows.select("token", length_class(F.col("n")).alias("kind"), F.col("doc_id").alias("b"), F.col("n").alias("m"), F.col("place").alias("there"), F.col("label").alias("other"), "bits")
    enough = F.least(F.col("n") - F.col("place"), F.col("m") - F.col("there")) >= share * (F.col("n") + F.col("m")) - 1e-9
    apart = sum((F.bit_count(F.col("own")[i].bitwiseXOR(F.col("bits")[i])) for i in range(SIGNATURE_WORDS)), F.lit(0))
    near = apart <= (1 - 2 * share) * (F.col("n") + F.col("m")) + 1e-9
    return ask.join(have, (ask.token == have.token) & (ask.kind == have.kind) & (F.col("label") != F.col("other")) & enough & near).select("a", "b")


def classes(docs: DataFrame, *, hashes: int = HASHES, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id and class_id, the least doc_id of its class, for every doc_id (repeats once)."""
    work = Workspace(docs.sparkSession, "minhash")
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketched = work.table(_sketches(plain, hashes), "sketches")
    copies = sketched.filter("doc_id is not null").groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.min_by(F.struct("n", "bands"), "doc_id").alias("s"))
    copies = work.table(copies.select("d1", "d2", "rep", "s.*"), "copies")
    named = work.table(sketched.select("doc_id", "d1", "d2").join(copies.select("d1", "d2", "rep"), ["d1", "d2"], "left").select("doc_id", "rep"), "named")
    work.drop("sketches")
    own = work.table(named.groupBy("doc_id").agg(F.min("rep").alias("rep"), F.max("rep").alias("other")), "own")
    # a document with several texts stands in the components of all of them
    several = named.join(own.filter("rep != other").select("doc_id", F.col("rep").alias("a")), "doc_id").select("a", F.col("rep").alias("b")).filter("a != b").distinct()

    keys = copies.select(F.col("rep").alias("doc_id"), "n", F.posexplode("bands").alias("band", "key")).select(F.xxhash64("band", "key").alias("key"), "doc_id", "n").distinct()
    sizes = keys.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    shared = work.table(keys.join(sizes, "key"), "shared")
    degree = shared.groupBy("doc_id").agg(F.sum("size").alias("degree"))
    members = work.table(shared.join(degree, "doc_id"), "members")
    ids = work.table(degree.select("doc_id").unionByName(several.select(F.explode(F.array("a", "b")).alias("doc_id"))).distinct(), "ids")
    texts = plain.join(ids, "doc_id")
    shingled = work.table(_shingled(texts).groupBy("doc_id", "n", F.md5("s").alias("digest")).agg(F.first("s").alias("s")).drop("digest"), "shingled")

    rounds = _Rounds(shingled, ids.select("doc_id", F.col("doc_id").alias("label")), similarity, work)
    rounds.link(several)
    hubs = rounds.hubs(members, "key")
    rounds.hubs(members, "key", hubs)
    large = members.filter(F.col("size") > SETTLED).join(rounds.label, "doc_id")
    main = large.groupBy("key", "label").count().groupBy("key").agg(F.max_by("label", F.struct("count", "label")).alias("main"), F.count("*").alias("labels")).filter("labels > 1")
    open_ = work.table(large.join(main, "key").groupBy("doc_id").agg(F.max(F.col("label") != F.col("main")).alias("outside"), F.max("degree").alias("degree")), "open")
    if not open_.isEmpty():
        undecided = shingled.join(open_.select("doc_id"), "doc_id")
        prefixes = work.table(_prefixes(undecided, similarity).join(open_.select("doc_id", "degree"), "doc_id"), "prefixes")
        rounds.hubs(prefixes.select("token", "doc_id", "n", "degree"), "token")
        outside = open_.filter("outside").select("doc_id")
        signed = work.table(prefixes.drop("degree").join(_signatures(undecided), ["doc_id", "n"]), "signed")
        rounds.meet(_prefix_pairs(signed, outside, rounds.label, similarity))
    by_rep = rounds.label.select(F.col("doc_id").alias("rep"), "label")
    return own.join(by_rep, "rep", "left").select("doc_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "rep")).alias("class_id"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one document of each class, that with the least doc_id; rows without doc_id stay."""
    kept, row = tx.fresh(docs, "kept"), tx.fresh(docs, "row")
    found = classes(docs, **options).filter("doc_id = class_id").select(F.col("doc_id").alias(kept))
    chosen = docs.join(found, F.col("doc_id").cast("long") == F.col(kept), "left_semi")
    one = chosen.withColumn(row, F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_first()))).filter(F.col(row) == 1).drop(row)
    return one.unionByName(docs.filter("doc_id is null"))
