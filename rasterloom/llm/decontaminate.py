"""Benchmark decontamination: a broadcast hash set of normalised test n-grams.

The benchmark's windows (``n`` consecutive normalised words; an item with fewer
words, but not none, is one window) are hashed, broadcast, and looked up for every
window of every document.  A hit counts only after its words compare equal, byte
for byte.  The broadcast is bounded: at most ``max_bytes`` bytes of benchmark text, or
one item, go into one hash set, and a larger benchmark is scanned in several passes whose
hit masks are joined, with the same result.

Defined cases: a null or wordless text has no words and no hits; null or wordless
items have no windows; repeated documents are each scanned; repeated items with one
id count once, items with equal words and several ids count each; an empty benchmark
hits nothing; item ids compare and sort as strings and a null id is left out; further
columns of ``docs``, whatever their names, pass through unless they clash with an
output column, which then replaces them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..workspace import Workspace
from . import _text as tx

N_WORDS = 10
#: Bytes of benchmark text per broadcast hash set.  A window has a word of its own, of two bytes with what
#: separates it at least, so there are 4 million windows at most, of 20 bytes each: some 100 MB a worker.
MAX_BYTES = 8_000_000

#: Separators of lower-cased words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+.
PUNCTUATION = tx.separators((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
_TABLE_BITS = 20


class Windows:
    """The hash set as sorted arrays: for each window length its hashes, and where each window's words and item are.

    The words stand once, normalised and joined by a space, so a window is a slice of them, and a
    window takes 20 bytes besides: 8 of hash, 8 of place and 4 of item.
    """

    def __init__(self, ids: list[str | None], texts: list[str | None], n: int):
        words = tx.Words(pa.array(texts, pa.large_string()), PUNCTUATION, lower=True)
        h, counts = words.hashes(), words.counts
        self.ids = np.array(["" if x is None else x for x in ids], object)
        self.text = _joined(words, 0, len(words))
        begin = np.concatenate([[0], np.cumsum(words.lens + 1)])  # of each word in the joined text
        length = np.minimum(counts, n) * np.array([x is not None for x in ids], np.int64)
        self.hashes: dict[int, np.ndarray] = {}
        self.start: dict[int, np.ndarray] = {}
        self.item: dict[int, np.ndarray] = {}
        self.table: dict[int, np.ndarray] = {}
        for k in np.unique(length[length > 0]).tolist():
            fits = (length[words.doc] == k) & words.room(k)
            at = np.flatnonzero(fits)
            own = tx.windows(h, k)[at]
            order = np.argsort(own, kind="stable")
            self.hashes[k], self.start[k], self.item[k] = own[order], begin[at[order]], words.doc[at[order]].astype(np.int32)
            self.table[k] = np.zeros(1 << _TABLE_BITS, bool)
            self.table[k][own >> np.uint64(64 - _TABLE_BITS)] = True

    def hits(self, words: tx.Words, h: np.ndarray) -> Iterator[tuple[int, int, set[str]]]:
        """(first word, number of words, items) of each verified occurrence."""
        for k, keys in self.hashes.items():
            got = tx.windows(h, k)
            at = np.flatnonzero(self.table[k][got >> np.uint64(64 - _TABLE_BITS)] & words.room(k)[: len(got)])
            lo, hi = np.searchsorted(keys, got[at]), np.searchsorted(keys, got[at], "right")
            some = np.flatnonzero(hi > lo)
            for i, a, b in zip(at[some].tolist(), lo[some].tolist(), hi[some].tolist(), strict=True):
                said = _joined(words, i, i + k)
                items = {self.ids[self.item[k][w]] for w in range(a, b) if self.text.startswith(said, int(self.start[k][w]))}
                if items:
                    yield i, k, items


def _joined(words: tx.Words, i: int, j: int) -> bytes:
    """Words i to j, each with a blank behind it."""
    body = words.buf.tobytes() if i == 0 and j == len(words) else None
    starts, lens = words.starts[i:j].tolist(), words.lens[i:j].tolist()
    if body is not None:
        return b"".join(body[s : s + n] + b" " for s, n in zip(starts, lens, strict=True))
    return b"".join(words.buf[s : s + n].tobytes() + b" " for s, n in zip(starts, lens, strict=True))


def _cut(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, hit: np.ndarray) -> bytes:
    """The text without its runs of hit words, from a run's first byte to its last."""
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    out, at = [], 0
    for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
        out.append(buf[at : starts[a]].tobytes())
        at = ends[b - 1]
    out.append(buf[at:].tobytes())
    return b"".join(out)


def scan(docs: DataFrame, benchmark: DataFrame, *, n: int = N_WORDS, text: str = "text", item_id: str = "item_id", item_text: str = "text", keep_text: bool = True, max_bytes: int = MAX_BYTES) -> DataFrame:
    """``docs`` with n_words, n_hit, items (sorted strings) and, unless ``keep_text`` is False, ``text`` without its hit runs."""
    spark = docs.sparkSession
    bench = benchmark.select(F.col(item_id).cast("string").alias("item_id"), F.col(item_text).alias("text"))
    size = bench.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    passes = -(-size // max_bytes) or 1
    row, at = tx.fresh(docs, "_row"), tx.fresh(docs, "_at")
    out = ["n_words", "n_hit", "items"]
    rest = [c for c in docs.columns if c not in out and (keep_text or c != text)]
    src = docs if passes == 1 else Workspace(spark, "decontaminate").table(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    part = bench.withColumn("_part", F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)))
    found = []
    for p in range(passes):
        rows = part.filter(F.col("_part") == p).select("item_id", "text").collect()
        sent = spark.sparkContext.broadcast(Windows([r.item_id for r in rows], [r.text for r in rows], n))
        found.append((sent, p))
    if passes == 1:
        return _one_pass(src, found[0][0], rest, text)
    masks = None
    for sent, _ in found:
        one = _masks(src.select(F.col(row).alias("row"), F.col(text).alias("text")), sent)
        masks = one if masks is None else masks.unionByName(one)
    merged = masks.groupBy(F.col("row").alias(row)).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.array_distinct(F.flatten(F.collect_list("at"))).alias(at))
    joined = _columns(src, [row, text, *rest]).join(merged, row, "left")
    return _apply_masks(joined, rest, text, at)


def _schema(df: DataFrame, rest: list[str]) -> StructType:
    return tx.extended(df, rest, "n_words long, n_hit long, items array<string>")


def _columns(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*(F.col(f"`{c}`") for c in dict.fromkeys(names)))


def _emit(part: pa.RecordBatch, rest: list[str], text: str, words: tx.Words, hit: np.ndarray, items: list[list[str]]) -> pa.RecordBatch:
    n_hit = np.bincount(words.doc[hit], minlength=part.num_rows)
    cols = []
    for c in rest:
        col = tx.column(part, c)
        if c == text:
            kept = col.to_pylist()
            for i in np.flatnonzero(n_hit).tolist():
                a, b = words.first[i], words.first[i + 1]
                raw = np.frombuffer(kept[i].encode(), np.uint8)
                lo = words.starts[a:b] - words.offs[i]
                kept[i] = _cut(raw, lo, lo + words.lens[a:b], hit[a:b]).decode()
            col = pa.array(kept, pa.string())
        cols.append(col)
    cols += [pa.array(words.counts, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string()))]
    return pa.RecordBatch.from_arrays(cols, [*rest, "n_words", "n_hit", "items"])


def _one_pass(docs: DataFrame, sent, rest: list[str], text: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.slices(batch, text):
                words = tx.Words(tx.column(part, text), PUNCTUATION, lower=True)
                hit, items = np.zeros(len(words), bool), [set() for _ in range(part.num_rows)]
                for i, k, ids in sent.value.hits(words, words.hashes()):
                    hit[i : i + k] = True
                    items[words.doc[i]] |= ids
                yield _emit(part, rest, text, words, hit, [sorted(x) for x in items])

    return _columns(docs, [*rest, text]).mapInArrow(run, _schema(docs, rest))


def _masks(docs: DataFrame, sent) -> DataFrame:
    """For documents with hits in this pass: the items, and the numbers of the hit words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.slices(batch, "text"):
                words = tx.Words(tx.column(part, "text"), PUNCTUATION, lower=True)
                at: dict[int, set[int]] = {}
                items: dict[int, set[str]] = {}
                for i, k, ids in sent.value.hits(words, words.hashes()):
                    d = int(words.doc[i])
                    at.setdefault(d, set()).update(range(i - words.first[d], i - words.first[d] + k))
                    items.setdefault(d, set()).update(ids)
                rows = tx.column(part, "row").take(pa.array(list(at), pa.int64()))
                yield pa.RecordBatch.from_arrays([rows, pa.array([sorted(items[d]) for d in at], pa.list_(pa.string())), pa.array([sorted(at[d]) for d in at], pa.list_(pa.int64()))], ["row", "items", "at"])

    return docs.mapInArrow(run, "row long, items array<string>, at array<long>")


def _apply_masks(joined: DataFrame, rest: list[str], text: str, at: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.slices(batch, text):
                words = tx.Words(tx.column(part, text), PUNCTUATION, lower=True)
                hit = np.zeros(len(words), bool)
                for i, places in enumerate(tx.column(part, at).to_pylist()):
                    if places:
                        hit[np.asarray(places) + words.first[i]] = True
                items = [x or [] for x in tx.column(part, "items").to_pylist()]
                yield _emit(part, rest, text, words, hit, items)

    return _columns(joined, [*rest, text, at, "items"]).mapInArrow(run, _schema(joined, rest))


def clean(docs: DataFrame, benchmark: DataFrame, *, remove: str = "spans", **options) -> DataFrame:
    """``docs`` without hit runs (``spans``; a text with no other word is dropped) or without hit documents (``documents``)."""
    found = scan(docs, benchmark, **options)
    keep = F.col("n_hit") == 0 if remove == "documents" else (F.col("n_hit") == 0) | (F.col("n_hit") < F.col("n_words"))
    return _columns(found.filter(keep), docs.columns)


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from what ``scan`` returns."""
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def brute_force(docs: list[tuple], items: list[tuple], n: int = N_WORDS) -> list[tuple]:
    """The contract's rows by plain search, for tests."""
    import re

    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = []
    for doc_id, text in docs:
        words, hit, ids = split(text), set(), set()
        for item_id, item in items:
            w = split(item)
            k = min(n, len(w))
            for j in range(len(w) - k + 1 if k else 0):
                for i in range(len(words) - k + 1):
                    if words[i : i + k] == w[j : j + k]:
                        hit |= set(range(i, i + k))
                        ids.add(str(item_id))
        out.append((doc_id, len(words), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return out
