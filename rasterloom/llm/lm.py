"""LM scoring with a log-frequency Bloom filter of quantised n-gram counts.

Counting is exact and covers every training document.  Texts are taken in blocks of
bounded bytes; a block sends each bucket of the fingerprint space its distinct tokens
and bigrams with their counts, so a token that fills a third of the corpus is one entry
a block.  A bucket sums them and builds its shard of the filter: an n-gram of quantised
count q is inserted q times, as (n-gram, 1) .. (n-gram, q), and q is read back by
repeated membership probes.  It then answers each block with the counts of its tokens
and the levels that its tokens and bigrams have in the shard.

Quantiser: q = 1 + floor(2 log2 c) for unigrams and bigrams, so a count of 1 has level 1.
Model: P(w) = (rep(q) + 0.1) / Z, where rep(q) is 2 ** ((q - 0.5) / 2) (1 for q = 1) and Z
sums the same over the vocabulary and one unknown token;
P(w | v) = (low(vw) + K P(w)) / (high(v) + K) with the lower end of the
bigram's and the upper end of the context's level, so the probabilities of a context
sum to at most one, apart from the filter's false positives.  The begin mark's count is the
number of training texts, which is the exact count of the end token.

A shard has 12 bits an entry at every input size and lives in its bucket's task
only, where it is probed for all blocks; the number of buckets grows with the input.

Tokens are told apart by 64-bit fingerprints.  Defined cases: a null or empty text is
the end token alone; repeated rows count and are scored each; a null doc_id is in
training; with no training text every token is unknown; an empty table gives no rows;
doc_id must be an integer; other columns are not carried.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..workspace import Workspace
from . import _text as tx

BLOCK_BYTES = 4 << 20
CHUNK = 1 << 18
BITS_PER_ENTRY = 12
PROBES = 3
SMOOTHING = 8.0
FOLDS = 10

_UNI, _BI, _DOCS, _REPLY, _TOTAL = range(5)
_END = tx.mix(np.array([0xE4D], np.uint64))[0]
_BEGIN = tx.mix(np.array([0xBE6], np.uint64))[0]
_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_ROW = "block string, bucket int, kind int, payload binary"


def _planes(a: np.ndarray, width: int | None = None) -> bytes:
    """The bytes of an integer array, plane by plane, of the low ``width`` bytes; sorted values then compress well."""
    a = np.ascontiguousarray(a.astype(a.dtype.newbyteorder("<")))
    return a.view(np.uint8).reshape(len(a), a.itemsize)[:, :width].T.tobytes()


def _unplanes(b: bytes, n: int, dtype, width: int | None = None) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    out = np.zeros((n, size), np.uint8)
    out[:, : width or size] = np.frombuffer(b, np.uint8).reshape(width or size, n).T
    return out.view(dtype).reshape(n)


def _bucket(fp: np.ndarray, n: int) -> np.ndarray:
    return ((fp >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


def _edges(fp: np.ndarray, n: int) -> np.ndarray:
    """Where each bucket begins in sorted fingerprints."""
    return np.searchsorted(_bucket(fp, n), np.arange(n + 1))


def held_out(doc_ids: list[int | None], folds: int = FOLDS) -> np.ndarray:
    return np.array([x is not None and zlib.crc32(str(x).encode()) % folds == 0 for x in doc_ids], bool)


def _bigrams(tokens: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A fingerprint for each token with the one before it; the first of a text follows the begin mark."""
    before = np.empty_like(tokens)
    before[:1] = _BEGIN
    before[1:] = tokens[:-1]
    before[ends[:-1] + 1] = _BEGIN
    return tx.mix(before * _K1 + tokens * _K2)


def _blocks(docs: DataFrame, send: tuple[int, ...], n_buckets: int, block_bytes: int) -> DataFrame:
    """The messages of each block of texts, of the kinds in ``send``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, no = TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in tx.slices(batch, "text", block_bytes):
                block, no = f"{task}-{no}", no + 1
                words = tx.Words(tx.column(part, "text"), lower=True)
                ids = tx.column(part, "doc_id").to_pylist()
                train = ~held_out(ids)
                n = words.counts + 1
                ends = np.cumsum(n) - 1
                tokens = np.empty(int(n.sum()), np.uint64)
                body = np.ones(len(tokens), bool)
                body[ends] = False
                tokens[body], tokens[ends] = words.hashes(), _END
                of_train = np.repeat(train, n)
                kinds, buckets, payloads = [], [], []
                uniq, inv = np.unique(tokens, return_inverse=True)
                if _UNI in send:
                    counts = np.bincount(inv[of_train], minlength=len(uniq)).astype(np.uint64)
                    edge = _edges(uniq, n_buckets)
                    for b in np.flatnonzero(np.diff(edge)):
                        x = slice(edge[b], edge[b + 1])
                        kinds.append(_UNI)
                        buckets.append(b)
                        payloads.append(_planes(uniq[x]) + _planes(counts[x]))
                if _BI in send:
                    pairs, at = np.unique(_bigrams(tokens, ends), return_inverse=True)
                    counts = np.bincount(at[of_train], minlength=len(pairs)).astype(np.uint64)
                    edge = _edges(pairs, n_buckets)
                    for b in np.flatnonzero(np.diff(edge)):
                        x = slice(edge[b], edge[b + 1])
                        kinds.append(_BI)
                        buckets.append(b)
                        payloads.append(_planes(pairs[x]) + _planes(counts[x]))
                if _DOCS in send:
                    known = np.array([x is not None for x in ids], np.uint8)
                    head = np.array([len(ids), len(uniq), len(inv)], "<i8").tobytes()
                    kinds.append(_DOCS)
                    buckets.append(-1)
                    payloads.append(head + known.tobytes() + np.array([x or 0 for x in ids], "<i8").tobytes() + n.astype("<i8").tobytes() + _planes(uniq) + _planes(inv.astype(np.uint32)))
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(kinds)), pa.array(buckets, pa.int32()), pa.array(kinds, pa.int32()), pa.array(payloads, pa.binary())], ["block", "bucket", "kind", "payload"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _ROW)


def level_of(c: np.ndarray) -> np.ndarray:
    """The level of a count; 0 for none."""
    return np.where(c > 0, 1 + np.floor(2 * np.log2(np.maximum(c, 1)) + 1e-9), 0).astype(np.int64)


def uni_rep(q: np.ndarray) -> np.ndarray:
    """What a unigram level stands for."""
    return np.where(q <= 0, 0.0, np.where(q == 1, 1.0, 2.0 ** ((q - 0.5) / 2)))


def _slots(fp: np.ndarray, q: int | np.ndarray, last: np.ndarray) -> Iterator[np.ndarray]:
    """The places of (n-gram, q) in a shard, from 0 to ``last``, which is below 2 ** 32."""
    h, half = tx.mix(fp + np.asarray(q).astype(np.uint64) * _K2), np.uint64(32)
    step = h << half | h >> half | np.uint64(1)  # the upper halves of h and step are independent
    for i in range(PROBES):
        yield ((h + np.uint64(i) * step) >> half) * (last + np.uint64(1)) >> half


def _sums(rows: list[tuple[str, bytes]]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct fingerprints over all blocks, their counts, and where each block's are among them."""
    fps = [_unplanes(p[: len(p) // 2], len(p) // 16, np.uint64) for _, p in rows]
    counts = [_unplanes(p[len(p) // 2 :], len(p) // 16, np.uint64) for _, p in rows]
    uniq, inv = np.unique(np.concatenate(fps), return_inverse=True)
    total = np.bincount(inv, weights=np.concatenate(counts).astype(np.float64)).astype(np.int64)
    return uniq, total, np.split(inv, np.cumsum([len(x) for x in fps])[:-1])


def _shard(fp: np.ndarray, q: np.ndarray) -> Filter:
    """A filter of (n-gram, 1) .. (n-gram, q) for each fingerprint."""
    bits = 64 * max(1, -(-int(q.sum()) * BITS_PER_ENTRY // 64))
    shard = np.zeros(bits, bool)
    for at in range(0, len(fp), CHUNK):
        f, levels = fp[at : at + CHUNK], q[at : at + CHUNK]
        for level in range(1, int(levels.max(initial=0)) + 1):
            for slot in _slots(f[levels >= level], level, np.uint64(bits - 1)):
                shard[slot] = True
    return Filter({0: np.packbits(shard, bitorder="little").tobytes()}, 1)


def _levels(fp: np.ndarray, q: np.ndarray) -> np.ndarray:
    """What a shard of the given levels reads back for each fingerprint, as bytes."""
    shard = _shard(fp, q)
    return np.concatenate([shard.level(fp[at : at + CHUNK]).astype(np.uint8) for at in range(0, len(fp), CHUNK)] or [np.zeros(0, np.uint8)])


def _reduce(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    rows: dict[int, list] = {_UNI: [], _BI: []}
    for block, kind, payload in zip(table["block"].to_pylist(), table["kind"].to_pylist(), table["payload"].to_pylist(), strict=True):
        rows[kind].append((block, payload))
    totals, reply = np.zeros(3), {block: b"" for got in rows.values() for block, _ in got}
    if rows[_UNI]:
        uniq, counts, where = _sums(rows[_UNI])
        q = level_of(counts)
        totals[:] = counts.sum(), (counts > 0).sum(), (uni_rep(q)[q > 0] + 0.1).sum()
        levels = _levels(uniq, q)
        for (block, _), at in zip(rows[_UNI], where, strict=True):
            reply[block] += _planes(counts[at].astype(np.uint64)) + levels[at].tobytes()
    if rows[_BI]:
        uniq, counts, where = _sums(rows[_BI])
        levels = _levels(uniq, level_of(counts))
        for (block, _), at in zip(rows[_BI], where, strict=True):
            reply[block] += levels[at].tobytes()
    n = len(reply) + 1
    return pa.table([pa.array([*reply, ""]), pa.array([key[0].as_py()] * n, pa.int32()), pa.array([_REPLY] * (n - 1) + [_TOTAL], pa.int32()), pa.array([*reply.values(), totals.astype("<f8").tobytes()], pa.binary())], names=["block", "bucket", "kind", "payload"])


class Filter:
    """All shards side by side; ``level`` reads quantised counts by probing."""

    def __init__(self, shards: dict[int, bytes], n_buckets: int):
        sizes = np.zeros(n_buckets, np.int64)
        for b, s in shards.items():
            sizes[b] = len(s)
        self.at = (np.cumsum(sizes) - sizes).astype(np.uint64) * np.uint64(8)
        self.last = np.maximum(sizes * 8, 1).astype(np.uint64) - np.uint64(1)
        self.empty = sizes == 0
        self.bits = np.frombuffer(b"".join(shards[b] for b in sorted(shards)), np.uint8)

    def level(self, fp: np.ndarray, most: int = 200) -> np.ndarray:
        """The largest q for which (n-gram, 1) .. (n-gram, q) are all members."""
        out = np.zeros(len(fp), np.int64)
        bucket = _bucket(fp, len(self.at)).astype(np.int64)
        live = np.flatnonzero(~self.empty[bucket])
        for q in range(1, most):
            member = np.ones(len(live), bool)
            for slot in _slots(fp[live], q, self.last[bucket[live]]):
                bit = self.at[bucket[live]] + slot
                member &= (self.bits[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1
            live = live[member]
            if not len(live):
                break
            out[live] = q
        return out


def score(docs: DataFrame, *, n_buckets: int | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every text."""
    work = Workspace(docs.sparkSession, "lm")
    blocks = work.table(docs.select("doc_id", "text"), "docs") if _unstable(docs) else docs
    n_buckets = n_buckets or tx.buckets(blocks)
    sent = _blocks(blocks, (_UNI, _BI), n_buckets, block_bytes)
    summed = work.table(sent.groupBy("bucket").applyInArrow(_reduce, _ROW), "counts")
    totals = np.zeros(3)
    for r in summed.filter(F.col("kind") == _TOTAL).select("payload").collect():  # three numbers a bucket
        totals += np.frombuffer(r.payload, "<f8")
    total, vocabulary, mass = int(totals[0]), int(totals[1]), float(totals[2]) + 0.1

    def finish(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        kinds = table["kind"].to_pylist()
        payloads = table["payload"].to_pylist()
        p = payloads[kinds.index(_DOCS)]
        n_docs, n_uniq, n_tokens = np.frombuffer(p, "<i8", 3)
        at = 24
        known = np.frombuffer(p, np.uint8, n_docs, at).astype(bool)
        ids = np.frombuffer(p, "<i8", n_docs, at := at + n_docs)
        n = np.frombuffer(p, "<i8", n_docs, at := at + 8 * n_docs)
        uniq = _unplanes(p[(at := at + 8 * n_docs) : at + 8 * n_uniq], n_uniq, np.uint64)
        inv = _unplanes(p[at + 8 * n_uniq :], n_tokens, np.uint32)
        heads, ends = np.cumsum(n) - n, np.cumsum(n) - 1
        tokens = uniq[inv]
        pairs, pair_of = np.unique(_bigrams(tokens, ends), return_inverse=True)
        counts, level, pair_level = np.zeros(n_uniq, np.int64), np.zeros(n_uniq, np.int64), np.zeros(len(pairs), np.int64)
        edge, pair_edge = _edges(uniq, n_buckets), _edges(pairs, n_buckets)
        for b, k, reply in zip(table["bucket"].to_pylist(), kinds, payloads, strict=True):
            if k == _REPLY:
                m = edge[b + 1] - edge[b]
                counts[edge[b] : edge[b + 1]] = _unplanes(reply[: 8 * m], m, np.uint64)
                level[edge[b] : edge[b + 1]] = np.frombuffer(reply, np.uint8, m, 8 * m)
                pair_level[pair_edge[b] : pair_edge[b + 1]] = np.frombuffer(reply, np.uint8, offset=9 * m) if len(reply) > 9 * m else 0
        base = np.log10((counts + 0.1) / (total + 0.1 * (vocabulary + 1)))
        uni = ((uni_rep(level) + 0.1) / mass)[inv]
        context = np.ceil(2.0 ** (level / 2))[inv]  # above every count of the level
        context[inv[ends]] = 0
        before = np.empty(n_tokens)
        before[1:] = context[:-1]
        before[heads] = counts[uniq == _END]  # the training texts
        q = pair_level[pair_of]
        low = np.where(q > 0, np.ceil(2.0 ** ((q - 1) / 2) - 1e-9), 0.0)
        chance = (np.minimum(low, before) + SMOOTHING * uni) / (before + SMOOTHING)
        out = {
            "doc_id": pa.array(ids, pa.int64(), mask=~known),
            "held_out": pa.array(held_out([int(i) if k else None for i, k in zip(ids, known, strict=True)])),
            "n_tokens": pa.array(n, pa.int64()),
            "n_known": pa.array(np.add.reduceat((counts > 0)[inv].astype(np.int64), heads), pa.int64()),
            "train_tokens": pa.array(np.full(n_docs, total), pa.int64()),
            "base_score": pa.array(np.add.reduceat(base[inv], heads)),
            "score": pa.array(np.add.reduceat(np.log10(chance), heads)),
        }
        return pa.table(out)

    rows = _blocks(blocks, (_DOCS,), n_buckets, block_bytes).unionByName(summed.filter(F.col("kind") == _REPLY))
    return rows.groupBy("block").applyInArrow(finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _unstable(docs: DataFrame) -> bool:
    """Whether rows may come in other partitions when read again: anything but a scan with row-wise steps."""
    plan = docs._jdf.queryExecution().optimizedPlan().toString()
    return any(x in plan for x in ("Join", "Aggregate", "Repartition", "Sort", "Window", "Limit", "Sample", "Deduplicate", "Distinct", "Generate", "Python", "Arrow", "Pandas"))
