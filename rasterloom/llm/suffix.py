"""Repeated byte strings, by column-wise construction over aligned text pieces.

1. In each text every window of ``width`` bytes has an anchor: its 32-byte gram of least
   hash, leftmost on ties.  Equal windows have equal anchors at equal offsets, so they are
   found among the pieces of text around equal anchors.  A piece is taken for the windows
   that reach far to the left of the anchor, another for those that reach far to the right;
   all windows of a piece hold the same 116 bytes, and only pieces whose 116 bytes occur
   twice or more in the corpus go on.
2. Equal pieces are one, with a count.  The different pieces of an anchor form a
   collection, aligned at the anchor.  Symbols are inserted column by column from the right,
   one symbol per piece each round: a stable sort by the new symbol updates the order of
   the suffixes (the symbols in that order are the column's part of the Burrows-Wheeler
   transform), and the common prefixes of neighbours are updated from the range minima of
   the round before.  A window is repeated if its suffix shares ``width`` bytes with a
   neighbour, or if its piece occurs twice.  An anchor with more than ``BATCH_PIECES`` pieces
   is not one collection: digests of its pieces' windows are counted in all tasks, and a
   window is repeated if its digest occurs twice.
3. The repeated windows go back to their texts, by a hash of doc_id and text together, and
   their bytes are removed.

Inserting whole texts side by side would take as many rounds over the whole collection as
the longest text has bytes; pieces are at most ``width`` + 84 bytes, so a fixed number of
rounds sees every window of texts of any length.  The tables between the steps are files in
the shared folder, read in sequence; a task holds one batch of collections at a time, which
is two times ``BATCH_PIECES`` pieces at most.

Defined cases: a null or empty text has no bytes; texts below ``width`` bytes have no
window; repeated rows repeat each other's strings; rows with a null doc_id, or with one
doc_id and different texts, keep their own answers; an empty table gives no rows; other
columns are not carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..workspace import Workspace
from . import _exchange as ex
from . import _text as tx

WIDTH = 200
GRAM = 32
#: Pieces in one round of insertions, and in a collection at most.
BATCH_PIECES = 20_000
_POSITION_BITS = np.uint64(32)
#: Windows whose anchors are looked for at once, so that the arrays stay in a core's cache.
_ANCHOR_WINDOWS = 1 << 15


def _grams(buf: np.ndarray, k: int, which: int = 0) -> np.ndarray:
    """A hash of each k bytes, built by doubling."""
    base = int(tx.powers(2, which)[1])
    h, have = buf.astype(np.uint64) + np.uint64(1), 1
    out, done = None, 0
    bit = 1
    while bit <= k:
        if k & bit:
            if out is None:
                out, done = h, bit
            else:
                n = len(buf) - done - bit + 1
                if n <= 0:
                    return np.zeros(0, np.uint64)
                out = out[:n] * np.uint64(pow(base, bit, 1 << 64)) + h[done : done + n]
                done += bit
        bit <<= 1
        if bit <= k:
            n = len(h) - have
            if n <= 0:
                return np.zeros(0, np.uint64)
            h = h[:n] * np.uint64(pow(base, have, 1 << 64)) + h[have : have + n]
            have = bit
    return tx.mix(out)


def _window_min(a: np.ndarray, w: int) -> np.ndarray:
    """The least of each w consecutive values."""
    m, have = a, 1
    while have * 2 <= w:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    rest = w - have
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


def _anchors(buf: np.ndarray, width: int) -> np.ndarray:
    """The anchor's position of each window of the buffer."""
    low = (np.uint64(1) << _POSITION_BITS) - np.uint64(1)
    out = np.empty(len(buf) - width + 1, np.int64)
    for lo in range(0, len(out), _ANCHOR_WINDOWS):
        hi = min(lo + _ANCHOR_WINDOWS, len(out))
        grams = _grams(buf[lo : hi + width - 1], GRAM)
        ranked = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
        out[lo:hi] = (_window_min(ranked, width - GRAM + 1) & low).astype(np.int64) + lo
    return out


def _common_keys(buf: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of the k bytes at each place, from their 8-byte words; the last word may overlap the one before it."""
    one, two = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
    words = np.lib.stride_tricks.sliding_window_view(buf, 8)
    for j, from_ in enumerate([*range(0, k - 8, 8), k - 8]):
        word = words[at + from_].view("<u8").ravel()
        one = tx.mix((one ^ word) * tx.powers(2)[1] + np.uint64(j + 1))
        two = tx.mix((two ^ tx.mix(word)) * tx.powers(2, 1)[1] + np.uint64(j + 1))
    return one, two


class Pieces:
    """The pieces of one slice of texts.

    For each: ``doc`` (row), ``lo`` (first window start in the buffer), ``n`` (windows),
    ``anchor`` (position), ``key`` (hash of the 116 bytes that all its windows hold).
    """

    def __init__(self, texts: pa.Array, width: int):
        self.buf, self.offs = tx.buffer(texts)
        size = len(self.buf)
        self.width, self.reach = width, (width - GRAM) // 2
        common = self.reach + GRAM
        none = np.zeros(0, np.int64)
        self.doc = self.lo = self.n = self.anchor = none
        self.key, self.second = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        if size < width:
            return
        anchor = _anchors(self.buf, width)
        fitting = np.maximum(np.diff(self.offs) - width + 1, 0)
        row = np.repeat(np.arange(len(fitting)), fitting)
        if not len(row):
            return
        start = np.arange(len(row)) + (self.offs[:-1] - (np.cumsum(fitting) - fitting))[row]
        left = start <= anchor[start] - self.reach
        same = (np.diff(anchor[start]) == 0) & (np.diff(start) == 1) & (left[1:] == left[:-1])
        head = np.flatnonzero(np.concatenate([[True], ~same]))
        self.lo, self.n = start[head], np.diff([*head, len(start)])
        self.anchor, self.doc = anchor[start[head]], row[head]
        self.left = left[head]
        at = np.where(self.left, self.anchor - self.reach, self.anchor)
        key, second = _common_keys(self.buf, at, common)
        self.key, self.second = tx.mix(key + self.left.astype(np.uint64)), tx.mix(second + self.left.astype(np.uint64))


def repeated_windows(anchor_key: np.ndarray, content: list[bytes], anchor: np.ndarray, n: np.ndarray, width: int) -> list[np.ndarray]:
    """For each piece which of its windows occurs in another piece of the same key.

    ``anchor_key`` numbers the collections, in order; ``anchor`` is the anchor's place in the piece.
    """
    m = len(content)
    most_left, most_right = int(anchor.max()), int(max(len(c) - a for c, a in zip(content, anchor, strict=True)))
    columns = np.full((most_left + most_right, m), 256, np.int64)
    for i, (c, a) in enumerate(zip(content, anchor, strict=True)):
        columns[most_left - a : most_left - a + len(c), i] = np.frombuffer(c, np.uint8)
    order = np.arange(m)
    common = np.zeros(m + 1, np.int64)  # of each suffix with the one before it in order
    group = anchor_key.astype(np.int64) * 512
    out = [np.zeros(k, bool) for k in n]
    for at in range(most_left + most_right - 1, -1, -1):
        symbol = columns[at]
        sort_key = (group + symbol)[order]
        perm = np.argsort(sort_key, kind="stable")
        keys = sort_key[perm]
        pair = np.flatnonzero((keys[1:] == keys[:-1]) & (keys[1:] & 511 != 256)) + 1
        fresh = np.zeros(m + 1, np.int64)
        if len(pair):
            ask = np.column_stack([perm[pair - 1] + 1, perm[pair] + 1]).ravel()
            fresh[pair] = np.minimum.reduceat(common, ask)[::2] + 1
        order, common = order[perm], fresh
        if at <= most_left:
            deep = order[np.maximum(common[:-1], np.append(common[1:-1], 0)) >= width]
            for i in deep.tolist():
                t = at - (most_left - anchor[i])
                if 0 <= t < n[i]:
                    out[i][t] = True
    return out


def _candidates(docs: DataFrame, n_buckets: int, width: int, work: Workspace) -> DataFrame:
    """The pieces whose common bytes occur twice: row (the text's id), lo, n, anchor, key, same (hash of the content), content (once a block)."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.slices(batch, "text", ex.BLOCK_BYTES):
                fps, docs_, seconds = [], [], []
                for small in tx.slices(part, "text"):
                    p = Pieces(tx.column(small, "text"), width)
                    fps.append(p.key)
                    seconds.append(p.second % np.uint64(n_buckets))
                    docs_.append(ex.row_ids(small)[p.doc])
                yield ex.table(ex.messages(np.concatenate(fps), np.concatenate(seconds), np.concatenate(docs_), n_buckets, "again"))

    def answer(key: tuple[pa.Scalar, ...], got: pa.Table) -> pa.Table:
        return ex.answers(got, n_buckets, "again", False)

    def cut(part: pa.RecordBatch, fp: np.ndarray, doc: np.ndarray) -> pa.RecordBatch:
        p = Pieces(tx.column(part, "text"), width)
        ids = ex.row_ids(part)
        use = np.flatnonzero(np.isin(ex.pair_keys(p.key, ids[p.doc]), ex.pair_keys(fp, doc)))
        raw = p.buf.tobytes()
        content = [raw[i:j] for i, j in zip(p.lo[use].tolist(), (p.lo[use] + p.n[use] - 1 + width).tolist(), strict=True)]
        # the content once for each different piece of the slice
        first = {c: i for i, c in reversed(list(enumerate(content)))}
        sent = [c if first[c] == i else None for i, c in enumerate(content)]
        same = [hashlib.blake2b(c, digest_size=12).digest() for c in content]
        doc = p.doc[use]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids[doc]),
                pa.array(p.lo[use] - p.offs[doc], pa.int64()),
                pa.array(p.n[use], pa.int32()),
                pa.array(p.anchor[use] - p.lo[use], pa.int32()),
                pa.array(p.key[use].astype(np.int64)),
                pa.array(same, pa.binary()),
                pa.array(sent, pa.binary()),
            ],
            _PIECE_NAMES,
        )

    def finish(key: tuple[pa.Scalar, ...], got: pa.Table) -> pa.Table:
        done = list(ex.meet(got, cut, ex.row_ids))
        return pa.Table.from_batches(done) if done else _NO_PIECES.slice(0)

    sent = ex.plain(docs).mapInArrow(send, ex.SCHEMA)
    found = sent.groupBy("bucket").applyInArrow(answer, ex.SCHEMA)
    met = found.unionByName(ex.texts(docs, n_buckets, ex.row_ids)).groupBy("bucket").applyInArrow(finish, "row long, lo long, n int, anchor int, key long, same binary, content binary")
    return work.table(met, "pieces")


_PIECE_NAMES = ["row", "lo", "n", "anchor", "key", "same", "content"]
_NO_PIECES = pa.table({k: pa.array([], t) for k, t in zip(_PIECE_NAMES, [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()], strict=True)})


def _split(pieces: DataFrame, work: Workspace, most: int) -> tuple[DataFrame, DataFrame | None]:
    """The pieces of keys with ``most`` pieces at most, and those of all other keys, None if there are none."""
    large = work.table(pieces.groupBy("key").agg(F.count("*").alias("pieces")).filter(F.col("pieces") > most).select("key"), "large")
    if large.isEmpty():
        return pieces, None
    large = F.broadcast(large)  # one key for each ``most`` pieces at most
    return pieces.join(large, "key", "left_anti"), pieces.join(large, "key", "left_semi")


def _runs(masks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mask, start, end) of each run of ones in packed masks; the bits behind a mask's last window are zero."""
    raw = b"".join(masks.to_pylist())
    offs = np.concatenate([[0], np.cumsum(pc.binary_length(masks).to_numpy().astype(np.int64))]) * 8
    bits = np.unpackbits(np.frombuffer(raw, np.uint8)).astype(bool)
    head = np.zeros(len(bits) + 1, bool)
    head[offs] = True  # a run ends with its mask
    begins = bits & np.concatenate([[True], ~bits[:-1]])[: len(bits)] | bits & head[:-1]
    ends = bits & (np.concatenate([~bits[1:], [True]])[: len(bits)] | head[1:])
    a, b = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    mask = np.searchsorted(offs, a, "right") - 1
    return mask, a - offs[mask], b - offs[mask]


def _different(pieces: DataFrame) -> DataFrame:
    return pieces.groupBy("key", "same", "n", "anchor").agg(F.count("*").alias("times"), F.first("content", ignorenulls=True).alias("content"))


def _marks_of_large(pieces: DataFrame, width: int, work: Workspace) -> DataFrame:
    """As _marks, for keys with too many pieces for one task."""
    different = work.table(_different(pieces), "large_pieces")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.slices(batch, "content", 1 << 17):
                content, n = tx.column(part, "content").to_pylist(), tx.column(part, "n").to_numpy()
                row = pa.array(np.repeat(np.arange(len(n)), n))
                t = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                digests = [hashlib.blake2b(c[i : i + width], digest_size=16).digest() for c, m in zip(content, n.tolist(), strict=True) for i in range(m)]
                yield pa.RecordBatch.from_arrays([*(tx.column(part, x).take(row) for x in ("key", "same", "n")), pa.array(t, pa.int32()), pa.array(digests, pa.binary())], ["key", "same", "n", "t", "digest"])

    def masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = []
            for n, at in zip(tx.column(batch, "n").to_pylist(), tx.column(batch, "at").to_pylist(), strict=True):
                hit = np.zeros(n, bool)
                hit[at] = True
                got.append(np.packbits(hit).tobytes())
            yield pa.RecordBatch.from_arrays([*tx.pick(batch, "key", "same"), pa.array(got, pa.binary())], ["key", "same", "mask"])

    schema = "key long, same binary, n int, t int, digest binary"
    repeated = different.mapInArrow(windows, schema).groupBy("digest").agg(F.count("*").alias("pieces")).filter("pieces > 1").select("digest")
    hits = different.filter("times = 1").mapInArrow(windows, schema).join(repeated, "digest").groupBy("key", "same", "n").agg(F.collect_list("t").alias("at"))
    copies = different.filter("times > 1").select("key", "same", "n", F.sequence(F.lit(0), F.col("n") - 1).alias("at"))
    return hits.unionByName(copies).mapInArrow(masks, "key long, same binary, mask binary")


def _marks(pieces: DataFrame, width: int, work: Workspace, most: int) -> DataFrame:
    """(key, same, mask) of the different pieces with repeated windows; a bit for each window."""
    few, many = _split(pieces, work, most)
    different = _different(few)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        size = 0
        for batch in batches:
            for part in [batch.slice(i, 4096) for i in range(0, batch.num_rows, 4096)]:
                rows = part.to_pylist()
                held += rows
                size += len(rows)
                if size >= BATCH_PIECES:
                    last = held[-1]["key"]
                    ready = [r for r in held if r["key"] != last]
                    if ready:
                        yield marked(ready)
                        held = [r for r in held if r["key"] == last]
                        size = len(held)
        if held:
            yield marked(held)

    def marked(rows: list[dict]) -> pa.RecordBatch:
        keys = np.array([r["key"] for r in rows])
        group = np.cumsum(np.concatenate([[0], np.diff(keys) != 0]))
        alone = np.bincount(group)[group] == 1
        hits = [np.full(r["n"], r["times"] > 1) for r in rows]
        some = np.flatnonzero(~alone)
        if len(some):
            own = [rows[i] for i in some]
            found = repeated_windows(group[some], [r["content"] for r in own], np.array([r["anchor"] for r in own]), np.array([r["n"] for r in own]), width)
            for i, f in zip(some, found, strict=True):
                hits[i] |= f
        keep = [i for i, h in enumerate(hits) if h.any()]
        return pa.RecordBatch.from_arrays(
            [pa.array([rows[i]["key"] for i in keep], pa.int64()), pa.array([rows[i]["same"] for i in keep], pa.binary()), pa.array([np.packbits(hits[i]).tobytes() for i in keep], pa.binary())],
            ["key", "same", "mask"],
        )

    dealt = different.repartition(F.col("key")).sortWithinPartitions("key", "same")
    marks = dealt.mapInArrow(run, "key long, same binary, mask binary")
    return marks if many is None else marks.unionByName(_marks_of_large(many, width, work))


def dedup(docs: DataFrame, *, width: int = WIDTH, n_buckets: int | None = None, most_pieces: int = BATCH_PIECES) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (removed runs, start and end) and kept, the bytes left."""
    spark = docs.sparkSession
    n_buckets = n_buckets or tx.buckets(docs, 2)
    work = Workspace(spark, "suffix")
    pieces = _candidates(docs, n_buckets, width, work)
    marks = _marks(pieces, width, work, most_pieces)
    found = pieces.select("row", "lo", "n", "key", "same").join(marks, ["key", "same"]).select("row", "lo", "n", "mask")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lo = (tx.column(batch, c).to_numpy() for c in ("row", "lo"))
            piece, a, b = _runs(tx.column(batch, "mask"))
            owner, fps = ids[piece], ((lo[piece] + a) << 8 | (b - a)).astype(np.uint64)
            yield ex.table(ex.by_bucket(ex.doc_bucket(owner, n_buckets), ex.ANSWER, fps, owner) if len(owner) else [])

    def remove(part: pa.RecordBatch, runs: np.ndarray, doc: np.ndarray) -> pa.RecordBatch:
        buf, offs = tx.buffer(tx.column(part, "text"))
        lo, n = (runs >> np.uint64(8)).astype(np.int64), (runs & np.uint64(255)).astype(np.int64)
        ids = ex.row_ids(part)
        first, last = np.searchsorted(doc, ids), np.searchsorted(doc, ids, "right")
        many = last - first
        at = np.arange(int(many.sum())) + np.repeat(first - (np.cumsum(many) - many), many)
        a = lo[at] + np.repeat(offs[:-1], many)
        delta = np.bincount(a, minlength=len(buf) + 1) - np.bincount(a + n[at] - 1 + width, minlength=len(buf) + 1)
        gone = np.cumsum(delta[:-1]) > 0
        edge = np.zeros(len(buf) + 1, bool)
        edge[offs] = True  # a run ends with its text
        before, after = np.concatenate([[False], gone[:-1]])[: len(buf)], np.concatenate([gone[1:], [False]])[: len(buf)]
        start, end = np.flatnonzero(gone & (~before | edge[:-1])), np.flatnonzero(gone & (~after | edge[1:])) + 1
        row = np.searchsorted(offs, start, "right") - 1
        upto = np.concatenate([[0], np.cumsum(gone)])[offs]
        kept = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer((offs - upto).astype(np.int32)), pa.py_buffer(buf[~gone])])
        runs_of = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(ids)))]).astype(np.int32)
        spans = pa.ListArray.from_arrays(pa.array(runs_of), pa.StructArray.from_arrays([pa.array(start - offs[row], pa.int64()), pa.array(end - offs[row], pa.int64())], ["start", "end"]))
        return pa.RecordBatch.from_arrays([tx.column(part, "doc_id"), pa.array(np.diff(offs), pa.int64()), pa.array(np.diff(upto), pa.int64()), spans, kept], ["doc_id", "n_bytes", "n_removed", "spans", "kept"])

    def finish(key: tuple[pa.Scalar, ...], got: pa.Table) -> pa.Table:
        done = list(ex.meet(got, remove, ex.row_ids))
        if done:
            return pa.Table.from_batches(done)
        return pa.table({"doc_id": pa.array([], pa.int64()), "n_bytes": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "spans": pa.array([], _SPANS), "kept": pa.array([], pa.binary())})

    rows = found.mapInArrow(pack, ex.SCHEMA).unionByName(ex.texts(docs, n_buckets, ex.row_ids))
    return rows.groupBy("bucket").applyInArrow(finish, "doc_id long, n_bytes long, n_removed long, spans array<struct<start: long, end: long>>, kept binary")


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
