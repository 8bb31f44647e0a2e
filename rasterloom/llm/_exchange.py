"""Asking the whole corpus about fingerprints, in packed messages.

A block of texts sends each bucket of fingerprints one row with its distinct ones, not
a row for each; what many texts of the block share is one entry, so a passage that a
third of all texts hold costs one entry a block.  Buckets answer with (doc_id,
fingerprint) pairs, dealt by doc_id, and meet the texts there.

Rules: ``earlier`` answers the fingerprints of a doc_id that a smaller doc_id, or a
historical run, has too; ``again`` those that occur twice or more in all.  A fingerprint
is 56 bits, and its bucket is taken from a second, independent hash, so two count as
equal when 56 + log2(buckets) bits agree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as tx

BLOCK_BYTES = 4 << 20
WIDTH = 7
NEW, LOCAL, RUN, ANSWER, TEXT = range(5)
SCHEMA = "bucket int, kind int, n long, payload binary"
_NAMES = ["bucket", "kind", "n", "payload"]
NO_ID = np.iinfo(np.int64).max


def planes(a: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of 64-bit values, plane by plane; sorted or small values then compress well."""
    a = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), 8)
    return a[:, :width].T.tobytes()


def unplanes(b: memoryview | bytes, n: int, width: int, dtype=np.uint64) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(b, np.uint8, n * width).reshape(width, n).T
    return out.view(dtype).reshape(n)


def entry(fp: np.ndarray, doc: np.ndarray) -> bytes:
    return planes(fp, WIDTH) + planes(doc, 8)


def entries(rows: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    fps = [unplanes(p, n, WIDTH) for n, p in rows]
    docs = [unplanes(memoryview(p)[n * WIDTH :], n, 8, np.int64) for n, p in rows]
    return (np.concatenate(fps), np.concatenate(docs)) if rows else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def table(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    b, k, n, p = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(k, pa.int32()), pa.array(n, pa.int64()), pa.array(p, pa.binary())], _NAMES)


def by_bucket(bucket: np.ndarray, kind: int, fp: np.ndarray, doc: np.ndarray) -> list[tuple[int, int, int, bytes]]:
    """A row for each bucket that has entries."""
    if not len(bucket):
        return []
    order = np.argsort(bucket, kind="stable")
    bucket, fp, doc = bucket[order], fp[order], doc[order]
    cut = np.flatnonzero(np.diff(bucket, prepend=-1))
    return [(int(bucket[i]), kind, int(j - i), entry(fp[i:j], doc[i:j])) for i, j in zip(cut, [*cut[1:], len(bucket)], strict=True)]


def doc_bucket(doc: np.ndarray, n: int) -> np.ndarray:
    return (tx.mix(doc.astype(np.uint64)) % np.uint64(n)).astype(np.int32)


def messages(fp: np.ndarray, second: np.ndarray, doc: np.ndarray, n_buckets: int, rule: str) -> list[tuple[int, int, int, bytes]]:
    """What a block sends; ``second`` is the independent hash, ``doc`` the doc_id of each entry."""
    if not len(fp):
        return []
    fp = fp & np.uint64((1 << 8 * WIDTH) - 1)
    order = np.lexsort((doc, second, fp))
    fp, second, doc = fp[order], second[order], doc[order]
    new = np.ones(len(fp), bool)
    new[1:] = (fp[1:] != fp[:-1]) | (second[1:] != second[:-1])
    head = np.flatnonzero(new)
    first = np.repeat(head, np.diff([*head, len(fp)]))
    if rule == "earlier":
        known = doc > doc[first]
    else:
        known = np.repeat(np.diff([*head, len(fp)]) > 1, np.diff([*head, len(fp)]))
    once = known & np.concatenate([[True], (doc[1:] != doc[:-1]) | new[1:]])
    local = doc[once]
    rows = by_bucket(doc_bucket(local, n_buckets), LOCAL, fp[once], local)
    bucket = (second[head] % np.uint64(n_buckets)).astype(np.int32)
    if rule == "again":
        # an entry that the block has twice is sent twice, so that others learn of it
        twice = head[np.diff([*head, len(fp)]) > 1]
        head = np.concatenate([head, twice])
        bucket = (second[head] % np.uint64(n_buckets)).astype(np.int32)
    return rows + by_bucket(bucket, NEW, fp[head], doc[head])


def answers(got: pa.Table, n_buckets: int, rule: str, keep_run: bool) -> pa.Table:
    """What a bucket answers, and with ``keep_run`` its new sorted run."""
    rows: dict[int, list] = {NEW: [], LOCAL: [], RUN: []}
    bucket = got["bucket"][0].as_py()
    for k, n, p in zip(got["kind"].to_pylist(), got["n"].to_pylist(), got["payload"].to_pylist(), strict=True):
        rows[k].append((n, p))
    fp, doc = entries(rows[NEW])
    order = np.lexsort((doc, fp))
    fp, doc = fp[order], doc[order]
    new = np.ones(len(fp), bool)
    new[1:] = fp[1:] != fp[:-1]
    head = np.flatnonzero(new)
    size = np.diff([*head, len(fp)]) if len(head) else np.zeros(0, np.int64)
    if rule == "earlier":
        hit = doc > np.repeat(doc[head], size)
        for n, p in rows[RUN]:  # both sides are sorted: a merge
            run = unplanes(p, n, WIDTH)
            at = np.minimum(np.searchsorted(run, fp), max(0, n - 1))
            if n:
                hit |= run[at] == fp
    else:
        hit = np.repeat(size > 1, size)
    lfp, ldoc = entries(rows[LOCAL])
    fps, docs = np.concatenate([fp[hit], lfp]), np.concatenate([doc[hit], ldoc])
    out = by_bucket(doc_bucket(docs, n_buckets), ANSWER, fps, docs) if len(docs) else []
    if keep_run and len(head):
        out.append((bucket, RUN, len(head), planes(fp[head], WIDTH)))
    return pa.Table.from_batches([table(out)])


def ids_of(part: pa.RecordBatch) -> np.ndarray:
    return tx.column(part, "doc_id").fill_null(int(NO_ID)).to_numpy(zero_copy_only=False)


def row_ids(part: pa.RecordBatch) -> np.ndarray:
    """An id of each row's doc_id and text together: rows that share it are the same row twice."""
    buf, offs = tx.buffer(tx.column(part, "text"))
    raw = memoryview(buf)
    own = np.array([int.from_bytes(hashlib.blake2b(raw[i:j], digest_size=8).digest(), "little") for i, j in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)], np.uint64)
    return tx.mix(own ^ tx.mix(ids_of(part).astype(np.uint64))).view(np.int64)


def plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def texts(docs: DataFrame, n_buckets: int, ids_of: Callable[[pa.RecordBatch], np.ndarray] = ids_of) -> DataFrame:
    """The texts, packed by the bucket of their id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.slices(batch, "text", BLOCK_BYTES):
                ids = ids_of(part)
                bucket = doc_bucket(ids, n_buckets)
                rows = []
                for b in np.unique(bucket):
                    own = part.take(pa.array(np.flatnonzero(bucket == b)))
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, own.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                        w.write_batch(own)
                    rows.append((int(b), TEXT, own.num_rows, sink.getvalue().to_pybytes()))
                yield table(rows)

    return plain(docs).mapInArrow(run, SCHEMA)


def meet(got: pa.Table, work: Callable[[pa.RecordBatch, np.ndarray, np.ndarray], pa.RecordBatch], ids_of: Callable[[pa.RecordBatch], np.ndarray] = ids_of) -> Iterator[pa.RecordBatch]:
    """Calls ``work(texts, answered fingerprints, their ids)`` for slices of a bucket's texts."""
    rows: dict[int, list] = {ANSWER: [], TEXT: []}
    for k, n, p in zip(got["kind"].to_pylist(), got["n"].to_pylist(), got["payload"].to_pylist(), strict=True):
        rows[k].append((n, p))
    fp, doc = entries(rows[ANSWER])
    order = np.argsort(doc, kind="stable")
    fp, doc = fp[order], doc[order]
    for _, p in rows[TEXT]:
        for batch in pa.ipc.open_stream(p):
            for part in tx.slices(batch, "text"):
                ids = np.unique(ids_of(part))
                lo, hi = np.searchsorted(doc, ids), np.searchsorted(doc, ids, "right")
                at = np.concatenate([np.arange(i, j) for i, j in zip(lo, hi, strict=True)]) if len(ids) else np.zeros(0, np.int64)
                yield work(part, fp[at], doc[at])


def pair_keys(fp: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """One key for each (fingerprint, doc_id)."""
    return tx.mix((fp & np.uint64((1 << 8 * WIDTH) - 1)) ^ tx.mix(doc.astype(np.uint64)))
