"""Substring dedup over words by a log-structured fingerprint index.

The index is a list of immutable runs; a run has, for each bucket of the fingerprint
space, the sorted distinct fingerprints of all windows of one batch of documents.  A new
batch is fingerprinted, dealt to the buckets, merge-joined there with every run and with
itself, and leaves a run of its own.  When there are ``max_runs`` runs they are compacted
into one before the next is added.  The index lives in a folder and can be opened again.  Batches come in ascending doc_id order, so what a run holds is always of a
smaller doc_id.

A fingerprint match is verified by the bucket, which comes from a second independent hash:
56 bits and log2(buckets) more must agree.  Texts are not compared; with one bucket per
million windows, n windows make about n * 1e6 / 2 ** 56 false matches, 0.004 in 270 million.

Defined cases: a null or blank text has no words and keeps the empty string; texts below
13 words have no window; rows that repeat a doc_id are one document to each other, so they
remove nothing from each other; a null doc_id counts as larger than any other; an empty
table gives no rows; other columns are not carried.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workspace import Workspace, finished, remove
from . import _exchange as ex
from . import _text as tx

WINDOW = 13
BATCHES = 2
MAX_RUNS = 4


def _windows(words: tx.Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(start word, fingerprint) of each window."""
    fp = tx.windows(words.hashes(), n)
    at = np.flatnonzero(words.room(n)[: len(fp)])
    return at, fp[at]


class FingerprintIndex:
    """Immutable runs of window fingerprints in a folder that may be kept from one call to the next.

    ``open`` finds what is there; ``add`` takes the next batch, which must not hold a doc_id below
    those before; ``compact`` merges the runs.  A run that was not written to its end does not
    count, and one that was merged but not yet removed does no harm.
    """

    def __init__(self, spark: SparkSession, path: str, n_buckets: int, window: int = WINDOW, max_runs: int = MAX_RUNS):
        self.spark, self.path, self.n_buckets, self.window, self.max_runs = spark, path, n_buckets, window, max_runs

    @classmethod
    def open(cls, spark: SparkSession, path: str, n_buckets: int | None = None, window: int = WINDOW, max_runs: int = MAX_RUNS) -> FingerprintIndex:
        """The index in a folder, made if it isn't there; buckets and window are those that it was made with."""
        if "settings" in finished(spark, path):
            n_buckets, window = spark.read.parquet(f"{path}/settings").select("n_buckets", "window").first()
        else:
            n_buckets = n_buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
            spark.createDataFrame([(n_buckets, window)], "n_buckets int, window int").write.parquet(f"{path}/settings")
        return cls(spark, path, n_buckets, window, max_runs)

    def names(self) -> list[str]:
        """The runs, oldest first."""
        return [n for n in finished(self.spark, self.path) if n.startswith("run-")]

    def _next(self) -> str:
        names = self.names()
        return f"{self.path}/run-{int(names[-1].split('-')[1]) + 1 if names else 0:09d}"

    def runs(self) -> DataFrame | None:
        names = self.names()
        return self.spark.read.schema(ex.SCHEMA).parquet(*(f"{self.path}/{n}" for n in names)).filter(F.col("kind") == ex.RUN) if names else None

    def add(self, docs: DataFrame, keep_run: bool = True) -> DataFrame:
        """The answers for a batch: packed (doc_id, fingerprint) of windows that a smaller doc_id has, here or in a run."""
        n_buckets, window = self.n_buckets, self.window
        if keep_run and len(self.names()) >= self.max_runs:
            self.compact()

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in tx.slices(batch, "text", ex.BLOCK_BYTES):
                    fps, docs, seconds = [], [], []
                    for small in tx.slices(part, "text"):
                        words = tx.Words(tx.column(small, "text"))
                        at, fp = _windows(words, window)
                        fps.append(fp)
                        seconds.append(tx.windows(words.hashes(1), window, 1)[at] % np.uint64(n_buckets))
                        docs.append(ex.ids_of(small)[words.doc[at]])
                    yield ex.table(ex.messages(np.concatenate(fps), np.concatenate(seconds), np.concatenate(docs), n_buckets, "earlier"))

        def merge(key: tuple[pa.Scalar, ...], got: pa.Table) -> pa.Table:
            return ex.answers(got, n_buckets, "earlier", keep_run)

        rows, runs = ex.plain(docs).mapInArrow(send, ex.SCHEMA), self.runs()
        if runs is not None:
            rows = rows.unionByName(runs)
        at = self._next() if keep_run else f"{self.path}/last-{uuid.uuid4().hex}"
        rows.groupBy("bucket").applyInArrow(merge, ex.SCHEMA).write.parquet(at)
        # a run's table holds the answers of its batch too, as both come of one merge
        return self.spark.read.schema(ex.SCHEMA).parquet(at).filter(F.col("kind") == ex.ANSWER)

    def compact(self) -> None:
        """Merges all runs into one, and then removes them, with the answers of their batches."""
        names = self.names()
        if len(names) < 2:
            return

        def merge(key: tuple[pa.Scalar, ...], got: pa.Table) -> pa.Table:
            runs = [ex.unplanes(p, n, ex.WIDTH) for n, p in zip(got["n"].to_pylist(), got["payload"].to_pylist(), strict=True)]
            one = np.unique(np.concatenate(runs))
            return pa.Table.from_batches([ex.table([(key[0].as_py(), ex.RUN, len(one), ex.planes(one, ex.WIDTH))])])

        self.runs().groupBy("bucket").applyInArrow(merge, ex.SCHEMA).write.parquet(self._next())
        for n in names:
            remove(self.spark, f"{self.path}/{n}")


def dedup(docs: DataFrame, *, window: int = WINDOW, batches: int = BATCHES, n_buckets: int | None = None, max_runs: int = MAX_RUNS) -> DataFrame:
    """doc_id, n_words, n_removed and kept, the words left, joined by a space."""
    spark = docs.sparkSession
    shares = [i / batches for i in range(1, batches)]
    asked = [F.percentile_approx(F.col("doc_id").cast("long"), shares, 1000)] if batches > 1 else [F.lit(None)]
    size, cuts = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), *asked).first()
    cuts = sorted(set(cuts or []))
    index = FingerprintIndex(spark, Workspace(spark, "substring").path, n_buckets or tx.buckets(docs, size=size), window, max(max_runs, batches))
    rank = sum((F.coalesce(F.col("doc_id").cast("long"), F.lit(int(ex.NO_ID))) > c).cast("int") for c in cuts) if cuts else F.lit(0)
    found = [index.add(docs.filter(rank == i), keep_run=i < len(cuts)) for i in range(len(cuts) + 1)]
    return _removed(docs, reduce(DataFrame.unionByName, found), index)


def dedup_next(docs: DataFrame, index: FingerprintIndex) -> DataFrame:
    """The same for a new batch against all that an index holds; the batch is then part of it.

    What is returned reads the batch's answers, so it is to be used before the next batch is added.
    """
    return _removed(docs, index.add(docs), index)


def _removed(docs: DataFrame, answers: DataFrame, index: FingerprintIndex) -> DataFrame:
    window, n_buckets = index.window, index.n_buckets

    def remove(part: pa.RecordBatch, fp: np.ndarray, doc: np.ndarray) -> pa.RecordBatch:
        words = tx.Words(tx.column(part, "text"))
        at, own = _windows(words, window)
        ids = ex.ids_of(part)
        covered = tx.spread(at[np.isin(ex.pair_keys(own, ids[words.doc[at]]), ex.pair_keys(fp, doc))], len(words), window)
        raw, kept = words.buf.tobytes(), []
        for i, j in zip(words.first[:-1], words.first[1:], strict=True):
            use = np.flatnonzero(~covered[i:j]) + i
            kept.append(b" ".join([raw[s : s + n] for s, n in zip(words.starts[use].tolist(), words.lens[use].tolist(), strict=True)]).decode())
        removed = np.bincount(words.doc[covered], minlength=len(ids))
        return pa.RecordBatch.from_arrays([tx.column(part, "doc_id"), pa.array(words.counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    def finish(key: tuple[pa.Scalar, ...], got: pa.Table) -> pa.Table:
        done = list(ex.meet(got, remove))
        return pa.Table.from_batches(done) if done else pa.table({"doc_id": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "kept": pa.array([], pa.string())})

    rows = ex.texts(docs, n_buckets).unionByName(answers)
    return rows.groupBy("bucket").applyInArrow(finish, "doc_id long, n_words long, n_removed long, kept string")
