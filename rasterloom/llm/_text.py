"""Vectorised word and window fingerprints over Arrow text columns.

A text column arrives as one byte buffer with offsets, so words, hashes and
windows of a whole batch are a few numpy passes and no Python object per word.
Batches are cut into slices of bounded bytes first: memory depends on the slice
(or on the longest single text), not on the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SLICE_BYTES = 1 << 20
#: Text bytes for each bucket at most, on average, so that a bucket's task fits in memory at every input size.
BUCKET_BYTES = 32 << 20

#: A-Z to a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def separators(*ranges: tuple[int, int]) -> np.ndarray:
    """A 256-entry table, True for the bytes of the given inclusive ranges."""
    table = np.zeros(256, bool)
    for lo, hi in ranges:
        table[lo : hi + 1] = True
    return table


#: Separators of words [^\x20\x09-\x0D]+.
BLANKS = separators((0x20, 0x20), (0x09, 0x0D))


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that each part holds about ``limit`` bytes of text, one row at least."""
    if batch.num_rows == 0:
        return
    size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
    upto = np.cumsum(size.to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < batch.num_rows:
        before = upto[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(upto, before + limit, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]


def buckets(docs: DataFrame, each: int = 1, size: int | None = None) -> int:
    """``each`` buckets a shuffle partition, and more where they would hold over BUCKET_BYTES of text."""
    by_setting = each * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(by_setting, -(-(text_bytes(docs) if size is None else size) // BUCKET_BYTES))


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after the other, and the n + 1 offsets; null is empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None or not len(texts):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def powers(n: int, which: int = 0) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    out = np.full(max(n, 1), np.uint64(_BASES[which]))
    out[0] = 1
    return np.multiply.accumulate(out)


class Words:
    """The words of the texts of one slice.

    ``starts`` and ``lens`` are byte positions in ``buf``; ``first`` has the index
    of each text's first word, n + 1 entries; ``doc`` the text of each word.
    """

    def __init__(self, texts: pa.Array, blanks: np.ndarray = BLANKS, lower: bool = False):
        self.buf, self.offs = buffer(texts)
        if lower:
            self.buf = LOWER[self.buf]
        word = ~blanks[self.buf]
        before = np.empty_like(word)
        before[:1] = False
        before[1:] = word[:-1]
        edges = self.offs[:-1][self.offs[:-1] < len(word)]
        before[edges] = False
        self.starts = np.flatnonzero(word & ~before)
        after = np.empty_like(word)
        after[-1:] = False
        after[:-1] = word[1:]
        ends = self.offs[1:][self.offs[1:] > 0]
        after[ends - 1] = False
        self.lens = np.flatnonzero(word & ~after) + 1 - self.starts
        self._word = word
        self.first = np.searchsorted(self.starts, self.offs)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(self.offs) - 1), self.counts)

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self, which: int = 0, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of each word's bytes, of a-z for A-Z if ``lower``."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        body = self.buf[self._word]
        if lower:
            body = LOWER[body]
        heads = np.cumsum(self.lens) - self.lens
        inside = np.arange(int(self.lens.sum())) - np.repeat(heads, self.lens)
        terms = (body.astype(np.uint64) + np.uint64(1)) * powers(int(self.lens.max()), which)[inside]
        return mix(np.add.reduceat(terms, heads) + self.lens.astype(np.uint64))

    def room(self, k: int) -> np.ndarray:
        """True where a window of ``k`` words of the same text starts."""
        return self.first[1:][self.doc] - np.arange(len(self)) >= k


def windows(h: np.ndarray, k: int, which: int = 0) -> np.ndarray:
    """A hash of each k consecutive entries of ``h``; len(h) - k + 1 of them."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, by = np.zeros(n, np.uint64), powers(k, which)
    for j in range(k):
        out += h[j : j + n] * by[j]
    return mix(out)


def spread(starts: np.ndarray, n: int, k: np.ndarray | int) -> np.ndarray:
    """A mask of length n, True at every position within k of a start, itself included."""
    delta = np.zeros(n + 1, np.int64)
    np.add.at(delta, starts, 1)
    np.add.at(delta, np.minimum(starts + k, n), -1)
    return np.cumsum(delta[:n]) > 0


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def extended(df: DataFrame, kept: list[str], added: str) -> StructType:
    """The schema of some columns of ``df`` and of added ones; names may be any."""
    return StructType([*(df.schema[c] for c in kept), *StructType.fromDDL(added)])


def pick(batch: pa.RecordBatch, *names: str) -> list[pa.Array]:
    return [column(batch, x) for x in names]
