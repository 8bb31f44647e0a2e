"""Byte-level BPE encoding of whole texts, and the token-ID file format.

Encoding: a byte-level BPE with pre-tokens never merges over the start of
"space, then a non-space", so the distinct words of a slice of texts are looked up once,
words that the worker has not met are encoded side by side in one text, and the ids of
all words are put together by one gather.  Texts with other white space, control characters
or a special token's string go to the tokenizer whole.  The ids are the tokenizer's own
either way.

File format: one Parquet row per document with its ids in a list column, in ascending
doc_id order, dictionary-encoded pages (or DELTA_BINARY_PACKED, ``encoding="delta"``),
with set row-group and page sizes and page indexes, so that a reader takes the
metadata columns, a doc_id range or the ids alone.

Defined cases: null and empty texts have no ids but the end id; repeated doc_ids are
rows of their own, ordered among themselves by text; a null doc_id comes first; an
empty table gives no rows; other columns are not written.
"""

from __future__ import annotations

import itertools
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workspace import Workspace
from . import _text as tx

TOKENIZER = "byte_bpe_50k.json"
#: Words a worker remembers at most; beyond it only those that it has met in several slices.
TABLE_ENTRIES = 600_000
_LONG_WORD = 64
_CHUNK = 4000
_SLICE_BYTES = 2 << 20
#: Text for each written partition at most, on average.
PART_BYTES = 128 << 20

#: A word after which the whole text goes to the tokenizer: other white space or control characters in it, or white space, or nothing, after its space.
_ODD_WORD = re.compile("[\x00-\x08\x0b-\x1f\x7f-\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f\u3000\ufeff]|^[ \n\t]|^$")
_ODD = -1
#: Letters, then perhaps ASCII marks: one or two pre-tokens of a byte-level BPE.
_PLAIN_WORD = re.compile(r"([^\W\d_]+)([!-&(-/:-@\[-`{-~]*)\Z")


def _byte_characters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it is visible, the next free one from 256 on if not."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = itertools.count(0x100)
    return [chr(b if b in visible else next(free)) for b in range(0x100)]


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Texts to ids.  ``ids`` holds the known words' ids one after the other, ``at`` the number of each word, ``start`` and ``size`` its place; size -1 marks an odd word."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.bytes = dict(enumerate(_byte_characters()))
        self.space = self.bytes[0x20]
        #: Whether words of letters are one pre-token each.
        self.plain = self.tokenizer.normalizer is None and str(self.tokenizer.pre_tokenizer).startswith("ByteLevel(add_prefix_space=False") and "use_regex=True" in str(self.tokenizer.pre_tokenizer)
        self.marks: dict[str, list[int]] = {"": []}
        vocabulary = self.tokenizer.get_vocab()
        #: Whether an id begins with a space.
        self.spaced = np.zeros(max(vocabulary.values()) + 1, bool)
        self.spaced[[i for token, i in vocabulary.items() if token.startswith(self.space)]] = True
        self.forget([])

    def forget(self, keep: list[str]) -> None:
        """Starts a new table, with the words of the old one that are in ``keep``."""
        old = [self.ids[self.start[k] : self.start[k] + max(0, self.size[k])] for k in map(self.at.__getitem__, keep)] if keep else []
        size = self.size[[self.at[w] for w in keep]] if keep else np.zeros(0, np.int64)
        self.at: dict[str, int] = {w: k for k, w in enumerate(keep)}
        self.size, self.met = size, np.zeros(len(keep), np.int64)
        self.start = np.cumsum(np.maximum(size, 0)) - np.maximum(size, 0)
        self.ids = np.concatenate([*old, np.zeros(0, "<u4")])

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def odd(self, word: str) -> bool:
        return bool(_ODD_WORD.search(word)) or any(s in word for s in self.special)

    def learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, each after a space, and the number of each; -1 for odd ones."""
        out: list[list[int] | np.ndarray] = [[]] * len(words)
        odd, rest, cores, merge = [], [], {}, self.tokenizer.model.tokenize
        for i, w in enumerate(words):
            core, mark = w, ""
            if not w.isalpha() or not self.plain:
                found = _PLAIN_WORD.match(w)
                if not found or not found[1].isalpha() or not self.plain:
                    (odd if self.odd(w) else rest).append(i)
                    continue
                core, mark = found.groups()
            ids = cores.get(core)
            if ids is None and mark and core in self.at:
                k = self.at[core]
                ids = self.ids[self.start[k] : self.start[k] + self.size[k]].tolist()
            if ids is None:
                ids = cores[core] = [t.id for t in merge(self.space + (core if core.isascii() else core.encode().decode("latin-1").translate(self.bytes)))]
            if mark:
                if mark not in self.marks:
                    self.marks = self.marks if len(self.marks) < _CHUNK else {"": []}
                    self.marks[mark] = self.whole([mark])[0].tolist()
                ids = ids + self.marks[mark]
            out[i] = ids
        for at in range(0, len(rest), _CHUNK):
            own = rest[at : at + _CHUNK]
            some = [words[i] for i in own]
            [ids] = self.whole([" " + " ".join(some)])
            head = np.flatnonzero(self.spaced[ids])
            each = np.split(ids, head[1:]) if len(head) == len(some) else self.whole([" " + w for w in some])
            for i, x in zip(own, each, strict=True):
                out[i] = x.tolist()
        size = np.fromiter(map(len, out), np.int64, len(out))
        size[odd] = _ODD
        return np.fromiter(itertools.chain.from_iterable(out), "<u4"), size

    def __call__(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, each followed by ``end_id``, and the number of ids of each."""
        if len(self.at) > TABLE_ENTRIES:
            self.forget([w for w, k in self.at.items() if self.met[k] > 1 and len(w) <= _LONG_WORD][: TABLE_ENTRIES // 2])
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        split = pc.split_pattern(texts, " ")
        offs = split.offsets.to_numpy()
        offs = offs - offs[0]
        coded = split.flatten().dictionary_encode()
        distinct, place = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy(zero_copy_only=False)
        number = np.fromiter(map(self.at.get, distinct, itertools.repeat(-1)), np.int64, len(distinct))
        new = np.flatnonzero(number < 0)
        if len(new):
            words = [distinct[i] for i in new.tolist()]
            ids, size = self.learn(words)
            number[new] = np.arange(len(self.size), len(self.size) + len(new))
            self.at.update(zip(words, number[new].tolist(), strict=True))
            self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(np.maximum(size, 0)) - np.maximum(size, 0)])
            self.size, self.met, self.ids = np.concatenate([self.size, size]), np.concatenate([self.met, np.zeros(len(new), np.int64)]), np.concatenate([self.ids, ids])
        self.met[number] += 1

        # the first word of a text has no space before it, and an odd word sends its text to the tokenizer
        first = offs[:-1]
        odd = self.size[number] == _ODD
        odd_word = odd[place]
        odd_word[first] = False
        doc = np.repeat(np.arange(len(texts)), np.diff(offs))
        heads = [distinct[i] for i in place[first].tolist()]
        to_whole = np.bincount(doc[odd_word], minlength=len(texts)) > 0
        to_whole |= np.fromiter((self.odd(w) and w != "" for w in heads), bool, len(heads))
        for i in np.flatnonzero(to_whole).tolist():
            heads[i] = texts[i].as_py()
        own = self.whole(heads)
        start, size = self.start[number][place], self.size[number][place]
        size[to_whole[doc]] = 0
        size[first] = [len(x) for x in own]
        start[first] = len(self.ids) + np.cumsum(size[first]) - size[first]
        pool = np.concatenate([self.ids, *own, np.array([end_id], "<u4")])
        start, size = np.insert(start, offs[1:], len(pool) - 1), np.insert(size, offs[1:], 1)
        upto = np.cumsum(size)
        out = pool[np.repeat(start - (upto - size), size) + np.arange(upto[-1] if len(upto) else 0)]
        return out, np.diff(np.append(0, upto)[np.append(0, offs[1:] + np.arange(1, len(offs)))])


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker and path."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encoded(batches: Iterator[pa.RecordBatch], path: str, end_id: int, text: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with the ids of their rows, the end id last, and the number of ids of each row."""
    for batch in batches:
        for part in tx.slices(batch, text, _SLICE_BYTES):
            yield part, *encoder(path)(tx.column(part, text), end_id)


def write_ids(docs: DataFrame, path: str, *, end_id: int = 2, tokenizer: str | None = None, encoding: str = "dictionary", row_group_bytes: int = 32 << 20, page_rows: int = 256, partitions: int | None = None) -> None:
    """Writes the ids of every text, in doc_id order over the files and inside each."""
    model = tokenizer or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = before = 0
        from pyspark import TaskContext

        no = TaskContext.get().partitionId()
        for part, ids, n in encoded(batches, model, end_id):
            at = before + np.cumsum(n) - n
            rows = np.arange(row, row + len(n))
            row, before = row + len(n), before + len(ids)
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays(
                [tx.column(part, "doc_id"), pa.array(np.full(len(n), no), pa.int32()), pa.array(rows), pa.array(at), pa.array(n), lists],
                ["doc_id", "part", "row", "part_start", "n_tokens", "ids"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    src = docs.select("doc_id", "text")
    n = partitions or max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-tx.text_bytes(docs) // PART_BYTES))
    dealt = src.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    options = {"parquet.block.size": str(row_group_bytes), "parquet.page.row.count.limit": str(page_rows), "compression": "zstd"}
    options |= {"parquet.enable.dictionary": "true"} if encoding == "dictionary" else {"parquet.enable.dictionary": "false", "parquet.writer.version": "PARQUET_2_0"}
    dealt.mapInArrow(run, f"doc_id {kind}, part int, row long, part_start long, n_tokens long, ids array<int>").write.options(**options).parquet(path)


def read_ids(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """What ``write_ids`` wrote, with ``start``: all ids before the document.  Without ``ids`` only metadata columns are read.

    The offsets of the parts (one number per written partition) go to the driver.
    """
    table = spark.read.parquet(path)
    sums = {r.part: r.n for r in table.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}
    upto, offsets = 0, []
    for p in sorted(sums):
        offsets.append((p, upto))
        upto += sums[p]
    starts = spark.createDataFrame(offsets or [(0, 0)], "part int, part_offset long")
    cols = ["doc_id", (F.col("part_offset") + F.col("part_start")).alias("start"), "n_tokens"]
    return table.join(F.broadcast(starts), "part").select(*cols, *(["ids"] if ids else []))


def id_crcs(df: DataFrame) -> DataFrame:
    """Replaces ``ids`` by ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = tx.column(b, "ids")
            flat = col.flatten().to_numpy(zero_copy_only=False).astype("<u4")
            offs = np.concatenate([[0], np.cumsum(col.value_lengths().to_numpy(zero_copy_only=False))])
            crc = [zlib.crc32(flat[i:j]) for i, j in zip(offs[:-1], offs[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*(tx.column(b, c) for c in ("doc_id", "start", "n_tokens")), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return df.mapInArrow(run, f"doc_id {dict(df.dtypes)['doc_id']}, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, **options) -> DataFrame:
    """Writes, reads back, digests: doc_id, start, n_tokens, ids_crc32."""
    path = Workspace(docs.sparkSession, "token-ids").path
    write_ids(docs, path, **options)
    return id_crcs(read_ids(docs.sparkSession, path))
