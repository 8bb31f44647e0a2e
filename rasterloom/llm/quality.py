"""Quality rules: calibrated logistic regression on hashed word and character n-grams.

Two classifiers, low quality and toxic, are trained on labelled rows.  Features are the
presence of hashed lower-cased words, word pairs, byte 4-grams and word beginnings of 4
to 7 bytes.  The sample is bounded,
``max_labelled`` labelled documents in the order of a hash of their id; their whole texts
are read; of the features ``MAX_FEATURES``, those that are most unevenly spread over the
two classes, get a weight.  A fifth of the sample is held out of the fit: it calibrates the probabilities
(Platt scaling).  Every text is then scored in Arrow batches against fixed thresholds.

Defined cases: a null text has no words, fails the base rule and is rejected; labels that
are null count as absent, and a document with several labels counts as bad if any says so;
repeated rows are scored each, and of several texts of one labelled id the least trains; an empty table gives no rows; with fewer than ``min_class``
labelled rows of a class its classifier accepts everything; further columns pass through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..workspace import Workspace
from . import _text as tx

MAX_LABELLED = 4000
MAX_FEATURES = 6000
MIN_CLASS = 5
#: Text whose n-grams are held at once; all n-grams of a text take about 120 times its bytes for a moment.
SLICE_BYTES = 1 << 18
#: A document is rejected from these calibrated probabilities on.
LOW_QUALITY_FROM, TOXIC_FROM = 0.5, 0.5

_WORD_BITS, _PAIR_BITS, _CHAR_BITS, _HEAD_BITS = 18, 18, 17, 17
_HEADS = range(4, 8)
_HEADS_FROM = (1 << _WORD_BITS) + (1 << _PAIR_BITS) + (1 << _CHAR_BITS)
_SPACE = _HEADS_FROM + (1 << _HEAD_BITS)
_SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_K = np.uint64(0x9E3779B97F4A7C15)

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _per_text(flag: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """How many are set within each text."""
    return np.diff(np.concatenate([[0], np.cumsum(flag)])[offs])


def base_counts(words: tx.Words, texts: list[str | None]) -> dict[str, np.ndarray]:
    points = (words.buf & 0xC0) != 0x80
    dup = []
    for t in texts:
        lines = [x for x in (t or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        dup.append(len(lines) - len(set(lines)))
    repeat = np.zeros(len(words), bool)
    if len(words) >= 8:
        h = tx.windows(words.hashes(), 8)
        at = np.flatnonzero(words.room(8)[: len(h)])
        own = tx.mix(h[at] ^ (words.doc[at].astype(np.uint64) * _K))
        _, inv, counts = np.unique(own, return_inverse=True, return_counts=True)
        repeat = tx.spread(at[counts[inv] > 1], len(words), 8)
    return {
        "n_words": words.counts,
        "word_chars": _per_text(points & words._word, words.offs),
        "n_symbols": _per_text(_SYMBOLS[words.buf], words.offs),
        "n_dup_lines": np.array(dup, np.int64),
        "n_repeat_words": np.bincount(words.doc[repeat], minlength=len(texts)),
    }


def features(words: tx.Words) -> tuple[np.ndarray, np.ndarray]:
    """(text, hashed n-gram) of every n-gram, with repeats."""
    h = words.hashes(lower=True)
    one = (h >> np.uint64(64 - _WORD_BITS)).astype(np.int64)
    pairs = tx.windows(h, 2)
    same = words.room(2)[: len(pairs)]
    two = (pairs[same] >> np.uint64(64 - _PAIR_BITS)).astype(np.int64) + (1 << _WORD_BITS)
    b = words.buf.astype(np.uint32)
    quad = b[:-3] | b[1:-2] << np.uint32(8) | b[2:-1] << np.uint32(16) | b[3:] << np.uint32(24)
    three = ((quad * np.uint32(2654435761)) >> np.uint32(32 - _CHAR_BITS)).astype(np.int64) + (1 << _WORD_BITS) + (1 << _PAIR_BITS)
    owner = np.repeat(np.arange(len(words.offs) - 1), np.diff(words.offs))
    inside = owner[:-3] == owner[3:] if len(owner) > 3 else np.zeros(0, bool)
    docs, grams = [words.doc, words.doc[: len(pairs)][same], owner[: len(quad)][inside]], [one, two, three[inside]]
    lower, by = tx.LOWER[words.buf].astype(np.uint64) + np.uint64(1), tx.powers(max(_HEADS))
    for n in _HEADS:
        long = np.flatnonzero(words.lens >= n)
        head = np.zeros(len(long), np.uint64)
        for j in range(n):
            head += lower[words.starts[long] + j] * by[j]
        docs.append(words.doc[long])
        grams.append((tx.mix(head + np.uint64(n << 56)) >> np.uint64(64 - _HEAD_BITS)).astype(np.int64) + _HEADS_FROM)
    return np.concatenate(docs), np.concatenate(grams)


@dataclass
class Classifier:
    """Weights by hashed n-gram (zero for most), and the calibration p = sigmoid(a * score + b)."""

    weights: np.ndarray
    a: float
    b: float

    def probability(self, doc: np.ndarray, gram: np.ndarray, n: int) -> np.ndarray:
        w = self.weights[gram]
        use = np.flatnonzero(w)
        pair = np.unique(doc[use] * _SPACE + gram[use])
        score = np.bincount(pair // _SPACE, weights=self.weights[pair % _SPACE], minlength=n)
        return _sigmoid(self.a * score + self.b)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _always(p: float) -> Classifier:
    return Classifier(np.zeros(_SPACE), 0.0, float(np.log(p / (1 - p))))


def fit(cols: list[np.ndarray], target: np.ndarray, held: np.ndarray, chosen: np.ndarray, *, min_class: int = MIN_CLASS, penalty: float = 5e-4, steps: int = 400) -> Classifier:
    """L1-penalised logistic regression by accelerated proximal gradient, then Platt scaling on the held-out rows.

    ``cols`` has the places of each row's features among ``chosen``.
    """
    if min(target.sum(), (~target).sum()) < min_class:
        return _always(1e-3)
    learn = np.flatnonzero(~held)
    if min(target[learn].sum(), (~target[learn]).sum()) < 2 or not len(chosen):
        return _always(1e-3)

    def table(which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.repeat(np.arange(len(which)), [len(cols[i]) for i in which]), np.concatenate([cols[i] for i in which])

    r, c = table(learn)
    y, n, d = target[learn].astype(float), len(learn), len(chosen)
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    v = np.ones(d)
    for _ in range(20):
        v = np.bincount(c, weights=np.bincount(r, weights=v[c], minlength=n)[r], minlength=d)
        size = np.linalg.norm(v) or 1.0
        v /= size
    step = 1 / (0.25 * weight.max() * (size / n + 1))
    w = z = np.zeros(d)
    bias = zb = 0.0
    t = 1.0
    for _ in range(steps):
        err = weight * (_sigmoid(np.bincount(r, weights=z[c], minlength=n) + zb) - y) / n
        new = z - step * np.bincount(c, weights=err[r], minlength=d)
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        nb = zb - step * err.sum()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, zb, w, bias, t = new + (t - 1) / t2 * (new - w), nb + (t - 1) / t2 * (nb - bias), new, nb, t2
    rest = np.flatnonzero(held)
    s = np.array([w[cols[i]].sum() for i in rest]) + bias
    yy = target[rest]
    a, b = 1.0, 0.0
    # Platt's smoothed targets keep the slope finite where the classes are apart.
    goal = np.where(yy, (yy.sum() + 1) / (yy.sum() + 2), 1 / ((~yy).sum() + 2))
    for _ in range(300):
        e = _sigmoid(a * s + b) - goal
        h = np.maximum(_sigmoid(a * s + b) * (1 - _sigmoid(a * s + b)), 1e-6)
        g = np.array([(e * s).sum() + 1e-3 * (a - 1), e.sum()])
        hess = np.array([[(h * s * s).sum() + 1e-3, (h * s).sum()], [(h * s).sum(), h.sum() + 1e-6]])
        move = np.linalg.solve(hess, g)
        move *= min(1, 1 / (np.abs(move).max() + 1e-12))
        a, b = a - move[0], b - move[1]
    weights = np.zeros(_SPACE)
    weights[chosen] = w
    return Classifier(weights, float(a), float(a * bias + b))


def scored(batch: pa.RecordBatch, low: Classifier, toxic: Classifier) -> Iterator[tuple[pa.RecordBatch, dict[str, np.ndarray], np.ndarray, np.ndarray]]:
    """Slices of a batch with their base counts and both probabilities."""
    for part in tx.slices(batch, "text", SLICE_BYTES):
        n = part.num_rows
        words = tx.Words(tx.column(part, "text"))
        found = base_counts(words, tx.column(part, "text").to_pylist())
        doc, gram = features(words)
        yield part, found, low.probability(doc, gram, n), toxic.probability(doc, gram, n)


def train(docs: DataFrame, labels: DataFrame, *, max_labelled: int = MAX_LABELLED) -> tuple[Classifier, Classifier]:
    """(low quality, toxic) from at most ``max_labelled`` labelled documents."""
    spark = docs.sparkSession
    marks = (
        labels.filter("doc_id is not null").groupBy("doc_id").agg(F.max((F.col("quality") == 0).cast("int")).alias("low"), F.max(F.col("toxic")).alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    )
    known = sorted(marks.collect(), key=lambda r: hash_order(r.doc_id))  # bounded, and so small enough to broadcast
    place = {"low": 0, "toxic": 0}
    flags = []
    for r in known:  # of the rows with a mark every fifth is held out
        own = []
        for name in place:
            own.append(None if r[name] is None else place[name] % 5 == 4)
            place[name] += r[name] is not None
        flags.append((*r, *own))
    mark_type = marks.schema["doc_id"].dataType.simpleString()
    flagged = spark.createDataFrame(flags, f"doc_id {mark_type}, low int, toxic int, held_low boolean, held_toxic boolean")
    mark = ["low", "toxic", "held_low", "held_toxic"]
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.slices(batch, "text", SLICE_BYTES):
                doc, gram = features(tx.Words(tx.column(part, "text")))
                pair = np.unique(doc * _SPACE + gram)
                cut = np.searchsorted(pair // _SPACE, np.arange(part.num_rows + 1))
                grams = [(pair[i:j] % _SPACE).astype("<u4").tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*tx.pick(part, "doc_id", *mark), pa.array(grams, pa.binary())], ["doc_id", *mark, "grams"])

    sample = docs.select("doc_id", "text").join(F.broadcast(flagged), "doc_id").groupBy("doc_id", *mark).agg(F.min("text").alias("text"))
    work = Workspace(spark, "quality")
    sample = work.table(sample.mapInArrow(run, f"doc_id {kind}, low int, toxic int, held_low boolean, held_toxic boolean, grams binary"), "sample")
    chosen = {name: _chosen(sample.filter(f"not held_{name}"), name) for name in place}
    sent = spark.sparkContext.broadcast(chosen)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = [np.frombuffer(g, "<u4") for g in batch.column("grams").to_pylist()]
            own = [pa.array([np.flatnonzero(np.isin(sent.value[name], g, assume_unique=True)).astype("<u2").tobytes() for g in grams], pa.binary()) for name in place]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", *mark)), *own], ["doc_id", *mark, "at_low", "at_toxic"])

    rows = sample.mapInArrow(places, f"doc_id {kind}, low int, toxic int, held_low boolean, held_toxic boolean, at_low binary, at_toxic binary").collect()
    rows.sort(key=lambda r: hash_order(r.doc_id))
    work.drop()
    out = []
    for name in place:
        use = [r for r in rows if r[name] is not None]
        cols = [np.frombuffer(r[f"at_{name}"], "<u2").astype(np.int64) for r in use]
        out.append(fit(cols, np.array([bool(r[name]) for r in use], bool), np.array([r[f"held_{name}"] for r in use], bool), chosen[name]))
    return out[0], out[1]


def _chosen(rows: DataFrame, name: str, max_features: int = MAX_FEATURES) -> np.ndarray:
    """The n-grams, ascending, that are most unevenly spread over the classes; those in less than three rows are left out."""
    n = rows.agg(F.coalesce(F.sum(name), F.lit(0)).alias("yes"), F.count("*").alias("all")).first()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((2, _SPACE), np.int32)
        for batch in batches:
            for y, grams in zip(batch.column(name).to_pylist(), batch.column("grams").to_pylist(), strict=True):
                found[y][np.frombuffer(grams, "<u4")] += 1  # a row has each n-gram once
        some = np.flatnonzero(found.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(found[1][some].astype(np.int64)), pa.array(found[0][some].astype(np.int64))], ["gram", "yes", "no"])

    counts = rows.select(name, "grams").mapInArrow(count, "gram long, yes long, no long").groupBy("gram").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    p, q = (F.col("yes") + 0.5) / (n.yes + 1), (F.col("no") + 0.5) / (n["all"] - n.yes + 1)
    pull = F.abs(p - q) / F.sqrt(p * (1 - p) / max(1, n.yes) + q * (1 - q) / max(1, n["all"] - n.yes))
    best = counts.filter("yes + no >= 3").select("gram", pull.alias("pull")).orderBy(F.desc("pull"), "gram").limit(max_features)
    return np.sort(np.array([r.gram for r in best.select("gram").collect()], np.int64))


def hash_order(doc_id: int) -> int:
    """A fixed shuffle of ids."""
    return int(tx.mix(np.array([int(doc_id) & (2**64 - 1)], np.uint64))[0])


def judge(docs: DataFrame, labels: DataFrame, *, max_labelled: int = MAX_LABELLED, low_quality_from: float = LOW_QUALITY_FROM, toxic_from: float = TOXIC_FROM, keep_text: bool = True) -> DataFrame:
    """``docs`` with the base counts, base_failed, p_low_quality, p_toxic and kept."""
    models = docs.sparkSession.sparkContext.broadcast(train(docs, labels, max_labelled=max_labelled))
    added = [*BASE, "base_failed", "p_low_quality", "p_toxic", "kept"]
    rest = [c for c in docs.columns if c not in added and (keep_text or c != "text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, toxic = models.value
        for batch in batches:
            for part, found, p, q in scored(batch, low, toxic):
                failed = (found["n_words"] < 20) | (100 * found["n_repeat_words"] > 30 * found["n_words"])
                kept = ~failed & (p < low_quality_from) & (q < toxic_from)
                yield pa.RecordBatch.from_arrays(
                    [*tx.pick(part, *rest), *(pa.array(found[k], pa.int64()) for k in BASE), pa.array(failed), pa.array(p), pa.array(q), pa.array(kept)],
                    [*rest, *added],
                )

    schema = tx.extended(docs, rest, ", ".join([*(f"{c} long" for c in BASE), "base_failed boolean, p_low_quality double, p_toxic double, kept boolean"]))
    return docs.select(*(F.col(f"`{c}`") for c in dict.fromkeys([*rest, "text"]))).mapInArrow(run, schema)


def brute_force(doc_id: int, text: str | None) -> tuple:
    """The base columns by plain search, for tests."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen: dict[tuple, int] = {}
    for i in range(len(words) - 7):
        seen[tuple(words[i : i + 8])] = seen.get(tuple(words[i : i + 8]), 0) + 1
    again = {i + j for i in range(len(words) - 7) if seen[tuple(words[i : i + 8])] > 1 for j in range(8)}
    lines, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in lines
            lines.add(line)
    failed = len(words) < 20 or 100 * len(again) > 30 * len(words)
    return doc_id, len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(again), failed
