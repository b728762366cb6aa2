"""Toxicity by multiple-instance learning: sentence scores combined by noisy-or.

Only documents are labelled. A document's sentences are its instances; a sentence has
probability ``p = sigmoid(bias + sum of the weights of its features)`` and the document
``1 - product of (1 - p)``. The weights are trained from document labels through that
noisy-or, after which the sentence probabilities locate the offending sentences. Features
are the words (runs of ASCII letters and digits and all other bytes, A-Z lower-cased) and
their prefixes of 4, 5 and 6 bytes. Sentences without a selected feature are all alike and
count as one instance, so that length alone does not make a document toxic.

The classifier is fitted on the driver on a bounded sample: at most ``SAMPLE_TOXIC`` toxic
and ``SAMPLE_CLEAN`` other labelled documents, in order of a hash of their ids; texts that
occur twice among them count once. Scoring is one pass without a shuffle over all whole
texts; the model that travels is at most ``MAX_FEATURES`` weights.

Null and empty texts score as a document without features. Null labels and labels of
unknown documents are ignored, of several labels of one document the largest counts.
Without toxic or without clean labelled documents every score is 0. Repeated rows score
alike. An empty table gives no rows. No column but the id and the text is read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from knotwork.llm.textkernel import _KEEP, ALNUM_SEP, mix, release, slices, utf8, word_hashes, words
from knotwork.storage import packed, unpacked

SAMPLE_TOXIC, SAMPLE_CLEAN, MAX_FEATURES = 1500, 2500, 20_000
PREFIXES = (4, 5, 6)
#: Standard deviations by which a feature's toxic documents must exceed their expectation.
SELECT = 4.0
_SENTENCE_END = np.zeros(256, bool)
_SENTENCE_END[[10, 33, 46, 63]] = True


@dataclass
class Model:
    """Sorted feature keys, their weights and the bias; without keys every score is 0."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float

    def __post_init__(self):
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[(self.keys >> np.uint64(44)).astype(np.int64)] = True


def feature_keys(low: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """(word index or None for all, key) arrays: whole words, then prefixes of long enough words."""
    yield None, word_hashes(low, starts, ends)
    padded = np.concatenate([low, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    head, size = eight[starts], ends - starts
    for k in PREFIXES:
        long_ = np.flatnonzero(size > k)
        yield long_, mix((head[long_] & _KEEP[k]) ^ np.uint64(k << 56))


def instances(column, model: Model):
    """For each run of documents: (first document, document, sentence start, feature) of every hit.

    A sentence's start is the byte after the previous sentence end in its document.
    """
    data, offsets = utf8(column)
    for a, b in slices(offsets):
        cut = offsets[a : b + 1] - offsets[a]
        low, starts, ends, per = words(data[offsets[a] : offsets[b]], cut, ALNUM_SEP)
        stops = np.flatnonzero(_SENTENCE_END[low])
        hit_word, hit_key = [], []
        for index, key in feature_keys(low, starts, ends):
            some = np.flatnonzero(model.sieve[(key >> np.uint64(44)).astype(np.int64)])
            at = np.searchsorted(model.keys, key[some])
            same = model.keys[np.minimum(at, len(model.keys) - 1)] == key[some]
            hit_word.append(some[same] if index is None else index[some[same]])
            hit_key.append(at[same])
        word, feature = np.concatenate(hit_word), np.concatenate(hit_key)
        doc = np.searchsorted(per, word, side="right") - 1
        before = np.searchsorted(stops, starts[word])
        begin = np.where(before > 0, stops[before - 1] + 1 if len(stops) else 0, 0)
        begin = np.maximum(begin, cut[doc])
        after = np.searchsorted(stops, starts[word])
        end = np.where(after < len(stops), stops[np.minimum(after, len(stops) - 1)] if len(stops) else len(low), len(low))
        end = np.minimum(end, cut[doc + 1])
        rows = np.unique(np.stack([doc, begin - cut[doc], end - cut[doc], feature], 1), axis=0)
        yield a, b, rows


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def train(texts: list[str], labels: np.ndarray, epochs: int = 200, rate: float = 0.15, l2: float = 1e-4) -> Model:
    """Select features and fit the noisy-or on whole texts with 0/1 labels."""
    none = Model(np.zeros(1, np.uint64), np.zeros(1), -40.0)
    y = np.asarray(labels, bool)
    if not y.any() or y.all():
        return none
    data, offsets = utf8(pa.array(texts, pa.string()))
    seen: list[list[np.ndarray]] = [[], []]
    for a, b in slices(offsets):
        cut = offsets[a : b + 1] - offsets[a]
        low, starts, ends, per = words(data[offsets[a] : offsets[b]], cut, ALNUM_SEP)
        doc = np.repeat(np.arange(b - a), np.diff(per))
        parts = [(doc if i is None else doc[i], k) for i, k in feature_keys(low, starts, ends)]
        order = np.lexsort((np.concatenate([k for _, k in parts]), np.concatenate([d for d, _ in parts])))
        key, doc = np.concatenate([k for _, k in parts])[order], np.concatenate([d for d, _ in parts])[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
        key, doc = key[new], doc[new]
        for side in (0, 1):
            seen[side].append(key[y[a + doc] == bool(side)])
    every, where = np.unique(np.concatenate([*seen[0], *seen[1]]), return_inverse=True)
    clean = sum(len(x) for x in seen[0])
    neg, pos = np.bincount(where[:clean], minlength=len(every)), np.bincount(where[clean:], minlength=len(every))
    share = y.mean()
    expected = (neg + pos) * share
    score = (pos - expected) / np.sqrt(np.maximum(expected * (1 - share), 1e-9))
    # a feature must also lean to toxic documents clearly, not only surely
    score[(pos * (1 - share) < 2 * neg * share) | (pos < 3)] = 0
    chosen = np.flatnonzero(score >= SELECT)
    if len(chosen) == 0:
        chosen = np.argsort(-score, kind="stable")[:50]
        chosen = chosen[score[chosen] > 0]
        if len(chosen) == 0:
            return none
    chosen = np.sort(chosen[np.argsort(-score[chosen], kind="stable")[:MAX_FEATURES]])
    model = Model(every[chosen], np.zeros(len(chosen)), -4.0)
    doc, sentence, feature, base = [], [], [], 0
    for a, _, rows in instances(pa.array(texts, pa.string()), model):
        key = np.unique(rows[:, :2], axis=0, return_inverse=True)
        doc.append(key[0][:, 0] + a)
        sentence.append(key[1].ravel() + base)
        feature.append(rows[:, 3])
        base += len(key[0])
    doc, sentence, feature = np.concatenate(doc), np.concatenate(sentence), np.concatenate(feature)
    w, bias, n = model.weights, model.bias, len(texts)
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, epochs + 1):
        z = bias + np.bincount(sentence, w[feature], minlength=base)
        p, p0 = _sigmoid(z), _sigmoid(bias)
        none_log = np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=n) + np.log1p(-p0)
        whole = np.clip(-np.expm1(none_log), 1e-9, 1 - 1e-9)
        # derivative of the loss by z of an instance: p for a clean document, p * (1 - 1 / P) for a toxic one
        outer = np.where(y, 1 - 1 / whole, 1.0)
        g = outer[doc] * p
        gw = np.bincount(feature, g[sentence], minlength=len(w)) / n + l2 * w
        gb = (g.sum() + (outer * p0).sum()) / n
        m, v, mb, vb = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw**2, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb**2
        c1, c2 = 1 - 0.9**t, 1 - 0.999**t
        w = w - rate * (m / c1) / (np.sqrt(v / c2) + 1e-8)
        bias -= rate * (mb / c1) / (np.sqrt(vb / c2) + 1e-8)
    return Model(model.keys, w, float(bias))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_rows=None) -> Model:
    """Fit on the bounded sample; ``train_rows`` is a condition on the id column of the labels."""
    marked = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    if train_rows is not None:
        marked = marked.where(train_rows)
    marked = marked.groupBy(id_col).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    order = [F.xxhash64(id_col), F.col(id_col)]
    picked = marked.where("y = 1").orderBy(*order).limit(SAMPLE_TOXIC).unionByName(marked.where("y = 0").orderBy(*order).limit(SAMPLE_CLEAN))
    picked = picked.withColumnRenamed(id_col, "picked_")
    # at most SAMPLE_TOXIC + SAMPLE_CLEAN ids, so the broadcast is bounded
    rows = docs.select(id_col, text_col).join(F.broadcast(picked), F.col(id_col) == F.col("picked_")).select("y", F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).toPandas()
    rows = rows.drop_duplicates().sort_values(["text", "y"])
    model = train(rows["text"].tolist(), rows["y"].to_numpy())
    del rows
    release()
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The id and the columns of ``marked``."""
    return marked(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")), model, "text", threshold).drop("text")


_ADDED = {"score": T.DoubleType(), "predicted": T.IntegerType(), "n_hits": T.LongType(), "worst_start": T.LongType(), "worst_end": T.LongType(), "worst_score": T.DoubleType()}


def marked(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """``docs`` with the columns of ``scored``; columns of these names are replaced."""
    return unpacked(scored(docs, model, text_col, threshold), docs.columns, {n: F.col(n) for n in _ADDED})


def scored(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """``(row, score, predicted, n_hits, worst_start, worst_end, worst_score)``, rows as structs.

    ``n_hits`` counts sentences at or above the threshold; the last three give the bytes and
    the probability of the most offending sentence, null where no sentence has a feature.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.keys, model.weights, model.bias))
    names, at = ["row", *_ADDED], docs.columns.index(text_col)
    held = packed(docs)

    def run(batches):
        m = Model(*shared.value)
        p0 = float(_sigmoid(m.bias))
        for batch in batches:
            n = batch.num_rows
            none_log, hits = np.full(n, np.log1p(-p0)), np.zeros(n, np.int64)
            start, end, worst = np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, np.nan)
            for a, _, rows in instances(batch.column(0).flatten()[at], m):
                if not len(rows):
                    continue
                key, where = np.unique(rows[:, :3], axis=0, return_inverse=True)
                p = _sigmoid(m.bias + np.bincount(where.ravel(), m.weights[rows[:, 3]]))
                doc = key[:, 0] + a
                np.add.at(none_log, doc, np.log1p(-np.minimum(p, 1 - 1e-12)))
                np.add.at(hits, doc, p >= threshold)
                order = np.lexsort((-key[:, 1], p))
                start[doc[order]], end[doc[order]], worst[doc[order]] = key[order, 1], key[order, 2], p[order]
            s = np.clip(-np.expm1(none_log), 0.0, 1.0)
            hit = np.isnan(worst)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32)), pa.array(hits), pa.array(start, mask=hit), pa.array(end, mask=hit), pa.array(worst, mask=hit)], names=names
            )

    return held.mapInArrow(run, T.StructType([*held.schema.fields, *(T.StructField(n, kind) for n, kind in _ADDED.items())]))
