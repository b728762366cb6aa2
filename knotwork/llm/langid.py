"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. The
probability of a word is the sum over all its segmentations into pieces of the product of
their probabilities, computed by a forward algorithm; a text's is the product over its
words. Piece probabilities are trained by expectation maximisation, with forward and
backward sums giving the expected piece counts. Nothing of the vocabulary is trained.

Words are runs of ASCII letters and all non-ASCII bytes, A-Z lower-cased, with the
vocabulary's word-begin mark in front; a run above ``UNIT`` bytes, as in scripts without
spaces, is cut between characters into words of at most that many. Every byte value is a
piece too, so every word has a probability. Words of a batch are computed once each, all
together, position by position, ``TOGETHER`` languages at a time.

The model is fitted on a bounded sample of at most ``SAMPLE`` labelled documents of each
language, by a hash of their ids; all languages are learned. Null texts and texts without a
letter get ``und`` and score 0, and so does every text if nothing could be learned. Repeated
rows score alike, ties go to the first language by name. An empty table gives no rows. Only
id, text and (for training) language are read.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from knotwork.llm.textkernel import LETTER_SEP, mix, release, slices, utf8, word_hashes, words

TOKENIZERS = os.environ.get("KNOTWORK_TOKENIZERS", "/opt/tokenizers")
SAMPLE, UNIT, TOGETHER, ROUNDS = 400, 48, 64, 3
_MARK = "▁".encode()
_BASE = np.uint64(0x100000001B3)


def pieces(path: str = f"{TOKENIZERS}/piece_bpe_32k.model") -> list[bytes]:
    """Pieces of a vocabulary file as bytes, single bytes first; runs of marks never match a word."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {model.id_to_piece(i).encode() for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
    return [bytes([b]) for b in range(256)] + sorted(p for p in found if len(p) > 1 and p.rfind(_MARK) <= 0)


def _powers(longest: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([[np.uint64(1)], np.full(longest, _BASE)]), dtype=np.uint64)


def _piece_hash(p: bytes) -> int:
    h = 0
    for b in p:
        h = (h * int(_BASE) + b + 1) & (1 << 64) - 1
    return h


@dataclass
class Model:
    """Languages, log prior, and piece probabilities in the order of ``vocabulary``."""

    languages: list[str]
    prior: np.ndarray
    vocabulary: list[bytes]
    p: np.ndarray

    def __post_init__(self):
        keys = np.array([_piece_hash(x) for x in self.vocabulary], np.uint64)
        self.lengths = sorted({len(x) for x in self.vocabulary})
        self.table = np.zeros(1 << 18, np.int32)  # slot -> piece + 1, linear probing
        self.keys = np.concatenate([[np.uint64(0)], keys])
        slot = (mix(keys) >> np.uint64(46)).astype(np.int64)
        self.probes = 1
        for i, s in enumerate(slot.tolist()):
            k = 1
            while self.table[s]:
                s, k = (s + 1) & (1 << 18) - 1, k + 1
            self.table[s] = i + 1
            self.probes = max(self.probes, k)
        self.q = np.concatenate([np.zeros((1, self.p.shape[1])), self.p])

    def find(self, key: np.ndarray) -> np.ndarray:
        """Piece + 1 of every hash, 0 where there is none."""
        slot = (mix(key) >> np.uint64(46)).astype(np.int64)
        out = self.table[slot]
        wrong = np.flatnonzero((out > 0) & (self.keys[out] != key))
        while len(wrong):
            slot[wrong] = (slot[wrong] + 1) & (1 << 18) - 1
            out[wrong] = self.table[slot[wrong]]
            wrong = wrong[(out[wrong] > 0) & (self.keys[out[wrong]] != key[wrong])]
        return out


def _grid(low: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Words of one length class as a matrix of bytes behind the word-begin mark."""
    width = int((ends - starts).max()) + len(_MARK)
    at = starts[:, None] + np.arange(width - len(_MARK))
    body = low[np.minimum(at, len(low) - 1)]
    return np.concatenate([np.broadcast_to(np.frombuffer(_MARK, np.uint8), (len(starts), 3)), body], 1), ends - starts + 3


def forward(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, model: Model, weights: np.ndarray | None = None):
    """Log marginals of words, one column for each language.

    With ``weights`` (words by languages) also returns the expected piece counts.
    """
    logs, counts = np.zeros((len(starts), model.p.shape[1])), np.zeros_like(model.q)
    for a in range(0, model.p.shape[1], TOGETHER):
        part = slice(a, a + TOGETHER)
        logs[:, part], counts[:, part] = _forward(low, starts, ends, model, model.q[:, part], None if weights is None else weights[:, part])
    return (logs, counts) if weights is not None else logs


def _forward(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, model: Model, q: np.ndarray, weights: np.ndarray | None):
    n, langs = len(starts), q.shape[1]
    logs, counts = np.zeros((n, langs)), np.zeros_like(q)
    size = ends - starts
    order = np.argsort(size, kind="stable")
    power = _powers(model.lengths[-1])
    edge = 0
    while edge < n:
        # words of similar length together, and a bounded matrix
        limit = max(8, int(size[order[edge]]) * 5 // 4)
        last = int(np.searchsorted(size[order], limit, side="right"))
        last = max(edge + 1, min(last, edge + max(1, 400_000 // (limit + 3))))
        pick = order[edge:last]
        edge = last
        text, length = _grid(low, starts[pick], ends[pick])
        width = text.shape[1]
        prefix = np.zeros((len(pick), width + 1), np.uint64)
        for j in range(width):
            prefix[:, j + 1] = prefix[:, j] * _BASE + text[:, j] + np.uint64(1)
        alpha = np.zeros((width + 1, len(pick), langs))
        alpha[0] = 1.0
        scale = np.zeros((width + 1, len(pick), langs))
        found = {}
        for j in range(1, width + 1):
            live = np.flatnonzero(length >= j)
            total = np.zeros((len(live), langs))
            # the ring of earlier sums shares the newest scale
            for k in model.lengths:
                if k > j:
                    break
                piece = model.find(prefix[live, j] - prefix[live, j - k] * power[k])
                hit = np.flatnonzero(piece)
                if len(hit):
                    rows = live[hit]
                    if weights is not None:
                        found[j, k] = (rows, piece[hit])
                    total[hit] += alpha[j - k, rows] * q[piece[hit]] * np.exp(scale[j - k, rows] - scale[j - 1, rows])
            grow = np.maximum(total, 1e-300)
            scale[j, live] = scale[j - 1, live] + np.log(grow)
            alpha[j, live] = total / grow
        final = scale[length, np.arange(len(pick))]
        logs[pick] = final
        if weights is None:
            continue
        beta = np.full((width + 1, len(pick), langs), -np.inf)
        beta[length, np.arange(len(pick))] = 0.0
        for j in range(width, 0, -1):
            for k in model.lengths:
                if (j, k) in found:
                    rows, piece = found[j, k]
                    step = np.log(np.maximum(q[piece], 1e-300)) + beta[j, rows]
                    part = np.exp(np.minimum(scale[j - k, rows] + step - final[rows], 0.0)) * weights[pick[rows]]
                    beta[j - k, rows] = np.logaddexp(beta[j - k, rows], step)
                    for g in range(langs):
                        counts[:, g] += np.bincount(piece, part[:, g], minlength=len(counts))
    return logs, counts


def _units(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, per: np.ndarray):
    """The same with words above ``UNIT`` bytes cut, before a byte that begins a character if there is one."""
    long_ = np.flatnonzero(ends - starts > UNIT)
    if not len(long_):
        return low, starts, ends, per
    cuts, owner = [], []
    for i in long_.tolist():
        at, end = int(starts[i]), int(ends[i])
        while end - at > UNIT:
            back = np.flatnonzero((low[at + 1 : at + UNIT + 1] & 0xC0) != 0x80)
            at += int(back[-1]) + 1 if len(back) else UNIT
            cuts.append(at)
            owner.append(i)
    cuts, owner = np.array(cuts, np.int64), np.array(owner, np.int64)
    more = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(starts)))])
    return low, np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts])), per + more[per]


def _unique_words(data: np.ndarray, offsets: np.ndarray):
    """Lower-cased bytes, spans of the distinct words, each word's number, words' offsets."""
    low, starts, ends, per = _units(*words(data, offsets, LETTER_SEP))
    _, first, inverse = np.unique(word_hashes(low, starts, ends), return_index=True, return_inverse=True)
    return low, starts[first], ends[first], inverse.ravel(), per


def train(texts: list[str], langs: list[str], vocabulary: list[bytes], rounds: int = ROUNDS, smooth: float = 0.05) -> Model:
    """Expectation maximisation from a start of equal probabilities."""
    names = sorted(set(langs))
    share = np.array([langs.count(x) for x in names], float)
    model = Model(names, np.log(share / share.sum()), vocabulary, np.full((len(vocabulary), len(names)), 1 / len(vocabulary)))
    data, offsets = utf8(pa.array(texts, pa.string()))
    if len(offsets) < 2:
        return model
    low, starts, ends, inverse, per = _unique_words(data, offsets)
    number = np.array([names.index(x) for x in langs])
    of = np.repeat(number, np.diff(per))
    weights = np.stack([np.bincount(inverse[of == g], minlength=len(starts)) for g in range(len(names))], 1).astype(float)
    for _ in range(rounds):
        _, counts = forward(low, starts, ends, model, weights)
        p = counts[1:] + smooth
        model = Model(names, model.prior, vocabulary, p / p.sum(0))
    return model


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_rows=None, vocabulary: list[bytes] | None = None) -> Model | None:
    """Fit on the bounded sample; None if no labelled text is there."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    if train_rows is not None:
        rows = rows.where(train_rows)
    rows = rows.select(F.col(lang_col).cast("string").alias("g"), F.xxhash64(id_col).alias("h"), F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("text"))
    many = rows.groupBy("g").agg(F.count("*").alias("many"))
    # a quarter more than the sample by hash, so that ranks are of few rows
    share = F.pmod("h", F.lit(1 << 53)) / F.lit(float(1 << 53))
    light = rows.select("g", "h", "i").join(F.broadcast(many), "g").where(share * F.col("many") <= 1.25 * SAMPLE + 20)
    rank = F.row_number().over(W.partitionBy("g").orderBy("h", "i"))
    picked = light.withColumn("rank", rank).where(F.col("rank") <= SAMPLE).select(F.col("g").alias("g_"), F.col("i").alias("i_")).distinct()
    # at most SAMPLE ids for each language
    same = F.col("i").eqNullSafe(F.col("i_")) & (F.col("g") == F.col("g_"))
    got = rows.join(F.broadcast(picked), same).select("g", "text").toPandas().sort_values(["g", "text"])
    if not len(got):
        return None
    model = train(got["text"].tolist(), got["g"].tolist(), vocabulary or pieces())
    release()
    return model


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, lang_pred, score, n_words)``; the score is the language's posterior probability."""
    parts = None if model is None else (model.languages, model.prior, model.vocabulary, model.p.astype(np.float64))
    shared = docs.sparkSession.sparkContext.broadcast(parts)

    def run(batches):
        m = None if shared.value is None else Model(*shared.value)
        for batch in batches:
            n = batch.num_rows
            data, offsets = utf8(batch.column(1))
            langs = 1 if m is None else len(m.languages)
            total, count, ascii_ = np.zeros((n, langs)), np.zeros(n, np.int64), np.zeros(n, bool)
            if m is not None and n:
                for a, b in slices(offsets, 1 << 22):
                    cut = offsets[a : b + 1] - offsets[a]
                    low, starts, ends, inverse, per = _unique_words(data[offsets[a] : offsets[b]], cut)
                    logs = forward(low, starts, ends, m)
                    doc = np.repeat(np.arange(a, b), np.diff(per))
                    for g in range(langs):
                        total[:, g] += np.bincount(doc, logs[inverse, g], minlength=n)
                    count[a:b] = np.diff(per)
                    has = np.flatnonzero((low >= 97) & (low <= 122))
                    ascii_[a:b] = np.searchsorted(has, cut[1:]) > np.searchsorted(has, cut[:-1])
            letter = ascii_.copy()
            for i in np.flatnonzero(~ascii_ & (count > 0)):
                letter[i] = any(c.isalpha() for c in batch.column(1)[int(i)].as_py() or "")
            if m is None:
                name, best = ["und"] * n, np.zeros(n)
            else:
                z = total + m.prior
                z = np.exp(z - z.max(1, keepdims=True))
                z /= z.sum(1, keepdims=True)
                top = z.argmax(1)
                name = [m.languages[g] if ok else "und" for g, ok in zip(top.tolist(), letter.tolist())]
                best = np.where(letter, z[np.arange(n), top], 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(name, pa.string()), pa.array(best, pa.float64()), pa.array(count)], names=["doc_id", "lang_pred", "score", "n_words"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, n_words long")
