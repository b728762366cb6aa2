"""Language-model scoring: a causal self-attention model in numpy over subword ids.

*Model.* Words are encoded by a fixed public byte-level vocabulary; an end id closes a
text. One attention head over ``WINDOW`` input positions, with an embedding for every id,
predicts one of ``CLASSES`` token classes. Within its class a token's probability is conditional
on the token before it: discounted counts of the ``PAIRS`` most frequent neighbours, backed off
to the token's smoothed share of its class. Both factors sum to 1, so probabilities over all ids
do. Frequent ids are classes of their own, the others are grouped by which ids precede and
follow them. Keys, queries and values are linear in an embedding of id and position, so they are
table look-ups when scoring.

*What is gathered.* One pass encodes every document once and keeps the ids as a table. It
counts every pair of neighbouring subwords of all training documents, packed by hash bucket
like the words below; counts, shares, pairs and the neighbours of every id are sums of these, so
nothing is sampled for them. Every window of every training document trains the attention.
Documents are dealt over shards of about ``SHARD`` windows by a hash of id and text. The first
shard is trained from the start in plain numpy with Adam; with more of them, all documents train
once more from its weights, in ``ROUNDS`` parts and in shards ``LARGE`` times as large side by
side, whose weights are averaged after each part. Documents travel as ids, not as windows.

*Scoring.* Windows overlap by half: each window's last ``STRIDE`` positions are scored and
its first half is context, so every token is scored once and sees at least ``STRIDE``
earlier positions, under a causal mask, hundreds of windows at a time.

*Base score.* Word counts over all training documents are exact. Each task sends its
distinct words with counts, packed by hash bucket, so a frequent word costs a row for each
task at most. For scoring, at most ``COMMON`` frequent words travel as a table; every other
word of a document is looked up by a request to its bucket, which answers with sums for
each document of the requesting batch. No count is dropped or approximated; words are told
apart by 64-bit hashes.

Null and empty texts are one end token. Repeated rows are counted and scored each. An empty
table gives no rows; without training documents all counts are 0, and all classes and all ids of
a class are equally likely. Only the id, the text and the training condition are read.
"""

from __future__ import annotations

import base64
import os
import re
import sys
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from types import ModuleType

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knotwork.llm.textkernel import mix, slices, utf8, word_hashes, words
from knotwork.storage import cut, partitions, table

TOKENIZERS = os.environ.get("KNOTWORK_TOKENIZERS", "/opt/tokenizers")
WINDOW, STRIDE, WIDTH, CLASSES, SINGLE = 32, 16, 32, 64, 40
STEPS, BATCH, COMMON, PAIRS = 800, 512, 1 << 17, 1 << 19
#: Discount of the pair counts; attention scores and logits are cut off at this size.
DISCOUNT, CLIP = 0.75, 60
#: Columns of frequent neighbours on each side; windows of the first shard, and how many times as
#: many later ones hold; parts that all documents train in; windows in memory at once, and subword
#: ids that a task holds before it sends them.
SIDE, SHARD, LARGE, ROUNDS, CHUNK, HELD = 96, 200_000, 5, 2, 1 << 16, 1 << 22
#: Bytes of text for each hash bucket of words and of pairs.
BUCKET = 16_000_000
#: Words whose subwords a worker keeps.
KEPT = 1 << 20
#: Hash that stands for the end token, and the end's subword id.
END_HASH, END_ID, IDS = np.uint64(1), 50256, 50257
#: In windows, the place before a text and all places outside of it; and their embeddings.
BEFORE, OUTSIDE = 65534, 65535
BEFORE_ROW, OUTSIDE_ROW = IDS, IDS + 1
#: The pattern that belongs to the vocabulary (fixed value).
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: First bytes of characters that may be white space to the pattern but not to ``words``.
_SPACES = re.compile(rb"[\xc2\xe1\xe2\xe3]")


def _held() -> dict:
    """What a worker process keeps over its tasks: functions come by value, so their globals do not last."""
    return sys.modules.setdefault("knotwork_held", ModuleType("knotwork_held")).__dict__


def encoder(path: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"):
    """The public byte-level encoder, loaded once for each process."""
    held = _held()
    if ("encoder", path) not in held:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        held["encoder", path] = tiktoken.Encoding("public", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
    return held["encoder", path]


def _encode(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Subword ids of words, concatenated, and how many each has.

    The pattern never joins over a space between words without white space of their own, so
    those are encoded in one go and told apart by the bytes of their tokens.
    """
    enc, held = encoder(), _held()
    if "sizes" not in held:
        held["sizes"] = np.array([len(enc.decode_single_token_bytes(i)) for i in range(END_ID)], np.int64)
    odd = np.array([_SPACES.search(t) is not None for t in texts], bool)
    plain = [t for t, o in zip(texts, odd.tolist()) if not o]
    size = np.zeros(len(texts), np.int64)
    joint = np.array(enc.encode_ordinary((b" " + b" ".join(plain)).decode("utf-8", "replace")) if plain else [], np.int32)
    ends = np.searchsorted(np.cumsum(held["sizes"][joint]), np.cumsum(np.array([len(t) + 1 for t in plain], np.int64))) + 1
    size[~odd] = np.diff(ends, prepend=0)
    alone = [enc.encode_ordinary(" " + t.decode("utf-8", "replace")) for t, o in zip(texts, odd.tolist()) if o]
    size[odd] = [len(x) for x in alone]
    flat = np.zeros(size.sum(), np.int32)
    one = np.repeat(odd, size)
    flat[~one] = joint
    flat[one] = [i for x in alone for i in x]
    return flat, size


def word_pieces(raw: bytes, starts: np.ndarray, ends: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Subword ids, and where those of each word begin and how many they are; ``key`` holds the
    words' sorted hashes. A worker encodes a word once, up to ``KEPT`` words."""
    held = _held()
    none = np.zeros(0, np.int64)
    known, begin, size, flat = held.get("pieces") or (np.zeros(0, np.uint64), none, none, np.zeros(0, np.int32))
    at = np.searchsorted(known, key)
    hit = known[np.minimum(at, len(known) - 1)] == key if len(known) else np.zeros(len(key), bool)
    b, n = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
    b[hit], n[hit] = begin[at[hit]], size[at[hit]]
    new = np.flatnonzero(~hit)
    if len(new):
        ids, many = _encode([raw[x:y] for x, y in zip(starts[new].tolist(), ends[new].tolist())])
        b[new], n[new] = len(flat) + np.cumsum(many) - many, many
        flat = np.concatenate([flat, ids])
        if len(known) + len(new) <= KEPT:
            held["pieces"] = tuple(np.insert(x, at[new], y[new]) for x, y in ((known, key), (begin, b), (size, n))) + (flat,)
    return flat, b, n


def subwords(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, per: np.ndarray):
    """Subword ids of documents, each closed by the end id, and the documents' offsets."""
    key, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    flat, begin, size = word_pieces(low.tobytes(), starts[first], ends[first], key)
    n_docs = len(per) - 1
    count = size[inverse.ravel()] if len(size) else np.zeros(0, np.int64)
    # an end id after each document's words
    doc = np.repeat(np.arange(n_docs), np.diff(per))
    total = np.bincount(doc, count, minlength=n_docs).astype(np.int64) + 1
    offsets = np.concatenate([[0], np.cumsum(total)])
    out = np.full(offsets[-1], END_ID, np.int32)
    if len(count):
        at = np.cumsum(count) - count
        place = np.arange(count.sum()) - np.repeat(at, count)
        out[np.repeat(at + doc, count) + place] = flat[np.repeat(begin[inverse.ravel()], count) + place]
    return out, offsets


@dataclass
class Model:
    """Class and share in its class of every id, the frequent pairs, and the weights."""

    klass: np.ndarray
    share: np.ndarray
    pairs: tuple[np.ndarray, np.ndarray]
    weights: dict[str, np.ndarray]


def _windows(ids: np.ndarray, offsets: np.ndarray):
    """Input rows (windows, WINDOW), targets (windows, STRIDE) with -1 for none, documents."""
    size = np.diff(offsets)
    many = -(-size // STRIDE)
    doc = np.repeat(np.arange(len(size)), many)
    w = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    at = (w * STRIDE)[:, None] + np.arange(STRIDE)
    targets = np.where(at < size[doc][:, None], ids[np.minimum(offsets[doc][:, None] + at, len(ids) - 1)], -1)
    back = (w * STRIDE - STRIDE)[:, None] + np.arange(WINDOW) - 1
    inside = (back >= 0) & (back < size[doc][:, None])
    inputs = np.where(inside, ids[np.clip(offsets[doc][:, None] + back, 0, len(ids) - 1)], np.where(back == -1, BEFORE_ROW, OUTSIDE_ROW))
    return inputs, targets, doc


#: Query i of the scored half sees input positions up to STRIDE + i.
_CAUSAL = (np.arange(WINDOW)[None, :] <= STRIDE + np.arange(STRIDE)[:, None]).astype(np.float32)


def pair_counts(ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes ``before * IDS + id`` of neighbours with counts; the end id comes before each text."""
    before = np.empty(len(ids), np.uint64)
    before[1:] = ids[:-1]
    before[offsets[:-1][np.diff(offsets) > 0]] = END_ID
    return np.unique(before * np.uint64(IDS) + ids.astype(np.uint64), return_counts=True)


def neighbours(code: np.ndarray, count: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells ``id * 2 * SIDE + column`` with counts: frequent ids before an id, then those after it."""
    before, after = (code // np.uint64(IDS)).astype(np.int64), (code % np.uint64(IDS)).astype(np.int64)
    place = np.full(IDS, -1)
    place[frequent] = np.arange(len(frequent))
    one, two = place[before] >= 0, place[after] >= 0
    cell = np.concatenate([after[one] * 2 * SIDE + place[before[one]], before[two] * 2 * SIDE + place[after[two]] + SIDE])
    return _merge([cell.astype(np.uint64)], [np.concatenate([count[one], count[two]])])


def classes(counts: np.ndarray, cell: np.ndarray, many: np.ndarray, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Class and share in its class of every id, from its count and neighbours."""
    rank = np.argsort(-counts, kind="stable")
    klass = np.zeros(IDS, np.int32)
    klass[rank[:SINGLE]] = np.arange(SINGLE)
    rest, groups = rank[SINGLE:], CLASSES - SINGLE
    # the other seen ids by the frequent ids before and after them, grouped by k-means
    seen = rest[counts[rest] > 0]
    klass[rest] = SINGLE + np.arange(len(rest)) % groups
    if len(seen) > groups:
        spot = np.full(IDS, -1)
        spot[seen] = np.arange(len(seen))
        row, column = spot[(cell // np.uint64(2 * SIDE)).astype(np.int64)], (cell % np.uint64(2 * SIDE)).astype(np.int64)
        vec = np.zeros((len(seen), 2 * SIDE), np.float32)
        vec[row[row >= 0], column[row >= 0]] = many[row >= 0]
        vec = np.sqrt(vec / np.maximum(vec.sum(1, keepdims=True), 1))
        rng = np.random.default_rng(seed)
        weight = counts[seen].astype(float)
        centre = vec[rng.choice(len(seen), groups, replace=False, p=weight / weight.sum())]
        for _ in range(15):
            best = np.argmin((centre**2).sum(1)[None] - 2 * vec @ centre.T, 1)
            for g in range(groups):
                if (best == g).any():
                    centre[g] = np.average(vec[best == g], axis=0, weights=weight[best == g])
        klass[seen] = SINGLE + best
    soft = counts + 0.02
    return klass, soft / np.bincount(klass, soft, minlength=CLASSES)[klass]


def _initial(klass: np.ndarray, counts: np.ndarray, rng) -> dict[str, np.ndarray]:
    """Weights before training; without any counts all classes are equally likely."""
    d = WIDTH
    init = lambda *s: (rng.standard_normal(s) * 0.3 / np.sqrt(s[0] if len(s) > 1 and s[0] <= 64 else 1)).astype(np.float32)
    w = {"E": init(IDS + 2, d), "P": init(WINDOW, d) * np.float32(0.3), "q": init(d, d), "k": init(d, d), "v": init(d, d), "o": init(d, CLASSES)}
    first = np.bincount(klass, counts, minlength=CLASSES) + 1.0
    w["b"] = np.log(first / first.sum()).astype(np.float32)
    return w if counts.any() else w | {"o": np.zeros_like(w["o"]), "b": np.zeros_like(w["b"])}


def train(ids: np.ndarray, offsets: np.ndarray, steps: int = STEPS, rate: float = 0.01, seed: int = 7) -> Model:
    """Train on documents given as concatenated ids and offsets."""
    rng = np.random.default_rng(seed)
    counts, pairs = np.bincount(ids, minlength=IDS), pair_counts(ids, offsets)
    klass, share = classes(counts, *neighbours(*pairs, np.argsort(-counts, kind="stable")[:SIDE]), seed)
    w = _initial(klass, counts, rng)
    if len(ids) == 0:
        return Model(klass, share, pairs, w)
    inputs, targets, _ = _windows(ids, offsets)
    picks = (rng.integers(0, len(inputs), BATCH) for _ in range(steps))
    return Model(klass, share, pairs, _descend(w, klass, ((inputs[p], targets[p]) for p in picks), steps, rate))


def _descend(w: dict[str, np.ndarray], klass: np.ndarray, windows: Iterable[tuple[np.ndarray, np.ndarray]], steps: int, rate: float) -> dict[str, np.ndarray]:
    """Weights after ``steps`` steps of Adam, one for each inputs and targets of some windows; of the
    embeddings only the rows that a step reads change in it."""
    w, d = {n: x.copy() for n, x in w.items()}, WIDTH
    scale, m, v = np.float32(1 / np.sqrt(d)), {n: np.zeros_like(x) for n, x in w.items()}, {n: np.zeros_like(x) for n, x in w.items()}
    flat = lambda x: x.reshape(-1, x.shape[-1])
    for t, (x_id, y) in enumerate(windows, 1):
        x = w["E"][x_id] + w["P"]
        xq = x[:, STRIDE:]
        q, k, val = xq @ w["q"] * scale, x @ w["k"], x @ w["v"]
        a = np.matmul(q, k.transpose(0, 2, 1))
        np.exp(np.clip(a, -CLIP, CLIP, out=a), out=a)
        a *= _CAUSAL
        a *= (x_id != OUTSIDE_ROW).astype(np.float32)[:, None, :]
        a /= a.sum(-1, keepdims=True)
        h = xq + a @ val
        p = np.exp(np.clip(h @ w["o"] + w["b"], -CLIP, CLIP))
        p /= p.sum(-1, keepdims=True)
        live = y >= 0
        goal = klass[np.maximum(y, 0)]
        dz = p
        dz.reshape(-1, CLASSES)[np.arange(goal.size), goal.ravel()] -= 1
        dz *= (live / max(1, live.sum())).astype(np.float32)[..., None]
        g = {"o": flat(h).T @ flat(dz), "b": dz.sum((0, 1))}
        dh = dz @ w["o"].T
        da, dv = np.matmul(dh, val.transpose(0, 2, 1)), np.matmul(a.transpose(0, 2, 1), dh)
        ds = a * (da - (da * a).sum(-1, keepdims=True))
        dq, dk = np.matmul(ds, k) * scale, np.matmul(ds.transpose(0, 2, 1), q)
        g |= {n: flat(u).T @ flat(e) for n, u, e in (("q", xq, dq), ("k", x, dk), ("v", x, dv))}
        dx = dk @ w["k"].T + dv @ w["v"].T
        dx[:, STRIDE:] += dh + dq @ w["q"].T
        g["P"] = dx.sum(0)
        order = np.argsort(x_id, axis=None, kind="stable")
        rows, first = np.unique(x_id.ravel()[order], return_index=True)
        g["E"] = np.add.reduceat(flat(dx)[order], first, axis=0)
        step = rate * min(1.0, t / 20) * (1 - 0.9 * t / steps)
        for n in w:
            at = rows if n == "E" else slice(None)
            m[n][at] = 0.9 * m[n][at] + 0.1 * g[n]
            v[n][at] = 0.99 * v[n][at] + 0.01 * g[n] ** 2
            w[n][at] -= (step * (m[n][at] / (1 - 0.9**t)) / (np.sqrt(v[n][at] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
    return w


@dataclass
class Tables:
    """Look-up tables of a model: see ``tables``."""

    rows: np.ndarray
    query: np.ndarray
    key: np.ndarray
    value: np.ndarray
    slots: np.ndarray
    chance: np.ndarray
    back: np.ndarray


def _slot(code: np.ndarray, size: int) -> np.ndarray:
    return (code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(65 - size.bit_length())).astype(np.int64)


def tables(model: Model) -> Tables:
    """The linear maps by input row and by window position, and the pairs as a hash table.

    For the kept pairs of a token and a class, ``chance`` is the discounted share of a pair and
    ``back`` what the discounts leave; without kept pairs all of it is left.
    """
    w, s = model.weights, np.float32(1 / np.sqrt(WIDTH))
    code, count = model.pairs
    before, klass = (code // np.uint64(IDS)).astype(np.int64), model.klass[(code % np.uint64(IDS)).astype(np.int64)]
    cell = before * CLASSES + klass
    total = np.bincount(cell, count, minlength=IDS * CLASSES).astype(np.float32)
    left = np.bincount(cell, np.minimum(count, DISCOUNT), minlength=IDS * CLASSES).astype(np.float32)
    back = np.where(total > 0, left / np.maximum(total, 1), np.float32(1))
    size = max(16, 1 << int(2 * len(code)).bit_length())
    slots, chance = np.full(size, 0xFFFFFFFF, np.uint32), np.zeros(size, np.float32)
    todo, at = np.arange(len(code)), _slot(code, size)
    while len(todo):
        free = slots[at] == 0xFFFFFFFF
        slots[at[free]] = code[todo[free]].astype(np.uint32)
        mine = slots[at] == code[todo].astype(np.uint32)
        chance[at[mine]] = np.maximum(count[todo[mine]] - DISCOUNT, 0) / total[cell[todo[mine]]]
        todo, at = todo[~mine], (at[~mine] + 1) % size
    rows = np.concatenate([w["E"] @ w["q"] * s, w["E"] @ w["k"], w["E"] @ w["v"], w["E"]], 1)
    return Tables(rows, (w["P"] @ w["q"] * s)[STRIDE:], w["P"] @ w["k"], w["P"] @ w["v"], slots, chance, back)


def _within(before: np.ndarray, ids: np.ndarray, model: Model, look: Tables) -> np.ndarray:
    """Probability of every id within its class, after the token before it."""
    code = before.astype(np.uint64) * np.uint64(IDS) + ids.astype(np.uint64)
    short, size = code.astype(np.uint32), len(look.slots)
    at, found = _slot(code, size), np.zeros(len(ids), np.float32)
    todo = np.arange(len(ids))
    while len(todo):
        there = look.slots[at]
        hit = there == short[todo]
        found[todo[hit]] = look.chance[at[hit]]
        more = ~hit & (there != 0xFFFFFFFF)
        todo, at = todo[more], (at[more] + 1) % size
    return found + look.back[before * CLASSES + model.klass[ids]] * model.share[ids]


def log10_probability(ids: np.ndarray, offsets: np.ndarray, model: Model, look: Tables, chunk: int = 128) -> np.ndarray:
    """log10 probability of every document.

    A window's first half is the window before it, so a chunk looks its tokens up once; the part
    of the products that depends on the position alone is one product for the whole chunk.
    """
    out, w, d = np.zeros(len(offsets) - 1), model.weights, WIDTH
    if len(ids) == 0:
        return out
    size = np.diff(offsets)
    many = -(-size // STRIDE)
    doc = np.repeat(np.arange(len(size)), many)
    place = (np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)) * STRIDE
    before = np.empty(len(ids), np.int64)
    before[1:] = ids[:-1]
    before[offsets[:-1][size > 0]] = END_ID
    got = np.log10(_within(before, ids, model, look))
    out += np.add.reduceat(np.append(got, 0.0), offsets[:-1]) * (size > 0)
    before[offsets[:-1][size > 0]] = BEFORE_ROW
    before, klass = np.append(before, OUTSIDE_ROW), np.append(model.klass[ids], 0)
    start, step = offsets[doc] + place, np.arange(STRIDE)
    # sums along short rows are products with ones
    value, ones = np.concatenate([look.value, np.ones((WINDOW, 1), np.float32)], 1), np.ones(CLASSES, np.float32)
    for c in range(0, len(doc), chunk):
        part = slice(c, c + chunk)
        live = (place[part, None] + step) < size[doc[part]][:, None]
        at = np.where(live, start[part, None] + step, len(ids))
        # the half before the first window of the chunk, if that is not a document's first
        lead = start[c] - STRIDE + step if place[c] else np.full(STRIDE, len(ids))
        rows = look.rows[before[np.concatenate([lead, at.ravel()])]]
        many, one = len(at), rows.strides[0]
        # a window is the rows of two neighbouring halves, seen in place
        windows = np.lib.stride_tricks.as_strided(rows, (many, WINDOW, 4 * d), (STRIDE * one, one, rows.strides[1]))
        q = windows[:, STRIDE:, :d] + look.query
        s = np.matmul(q, windows[:, :, d : 2 * d].transpose(0, 2, 1))
        s += (q.reshape(-1, d) @ look.key.T).reshape(s.shape)
        np.exp(np.clip(s, -CLIP, CLIP, out=s), out=s)
        s *= _CAUSAL
        s[place[part] == 0, :, :STRIDE] = 0
        o = np.matmul(s, windows[:, :, 2 * d : 3 * d])
        by_place = (s.reshape(-1, WINDOW) @ value).reshape(many, STRIDE, d + 1)
        o += by_place[:, :, :d]
        o /= by_place[:, :, d:]
        o += windows[:, STRIDE:, 3 * d :]
        o += w["P"][STRIDE:]
        z = o.reshape(-1, d) @ w["o"]
        z += w["b"]
        np.clip(z, -CLIP, CLIP, out=z)
        goal = z[np.arange(len(z)), klass[at].ravel()]
        np.exp(z, out=z)
        got = ((goal - np.log(z @ ones)) / np.log(10)).reshape(live.shape)
        out += np.bincount(doc[part], np.where(live, got, 0.0).sum(1), minlength=len(out))
    return out


def _pack(key: np.ndarray, columns: list[np.ndarray], buckets: int):
    """(bucket, bytes of the key and each column) for every bucket that has rows."""
    bucket = (key % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for b in np.flatnonzero(ends[1:] > ends[:-1]):
        s = order[ends[b] : ends[b + 1]]
        yield int(b), key[s].tobytes(), *(c[s].tobytes() for c in columns)


def _merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, where = np.unique(np.concatenate(keys), return_inverse=True)
    return key, np.bincount(where.ravel(), np.concatenate(counts), minlength=len(key)).astype(np.int64)


def _reduced(parts: DataFrame) -> DataFrame:
    """Packed keys and counts, merged to one row for each bucket."""

    def reduce(table: pa.Table) -> pa.Table:
        key, count = _merge([np.frombuffer(x.as_py(), np.uint64) for x in table.column("words")], [np.frombuffer(x.as_py(), np.int64) for x in table.column("counts")])
        return pa.table([pa.array([table.column("bucket")[0].as_py()], pa.int32()), pa.array([key.tobytes()]), pa.array([count.tobytes()])], names=["bucket", "words", "counts"])

    return parts.groupBy("bucket").applyInArrow(reduce, "bucket int, words binary, counts binary")


def word_counts(docs: DataFrame, buckets: int, hold: int = 1 << 20) -> DataFrame:
    """``(bucket, words, counts)``: one row for each hash bucket, words sorted by hash."""
    schema = pa.schema([("bucket", pa.int32()), ("words", pa.binary()), ("counts", pa.binary())])

    def run(batches):
        keys, counts, held = [], [], 0

        def flush():
            key, count = _merge(keys, counts)
            rows = list(_pack(key, [count], buckets))
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

        for batch in batches:
            data, offsets = utf8(batch.column(0))
            for a, b in slices(offsets):
                low, starts, ends, _ = words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                key, count = np.unique(word_hashes(low, starts, ends), return_counts=True)
                keys.append(np.concatenate([key, [END_HASH]]))
                counts.append(np.concatenate([count, [b - a]]))
                held += len(key)
                if held > hold:
                    merged = _merge(keys, counts)
                    if len(merged[0]) > hold // 2:
                        yield flush()
                        keys, counts, held = [], [], 0
                    else:
                        keys, counts, held = [merged[0]], [merged[1]], len(merged[0])
        if keys:
            yield flush()

    parts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(run, "bucket int, words binary, counts binary")
    return _reduced(parts)


def _summary(counts: DataFrame, common: int) -> tuple[int, int, np.ndarray, np.ndarray]:
    """Tokens, distinct tokens, and the most frequent words of each bucket (bounded) with counts."""

    def run(batches):
        for batch in batches:
            rows = []
            for w, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                key, count = np.frombuffer(w, np.uint64), np.frombuffer(c, np.int64)
                top = np.argsort(-count, kind="stable")[:common]
                top = top[count[top] > 1]
                rows.append((int(count.sum()), len(count), key[top].tobytes(), count[top].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=["n", "v", "words", "counts"])

    got = counts.select("words", "counts").mapInArrow(run, "n long, v long, words binary, counts binary").collect()
    key = np.concatenate([np.frombuffer(r.words, np.uint64) for r in got] or [np.zeros(0, np.uint64)])
    count = np.concatenate([np.frombuffer(r.counts, np.int64) for r in got] or [np.zeros(0, np.int64)])
    order = np.argsort(key)
    return sum(r.n for r in got), sum(r.v for r in got), key[order], count[order]


_PREPARED = (
    "kind int, batch long, bucket int, words binary, counts binary, owner binary, n long, ids binary, nulls binary, tokens binary, known binary, logs binary, pieces binary, sizes binary, learn binary, salts binary"
)
_NAMES = [x.split()[0] for x in _PREPARED.split(", ")]
_KINDS = [{"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]] for x in _PREPARED.split(", ")]
PAIR, LOCAL, ASKED = range(3)


def _prepared(docs: DataFrame, common: tuple[np.ndarray, np.ndarray], buckets: int, hold: int = 1 << 20) -> DataFrame:
    """What one pass over ``docs(doc_id, text, learn)`` gathers, told apart by ``kind``.

    ``PAIR``: pair counts of training documents by hash bucket. ``LOCAL``: for each batch its ids,
    encoded texts, which of them train, and what the frequent words give for the base score.
    ``ASKED``: a batch's requests, one for each bucket.
    """
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches):
        key, count = shared.value
        log = np.log10(count + 1.0)
        task, number = TaskContext.get().partitionId() << 32, 0
        codes, many, held = [], [], 0

        def made(rows):
            return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in zip(_NAMES, _KINDS)], names=_NAMES)

        def gathered():
            return made([{"kind": PAIR, "bucket": b, "words": w, "counts": c} for b, w, c in _pack(*_merged(), buckets)])

        def _merged():
            code, n = _merge(codes, many)
            return code, [n]

        for batch in batches:
            data, offsets = utf8(batch.column(1))
            learn, salt = batch.column(2).to_numpy(zero_copy_only=False).astype(bool), batch.column(3).to_numpy().astype(np.uint64)
            for a, b in slices(offsets):
                low, starts, ends, per = words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                h = word_hashes(low, starts, ends)
                ids, at = subwords(low, starts, ends, h, per)
                some = learn[a:b]
                if some.any():
                    size = np.diff(at)
                    own, ends_ = ids[np.repeat(some, size)], np.concatenate([[0], np.cumsum(size[some])])
                    code, n = pair_counts(own, ends_)
                    codes.append(code)
                    many.append(n)
                    held += len(code)
                    if held > hold:
                        merged = _merge(codes, many)
                        codes, many, held = [merged[0]], [merged[1]], len(merged[0])
                        if held > hold // 2:
                            yield gathered()
                            codes, many, held = [], [], 0
                n = b - a
                doc = np.concatenate([np.repeat(np.arange(n), np.diff(per)), np.arange(n)])
                h = np.concatenate([h, np.full(n, END_HASH)])
                spot = np.minimum(np.searchsorted(key, h), max(0, len(key) - 1))
                hit = key[spot] == h if len(key) else np.zeros(len(h), bool)
                known, logs = np.bincount(doc[hit], minlength=n), np.bincount(doc[hit], log[spot[hit]], minlength=n)
                name = task + number
                number += 1
                who = batch.column(0).slice(a, n)
                rows = [{
                    "kind": LOCAL, "batch": name, "ids": who.fill_null(0).to_numpy().tobytes(), "nulls": who.is_null().to_numpy(zero_copy_only=False).tobytes(),
                    "tokens": np.diff(per).astype(np.int64).tobytes(), "known": known.astype(np.int64).tobytes(), "logs": logs.tobytes(),
                    "pieces": ids.astype(np.uint16).tobytes(), "sizes": np.diff(at).astype(np.int64).tobytes(),
                    "learn": some.tobytes(), "salts": salt[a:b].tobytes(),
                }]
                miss = np.flatnonzero(~hit)
                order = miss[np.lexsort((doc[miss], h[miss]))]
                hh, dd = h[order], doc[order]
                new = np.ones(len(hh), bool)
                new[1:] = (hh[1:] != hh[:-1]) | (dd[1:] != dd[:-1])
                first = np.flatnonzero(new)
                times = np.diff(np.concatenate([first, [len(hh)]]))
                for bucket, w, o, c in _pack(hh[first], [dd[first].astype(np.uint32), times.astype(np.uint32)], buckets):
                    rows.append({"kind": ASKED, "batch": name, "bucket": bucket, "words": w, "owner": o, "counts": c, "n": n})
                yield made(rows)
        if codes:
            yield gathered()

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("learn", F.lit(False)).alias("learn"), F.xxhash64("doc_id", "text").alias("salt"))
    return rows.mapInArrow(run, _PREPARED)


def _answer(asked: pa.Table, counts: pa.Table) -> pa.Table:
    """Known tokens and sums of log10(c + 1) for each document of each requesting batch."""
    have = counts.num_rows > 0
    key = np.frombuffer(counts.column("words")[0].as_py(), np.uint64) if have else np.zeros(0, np.uint64)
    count = np.frombuffer(counts.column("counts")[0].as_py(), np.int64) if have else np.zeros(0, np.int64)
    rows = []
    for r in asked.select(["batch", "words", "owner", "counts", "n"]).to_pylist():
        h, doc, many = np.frombuffer(r["words"], np.uint64), np.frombuffer(r["owner"], np.uint32), np.frombuffer(r["counts"], np.uint32)
        n = r["n"]
        spot = np.minimum(np.searchsorted(key, h), max(0, len(key) - 1))
        hit = key[spot] == h if len(key) else np.zeros(len(h), bool)
        known = np.bincount(doc[hit], many[hit], minlength=n).astype(np.int64)
        rows.append((r["batch"], known.tobytes(), np.bincount(doc[hit], many[hit] * np.log10(count[spot[hit]] + 1.0), minlength=n).tobytes()))
    return pa.table([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.binary(), pa.binary()))], names=["batch", "known", "logs"])


def _draw(ids: np.ndarray, offsets: np.ndarray, salt: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Keys and ids of the drawn windows: the ``WINDOW`` inputs and the last target."""
    size = np.diff(offsets)
    many = -(-size // STRIDE)
    doc = np.repeat(np.arange(len(size)), many)
    w = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    key = mix(mix(salt)[doc] + w.astype(np.uint64))
    some = np.flatnonzero((key >> np.uint64(32)).astype(np.int64) < int(share * (1 << 32)))
    doc, key = doc[some], mix(key[some] + np.uint64(1))
    at = (w[some] * STRIDE - STRIDE - 1)[:, None] + np.arange(WINDOW + 1)
    inside = (at >= 0) & (at < size[doc][:, None])
    span = np.where(inside, ids[np.clip(offsets[doc][:, None] + at, 0, len(ids) - 1)], np.where(at == -1, BEFORE, OUTSIDE))
    return key, span.astype(np.uint16)


def _id_counts(pairs: DataFrame) -> np.ndarray:
    """Count of every id."""

    def run(batches):
        total = np.zeros(IDS, np.int64)
        for batch in batches:
            for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                np.add.at(total, (np.frombuffer(k, np.uint64) % np.uint64(IDS)).astype(np.int64), np.frombuffer(c, np.int64))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["id", "n"])

    got = pairs.select("words", "counts").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(IDS, np.int64)
    out[got["id"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    return out


def _id_neighbours(pairs: DataFrame, frequent: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Cells and counts of ``neighbours`` over all pairs; at most ``IDS * 2 * SIDE`` of them."""

    def run(batches):
        keys, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for batch in batches:
            for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                cell, many = neighbours(np.frombuffer(k, np.uint64), np.frombuffer(c, np.int64), frequent)
                keys, counts = [keys[0], cell], [counts[0], many]
                cell, many = _merge(keys, counts)
                keys, counts = [cell], [many]
        rows = list(_pack(keys[0], [counts[0]], buckets))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.binary(), pa.binary()))], names=["bucket", "words", "counts"])

    got = _reduced(pairs.select("words", "counts").mapInArrow(run, "bucket int, words binary, counts binary")).collect()
    return tuple(np.concatenate([np.zeros(0, d), *(np.frombuffer(r[n], d) for r in got)]) for n, d in (("words", np.uint64), ("counts", np.int64)))


def _frequent(pairs: DataFrame, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``PAIRS`` most frequent pairs, an equal part of each bucket, with their counts."""
    most = -(-PAIRS // buckets)

    def run(batches):
        for batch in batches:
            rows = []
            for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                code, count = np.frombuffer(k, np.uint64), np.frombuffer(c, np.int64)
                top = np.lexsort((code, -count))[:most]
                rows.append((code[top].astype(np.uint32).tobytes(), count[top].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.binary()) for i in (0, 1)], names=["words", "counts"])

    got = pairs.select("words", "counts").mapInArrow(run, "words binary, counts binary").collect()
    code, count = (np.concatenate([np.zeros(0, d), *(np.frombuffer(r[n], d) for r in got)]) for n, d in (("words", np.uint32), ("counts", np.int64)))
    order = np.argsort(code)
    return code[order].astype(np.uint64), count[order]


def _taught(prepared: DataFrame, shards: int, turn: int = 0, turns: int = 1, first: bool = False) -> DataFrame:
    """``(bucket, salts, sizes, pieces)``: the training documents of a turn, packed by shard; of the
    first shard only, if asked."""
    names, kinds = ["bucket", "salts", "sizes", "pieces"], [pa.int32(), *[pa.binary()] * 3]

    def run(batches):
        salts, sizes, pieces, held = [], [], [], 0

        def flush():
            salt, size, flat = (np.concatenate(x) for x in (salts, sizes, pieces))
            shard, start = (mix(salt) % np.uint64(shards)).astype(np.int64), np.cumsum(size) - size
            order = np.argsort(shard, kind="stable")
            edge = np.flatnonzero(np.diff(shard[order], prepend=-1))
            rows = []
            for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(order)]):
                s = order[a:b]
                ids = np.concatenate([flat[x : x + n] for x, n in zip(start[s].tolist(), size[s].tolist())])
                rows.append((int(shard[s[0]]), salt[s].tobytes(), size[s].tobytes(), ids.tobytes()))
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

        for batch in batches:
            for learn, *packed in zip(*(batch.column(k).to_pylist() for k in range(4))):
                salt, size, ids = (np.frombuffer(x, d) for x, d in zip(packed, (np.uint64, np.int64, np.uint16)))
                name = mix(salt)
                some = np.frombuffer(learn, bool) & ((name >> np.uint64(40)) % np.uint64(turns) == turn)
                if first:
                    some &= name % np.uint64(shards) == 0
                if not some.any():
                    continue
                salts.append(salt[some])
                sizes.append(size[some])
                pieces.append(ids[np.repeat(some, size)])
                held += len(pieces[-1])
                if held >= HELD:
                    yield flush()
                    salts, sizes, pieces, held = [], [], [], 0
        if salts:
            yield flush()

    local = prepared.where(F.col("kind") == LOCAL).select("learn", "salts", "sizes", "pieces")
    return local.mapInArrow(run, "bucket int, salts binary, sizes binary, pieces binary")


def _chunks(size: np.ndarray) -> list[slice]:
    """Ranges of documents that have about ``CHUNK`` windows each."""
    part = np.cumsum(-(-size // STRIDE)) // CHUNK
    edge = np.flatnonzero(np.diff(part, prepend=-1)).tolist()
    return [slice(a, b) for a, b in zip(edge, [*edge[1:], len(size)])]


def _passes(salt: np.ndarray, size: np.ndarray, flat: np.ndarray, times: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Inputs and targets of all windows of some documents, ``BATCH`` windows of a chunk at a time.

    Salts and keys are hashes, so their order is a random one, and the same for any partitions.
    """
    start, order = np.cumsum(size) - size, np.argsort(salt, kind="stable")
    for _ in range(times):
        for part in _chunks(size[order]):
            s = order[part]
            ids = np.concatenate([flat[x : x + n] for x, n in zip(start[s].tolist(), size[s].tolist())])
            key, span = _draw(ids, np.concatenate([[0], np.cumsum(size[s])]), salt[s], 1.0)
            span = span[np.argsort(key, kind="stable")].astype(np.int32)
            span[span == BEFORE], span[span == OUTSIDE] = BEFORE_ROW, OUTSIDE_ROW
            target = np.where(span[:, STRIDE + 1 :] < IDS, span[:, STRIDE + 1 :], -1)
            for k in range(0, len(span), BATCH):
                yield span[k : k + BATCH, :WINDOW], target[k : k + BATCH]


def _trained(taught: DataFrame, klass: np.ndarray, weights: dict[str, np.ndarray], rate: float, steps: int) -> dict[str, np.ndarray]:
    """Weights trained by every shard on all windows of its documents, averaged by their numbers.

    The windows are passed over until there are ``steps`` steps, once at least.
    """
    shared = taught.sparkSession.sparkContext.broadcast((klass, weights))
    shape = {n: x.shape for n, x in weights.items()}
    kinds = pa.schema([("part", pa.int32()), ("n", pa.int64()), ("weights", pa.binary())])

    def local(table: pa.Table) -> pa.Table:
        klass, w = shared.value
        salt, size, flat = (np.concatenate([np.frombuffer(x.as_buffer(), d) for x in table.column(n)]) for n, d in (("salts", np.uint64), ("sizes", np.int64), ("pieces", np.uint16)))
        many, order = -(-size // STRIDE), np.argsort(salt, kind="stable")
        per = sum(-(-int(many[order][part].sum()) // BATCH) for part in _chunks(size[order]))
        times = max(1, -(-steps // max(1, per)))
        w = _descend(w, klass, _passes(salt, size, flat, times), times * per, rate)
        flat = np.concatenate([w[n].ravel() for n in sorted(w)])
        return pa.table([pa.array([table.column("bucket")[0].as_py() % 16], pa.int32()), pa.array([int(many.sum())], pa.int64()), pa.array([flat.tobytes()], pa.binary())], schema=kinds)

    def total(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["part"], r["weights"]))
        many = sum(r["n"] for r in rows)
        flat = sum(np.frombuffer(r["weights"], np.float32).astype(float) * (r["n"] / max(1, many)) for r in rows)
        return pa.table([pa.array([0], pa.int32()), pa.array([many], pa.int64()), pa.array([flat.astype(np.float32).tobytes()], pa.binary())], schema=kinds)

    each = taught.groupBy("bucket").applyInArrow(local, "part int, n long, weights binary")
    sums = each.groupBy("part").applyInArrow(total, "part int, n long, weights binary").groupBy("part").applyInArrow(total, "part int, n long, weights binary")
    got = sums.first()
    if got is None or not got.n:
        return weights
    flat, out = np.frombuffer(got.weights, np.float32), {}
    for name in sorted(shape):
        size = int(np.prod(shape[name]))
        out[name], flat = flat[:size].reshape(shape[name]), flat[size:]
    return out


def _fit(prepared: DataFrame, buckets: int, shards: int, seed: int = 7) -> Model:
    """The model of what the pass gathered."""
    pairs = cut(_reduced(prepared.where(F.col("kind") == PAIR).select("bucket", "words", "counts")))
    counts = _id_counts(pairs)
    klass, part = classes(counts, *_id_neighbours(pairs, np.argsort(-counts, kind="stable")[:SIDE], buckets), seed)
    w = _initial(klass, counts, np.random.default_rng(seed))
    if counts.any():
        w = _trained(_taught(prepared, shards, first=True), klass, w, 0.01, STEPS)
        for turn in range(ROUNDS if shards > 1 else 0):
            w = _trained(_taught(prepared, max(1, shards // LARGE), turn, ROUNDS), klass, w, 0.003 / (1 + 2 * turn), 1)
    return Model(klass, part, _frequent(pairs, buckets), w)


def _scored(local: DataFrame, model: Model) -> DataFrame:
    """The local rows with ``model``, the log10 probability of each of their documents."""
    shared = local.sparkSession.sparkContext.broadcast((model.klass, model.share, model.pairs, model.weights))
    name = uuid.uuid4().hex
    names = ["batch", "ids", "nulls", "tokens", "known", "logs"]

    def run(batches):
        held = _held()
        if held.get("tables", ("",))[0] != name:
            m = Model(*shared.value)
            held["tables"] = (name, m, tables(m))
        _, m, look = held["tables"]
        for batch in batches:
            out = []
            for pieces, sizes in zip(batch.column("pieces").to_pylist(), batch.column("sizes").to_pylist()):
                at = np.concatenate([[0], np.cumsum(np.frombuffer(sizes, np.int64))])
                out.append(log10_probability(np.frombuffer(pieces, np.uint16).astype(np.int64), at, m, look).tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(out, pa.binary())], names=[*names, "model"])

    return local.select(*names, "pieces", "sizes").mapInArrow(run, "batch long, ids binary, nulls binary, tokens binary, known binary, logs binary, model binary")


def _gathered(docs: DataFrame, train_rows: Column, common: tuple[np.ndarray, np.ndarray], buckets: int) -> tuple[DataFrame, int]:
    """The written table of ``_prepared``, and the number of shards."""
    rows = docs.withColumn("learn", train_rows)
    volume = rows.where("learn").agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, round(volume / 3 / STRIDE / SHARD))
    return table(_prepared(rows, common, buckets), "kind"), shards


def score(docs: DataFrame, train_rows: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, n_known, train_tokens, base_score, score)`` of every document."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    condition = F.coalesce(train_rows, F.lit(True))
    # words and pairs of a bucket stay a few megabytes
    volume = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(partitions(spark), -(-volume // BUCKET))
    counts = cut(word_counts(rows.where(condition), buckets))
    n, v, key, count = _summary(counts, -(-COMMON // buckets))
    prepared, shards = _gathered(rows, condition, (key, count), buckets)
    model = _fit(prepared, buckets, shards)
    answers = (
        prepared.where(F.col("kind") == ASKED).select("batch", "bucket", "words", "owner", "counts", "n")
        .groupBy("bucket").cogroup(counts.groupBy("bucket"))
        .applyInArrow(_answer, "batch long, known binary, logs binary")
    )
    size = float(np.log10(n + v + 1))

    def finish(mine: pa.Table, got: pa.Table) -> pa.Table:
        out = [[] for _ in range(6)]
        extra: dict[int, list] = {}
        for r in got.to_pylist():
            known, logs = np.frombuffer(r["known"], np.int64), np.frombuffer(r["logs"], np.float64)
            old = extra.get(r["batch"])
            extra[r["batch"]] = [known, logs] if old is None else [old[0] + known, old[1] + logs]
        for r in mine.to_pylist():
            ids, null = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["nulls"], bool)
            tokens = np.frombuffer(r["tokens"], np.int64) + 1
            known, logs = np.frombuffer(r["known"], np.int64), np.frombuffer(r["logs"], np.float64)
            if r["batch"] in extra:
                known, logs = known + extra[r["batch"]][0], logs + extra[r["batch"]][1]
            for o, x in zip(out, (pa.array(ids, mask=null), tokens, known, np.full(len(ids), n, np.int64), logs - tokens * size, np.frombuffer(r["model"], np.float64))):
                o.append(x if isinstance(x, pa.Array) else pa.array(x))
        kinds = [*[pa.int64()] * 4, *[pa.float64()] * 2]
        return pa.table([pa.chunked_array(o, t) for o, t in zip(out, kinds)], names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    mine = _scored(prepared.where(F.col("kind") == LOCAL), model)
    return mine.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(
        finish, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
