"""Exact removal of long repeated byte strings with suffix arrays.

A byte is removed if a string of ``length`` bytes that covers it also starts anywhere else,
in the same document or another one. The suffix arrays are built by external induced
sorting (``induced.py``), in shards that together hold every string that can repeat:

1. *Contexts.* Every string of ``length`` bytes has a smallest 32-byte gram (by hash). A
   context is a run of neighbouring strings with the same smallest gram. Equal strings have
   equal smallest grams, so all starts of a string lie in contexts of one gram, and each
   start lies in one context only. Equal texts are one text throughout.
2. *Pre-aggregation.* Contexts meet by gram, packed, one row for each task and bucket. A
   gram with one context is unique and done, unless it occurs twice in that context.
   Contexts of one gram with equal bytes (128 bits of hashes and equal length) collapse to
   one with a count, and their strings repeat: a passage in a third of all documents costs
   a row for each task. All grams with different contexts go on.
3. *Sorting.* Those contexts, one of each kind, meet in shards by gram. A gram with more than
   ``HOT`` contexts is split: its strings are told apart by where the gram lies in them, in
   ``PARTS`` ranges, and all strings of a range hold the same bytes around the gram if they are
   equal, so these bytes join the gram in the key. A shard is one text with a separator after
   each context and is sorted by induction. Of the suffixes with ``length`` bytes left in their
   context, a string repeats if the one before or after it shares ``length`` bytes.
4. *Removal.* The repeated ranges of a text are united and meet its row. A text that occurs
   twice goes as a whole if it has ``length`` bytes, which its rows learn from a count.

Texts travel keyed by a 128-bit digest, and only those that have contexts to sort. Null is the
empty text. Repeated rows are copies of each other. Documents shorter than ``length`` lose
nothing. An empty table gives no rows. Columns other than id and text are carried by
``remove_repeats`` only.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from knotwork.llm.induced import suffix_array
from knotwork.llm.sieve import SIEVE, passes, sieve
from knotwork.llm.textkernel import mix, release, utf8
from knotwork.operators.skew import lookup
from knotwork.storage import cut, packed, partitions, unpacked

GRAM, SHARD, GROUP = 32, 2_000_000, 24_000_000
#: Different contexts above which a gram is split, and ranges of its place in a string.
HOT, PARTS = 4096, 8
#: Bytes of a text that are searched at once; positions in them have 28 bits.
BLOCK = 1 << 26
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_Q = 0x2545F4914F6CDD1D
_QI = pow(_Q, -1, 1 << 64)
_power_cache: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64."""
    size = 1 << max(16, n.bit_length())
    if size not in _power_cache:
        if len(_power_cache) > 4:
            _power_cache.clear()
        _power_cache[size] = tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, np.uint64(q))]), dtype=np.uint64) for q in (_Q, _QI))
    return _power_cache[size]


def contexts(data: np.ndarray, length: int):
    """(gram, bytes hash, first start, number of starts, gram twice inside) of a text's contexts.

    A context that crosses two blocks of a very long text is two contexts of one gram.
    """
    parts = []
    for at in range(0, max(1, len(data) - length + 1), BLOCK):
        got = _contexts(data[at : at + BLOCK + length - 1], length)
        if got is not None:
            parts.append((*got[:2], got[2] + at, *got[3:]))
    return tuple(np.concatenate(x) for x in zip(*parts)) if parts else None


def _contexts(data: np.ndarray, length: int):
    n, w = len(data) - length + 1, length - GRAM + 1
    if n < 1:
        return None
    g, h = len(data) - GRAM + 1, _gram_hashes(data)
    # sliding minimum of (hash, position): windows double, then two of them cover the width
    low = (h & ~np.uint64((1 << 28) - 1)) | np.arange(g, dtype=np.uint64)
    span = 1
    while 2 * span <= w:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    low = np.minimum(low[:n], low[w - span : w - span + n])
    at = (low & np.uint64((1 << 28) - 1)).astype(np.int64)
    best = h[at]
    new = np.ones(n, bool)
    new[1:] = best[1:] != best[:-1]
    start = np.flatnonzero(new)
    count = np.diff(np.concatenate([start, [n]]))
    moved = np.zeros(n, np.int64)
    moved[1:] = at[1:] != at[:-1]
    moved[start] = 0
    twice = np.add.reduceat(moved, start) > 0
    up, down = _powers(g)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(h * up[:g], dtype=np.uint64)])
    body = mix((sums[start + count + w - 1] - sums[start]) * down[start] + count.astype(np.uint64))
    return best[start], body, start, count, twice


def _texts(docs: DataFrame, text_col: str, wanted: np.ndarray | None = None) -> DataFrame:
    """``(cid, text)``: every text, or those that pass the filter, with its digest; a text that a
    task has seen is left out."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    shared = None if wanted is None else docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches):
        seen: set[bytes] = set()
        for batch in batches:
            cids = batch.column(0).to_pylist()
            keep = [True] * len(cids) if shared is None else passes(shared.value, _names(b"".join(cids))).tolist()
            for i, c in enumerate(cids):
                keep[i] = keep[i] and c not in seen
                if keep[i]:
                    seen.add(c)
            if len(seen) > 1 << 20:
                seen.clear()
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.select(F.unhex(F.md5(text)).alias("cid"), text.alias("text")).mapInArrow(run, "cid binary, text string")


def _names(cids: bytes) -> np.ndarray:
    """The first eight bytes of packed digests."""
    return np.frombuffer(cids, "<u8")[::2]


def _asked(cuts: DataFrame) -> np.ndarray:
    """A filter of the texts with contexts to sort."""

    def run(batches):
        for batch in batches:
            names = np.unique(np.concatenate([np.zeros(0, np.uint64), *(_names(x) for x in batch.column(0).to_pylist())]) % np.uint64(SIEVE))
            yield pa.RecordBatch.from_arrays([pa.array(names.astype(np.int64))], names=["bit"])

    return sieve(cuts.where("kind = 1").select("cids").mapInArrow(run, "bit long"))


def _target(cid: np.ndarray, groups: int) -> np.ndarray:
    """Group of each digest, given as rows of 16 bytes: its first seven bytes modulo the groups."""
    return ((np.ascontiguousarray(cid[:, :8]).view(">u8").ravel().astype(np.uint64) >> np.uint64(8)) % np.uint64(groups)).astype(np.int64)


def _key(groups: int):
    """The same as a column of ``cid``."""
    return F.conv(F.hex(F.substring("cid", 1, 7)), 16, 10).cast("long") % F.lit(groups)


def _rows(names: list[str], rows: list[tuple], kinds: list) -> pa.Table:
    return pa.table([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)


_FOUND = "bucket int, cids binary, owner binary, gram binary, body binary, start binary, count binary, twice binary"


def _find(texts: DataFrame, length: int, buckets: int, hold: int = 1 << 19) -> DataFrame:
    """Contexts packed by bucket of their gram."""
    names = ["bucket", "cids", "owner", "gram", "body", "start", "count", "twice"]
    kinds = [pa.int32(), *[pa.binary()] * 7]

    def run(batches):
        cids, parts, held = [], [], 0

        def flush():
            cid = np.frombuffer(b"".join(cids), np.uint8).reshape(-1, 16)
            owner, gram, body, start, count, twice = (np.concatenate([p[k] for p in parts]) for k in range(6))
            bucket = (gram % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
            rows = []
            for b in np.flatnonzero(ends[1:] > ends[:-1]):
                s = order[ends[b] : ends[b + 1]]
                used, local = np.unique(owner[s], return_inverse=True)
                rows.append((int(b), cid[used].tobytes(), local.astype(np.uint32).tobytes(), gram[s].tobytes(), body[s].tobytes(), start[s].astype(np.int64).tobytes(), count[s].astype(np.int64).tobytes(), twice[s].tobytes()))
            return _rows(names, rows, kinds).to_batches()

        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for i, cid in enumerate(batch.column(0).to_pylist()):
                got = contexts(data[offsets[i] : offsets[i + 1]], length)
                if got is None:
                    continue
                parts.append((np.full(len(got[0]), len(cids), np.int64), *got))
                cids.append(cid)
                held += len(got[0])
                if held >= hold:
                    yield from flush()
                    cids, parts, held = [], [], 0
        if parts:
            yield from flush()

    return texts.mapInArrow(run, _FOUND)


_CUTS = "t long, kind int, cids binary, start binary, size binary, gram binary, need binary, hot binary, bytes long"
_CUT_NAMES = ["t", "kind", "cids", "start", "size", "gram", "need", "hot", "bytes"]
_CUT_KINDS = [pa.int64(), pa.int32(), *[pa.binary()] * 6, pa.int64()]


def _pack(t: np.ndarray, kind: int, cid: np.ndarray, start: np.ndarray, size: np.ndarray, *more: np.ndarray) -> list[tuple]:
    """Rows by group of text: kind 0 holds repeated byte ranges, kind 1 contexts to sort, with
    their gram, whether they are needed and whether the gram is split."""
    order = np.argsort(t, kind="stable")
    t = t[order]
    edges = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]])) if len(t) else np.zeros(0, np.int64)
    rows = []
    for a, b in zip(edges, np.concatenate([edges[1:], [len(t)]])):
        s = order[a:b]
        rest = [x[s].tobytes() for x in more] or [None] * 3
        rows.append((int(t[a]), kind, cid[s].tobytes(), start[s].astype(np.int64).tobytes(), size[s].astype(np.int64).tobytes(), *rest, int(size[s].sum())))
    return rows


def _compare(found: DataFrame, length: int, groups: int) -> DataFrame:
    """Step 2: ranges that repeat as whole contexts, and the contexts left to sort."""

    def run(table: pa.Table) -> pa.Table:
        cid, owner, base = [], [], 0
        for c, o in zip(table.column("cids"), table.column("owner")):
            cid.append(np.frombuffer(c.as_py(), np.uint8).reshape(-1, 16))
            owner.append(np.frombuffer(o.as_py(), np.uint32).astype(np.int64) + base)
            base += len(cid[-1])
        cid, owner = np.concatenate(cid), np.concatenate(owner)
        gram, body, start, count, twice = (np.concatenate([np.frombuffer(x.as_py(), d) for x in table.column(n)]) for n, d in (("gram", np.uint64), ("body", np.uint64), ("start", np.int64), ("count", np.int64), ("twice", bool)))
        # equal texts of different tasks are one text
        _, first, same = np.unique(np.ascontiguousarray(cid).view("V16").ravel(), return_index=True, return_inverse=True)
        owner = same.ravel()[owner]
        cid = cid[first]
        order = np.lexsort((start, owner, count, body, gram))
        gram, body, start, count, twice, owner = gram[order], body[order], start[order], count[order], twice[order], owner[order]
        new = np.ones(len(gram), bool)
        new[1:] = (gram[1:] != gram[:-1]) | (owner[1:] != owner[:-1]) | (start[1:] != start[:-1])
        gram, body, start, count, twice, owner = gram[new], body[new], start[new], count[new], twice[new], owner[new]
        kind = np.ones(len(gram), bool)
        kind[1:] = (gram[1:] != gram[:-1]) | (body[1:] != body[:-1]) | (count[1:] != count[:-1])
        klass = np.cumsum(kind) - 1
        many = np.bincount(klass)
        head = np.flatnonzero(kind)
        lead = np.ones(len(head), bool)
        lead[1:] = gram[head][1:] != gram[head][:-1]
        of = np.cumsum(lead) - 1
        kinds = np.bincount(of)[of]
        sort = (kinds > 1) | ((many == 1) & twice[head])
        rows = []
        multi = many[klass] > 1
        o = owner[multi]
        rows += _pack(_target(cid[o], groups), 0, cid[o], start[multi], count[multi] + length - 1)
        pick = head[sort]
        o = owner[pick]
        rows += _pack(_target(cid[o], groups), 1, cid[o], start[pick], count[pick] + length - 1, gram[pick], (many == 1)[sort], (kinds > HOT)[sort])
        release()
        return _rows(_CUT_NAMES, rows, _CUT_KINDS)

    return found.groupBy("bucket").applyInArrow(run, _CUTS)


def _unpack(table: pa.Table, kind: int):
    """Concatenated columns (cid, start, size, gram, need, hot) of the rows of one kind."""
    rows = [r for r in table.to_pylist() if r["kind"] == kind]
    if not rows:
        return None
    col = lambda n, d: np.concatenate([np.frombuffer(r[n], d) for r in rows if r[n] is not None] or [np.zeros(0, d)])
    return col("cids", np.uint8).reshape(-1, 16), col("start", np.int64), col("size", np.int64), col("gram", np.uint64), col("need", bool), col("hot", bool)


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the gram at every place."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    g = len(data) - GRAM + 1
    h = eight[:g] * _M[0]
    for k in (1, 2, 3):
        h += eight[8 * k : 8 * k + g] * _M[k]
    return mix(h)


def split(raw: bytes, gram: int, length: int) -> list[tuple[int, int, int]]:
    """(key, first byte, bytes) of the parts of a context whose gram is hot.

    A string belongs to the range that the place of the gram in it falls in. All strings of a
    range hold the same stretch of ``length + 1 - width`` bytes around the gram, which is hashed.
    """
    data = np.frombuffer(raw, np.uint8)
    starts = np.arange(len(data) - length + 1)
    places = np.flatnonzero(_gram_hashes(data) == np.uint64(gram))
    place = places[np.searchsorted(places, starts)]
    width = -(-(length - GRAM + 1) // PARTS)
    range_ = (place - starts) // width
    edge = np.flatnonzero(np.concatenate([[True], (range_[1:] != range_[:-1]) | (place[1:] != place[:-1])]))
    out = []
    for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(starts)]):
        low = int(place[a] - range_[a] * width)
        key = hashlib.blake2b(raw[low : low + length + 1 - width], digest_size=8, salt=bytes([int(range_[a])])).digest()
        out.append((int.from_bytes(key, "little"), a, b - a + length - 1))
    return out


def _fetch(texts: DataFrame, cuts: DataFrame, groups: int, shards: int, length: int) -> DataFrame:
    """The bytes of the contexts to sort, packed by shard."""

    def run(table: pa.Table, asked: pa.Table) -> pa.Table:
        names, kinds = ["shard", "cids", "start", "size", "need", "data"], [pa.int64(), *[pa.binary()] * 5]
        got = _unpack(asked, 1) if asked.num_rows else None
        if got is None:
            return _rows(names, [], kinds)
        cid, start, size, gram, need, hot = got
        place = {c: i for i, c in enumerate(table.column("cid").to_pylist())}
        text = table.column("text").combine_chunks()
        order = np.argsort(np.ascontiguousarray(cid).view("V16").ravel(), kind="stable")
        key = mix(gram)
        parts: dict[int, list] = {}
        last, raw = None, b""
        for i in order.tolist():
            c = cid[i].tobytes()
            if c != last:
                last, raw = c, text[place[c]].as_py().encode()
            own = raw[start[i] : start[i] + size[i]]
            for k, at, n in split(own, int(gram[i]), length) if hot[i] else ((int(key[i]), 0, len(own)),):
                parts.setdefault(k % shards, []).append((i, int(start[i]) + at, own[at : at + n]))
        rows = []
        for s, items in parts.items():
            at = np.array([i for i, _, _ in items])
            begin, long_ = (np.array(x, np.int64) for x in zip(*((b, len(x)) for _, b, x in items)))
            rows.append((s, cid[at].tobytes(), begin.tobytes(), long_.tobytes(), need[at].tobytes(), b"".join(x for _, _, x in items)))
        del parts
        release()
        return _rows(names, rows, kinds)

    return texts.withColumn("t", _key(groups)).groupBy("t").cogroup(cuts.where("kind = 1").groupBy("t")).applyInArrow(run, "shard long, cids binary, start binary, size binary, need binary, data binary")


def repeated_starts(pieces: list[bytes], length: int) -> list[np.ndarray]:
    """For each piece the starts of strings of ``length`` bytes that occur at another start of any piece."""
    size = np.array([len(p) for p in pieces], np.int64)
    base = np.cumsum(size + 1) - size - 1
    total = int(size.sum()) + len(pieces)
    joined = b"\0".join([*pieces, bytes(8)])
    raw = np.frombuffer(joined, np.uint8)
    text = raw[:total].astype(np.int16) + np.int16(2)
    # symbol 1 after each piece, 0 at the very end
    text[base + size] = 1
    order = suffix_array(np.append(text, np.int16(0)))
    room = np.zeros(total + 1, bool)
    change = np.zeros(total + 2, np.int64)
    long_ = size >= length
    np.add.at(change, base[long_], 1)
    np.add.at(change, base[long_] + size[long_] - length + 1, -1)
    room = np.cumsum(change)[: total + 1] > 0
    order = order[room[order]]
    # the common prefix of neighbours reaches the length: eight bytes at a time, survivors only
    eight = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
    live = np.arange(len(order) - 1) if len(order) > 1 else np.zeros(0, np.int64)
    for k in [*range(0, length - 7, 8), length - 8]:
        live = live[eight[order[live] + k] == eight[order[live + 1] + k]]
    hit = np.zeros(total + 1, bool)
    hit[order[live]] = True
    hit[order[live + 1]] = True
    at = np.flatnonzero(hit)
    edges = np.searchsorted(at, np.concatenate([base, [total]]))
    return [at[edges[i] : edges[i + 1]] - base[i] for i in range(len(pieces))]


def _sorted(fetched: DataFrame, length: int, groups: int) -> DataFrame:
    """Step 3 for each shard: byte ranges that repeat."""

    def run(table: pa.Table) -> pa.Table:
        pieces, cid, start, need = [], [], [], []
        for r in table.select(["cids", "start", "size", "need", "data"]).to_pylist():
            size = np.frombuffer(r["size"], np.int64)
            ends = np.cumsum(size)
            pieces += [r["data"][a:b] for a, b in zip((ends - size).tolist(), ends.tolist())]
            cid.append(np.frombuffer(r["cids"], np.uint8).reshape(-1, 16))
            start.append(np.frombuffer(r["start"], np.int64))
            need.append(np.frombuffer(r["need"], bool))
        cid, start, need = np.concatenate(cid), np.concatenate(start), np.concatenate(need)
        found = repeated_starts(pieces, length)
        release()
        owner, a, b = [], [], []
        for i in np.flatnonzero(need):
            s = found[i]
            if len(s):
                new = np.flatnonzero(np.concatenate([[True], np.diff(s) > 1]))
                last = np.concatenate([new[1:] - 1, [len(s) - 1]])
                owner.append(np.full(len(new), i))
                a.append(s[new] + start[i])
                b.append(s[last] - s[new] + length)
        if not owner:
            return _rows(_CUT_NAMES, [], _CUT_KINDS)
        owner = np.concatenate(owner)
        return _rows(_CUT_NAMES, _pack(_target(cid[owner], groups), 0, cid[owner], np.concatenate(a), np.concatenate(b)), _CUT_KINDS)

    return fetched.groupBy("shard").applyInArrow(run, _CUTS)


def _united(cuts: DataFrame) -> DataFrame:
    """``(cid, first, last)``: the byte ranges to remove of each text, united and packed."""

    def run(table: pa.Table) -> pa.Table:
        cid, start, size, *_ = _unpack(table, 0)
        _, of = np.unique(np.ascontiguousarray(cid).view("V16").ravel(), return_inverse=True)
        order = np.lexsort((start, of))
        cid, start, end, of = cid[order], start[order], (start + size)[order], of.ravel()[order]
        edge = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        rows = []
        for x, y in zip(edge.tolist(), [*edge[1:].tolist(), len(of)]):
            a, b = start[x:y], np.maximum.accumulate(end[x:y])
            new = np.flatnonzero(np.concatenate([[True], a[1:] > b[:-1]]))
            rows.append((cid[x].tobytes(), a[new].tobytes(), b[np.concatenate([new[1:] - 1, [len(b) - 1]])].tobytes()))
        release()
        return _rows(["cid", "first", "last"], rows, [pa.binary()] * 3)

    return cuts.where("kind = 0").groupBy("t").applyInArrow(run, "cid binary, first binary, last binary")


def _cid(text_col: str):
    """Digest of a text."""
    return F.unhex(F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))


def _marked(rows: DataFrame, docs: DataFrame, text_col: str, length: int) -> DataFrame:
    """``rows``, which have the digest ``cid`` of a text of ``docs``, with ``whole, first, last``: whether
    the text goes as a whole, or the ranges that go; all null if nothing does."""
    if length < GRAM:
        raise ValueError(f"length must be at least {GRAM}")
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    light = cut(docs.select(_cid(f"`{text_col}`").alias("cid"), F.octet_length(text).alias("n")).groupBy("cid").agg(F.count("*").alias("many"), F.max("n").alias("n")))
    volume, total, most = light.agg(*(F.coalesce(x, F.lit(0)) for x in (F.sum("n"), F.sum("many"), F.max("many")))).first()
    groups = max(partitions(docs.sparkSession), math.ceil(volume / GROUP))
    # contexts take about half a byte for a byte of text
    cuts = cut(_compare(_find(_texts(docs, text_col), length, max(4, math.ceil(volume / 2 / GROUP))), length, groups))
    held = cuts.where("kind = 1").agg(F.sum("bytes")).first()[0] or 0
    done = cuts
    if held:
        fetched = _fetch(_texts(docs, text_col, _asked(cuts)), cuts, groups, math.ceil(held / SHARD), length)
        done = done.unionByName(cut(_sorted(fetched, length, groups)))
    copies = light.where((F.col("many") > 1) & (F.col("n") >= length)).select("cid", "many")
    none = F.lit(None).cast("binary")
    marks = copies.select("cid", "many", F.lit(True).alias("whole"), none.alias("first"), none.alias("last")).unionByName(
        _united(done).join(copies, "cid", "left_anti").select("cid", F.lit(1).cast("long").alias("many"), F.lit(False).alias("whole"), "first", "last")
    )
    return lookup(rows, cut(marks), ["cid"], "many", total, most, "left")


def _kept(raw: bytes, whole: bool | None, first: bytes | None, last: bytes | None) -> tuple[int, int, bytes]:
    """Removed bytes, their spans, and what is left."""
    if whole is None:
        return 0, 0, raw
    if whole:
        return len(raw), 1, b""
    a, b = np.frombuffer(first, np.int64).tolist(), np.frombuffer(last, np.int64).tolist()
    left = b"".join(raw[x:y] for x, y in zip([0, *b], [*a, len(raw)]))
    return len(raw) - len(left), len(a), left


def repeat_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)`` for every row."""
    kinds = [("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]

    def run(batches):
        for batch in batches:
            rows = []
            for text, *mark in zip(*(batch.column(k).to_pylist() for k in range(1, 5))):
                raw = (text or "").encode()
                removed, spans, left = _kept(raw, *mark)
                rows.append((len(raw), removed, spans, hashlib.sha256(left).hexdigest()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(kinds))], names=["doc_id", *(n for n, _ in kinds)])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), _cid(f"`{text_col}`").alias("cid"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return _marked(rows, docs, text_col, length).select("doc_id", "text", "whole", "first", "last").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame, text_col: str = "text", length: int = 200, length_col: str | None = None) -> DataFrame:
    """``docs`` with the repeated strings cut out of the text.

    A cut may split a character of several bytes; what is left of it goes too. A text that
    lost nothing stays as it was, null included. ``length_col``, if there, follows the text.
    """

    def run(batches):
        for batch in batches:
            texts, *marks = (batch.column(k).to_pylist() for k in range(1, 5))
            made = [None if mark[0] is None else _kept((text or "").encode(), *mark)[2].decode("utf-8", "ignore") for text, *mark in zip(texts, *marks)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string())], names=["row", "kept"])

    rows = packed(docs).withColumn("cid", _cid(f"row.`{text_col}`"))
    # only the text of a row that loses something is sent beside it
    found = _marked(rows, docs, text_col, length).withColumn("text", F.when(F.col("whole").isNotNull(), F.col(f"row.`{text_col}`").cast("string")))
    joined = found.select("row", "text", "whole", "first", "last")
    cut_ = joined.mapInArrow(run, StructType([joined.schema["row"], StructField("kept", StringType())]))
    new = {text_col: F.col("kept")} | ({length_col: F.length("kept").cast("long")} if length_col else {})
    made = {c: F.when(F.col("kept").isNotNull(), x).otherwise(F.col(f"row.`{c}`")) for c, x in new.items()}
    return unpacked(cut_, docs.columns, made).select(*(F.col(f"`{c}`") for c in docs.columns))
