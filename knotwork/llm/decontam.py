"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Every word n-gram of the test items is counted over all documents (documents that hold it).
A gram is a seed unless it is common: held by more than ``COMMON`` of the documents and also
by more than ``FACTOR`` times the item's ``HIGH`` quantile of the grams that occur at all.
Rarity is relative to the item, so an item that leaked into a third of the corpus keeps its
seeds, whole or as an edited version of which a tenth of the grams that occur is left, even
beside chance hits of the others; of fewer than ten grams none is dropped. Where a document
holds a seed, the passage around it is aligned with the item: local
alignment over words, with match 2 and mismatch and gap -1. The score is the alignment's
share of the best possible one; paraphrased or edited copies lose one to three points a word.

Items are sent to the documents, which are scanned twice (counts, then seeds with alignment)
and never shuffled. Items travel in blocks of at most ``BLOCK`` words, each of which scans
the documents again, so memory is bounded for any benchmark. Items are few and short next to
documents; the item table itself is read to the driver block by block.

Words are runs of ASCII letters and digits and all other bytes, of the lower-cased text. Items with
fewer words than a gram use all their words as one gram; null or empty items match nothing,
like null or empty documents. Repeated items and documents give a row each. Ties: of equal
alignments the first one counts. Extra columns are carried by ``clean`` and ``marked`` only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from knotwork.llm.textkernel import _P, ALNUM_SEP, mix, slices, utf8, word_hashes, words
from knotwork.storage import packed, unpacked

GRAM, COMMON, FACTOR, HIGH, BLOCK, THRESHOLD = 3, 0.001, 8, 0.9, 500_000, 0.5
#: Cells of a row of alignment tables, all pairs together.
CELLS = 1 << 20


def grams(h: np.ndarray, n: int = GRAM) -> np.ndarray:
    """Hashes of all n-grams of a vector of word hashes."""
    g = h[: max(0, len(h) - n + 1)].copy()
    for j in range(1, n):
        g = g * _P + h[j : j + len(g)]
    return mix(g)


def align(passages: list[np.ndarray], items: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment score of each pair, and where it ends in the passage.

    All pairs advance together, one item word at a time; the gap along the passage is a
    running maximum, so a row of the table is a handful of vector operations.
    """
    n = len(passages)
    width, depth = max(map(len, passages)), max(map(len, items))
    p = np.zeros((n, width), np.uint64)
    q = np.zeros((n, depth), np.uint64)
    for i, (x, y) in enumerate(zip(passages, items)):
        p[i, : len(x)], q[i, : len(y)] = x, y
    inside = np.arange(width)[None, :] < np.array([len(x) for x in passages])[:, None]
    size = np.array([len(y) for y in items])
    slope = np.arange(width + 1)
    row, best, end = np.zeros((n, width + 1), np.int32), np.zeros(n, np.int32), np.zeros(n, np.int64)
    for j in range(depth):
        live = (size > j)[:, None]
        step = np.where((p == q[:, j : j + 1]) & inside, 2, -1)
        new = np.zeros_like(row)
        new[:, 1:] = np.maximum(row[:, :-1] + step, row[:, 1:] - 1)
        np.maximum(new, 0, out=new)
        new = np.maximum.accumulate(new + slope, axis=1) - slope
        row = np.where(live, new, row).astype(np.int32)
        top = row.argmax(1)
        high = row[np.arange(n), top]
        better = high > best
        best[better], end[better] = high[better], top[better]
    return best, end


class Items:
    """A block of test items: word hashes, and where each gram occurs in which item."""

    def __init__(self, ids: list, texts: list[str], n: int = GRAM):
        data, offsets = utf8(pa.array(texts, pa.string()))
        low, starts, ends, per = words(data, offsets, ALNUM_SEP)
        h = word_hashes(low, starts, ends)
        self.ids, self.words = ids, [h[per[i] : per[i + 1]] for i in range(len(ids))]
        key, item, offset = [], [], []
        for i, w in enumerate(self.words):
            g = grams(w, min(n, max(1, len(w)))) if 0 < len(w) < n else grams(w, n)
            key.append(g)
            item.append(np.full(len(g), i))
            offset.append(np.arange(len(g)))
        key, item, offset = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (key, item, offset))
        order = np.lexsort((offset, item, key))
        self.key, self.item, self.offset = key[order].astype(np.uint64), item[order], offset[order]
        self.short = sorted({len(w) for w in self.words if 0 < len(w) < n})
        self.n = n

    def keep(self, mask: np.ndarray) -> None:
        """Leave only the occurrences in the mask."""
        self.key, self.item, self.offset = self.key[mask], self.item[mask], self.offset[mask]

    def prepare(self):
        self.unique, self.first = np.unique(self.key, return_index=True)
        self.last = np.concatenate([self.first[1:], [len(self.key)]])
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[(self.unique >> np.uint64(44)).astype(np.int64)] = True
        return self

    def hits(self, h: np.ndarray, per: np.ndarray):
        """(position, gram number) of the block's grams in documents given by word offsets."""
        out = []
        for n in [self.n, *self.short]:
            g = grams(h, n)
            some = np.flatnonzero(self.sieve[(g >> np.uint64(44)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.unique, g[some]), max(0, len(self.unique) - 1))
            some, at = (some[m], at[m]) if len(self.unique) and (m := self.unique[at] == g[some]).any() else (some[:0], at[:0])
            doc = np.searchsorted(per, some, side="right") - 1
            ok = some + n <= per[doc + 1]
            out.append((some[ok], at[ok], doc[ok]))
        return tuple(np.concatenate([x[k] for x in out]) for k in range(3))


def _document_counts(docs: DataFrame, items: Items) -> tuple[np.ndarray, int]:
    """Documents that hold each gram of the block, and the number of documents."""
    parts = (items.ids, items.unique, items.sieve, items.short, items.n)
    shared = docs.sparkSession.sparkContext.broadcast(parts)

    def run(batches):
        block = Items.__new__(Items)
        block.ids, block.unique, block.sieve, block.short, block.n = shared.value
        count, n = np.zeros(len(block.unique) + 1, np.int64), 0
        for batch in batches:
            n += batch.num_rows
            data, offsets = utf8(batch.column(0))
            for a, b in slices(offsets):
                low, starts, ends, per = words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], ALNUM_SEP)
                _, gram, doc = block.hits(word_hashes(low, starts, ends), per)
                held = np.unique(doc * (len(count) + 1) + gram) % (len(count) + 1)
                count[: len(block.unique)] += np.bincount(held, minlength=len(block.unique))
        count[-1] = n
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(count[some])], names=["gram", "n"])

    rows = docs.mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(len(items.unique) + 1, np.int64)
    out[rows["gram"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out[:-1], int(out[-1])


def _choose(items: Items, held: np.ndarray, total: int) -> None:
    """Keep the seeds."""
    of = np.searchsorted(items.unique, items.key)
    frequency = held[of]
    # grams that no document holds say nothing about how common the others are
    some = np.flatnonzero(frequency > 0)
    some = some[np.lexsort((frequency[some], items.item[some]))]
    edge = np.searchsorted(items.item[some], np.arange(len(items.ids) + 1))
    last = np.minimum(edge[:-1] + np.ceil((np.diff(edge) - 1) * HIGH).astype(np.int64), np.maximum(edge[1:] - 1, 0))
    usual = np.where(np.diff(edge) > 0, frequency[some][np.minimum(last, max(0, len(some) - 1))] if len(some) else 0, 0)
    items.keep((frequency <= COMMON * total) | (frequency <= FACTOR * usual[items.item]))
    items.prepare()


def _blocks(benchmark: DataFrame, id_col: str, text_col: str):
    """Items in blocks of at most ``BLOCK`` words (or one longer item)."""
    ids, texts, held = [], [], 0
    rows = benchmark.select(F.col(id_col).cast("long").alias("i"), F.lower(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("t")).orderBy("i", "t")
    for r in rows.toLocalIterator():
        size = len(r.t.split())
        if ids and held + size > BLOCK:
            yield Items(ids, texts)
            ids, texts, held = [], [], 0
        ids.append(r.i)
        texts.append(r.t)
        held += size
    if ids:
        yield Items(ids, texts)


_LEAK = T.ArrayType(T.StructType([T.StructField(n, T.LongType() if n != "score" else T.DoubleType()) for n in ("item_id", "score", "n_seeds", "start", "end")]))


def _seeded(docs: DataFrame, items: Items, text_col: str, threshold: float) -> DataFrame:
    """``docs`` with a column ``leaks_`` of the block's items found in each row."""
    shared = docs.sparkSession.sparkContext.broadcast({k: getattr(items, k) for k in ("ids", "words", "key", "item", "offset", "short", "n", "unique", "first", "last", "sieve")})
    kind = pa.list_(pa.struct([(n, pa.int64() if n != "score" else pa.float64()) for n in ("item_id", "score", "n_seeds", "start", "end")]))
    names = docs.columns

    def leaks(block, h, per, base, out):
        at, gram, doc = block.hits(h, per)
        if not len(at):
            return
        many = block.last[gram] - block.first[gram]
        at, doc = np.repeat(at, many), np.repeat(doc, many)
        spot = np.repeat(block.first[gram], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        item, begin = block.item[spot], at - per[doc] - block.offset[spot]
        size = np.array([len(w) for w in block.words])
        order = np.lexsort((begin, item, doc))
        doc, item, begin = doc[order], item[order], begin[order]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (np.diff(begin) > size[item[1:]])
        head = np.flatnonzero(new)
        tail = np.concatenate([head[1:], [len(doc)]])
        d, i = doc[head], item[head]
        slack = size[i] // 4 + 4
        lo = np.maximum(0, begin[head] - slack)
        hi = np.minimum(per[d + 1] - per[d], begin[tail - 1] + size[i] + slack)
        seeds = tail - head
        # an alignment of positive score spans less than three items, so a long passage is cut into
        # windows of twice that, which overlap by it
        span = 3 * size[i] + 8
        many = np.maximum(1, -(-(hi - lo - span) // span))
        d, i, seeds, span, stop = (np.repeat(x, many) for x in (d, i, seeds, span, hi))
        lo = np.repeat(lo, many) + (np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)) * span
        hi = np.minimum(lo + 2 * span, stop)
        # passages and items of similar sizes together, a bounded table at a time
        order = np.lexsort((size[i], hi - lo))
        a = 0
        while a < len(order):
            most = max(1, min(256, CELLS // int(hi[order[min(a + 255, len(order) - 1)]] - lo[order[min(a + 255, len(order) - 1)]] + 1)))
            pick = order[a : a + most]
            a += most
            passages = [h[per[x] + u : per[x] + v] for x, u, v in zip(d[pick], lo[pick], hi[pick])]
            score, end = align(passages, [block.words[x] for x in i[pick]])
            share = score / (2 * size[i[pick]])
            good = np.flatnonzero(share >= threshold)
            if not len(good):
                continue
            back = [passages[k][: end[k]][::-1] for k in good]
            _, length = align(back, [block.words[x][::-1] for x in i[pick[good]]])
            for k, n in zip(good.tolist(), length.tolist()):
                at = pick[k]
                held = out.setdefault(base + int(d[at]), {})
                row = (float(share[k]), int(seeds[at]), int(lo[at] + end[k] - n), int(lo[at] + end[k]))
                if i[at] not in held or (-held[i[at]][0], held[i[at]][2]) > (-row[0], row[2]):
                    held[i[at]] = row

    def run(batches):
        block = Items.__new__(Items)
        block.__dict__.update(shared.value)
        for batch in batches:
            data, offsets = utf8(batch.column(text_col))
            out: dict[int, dict] = {}
            for a, b in slices(offsets):
                low, starts, ends, per = words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], ALNUM_SEP)
                leaks(block, word_hashes(low, starts, ends), per, a, out)
            made = [[{"item_id": block.ids[i], "score": s, "n_seeds": n, "start": x, "end": y} for i, (s, n, x, y) in sorted(out.get(r, {}).items())] for r in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, kind)], names=[*names, "leaks_"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("leaks_", _LEAK)]))


def found(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``(row, leaks)``: every row of ``docs`` as a struct, and the items found in it, as (item_id,
    score, n_seeds, start, end) in words."""
    low = F.lower(F.col(f"`{text_col}`").cast("string")).alias("t")
    out, texts = packed(docs).withColumns({"t": F.lower(F.col(f"row.`{text_col}`").cast("string")), "leaks": F.array().cast(_LEAK)}), docs.select(low)
    for items in _blocks(benchmark, item_id, item_text):
        items.prepare()
        if not len(items.key):
            continue
        _choose(items, *_document_counts(texts, items))
        out = _seeded(out, items, "t", threshold).withColumn("leaks", F.concat("leaks", "leaks_")).drop("leaks_")
    return out.drop("t")


def marked(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` with ``leaks`` as in ``found``; a column of that name is replaced."""
    return unpacked(found(docs, benchmark, **options), docs.columns, {"leaks": F.col("leaks")})


def leak_table(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``(doc_id, item_id, score, n_seeds, start, end)``: a row for each document and item found in it."""
    text_col = options.get("text_col", "text")
    return marked(docs.select(id_col, text_col), benchmark, **options).select(F.col(id_col).alias("doc_id"), F.inline("leaks"))


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` in which no item is found."""
    return unpacked(found(docs, benchmark, **options).where(F.size("leaks") == 0), docs.columns)
