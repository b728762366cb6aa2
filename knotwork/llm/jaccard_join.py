"""N-gram Jaccard self-join with signature trees.

Two documents link when ``100 * |x & y| >= percent * |x | y|`` over their sets of word
shingles. Equal sets are one node, named by a 64-bit hash of the set, so thousands of copies
cost one node and different texts of one doc_id are different nodes.

1. *Sketches.* One pass gives every row's set size, node and token bitmap (two to four bits a
   shingle), and for each task the shingles that several of its sets hold.
2. *Routing, without loss.* Linked sets share a shingle among the first ``n - ceil(p n) + 1``
   of each in any fixed order of all shingles. The order puts shingles last that the sets of several
   tasks share, counted in a table of slots, so repeated passages route nothing unless a text has
   little else. Keys travel packed, one row for each map task and bucket. Pairs that share a key
   which few hold are compared by size and bitmap at once; those of other keys are chained in order
   of size. What is left forms coarse groups.
3. *Signature trees, on bitmaps only.* A coarse group is cut into leaves by size class and
   hash. Inner nodes carry the OR and the AND of their documents' bitmaps and their range of
   sizes; the dual traversal goes down one level a round, as a join of node pairs with node
   pages, and drops pairs whose largest possible overlap is too small. Leaf pairs that it
   leaves are screened document by document. What survives forms tight groups.
4. *Exact check.* Only documents of tight groups send their sets. Their leaves are joined with
   an incidence product: first each leaf with itself and with the first leaf of its size class
   and the next, which connects families at linear cost, then all other pairs that a second
   traversal cannot rule out and whose documents are not in one component yet.

No step holds a group of unbounded size in one task, and no link is lost.

Nulls and texts without words have an empty set and link with nothing. Repeated rows of
one doc_id yield one row each with the same values; rows without an id take part like all
others. An empty table gives no rows. Columns of the input other than the id and the text are
never read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.llm.sieve import SIEVE, sieve
from knotwork.llm.textkernel import mix, release, shingle_sets
from knotwork.operators.components import connected_components, local_forest
from knotwork.operators.skew import lookup
from knotwork.storage import Tables, cut, table

#: Shingles in a leaf of sets, and documents in one.
LEAF_VOLUME, LEAF_DOCS = 150_000, 256
#: Bits in a leaf of bitmaps, and the least that a document counts for.
LEAF_BITS, LEAST_BITS = 1 << 23, 1 << 12
#: Bits of an inner node at most, and children of one.
NODE_BITS, FAN = 1024, 64
FLUSH = 1 << 20
#: Bytes of packed keys in a bucket, about. A bucket gives one edge for each of its documents at
#: most, so buckets by volume repeat fewer edges than buckets by partitions.
BUCKET_BYTES = 24_000_000
#: Shingles that the order puts last, at most, and how many of them a task proposes. They only
#: choose the order, which is valid whatever they are.
COMMON, PROPOSED = 1 << 19, 1 << 18
#: Slots in which all shingles are counted, slots of a segment, and how often a flush names a slot
#: for one shingle at most. A slot of several sets puts its shingles behind all others.
SLOTS, SEGMENT, NAMED = 1 << 29, 1 << 22, 15
#: Bytes of packed slots that come to the driver at once.
PIECE = 1 << 23
#: Nodes of a key up to which its pairs are compared one by one.
FEW = 8


def size_classes(percent: int, top: int) -> list[int]:
    """Lower bounds of size classes such that linked sizes are in the same or the next class."""
    bounds = [1]
    while bounds[-1] <= top:
        bounds.append(bounds[-1] * 100 // percent + 1)
    return bounds


def node_name(t: np.ndarray) -> int:
    """The 64-bit name of a set."""
    one, two = (np.sum(mix(t ^ np.uint64(x)), dtype=np.uint64) for x in (0x11, 0x2222))
    return int(mix(np.array([one ^ (two << np.uint64(1)) ^ (two >> np.uint64(63)) ^ np.uint64(len(t))], np.uint64)).view(np.int64)[0])


def prefix(t: np.ndarray, percent: int, common: np.ndarray, rank: np.ndarray, full: np.ndarray | None = None) -> np.ndarray:
    """The first shingles of the sorted set ``t``: rare ones by hash, those of ``full`` slots by hash,
    then common ones by rank."""
    n = len(t)
    need = n - -(-percent * n // 100) + 1
    last = np.zeros(n, bool)
    if len(common):
        at = np.minimum(np.searchsorted(common, t), len(common) - 1)
        last = common[at] == t
    late = np.zeros(n, bool)
    if full is not None:
        slot = (t >> np.uint64(65 - (8 * len(full)).bit_length())).astype(np.int64)
        late = (full[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8) & 1).astype(bool) & ~last
    first = t[~(last | late)]
    if len(first) < need:
        first = np.concatenate([first, t[late]])
    if len(first) < need:
        first = np.concatenate([first, t[last][np.argsort(rank[at[last]])]])
    return first[:need]


def gaps(at: np.ndarray) -> bytes:
    """Ascending numbers as the bytes of their gaps, 255 for as much of a gap."""
    many, rest = np.divmod(np.diff(at, prepend=0), 255)
    out = np.full(len(at) + int(many.sum()), 255, np.uint8)
    out[np.cumsum(many + 1) - 1] = rest
    return out.tobytes()


def ungaps(packed: bytes) -> np.ndarray:
    """The numbers of ``gaps``."""
    x = np.frombuffer(packed, np.uint8)
    return np.cumsum(x, dtype=np.int64)[x != 255]


def bitmap_size(n):
    """Bits of the bitmap of a set of ``n``: a power of two, at least twice the set."""
    return np.maximum(128, 1 << (np.ceil(np.log2(np.maximum(2 * np.asarray(n), 1)))).astype(np.int64))


def bitmap(t: np.ndarray) -> np.ndarray:
    """Packed bits of a set: every bit set for x but not for y is a shingle of x that y lacks."""
    size = int(bitmap_size(len(t)))
    bits = np.zeros(size, np.uint8)
    bits[(mix(t) >> np.uint64(65 - size.bit_length())).astype(np.int64)] = 1
    return np.packbits(bits)


def fold(bits: np.ndarray, size: int) -> np.ndarray:
    """Unpacked bits (rows, any power of two) shortened to ``size`` by OR of neighbours."""
    return bits if bits.shape[-1] <= size else bits.reshape(*bits.shape[:-1], size, -1).max(-1)


def _unpack_bits(packed: bytes, sizes: np.ndarray) -> np.ndarray:
    """Bitmaps of documents of ``sizes``, unpacked and folded to the shortest of them."""
    many = bitmap_size(sizes)
    flat = np.unpackbits(np.frombuffer(packed, np.uint8))
    least = int(many.min())
    if (many == least).all():
        return flat.reshape(len(sizes), least)
    at = np.cumsum(many) - many
    return np.stack([fold(flat[a : a + m], least) for a, m in zip(at.tolist(), many.tolist())])


def linked(sets_a: list[np.ndarray], sets_b: list[np.ndarray] | None, percent: int):
    """Index pairs that link, between two lists of sets or (None) within one."""
    rows = sets_a + (sets_b or [])
    if len(rows) < 2:
        return np.zeros((0, 2), np.int64)
    size = np.array([len(x) for x in rows], np.int64)
    owner = np.repeat(np.arange(len(rows)), size)
    token, place = np.unique(np.concatenate(rows), return_inverse=True)
    often = np.bincount(place, minlength=len(token)) > 1
    number = np.cumsum(often) - 1
    keep = often[place]
    owner, place, width = owner[keep], number[place[keep]], int(often.sum())
    na = len(sets_a)
    nb = len(sets_b) if sets_b is not None else na
    common = np.zeros((na, nb), np.float32)
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    for lo in range(0, width, 8192):
        a, b = np.searchsorted(place, (lo, lo + 8192))
        block = np.zeros((len(rows), min(8192, width - lo)), np.float32)
        block[owner[a:b], place[a:b] - lo] = 1
        common += block[:na] @ (block[na:] if sets_b is not None else block).T
    both = common.astype(np.int64)
    sb = size[na:] if sets_b is not None else size
    hit = (100 * both >= percent * (size[:na, None] + sb[None, :] - both)) & (size[:na, None] > 0) & (sb[None, :] > 0)
    if sets_b is None:
        hit = np.triu(hit, 1)
    return np.argwhere(hit)


def survivors(size_a, bits_a, size_b, bits_b, percent: int) -> np.ndarray:
    """Document pairs of two leaves whose bitmaps allow a link.

    At most ``|x| - |bits of x that y lacks|`` shingles of x can be in y, and likewise for y.
    """
    width = min(bits_a.shape[1], bits_b.shape[1])
    x, y = (fold(b, width).astype(np.float32) for b in (bits_a, bits_b))
    both = x @ y.T
    most = np.minimum(size_a[:, None] - x.sum(1)[:, None] + both, size_b[None, :] - y.sum(1)[None, :] + both)
    # an overlap of o links sizes x and y only if (100 + p) o >= p (x + y)
    return (100 + percent) * most >= percent * (size_a[:, None] + size_b[None, :])


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def _edges(u: list[np.ndarray], v: list[np.ndarray]) -> pa.RecordBatch:
    """A forest of some edges as a batch."""
    none = np.zeros(0, np.int64)
    p, q = local_forest(np.concatenate([none, *u]), np.concatenate([none, *v]))
    return pa.RecordBatch.from_arrays([pa.array(p, pa.int64()), pa.array(q, pa.int64())], names=["u", "v"])


def sketches(docs: DataFrame, id_col: str, text_col: str, k: int, percent: int) -> DataFrame:
    """``(doc_id, n_shingles, node, klass, bits, common, segment, slots)``, a row for each document.

    ``common`` and ``slots`` are null there; rows with ``common`` hold packed shingles and in how many
    sets of a task each is, rows with ``slots`` the slots of a segment that the sets of a task name,
    and nothing else.
    """
    bounds = np.array(size_classes(percent, 1 << 40))
    names = ["doc_id", "n_shingles", "node", "klass", "bits", "common", "segment", "slots"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.binary()]
    none = (None,) * 5

    def run(batches):
        seen, held, tokens = set(), 0, []

        def proposed():
            token, many = np.unique(np.concatenate(tokens), return_counts=True)
            slot = np.repeat((token >> np.uint64(65 - SLOTS.bit_length())).astype(np.int64), np.minimum(many, NAMED))
            ends = np.searchsorted(slot, np.arange(0, SLOTS + 1, SEGMENT))
            slots = [(*none, None, k, gaps(slot[a:b] - k * SEGMENT)) for k, (a, b) in enumerate(zip(ends[:-1], ends[1:])) if a < b]
            top = np.argsort(-many, kind="stable")[:PROPOSED]
            top = top[many[top] > 1]
            return _batch([(*none, np.stack([token[top], many[top].astype(np.uint64)]).tobytes(), None, None), *slots], names, kinds)

        for batch in batches:
            rows = []
            for doc, t in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1), k)):
                if len(t) == 0:
                    rows.append((doc, 0, *(None,) * 6))
                    continue
                node = node_name(t)
                rows.append((doc, len(t), node, int(np.searchsorted(bounds, len(t), side="right")) - 1, bitmap(t).tobytes(), None, None, None))
                if node not in seen:
                    seen.add(node)
                    tokens.append(t)
                    held += len(t)
            yield _batch(rows, names, kinds)
            if held > 4 * FLUSH:
                yield proposed()
                seen, held, tokens = set(), 0, []
        if tokens:
            yield proposed()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_shingles long, node long, klass int, bits binary, common binary, segment int, slots binary")


def _common(sketch: DataFrame, made: Tables) -> tuple[np.ndarray, np.ndarray]:
    """The most widely shared shingles, at most ``COMMON``, sorted, and the rank of each."""

    def unpacked(batches):
        for batch in batches:
            for x in batch.column(0).to_pylist():
                token, many = np.frombuffer(x, np.uint64).reshape(2, -1).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(many)], names=["token", "many"])

    def packed(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([c.to_numpy().tobytes()], pa.binary()) for c in batch.columns], names=["token", "many"])

    every = sketch.where("common is not null").select("common").mapInArrow(unpacked, "token long, many long")
    level = F.floor(F.log2("many") * 4).cast("int").alias("level")
    counted = made.write(every.groupBy("token").agg(F.sum("many").alias("many")).select("token", "many", level))
    least, held = 1 << 20, 0
    for r in counted.groupBy("level").agg(F.count("*").alias("n")).orderBy(F.desc("level")).collect():
        held += r.n
        if held > COMMON:
            break
        least = r.level
    got = counted.where(F.col("level") >= least).select("token", "many").mapInArrow(packed, "token binary, many binary").collect()
    token, many = (np.concatenate([np.zeros(0, d), *(np.frombuffer(r[n], d) for r in got)]) for n, d in (("token", np.uint64), ("many", np.int64)))
    rank = np.empty(len(token), np.int64)
    rank[np.lexsort((token, many))] = np.arange(len(token))
    order = np.argsort(token)
    return token[order], rank[order].astype(np.int32)


def _full(sketch: DataFrame, total: int) -> np.ndarray:
    """Packed bits of the slots that sets name more often than unrelated shingles alone would.

    There are two to four slots for each of the ``total`` of shingles, but ``SLOTS`` at most. Whatever is full,
    the order is one and the same for all sets.
    """
    fewer = max(0, min(SLOTS.bit_length() - max(4 * total, 1 << 16).bit_length(), 13))
    slots, segment = SLOTS >> fewer, SEGMENT >> fewer
    # the least number, three at least, that one shingle in four at most meets with strangers in its slot
    many, mean = 3, total / slots
    while many < NAMED and sum(math.exp(-mean) * mean**k / math.factorial(k) for k in range(many - 1)) < 0.75:
        many += 1

    def run(table: pa.Table) -> pa.Table:
        seen, parts, held = np.zeros(segment, np.int64), [], 0
        for x in [*table.column("slots"), None]:
            if x is not None:
                parts.append(ungaps(x.as_py()) >> fewer)
                held += len(parts[-1])
            if parts and (x is None or held > segment):
                seen += np.bincount(np.concatenate(parts), minlength=segment)
                parts, held = [], 0
        out = pa.table([table.column("segment").slice(0, 1).combine_chunks(), pa.array([np.packbits(seen >= many).tobytes()], pa.binary())], names=["segment", "bits"])
        release()
        return out

    full = np.zeros(slots // 8, np.uint8)
    step = max(1, PIECE // (segment // 8))
    counted = sketch.where("slots is not null").select("segment", "slots").groupBy("segment").applyInArrow(run, "segment int, bits binary")
    with Tables(sketch.sparkSession) as made:
        if step < slots // segment:
            counted = made.write(counted)
        for k in range(0, slots // segment, step):
            for r in counted.where(F.col("segment").between(k, k + step - 1)).collect():
                full[r.segment * segment // 8 : (r.segment + 1) * segment // 8] = np.frombuffer(r.bits, np.uint8)
    return full


def _routed(texts: DataFrame, k: int, percent: int, buckets: int, shared: Broadcast) -> DataFrame:
    """Packed keys: ``(bucket, ids, sizes, keys, owner)``; equal sets of one task are sent once.

    ``shared`` holds what ``prefix`` needs of the order.
    """
    names, kinds = ["bucket", "ids", "sizes", "keys", "owner"], [pa.int32(), *(pa.binary(),) * 4]

    def run(batches):
        seen, keys, owner, ids, sizes, held = set(), [], [], [], [], 0

        def flush():
            key, who, name, size = np.concatenate(keys), np.concatenate(owner), np.array(ids, np.int64), np.array(sizes, np.int64)
            bucket = (key % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            key, who, bucket = key[order], who[order], bucket[order]
            ends = np.searchsorted(bucket, np.arange(buckets + 1))
            rows = []
            for b in np.flatnonzero(ends[1:] > ends[:-1]):
                s = slice(ends[b], ends[b + 1])
                used, local = np.unique(who[s], return_inverse=True)
                rows.append((int(b), name[used].tobytes(), size[used].tobytes(), key[s].tobytes(), local.astype(np.uint32).tobytes()))
            return _batch(rows, names, kinds)

        for batch in batches:
            for t in shingle_sets(batch.column(0), k):
                if len(t) == 0:
                    continue
                node = node_name(t)
                if node in seen:
                    continue
                seen.add(node)
                x = mix(prefix(t, percent, *shared.value) ^ np.uint64(0x5EED))
                keys.append(x)
                owner.append(np.full(len(x), len(ids)))
                ids.append(node)
                sizes.append(len(t))
                held += len(x)
                if held >= FLUSH:
                    yield flush()
                    keys, owner, ids, sizes, held = [], [], [], [], 0
                if len(seen) > 1 << 17:
                    seen.clear()
        if keys:
            yield flush()

    return texts.mapInArrow(run, "bucket int, ids binary, sizes binary, keys binary, owner binary")


def _coarse_edges(packed: DataFrame, percent: int) -> DataFrame:
    """``(u, v, many)``: nodes that share a key and whose sizes allow a link.

    Of keys that at most ``FEW`` nodes hold, every such pair; of others, with ``many``, a chain through
    the nodes in order of size, which breaks where a size is too far from the next.
    """
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("many", pa.bool_())])

    def run(table: pa.Table) -> pa.Table:
        keys = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("keys")])
        names = [np.frombuffer(x.as_buffer(), np.int64) for x in table.column("ids")]
        every, first = np.unique(np.concatenate(names), return_index=True)
        size = np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in table.column("sizes")])[first]
        place = [np.searchsorted(every, x).astype(np.uint32) for x in names]
        docs = np.concatenate([p[np.frombuffer(o.as_buffer(), np.uint32)] for p, o in zip(place, table.column("owner"))])
        order = np.argsort(keys, kind="stable")
        keys, docs = keys[order], docs[order]
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        start = np.flatnonzero(new)
        held = np.diff(np.append(start, len(docs)))
        del order, keys, new
        # what shares its key, by key and size
        several = np.repeat(held > 1, held)
        docs, held = docs[several], held[held > 1]
        group = np.repeat(np.arange(len(held)), held)
        docs = docs[np.lexsort((docs, size[docs], group))]

        def pairs(step: int, which: np.ndarray) -> np.ndarray:
            i = np.flatnonzero((group[:-step] == group[step:]) & which[group[step:]])
            a, b = docs[i].astype(np.uint64), docs[i + step].astype(np.uint64)
            ok = (a != b) & (100 * size[docs[i]] >= percent * size[docs[i + step]])
            return np.minimum(a, b)[ok] << np.uint64(32) | np.maximum(a, b)[ok]

        ends = lambda pair: (every[(pair >> np.uint64(32)).astype(np.int64)], every[(pair & np.uint64(0xFFFFFFFF)).astype(np.int64)])
        some = np.unique(np.concatenate([np.zeros(0, np.uint64), *(pairs(k, held <= FEW) for k in range(1, FEW))]))
        chain = _edges(*([x] for x in ends(np.unique(pairs(1, held > FEW)))))
        u, v = ends(some)
        out = pa.concat_tables([pa.table([pa.array(u), pa.array(v), pa.array(np.zeros(len(u), bool))], schema=schema), pa.Table.from_batches([chain]).append_column("many", pa.array(np.ones(len(chain), bool)))])
        release()
        return out

    return packed.groupBy("bucket").applyInArrow(run, "u long, v long, many boolean")


def _compared(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(u, v)`` whose bitmaps allow a link, of ``nodes(node, n, bits)``."""
    side = lambda s: nodes.select(F.col("node").alias(s), F.col("n").alias(f"n{s}"), F.col("bits").alias(f"bits{s}"))

    def run(batches):
        def one(n, bits):
            return np.array([n]), np.unpackbits(np.frombuffer(bits, np.uint8))[None]

        for batch in batches:
            keep = [bool(survivors(*one(r["nu"], r["bitsu"]), *one(r["nv"], r["bitsv"]), percent).any()) for r in batch.to_pylist()]
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("u", "v").distinct().join(side("u"), "u").join(side("v"), "v").mapInArrow(run, "u long, v long")


def _leaves(members: DataFrame, weight, limit: int) -> DataFrame:
    """``members(node, comp, n, klass, ...)`` with ``klass`` and ``leaf``.

    A group below the limit is one leaf of class -1. In others every size class has as many
    leaves as its weight asks for, and a hash of the node chooses one.
    """
    sizes = members.groupBy("comp", "klass").agg(F.sum(weight).alias("w"), F.count("*").alias("many")).cache()
    try:
        whole = sizes.groupBy("comp").agg(F.sum("w").alias("all_w"))
        total, most = sizes.agg(F.coalesce(F.sum("many"), F.lit(0)), F.coalesce(F.max("many"), F.lit(0))).first()
        small, large = whole.where(F.col("all_w") <= limit), whole.where(F.col("all_w") > limit)
        per = cut(sizes.join(large.select("comp"), "comp", "left_semi").select("comp", "klass", F.ceil(F.col("w") / limit).cast("long").alias("leaves"), "many"))
        few = cut(small.select("comp"))
    finally:
        sizes.unpersist()
    one = members.join(few, "comp", "left_semi").withColumns({"klass": F.lit(-1), "leaf": F.lit(0).cast("long")})
    several = lookup(members, per, ["comp", "klass"], "many", total, most)
    several = several.withColumn("leaf", F.pmod(F.xxhash64("node"), "leaves")).drop("leaves")
    return one.unionByName(several.select(one.columns))


_LEAF = "comp long, klass int, leaf long, lo long, hi long, any binary, all binary, ids binary, sizes binary, bits binary"
_LEAF_SCHEMA = pa.schema([("comp", pa.int64()), ("klass", pa.int32()), ("leaf", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), *((n, pa.binary()) for n in ("any", "all", "ids", "sizes", "bits"))])
_PLACE = ("comp", "klass", "leaf")


def _leaf_row(place: tuple, ids: np.ndarray, sizes: np.ndarray, maps: list[bytes]) -> tuple:
    """One leaf of bitmaps, its documents in order of size."""
    order = np.lexsort((ids, sizes))
    ids, sizes, packed = ids[order], sizes[order], b"".join(maps[i] for i in order)
    bits = fold(_unpack_bits(packed, sizes), NODE_BITS)
    return (*place, int(sizes[0]), int(sizes[-1]), np.packbits(bits.max(0)).tobytes(), np.packbits(bits.min(0)).tobytes(), ids.tobytes(), sizes.tobytes(), packed)


def _sketch_leaves(members: DataFrame) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        place = tuple(table.column(c)[0].as_py() for c in _PLACE)
        ids, first = np.unique(table.column("node").to_numpy(), return_index=True)
        maps = table.column("bits").to_pylist()
        row = _leaf_row(place, ids, table.column("n").to_numpy()[first], [maps[i] for i in first])
        return pa.table([pa.array([x], f.type) for x, f in zip(row, _LEAF_SCHEMA)], schema=_LEAF_SCHEMA)

    return members.select(*_PLACE, "node", "n", "bits").groupBy(*_PLACE).applyInArrow(run, _LEAF)


def _set_leaves(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Leaves with the sets of their documents, in ``tokens``."""
    schema = _LEAF_SCHEMA.append(pa.field("tokens", pa.binary()))

    def run(table: pa.Table) -> pa.Table:
        place = tuple(table.column(c)[0].as_py() for c in _PLACE)
        ids, first = np.unique(table.column("node").to_numpy(), return_index=True)
        packed = table.column("tokens")
        rows = [np.frombuffer(packed[int(i)].as_py(), np.uint64) for i in first]
        sizes = np.array([len(t) for t in rows], np.int64)
        order = np.lexsort((ids, sizes))
        row = (*_leaf_row(place, ids, sizes, [bitmap(t).tobytes() for t in rows]), b"".join(rows[i].tobytes() for i in order))
        return pa.table([pa.array([x], f.type) for x, f in zip(row, schema)], schema=schema)

    rows = members.select(*_PLACE, "node").join(sets, "node")
    return rows.groupBy(*_PLACE).applyInArrow(run, _LEAF + ", tokens binary")


def _fits(a, b, percent: int) -> np.ndarray:
    """Which children of two pages may hold a link; for x below A and y below B the overlap is at
    most hi(A) - |all(A) - any(B)|, and likewise from B."""
    lo_a, hi_a, any_a, all_a, label_a = a
    lo_b, hi_b, any_b, all_b, label_b = b
    width = min(any_a.shape[1], any_b.shape[1])
    # a bit that all documents hold is, shortened, still a bit that all of them hold
    any_a, any_b, all_a, all_b = (fold(x, width).astype(np.float32) for x in (any_a, any_b, all_a, all_b))
    only_a = all_a.sum(1)[:, None] - all_a @ any_b.T
    only_b = all_b.sum(1)[None, :] - any_a @ all_b.T
    most = np.minimum(hi_a[:, None] - only_a, hi_b[None, :] - only_b)
    ok = (100 + percent) * most >= percent * (lo_a[:, None] + lo_b[None, :])
    ok &= (100 * hi_a[:, None] >= percent * lo_b[None, :]) & (100 * hi_b[None, :] >= percent * lo_a[:, None])
    return ok & ((label_a[:, None] != label_b[None, :]) | (label_a[:, None] == 0))


_PAGE = "comp long, klass int, page long, kids binary, lows binary, highs binary, anys binary, alls binary, labels binary, width int, lo long, hi long, any binary, all binary, label long"
_PAGE_SCHEMA = pa.schema([("comp", pa.int64()), ("klass", pa.int32()), ("page", pa.int64()), *((n, pa.binary()) for n in ("kids", "lows", "highs", "anys", "alls", "labels")), ("width", pa.int32()), ("lo", pa.int64()), ("hi", pa.int64()), ("any", pa.binary()), ("all", pa.binary()), ("label", pa.int64())])


def _pages(nodes: DataFrame) -> DataFrame:
    """Inner nodes over ``nodes(comp, klass, kid, lo, hi, any, all, label)``, ``FAN`` children each.

    ``label`` is the component of all documents below, 0 when they are in several or in none.
    """

    def run(table: pa.Table) -> pa.Table:
        rows = table.sort_by("kid").to_pylist()
        anys, alls = ([np.unpackbits(np.frombuffer(r[c], np.uint8)) for r in rows] for c in ("any", "all"))
        width = min(len(x) for x in anys)
        any_, all_ = (np.stack([fold(x, width) for x in y]) for y in (anys, alls))
        lo, hi, label = (np.array([r[c] for r in rows], np.int64) for c in ("lo", "hi", "label"))
        row = (
            rows[0]["comp"], rows[0]["klass"], rows[0]["page"], np.array([r["kid"] for r in rows], np.int64).tobytes(), lo.tobytes(), hi.tobytes(), np.packbits(any_).tobytes(), np.packbits(all_).tobytes(), label.tobytes(),
            width, int(lo.min()), int(hi.max()), np.packbits(any_.max(0)).tobytes(), np.packbits(all_.min(0)).tobytes(), int(label[0]) if (label == label[0]).all() else 0,
        )
        return pa.table([pa.array([x], f.type) for x, f in zip(row, _PAGE_SCHEMA)], schema=_PAGE_SCHEMA)

    return nodes.withColumn("page", F.floor(F.col("kid") / FAN)).groupBy("comp", "klass", "page").applyInArrow(run, _PAGE)


_PAIR = "comp long, ka int, a long, kb int, b long"


def tree_pairs(nodes: DataFrame, percent: int, made: Tables) -> DataFrame:
    """Leaf pairs ``(comp, ka, a, kb, b)`` that the dual traversal leaves, no leaf with itself.

    ``nodes`` are leaves as in ``_pages``. The trees of two size classes of a group meet at
    their roots if linked sizes can lie in both; a round joins the pairs left with their pages
    and tests all pairs of children.
    """
    top = nodes.agg(F.max("leaf")).first()[0]
    levels, at = [], nodes.withColumnRenamed("leaf", "kid")
    while True:
        levels.append(made.write(_pages(at)))
        top //= FAN
        if top == 0:
            break
        at = levels[-1].select("comp", "klass", F.col("page").alias("kid"), "lo", "hi", "any", "all", "label")

    def run_at(bottom: bool):
        cols = ("kids", "lows", "highs", "anys", "alls", "labels")

        def side(r, s):
            kids, lo, hi, label = (np.frombuffer(r[f"{s}_{c}"], np.int64) for c in ("kids", "lows", "highs", "labels"))
            bits = [np.unpackbits(np.frombuffer(r[f"{s}_{c}"], np.uint8)).reshape(len(kids), r[f"{s}_width"]) for c in ("anys", "alls")]
            return kids, (lo, hi, *bits, label)

        def run(batches):
            for batch in batches:
                out = []
                for r in batch.to_pylist():
                    (ids_a, a), (ids_b, b) = side(r, "a"), side(r, "b")
                    ok = _fits(a, b, percent)
                    if (r["ka"], r["a"]) == (r["kb"], r["b"]):
                        ok = np.triu(ok, 1 if bottom else 0)
                    out += [(r["comp"], r["ka"], x, r["kb"], y) for x, y in zip(*(z.tolist() for z in (ids_a[np.nonzero(ok)[0]], ids_b[np.nonzero(ok)[1]])))]
                yield _batch(out, ["comp", "ka", "a", "kb", "b"], [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()])

        return run, (*cols, "width")

    roots = levels[-1].select("comp", "klass")
    near = roots.select("comp", F.col("klass").alias("ka"), F.explode(F.array(F.col("klass"), F.col("klass") + 1)).alias("klass"))
    pairs = near.join(roots, ["comp", "klass"]).select("comp", "ka", F.lit(0).cast("long").alias("a"), F.col("klass").alias("kb"), F.lit(0).cast("long").alias("b"))
    for depth in range(len(levels) - 1, -1, -1):
        run, cols = run_at(depth == 0)
        side = lambda s: levels[depth].select("comp", F.col("klass").alias(f"k{s}"), F.col("page").alias(s), *(F.col(c).alias(f"{s}_{c}") for c in cols))  # noqa: E731, B023
        rows = pairs.join(side("a"), ["comp", "ka", "a"]).join(side("b"), ["comp", "kb", "b"])
        pairs = made.write(rows.mapInArrow(run, _PAIR))
    return pairs


def _beside(pairs: DataFrame, leaves: DataFrame, cols: tuple[str, ...]) -> DataFrame:
    """Leaf pairs with columns of both leaves."""
    side = lambda s: leaves.select("comp", F.col("klass").alias(f"k{s}"), F.col("leaf").alias(s), *(F.col(c).alias(f"{s}_{c}") for c in cols))
    return pairs.join(side("a"), ["comp", "ka", "a"]).join(side("b"), ["comp", "kb", "b"])


def _allowed(ids_a, size_a, bits_a, ids_b, size_b, bits_b, percent: int, own: bool, step: int = 256):
    """Ends of the document pairs that bitmaps allow, a strip of the table at a time."""
    u, v = [], []
    for k in range(0, len(ids_a), step):
        strip = slice(k, k + step)
        i, j = np.nonzero(survivors(size_a[strip], bits_a[strip], size_b, bits_b, percent))
        if own:
            i, j = i[i + k < j], j[i + k < j]
        u.append(ids_a[strip][i])
        v.append(ids_b[j])
        if sum(map(len, u)) > 1 << 20:
            p, q = local_forest(np.concatenate(u), np.concatenate(v))
            u, v = [p], [q]
    return u, v


def _screened(leaves: DataFrame, pairs: DataFrame | None, percent: int) -> DataFrame:
    """A forest of the document pairs that bitmaps allow, within each leaf and between the pairs."""

    def side(r, s):
        sizes = np.frombuffer(r[f"{s}sizes"], np.int64)
        return np.frombuffer(r[f"{s}ids"], np.int64), sizes, _unpack_bits(r[f"{s}bits"], sizes)

    def within(batches):
        for batch in batches:
            u, v = [], []
            for r in batch.to_pylist():
                mine = side(r, "")
                p, q = _allowed(*mine, *mine, percent, True)
                u += p
                v += q
            yield _edges(u, v)

    def between(batches):
        for batch in batches:
            u, v = [], []
            for r in batch.to_pylist():
                p, q = _allowed(*side(r, "a_"), *side(r, "b_"), percent, False)
                u += p
                v += q
            yield _edges(u, v)

    out = leaves.select("ids", "sizes", "bits").mapInArrow(within, "u long, v long")
    if pairs is None:
        return out
    return out.unionByName(_beside(pairs, leaves, ("ids", "sizes", "bits")).mapInArrow(between, "u long, v long"))


def _sets(texts: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """``(node, tokens)`` of the nodes, and of rows that pass the filter by chance."""
    shared = texts.sparkSession.sparkContext.broadcast(sieve(nodes.select(F.pmod("node", F.lit(SIEVE)).alias("bit"))))

    def run(batches):
        seen, held = set(), shared.value
        for batch in batches:
            rows = []
            for t in shingle_sets(batch.column(0), k):
                if len(t) == 0:
                    continue
                node = node_name(t)
                at = node % SIEVE
                if held[at >> 3] >> (7 - (at & 7)) & 1 and node not in seen:
                    seen.add(node)
                    rows.append((node, t.tobytes()))
            if len(seen) > 1 << 17:
                seen.clear()
            yield _batch(rows, ["node", "tokens"], [pa.int64(), pa.binary()])

    return texts.mapInArrow(run, "node long, tokens binary")


def _check(leaves: DataFrame, pairs: DataFrame | None, percent: int) -> DataFrame:
    """Exact links as a forest, within each leaf (no pairs given) or between the pairs."""

    def side(r, s):
        sizes = np.frombuffer(r[f"{s}sizes"], np.int64)
        return np.frombuffer(r[f"{s}ids"], np.int64), np.split(np.frombuffer(r[f"{s}tokens"], np.uint64), np.cumsum(sizes)[:-1])

    alone = pairs is None

    def run(batches):
        for batch in batches:
            u, v = [], []
            for r in batch.to_pylist():
                ids_a, a = side(r, "" if alone else "a_")
                ids_b, b = (ids_a, None) if alone else side(r, "b_")
                at = linked(a, b, percent)
                u.append(ids_a[at[:, 0]])
                v.append(ids_b[at[:, 1]])
            yield _edges(u, v)

    cols = ("ids", "sizes", "tokens")
    rows = leaves.select(*cols) if pairs is None else _beside(pairs, leaves, cols).drop("comp", "ka", "a", "kb", "b")
    return rows.mapInArrow(run, "u long, v long")


def _labels(leaves: DataFrame, comps: DataFrame, made: Tables) -> DataFrame:
    """``(comp, klass, leaf, labels, label)``: the component of each document of a leaf, 0 for
    none, in the order of its ids, and that of all of them or 0."""

    def ids(batches):
        for batch in batches:
            parts = [np.frombuffer(x, np.int64) for x in batch.column("ids").to_pylist()]
            many = [len(x) for x in parts]
            flat = [np.repeat(batch.column(c).to_numpy(), many) for c in _PLACE]
            place = np.concatenate([np.arange(n) for n in many] or [np.zeros(0, np.int64)])
            yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in flat), pa.array(place), pa.array(np.concatenate([np.zeros(0, np.int64), *parts]))], names=[*_PLACE, "place", "node"])

    flat = leaves.select(*_PLACE, "ids").mapInArrow(ids, "comp long, klass int, leaf long, place long, node long")
    found = comps.select("node", F.when(F.col("comp") == 0, F.lit(1)).otherwise(F.col("comp")).alias("at"))
    each = flat.join(found, "node", "left").withColumn("at", F.coalesce("at", F.lit(0)))
    return made.write(
        each.groupBy(*_PLACE)
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "at"))), lambda x: x["at"]).alias("labels"))
        .withColumn("label", F.when(F.array_min("labels") == F.array_max("labels"), F.element_at("labels", 1)).otherwise(F.lit(0)))
    )


def _open(pairs: DataFrame, leaves: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """The leaf pairs with two documents, not of one component yet, whose bitmaps allow a link."""

    def run(batches):
        def side(r, s):
            sizes, label = np.frombuffer(r[f"{s}_sizes"], np.int64), np.array(r[f"{s}_labels"], np.int64)
            return (sizes, _unpack_bits(r[f"{s}_bits"], sizes)), label

        for batch in batches:
            keep = []
            for r in batch.to_pylist():
                (a, p), (b, q) = side(r, "a"), side(r, "b")
                keep.append(bool((survivors(*a, *b, percent) & ((p[:, None] != q[None, :]) | (p[:, None] == 0))).any()))
            yield batch.select(["comp", "ka", "a", "kb", "b"]).filter(pa.array(keep, pa.bool_()))

    held = leaves.select(*_PLACE, "sizes", "bits").join(labels.select(*_PLACE, "labels"), list(_PLACE))
    return _beside(pairs, held, ("sizes", "bits", "labels")).mapInArrow(run, _PAIR)


def _tight(members: DataFrame, percent: int, made: Tables) -> DataFrame:
    """``(node, comp)``: coarse groups broken up by what bitmaps allow."""
    weight = F.greatest(F.length("bits") * 8, F.lit(LEAST_BITS))
    leaves = made.write(_sketch_leaves(_leaves(members, weight, LEAF_BITS)))
    wide = leaves.where("klass >= 0")
    pairs = None
    if not wide.isEmpty():
        pairs = tree_pairs(wide.select(*_PLACE, "lo", "hi", "any", "all", F.lit(0).cast("long").alias("label")), percent, made)
    return connected_components(_screened(leaves, pairs, percent))


def _links(members: DataFrame, texts: DataFrame, k: int, percent: int, made: Tables) -> DataFrame:
    """``(node, comp)``: components of the exact links of the tight groups."""
    weight = F.greatest("n", F.lit(LEAF_VOLUME // LEAF_DOCS))
    placed = _leaves(members, weight, LEAF_VOLUME)
    leaves = made.write(_set_leaves(placed, _sets(texts, members, k)))
    found, wide = _check(leaves, None, percent), leaves.where("klass >= 0")
    if wide.isEmpty():
        return connected_components(found)
    heads = wide.where("leaf = 0").select("comp", "klass")
    first = F.struct(F.col("klass").alias("ka"), F.lit(0).cast("long").alias("a"), F.col("klass").alias("kb"), F.col("leaf").alias("b"))
    after = F.struct(F.col("klass").alias("ka"), F.col("leaf").alias("a"), (F.col("klass") + 1).alias("kb"), F.lit(0).cast("long").alias("b"))
    near = wide.select("comp", F.explode(F.array(first, after)).alias("p")).select("comp", "p.*").where("not (ka = kb and a = b)")
    near = made.write(near.join(heads.select("comp", F.col("klass").alias("kb")), ["comp", "kb"], "left_semi").select("comp", "ka", "a", "kb", "b"))
    found = made.write(found.unionByName(_check(leaves, near, percent)))
    labels = _labels(wide, connected_components(found), made)
    nodes = wide.select(*_PLACE, "lo", "hi", "any", "all").join(labels.select(*_PLACE, "label"), list(_PLACE))
    rest = tree_pairs(nodes, percent, made).join(near, ["comp", "ka", "a", "kb", "b"], "left_anti")
    rest = made.write(_open(rest, wide, labels, percent))
    return connected_components(found.unionByName(_check(leaves, rest, percent)))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, percent: int = 85) -> DataFrame:
    """``(doc_id, n_shingles, component_id)``, a row for each row.

    ``component_id`` is the smallest doc_id that links reach, the document included; null only
    where all of them are.
    """
    return set_components(docs, id_col, text_col, k, percent).select("doc_id", "n_shingles", "component_id")


def set_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, percent: int = 85) -> DataFrame:
    """``(doc_id, n_shingles, node, comp, component_id)``, a row for each row.

    ``node`` names the set and ``comp`` its component; both are null for empty sets.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    sketch = table(sketches(docs, id_col, text_col, k, percent))
    rows = sketch.where("n_shingles is not null").select("doc_id", "n_shingles", "node")
    with Tables(spark) as made:
        every = sketch.where("node is not null").select("node", F.col("n_shingles").alias("n"), "klass", "bits")
        # a set sends 1 - p of its shingles, of 12 bytes
        total = every.agg(F.sum("n")).first()[0] or 0
        volume = total * 12 * (100 - percent) // 100
        nodes = made.write(every.dropDuplicates(["node"]))
        shared = spark.sparkContext.broadcast((*_common(sketch, made), _full(sketch, total)))
        edges = made.write(_coarse_edges(_routed(texts, k, percent, max(2, volume // BUCKET_BYTES), shared), percent))
        # dozens of megabytes, of which the driver would hold a copy to the end
        shared.destroy()
        coarse = connected_components(edges.where("many").select("u", "v").unionByName(_compared(edges.where("not many"), nodes, percent)))
        tight = _tight(nodes.join(coarse, "node"), percent, made)
        members = made.write(nodes.select("node", "n", "klass").join(tight, "node"))
        comps = cut(_links(members, texts, k, percent, made))
    # copies are counted at the node first, then nodes at the component; hot ones are split
    nodes = cut(
        rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("low"), F.count("*").alias("many")).join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    )
    low = cut(nodes.groupBy("comp").agg(F.min("low").alias("component_id"), F.count("*").alias("nodes")))
    distinct, total, copies = nodes.agg(F.count("*"), F.coalesce(F.sum("many"), F.lit(0)), F.coalesce(F.max("many"), F.lit(0))).first()
    named = lookup(nodes.select("node", "comp", "many"), low, ["comp"], "nodes", distinct, low.agg(F.max("nodes")).first()[0] or 0)
    full = lookup(rows.where("node is not null"), named, ["node"], "many", total, copies).select("doc_id", "n_shingles", "node", "comp", "component_id")
    none = F.lit(None).cast("long")
    return full.unionByName(rows.where("node is null").select("doc_id", "n_shingles", none.alias("node"), none.alias("comp"), F.col("doc_id").alias("component_id")))
