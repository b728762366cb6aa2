"""Near duplicates among vectors by product quantisation.

Vectors of unit length with a cosine of at least ``least`` are at most ``sqrt(2 - 2 * least)`` apart,
so all pruning is by distances and the triangle inequality. A model fitted on a bounded sample
has coarse centroids and, for the residuals, a codebook for each of ``SUBSPACES`` subspaces; every
vector is indexed.

- The inverted list of a vector is that of its nearest centroid, of one label. Its entry is the code
  of its residual and the error of that code.
- A vector asks its own list and every list whose border (the plane halfway between the two
  centroids) is within ``reach``. With ``reach`` equal to the distance, no link can be missed. The
  default is the distance times four over the root of the dimension: the part of a difference of
  that length that points at a border is larger than that only by a rare chance.
- Where a list is asked, a table of the squared distances of the asker's residual to every code
  word gives the distance to each entry by lookups (asymmetric: the asker is not quantised). An entry
  that is further away than the distance and its own error cannot be a link. What is left is
  compared by its exact cosine in double precision, so no pair below the threshold is linked.

A list's core are the entries within half of the distance of the centroid. They are all linked with
each other, so they are counted and chained without being compared, and a dense group, to which
the fit gives a centroid of its own, costs no pairs. What is left of a list and those who ask it are
dealt over blocks of at most ``BLOCK`` rows each, and every two blocks meet in a task of their own. A
pair that would meet in two lists counts in the one of the smaller number. A task returns sums and
the spanning forest of its links, never pairs.

Equal vectors of a label are one entry with a count. Vectors that are null, empty or zero, hold a
null or a non-finite component or have no label link with nothing, and so do vectors of different
lengths. Rows with a null id are counted as links like all others, but a component is named by its
smallest id that is not null; one without any has a null name. An empty table gives no rows. Other
columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.operators.components import connected_components, local_forest
from knotwork.operators.skew import lookup
from knotwork.storage import Tables, cut

#: Vectors that the model is fitted on at most, and their bytes at most.
SAMPLE, SAMPLE_BYTES = 8192, 64_000_000
#: Entries of a list that the number of centroids aims at, and the most centroids.
ENTRIES, CENTROIDS = 512, 4096
SUBSPACES, WORDS = 8, 256
#: Rows of a block of entries, and of a block of askers.
BLOCK = 2048
#: Allowance for rounding in distances that only prune.
SLACK = 1e-4


@dataclass
class Codec:
    """Coarse centroids, a codebook of each subspace, and the two distances."""

    centroids: np.ndarray
    books: list[np.ndarray]
    distance: float
    reach: float

    def splits(self) -> list[slice]:
        ends = np.cumsum([0, *(b.shape[1] for b in self.books)])
        return [slice(a, b) for a, b in zip(ends, ends[1:])]

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, distance to its centroid, and which lists each vector asks besides its own."""
        square = np.maximum(_squares(x, self.centroids), 0)
        rows, own = np.arange(len(x)), square.argmin(1)
        apart = 2 * np.sqrt(np.maximum(_squares(self.centroids, self.centroids), 1e-18))
        asks = square - square[rows, own][:, None] <= apart[own] * self.reach
        asks[rows, own] = False
        return own, np.sqrt(square[rows, own]), asks

    def encode(self, residual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Code of each residual, and how far the code is from it."""
        code, left = np.zeros((len(residual), len(self.books)), np.uint8), residual.copy()
        for m, (part, book) in enumerate(zip(self.splits(), self.books)):
            code[:, m] = _squares(residual[:, part], book).argmin(1)
            left[:, part] -= book[code[:, m]]
        return code, np.sqrt((left**2).sum(1))

    def tables(self, residual: np.ndarray) -> np.ndarray:
        """Squared distance of each part of each residual to every word: (asker, subspace, word)."""
        out = np.full((len(residual), len(self.books), WORDS), np.inf, np.float32)
        for m, (part, book) in enumerate(zip(self.splits(), self.books)):
            out[:, m, : len(book)] = _squares(residual[:, part], book)
        return out


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of ``a`` to those of ``b``."""
    return (a**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * a @ b.T


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision, without overflow."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x**2).sum(1, keepdims=True))


def _means(x: np.ndarray, start: np.ndarray, rounds: int) -> np.ndarray:
    """Lloyd's rounds from some centroids; an empty one stays."""
    now = start.copy()
    for _ in range(rounds):
        own = _squares(x, now).argmin(1)
        many = np.bincount(own, minlength=len(now))
        sums = np.stack([np.bincount(own, x[:, k], len(now)) for k in range(x.shape[1])], 1)
        now[many > 0] = sums[many > 0] / many[many > 0][:, None]
    return now


def fit(sample: np.ndarray, lists: int, distance: float, reach: float) -> Codec:
    """A model of about ``lists`` centroids from unit vectors.

    Dense spots of the sample come first: the mean of what is near each. The others are vectors
    well apart from them and each other, moved by two rounds of Lloyd.
    """
    apart = 1.6 * distance
    some = sample[:2048]
    near = (_squares(some, some) <= (distance / 2) ** 2).sum(1)
    dense: list[np.ndarray] = []
    for i in np.argsort(-near, kind="stable"):
        if near[i] < 8 or len(dense) >= CENTROIDS // 2:
            break
        if not dense or _squares(some[i : i + 1], np.stack(dense)).min() > apart**2:
            dense.append(some[_squares(some, some[i : i + 1])[:, 0] <= distance**2].mean(0))
    others: list[np.ndarray] = []
    for x in sample:
        if len(others) >= max(0, min(lists, CENTROIDS) - len(dense)):
            break
        if not dense + others or _squares(x[None], np.stack(dense + others)).min() > apart**2:
            others.append(x)
    centroids = np.stack(dense + others or [np.zeros(sample.shape[1])])
    if others:
        centroids[len(dense) :] = _means(sample, centroids, 2)[len(dense) :]
    residual = sample - centroids[_squares(sample, centroids).argmin(1)]
    rng, books = np.random.default_rng(3), []
    for part in np.array_split(np.arange(sample.shape[1]), min(SUBSPACES, sample.shape[1])):
        x = residual[:, part]
        books.append(_means(x, x[rng.permutation(len(x))[:WORDS]], 6))
    return Codec(centroids, books, distance, reach)


def _matrix(column, width: int, dtype) -> np.ndarray:
    """Vectors of a binary column, shorter ones padded with zeros."""
    cells = column.to_pylist()
    size = np.dtype(dtype).itemsize * width
    return np.frombuffer(b"".join(c.ljust(size, b"\0") for c in cells), dtype).reshape(len(cells), width)


def _raw(column, dtype) -> list[bytes]:
    return [np.asarray(v, dtype).tobytes() for v in column.to_pylist()]


_INDEX = "g string, rid long, w long, own int, core boolean, code binary, err double, asks array<int>, vec binary"


def index(nodes: DataFrame, codec: Codec, width: int, dtype) -> DataFrame:
    """The entry of every node ``(g, rid, w, vec)``: its list, code, error, and the lists that it asks."""
    send, step = nodes.sparkSession.sparkContext.broadcast(codec), max(1, 4_000_000 // max(width, len(codec.centroids)) // 8)

    def run(batches):
        c = send.value
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                raw = pa.array(_raw(part.column("vec"), dtype), pa.binary())
                x = unit(_matrix(raw, width, dtype))
                own, far, asks = c.place(x)
                code, err = c.encode(x - c.centroids[own])
                yield pa.RecordBatch.from_arrays(
                    [part.column("g"), part.column("rid"), part.column("w"), pa.array(own.astype(np.int32)), pa.array(far <= c.distance / 2 - 1e-6), pa.array([r.tobytes() for r in code], pa.binary()),
                     pa.array(err), pa.array([np.flatnonzero(a).astype(np.int32) for a in asks], pa.list_(pa.int32())), raw],
                    names=["g", "rid", "w", "own", "core", "code", "err", "asks", "vec"],
                )

    return nodes.select("g", "rid", "w", "vec").mapInArrow(run, _INDEX)


def _met(here: pa.Table, there: pa.Table, cell: int, c: Codec, width: int, dtype, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links of a block of entries with a block of askers of one list.

    Sums for the entries and for the askers, and the linked pairs as places of a spanning forest
    over the entries and, after them, the askers.
    """
    x, y = unit(_matrix(here.column("vec"), width, dtype)), unit(_matrix(there.column("vec"), width, dtype))
    n, m = len(x), len(y)
    code = np.frombuffer(b"".join(here.column("code").to_pylist()), np.uint8).reshape(n, -1)
    limit = ((here.column("err").to_numpy() + c.distance + SLACK) ** 2).astype(np.float32)
    w, v = here.column("w").to_numpy(), there.column("w").to_numpy()
    rid, sid = here.column("rid").to_numpy(), there.column("rid").to_numpy()
    core, home = here.column("core").to_numpy(zero_copy_only=False).astype(bool), there.column("own").to_numpy()
    # an entry that asks the asker's list as well meets it in the list of the smaller number
    names, place = np.unique(home, return_inverse=True)
    both = np.zeros((n, len(names)), bool)
    asks = here.column("asks").to_pylist()
    flat, rows = np.array([a for q in asks for a in q], np.int64), np.repeat(np.arange(n), [len(q) for q in asks])
    at = np.minimum(np.searchsorted(names, flat), len(names) - 1)
    hit = names[at] == flat
    both[rows[hit], at[hit]] = True
    both &= (names < cell)[None]
    to_entry, to_asker = np.zeros(n, np.int64), np.zeros(m, np.int64)
    forest_u, forest_v, step = [], [], max(1, 2_000_000 // max(n, 1))
    for a in range(0, m, step):
        b = min(m, a + step)
        table = c.tables(y[a:b] - c.centroids[cell])
        found = np.zeros((b - a, n), np.float32)
        for k in range(code.shape[1]):
            found += table[:, k][:, code[:, k]]
        left = (found <= limit[None]) & (rid[None] != sid[a:b, None]) & ~both[:, place[a:b]].T
        some = np.flatnonzero(left.any(0))
        if not len(some):
            continue
        linked = left[:, some] & (y[a:b] @ x[some].T >= least)
        own = (home[a:b] == cell)[:, None]
        to_entry[some] += v[a:b] @ linked
        # two entries outside the core ask each other, so each sum is taken once
        to_asker[a:b] += (linked & (~own | core[some][None])) @ w[some]
        p, q = np.nonzero(linked)
        if len(p):
            u, t = local_forest(some[q], n + a + p)
            forest_u.append(u)
            forest_v.append(t)
    none = np.zeros(0, np.int64)
    return to_entry, to_asker, np.concatenate([none, *forest_u]), np.concatenate([none, *forest_v])


_FOUND = pa.schema([("rid", pa.int64()), ("other", pa.int64()), ("n", pa.int64())])


def links(held: DataFrame, codec: Codec, width: int, dtype, least: float) -> tuple[DataFrame, DataFrame]:
    """Sums ``(rid, n)`` and edges ``(u, v)`` of a spanning forest of the links, from the index."""
    spark = held.sparkSession
    send = spark.sparkContext.broadcast(codec)
    asked = F.when(F.col("core"), F.col("asks")).otherwise(F.concat("asks", F.array("own")))
    lists = held.groupBy("g", F.col("own").alias("cell")).agg(
        F.count("*").alias("many"), F.count_if("core").alias("cores"), F.sum(F.when(F.col("core"), F.col("w"))).alias("weight"), F.min(F.when(F.col("core"), F.col("rid"))).alias("first")
    )
    askers = held.select("g", F.explode(asked).alias("cell")).groupBy("g", "cell").agg(F.count("*").alias("askers"))
    lists = cut(lists.join(askers, ["g", "cell"], "left").na.fill(0, ["askers"]))
    stats = lists.agg(*(F.coalesce(f(c), F.lit(0)) for c in ("many", "cores", "askers") for f in (F.sum, F.max))).first()
    blocks = lists.where("askers > 0").select("g", "cell", "many", "askers", F.ceil(F.col("many") / BLOCK).alias("down"), F.ceil(F.col("askers") / BLOCK).alias("across"))
    spread = lambda n: F.explode(F.expr(f"sequence(0L, {n} - 1)"))
    entries = lookup(held.withColumnRenamed("own", "cell"), blocks.drop("askers"), ["g", "cell"], "many", stats[0], stats[1])
    entries = entries.withColumn("i", F.pmod(F.xxhash64("rid"), "down")).withColumn("j", spread("across")).select("g", "cell", "i", "j", "rid", "w", "core", "code", "err", "asks", "vec")
    asking = lookup(held.select("g", "rid", "w", "own", "vec", F.explode(asked).alias("cell")), blocks.drop("many"), ["g", "cell"], "askers", stats[4], stats[5])
    asking = asking.withColumn("j", F.pmod(F.xxhash64("rid"), "across")).withColumn("i", spread("down"))
    # new names for columns that both sides have from the index
    asking = asking.select(*(F.col(c).alias(c) for c in ("g", "cell", "i", "j", "rid", "w", "own", "vec")))

    def run(key, here, there):
        if not here.num_rows or not there.num_rows:
            return _FOUND.empty_table()
        to_entry, to_asker, u, v = _met(here, there, key[1].as_py(), send.value, width, dtype, least)
        ids = np.concatenate([here.column("rid").to_numpy(), there.column("rid").to_numpy()])
        sums = np.concatenate([to_entry, to_asker])
        some = np.flatnonzero(sums)
        p, q = local_forest(ids[u], ids[v]) if len(u) else (u, v)
        return pa.Table.from_arrays([pa.array(np.concatenate([ids[some], p])), pa.array(np.concatenate([np.full(len(some), -1), q])), pa.array(np.concatenate([sums[some], np.zeros(len(p), np.int64)]))], schema=_FOUND)

    keys = ("g", "cell", "i", "j")
    found = cut(entries.groupBy(*keys).cogroup(asking.groupBy(*keys)).applyInArrow(run, "rid long, other long, n long"))
    core = held.where("core").select("g", F.col("own").alias("cell"), "rid", "w")
    known = lists.where("cores > 1").select("g", "cell", "cores", "weight", "first")
    chained = cut(lookup(core, known, ["g", "cell"], "cores", stats[2], stats[3]).select("rid", "first", (F.col("weight") - F.col("w")).alias("n")))
    sums = found.where("n > 0").select("rid", "n").unionByName(chained.select("rid", "n")).groupBy("rid").agg(F.sum("n").alias("n"))
    edges = found.where("n = 0").select(F.col("rid").alias("u"), F.col("other").alias("v")).unionByName(chained.where("rid <> first").select(F.col("first").alias("u"), F.col("rid").alias("v")))
    return sums, edges


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", least: float = 0.93, reach: float | None = None, entries: int = ENTRIES) -> DataFrame:
    """``(id_col, n_links, component_id, kept)``, a row for each row of ``vectors``.

    ``n_links`` counts other rows linked directly. ``reach`` is how far a list's border may be from
    a vector that asks it: by default as described above, and ``math.inf`` asks every list.
    """
    spark = vectors.sparkSession
    vec = F.col(vec_col)
    kind = vectors.schema[vec_col].dataType.elementType.simpleString()
    dtype = np.float32 if kind == "float" else np.float64
    good = F.col(label_col).isNotNull() & vec.isNotNull() & F.exists(vec, lambda x: x != 0) & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    named = vectors.select(
        F.col(id_col).alias("id"), F.when(F.coalesce(good, F.lit(False)), F.concat_ws(":", F.size(vec).cast("string"), F.col(label_col).cast("string"))).alias("g"),
        F.xxhash64(vec).alias("a"), F.xxhash64(F.lit(7), vec).alias("b"), vec.alias("vec"),
    )
    every = named.where("g is not null")
    nodes = cut(every.groupBy("g", "a", "b").agg(F.first("vec").alias("vec"), F.count("*").alias("w"), F.min("id").alias("low")).withColumn("rid", F.monotonically_increasing_id()))
    sizes = nodes.groupBy("g").agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("d"), F.sum("w").alias("w")).agg(F.max("n"), F.max("d"), F.sum("n"), F.sum("w")).first()
    alone = [F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept")]
    if not sizes[0]:
        return named.select(F.col("id").alias(id_col), *alone)
    largest, width, many, total = sizes
    distance = math.sqrt(2 - 2 * least)
    reach = min(distance, 4 * distance / math.sqrt(width)) if reach is None else reach
    rows = nodes.orderBy(F.xxhash64(F.lit(5), "a", "b"), "rid").select("vec").limit(max(1, min(SAMPLE, SAMPLE_BYTES // (8 * width)))).toPandas()["vec"]
    sample = unit(_matrix(pa.array(_raw(pa.array(rows), dtype), pa.binary()), width, dtype))
    codec = fit(sample, -(-largest // entries), distance, reach)
    with Tables(spark) as tables:
        held = tables.write(index(nodes, codec, width, dtype))
        sums, edges = links(held, codec, width, dtype, least)
        comps = connected_components(edges).withColumnRenamed("node", "rid")
        labelled = cut(nodes.select("g", "a", "b", "w", "low", "rid").join(sums, "rid", "left").join(comps, "rid", "left").withColumn("comp", F.coalesce("comp", "rid")))
    lows = cut(labelled.groupBy("comp").agg(F.min("low").alias("component_id"), F.count("*").alias("held")))
    most = lows.agg(F.max("held")).first()[0]
    told = cut(lookup(labelled, lows, ["comp"], "held", many, most).select("g", "a", "b", "w", "component_id", (F.col("w") - 1 + F.coalesce("n", F.lit(0))).alias("n_links")))
    copies = told.agg(F.max("w")).first()[0]
    linked = lookup(every.select("id", "g", "a", "b"), told, ["g", "a", "b"], "w", total, copies)
    out = linked.select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
    return out.unionByName(named.where("g is null").select(F.col("id").alias(id_col), *alone))


#: DuckDB SQL of the query over ``embeddings``, by all pairs of a label.
LINK_SQL = """
WITH RECURSIVE g AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda v: v IS NULL OR isnan(v) OR isinf(v))) = 0 AND len(list_filter(embedding, lambda v: v <> 0)) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS u, b.vec_id AS v FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE CASE WHEN len(a.x) = len(b.x) THEN list_cosine_similarity(a.x, b.x) >= 0.93 ELSE FALSE END),
r AS (SELECT vec_id, vec_id AS reach FROM embeddings UNION SELECT r.vec_id, l.v FROM r JOIN l ON l.u = r.reach),
c AS (SELECT vec_id, min(reach) AS component_id FROM r GROUP BY 1), n AS (SELECT u, count(*) AS n FROM l GROUP BY 1)
SELECT c.vec_id, coalesce(n.n, 0) AS n_links, component_id, c.vec_id = component_id AS kept FROM c LEFT JOIN n ON n.u = c.vec_id
"""
