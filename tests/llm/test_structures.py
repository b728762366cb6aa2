"""Merkle manifest, vector links and filter audit against brute force."""

import collections
import glob
import hashlib
import itertools
import math
import os
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from knotwork.llm import embed_dedup, filter_audit, merkle, queries

from .conftest import SCHEMA

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plain(rows):
    return collections.Counter(tuple(r) for r in rows)


@needs_data
@pytest.mark.parametrize("name", ["op11_merkle", "op12_embedding_dedup", "op13_filter_audit"])
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    got = queries.queries()[name](spark, DATA)
    want = con.execute(f"select {', '.join(got.columns)} from ({queries.oracle_sql()[name]})").fetchall()
    assert plain(got.collect()) == plain(want)


# Merkle manifest


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_tree(nodes, fan=8):
    """Root, and for each node its siblings to the left and right, level by level."""
    proofs, at, place = [[] for _ in nodes], list(nodes), list(range(len(nodes)))
    while len(at) > 1:
        for k, p in enumerate(proofs):
            i = place[k]
            run = range(i - i % fan, min(len(at), i - i % fan + fan))
            p.append(("".join(at[j] for j in run if j < i), "".join(at[j] for j in run if j > i)))
        at = [sha("".join(at[i : i + fan])) for i in range(0, len(at), fan)]
        place = [i // fan for i in place]
    return at[0], proofs


def brute_manifest(rows, fan=8):
    """Counter of (id, leaf, lefts, rights, subroot, root) for rows (id, part, leaf)."""
    parts = sorted({r[1] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for part in parts:
        own = sorted(((r[0], r[2]) for r in rows if r[1] == part), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[part] = (own, *brute_tree([leaf for _, leaf in own], fan))
    root, above = brute_tree([trees[p][1] for p in parts], fan)
    return root, [(i, leaf, *map(list, zip(*(p + above[k]))), trees[part][1], root) if p + above[k] else (i, leaf, [], [], trees[part][1], root) for k, part in enumerate(parts) for (i, leaf), p in zip(trees[part][0], trees[part][2])]


def manifest_rows(spark, sizes):
    """Leaves of parts of given sizes, with ties of ids, null ids and repeated rows."""
    rows = []
    for part, n in sizes.items():
        rows += [(k // 2 if k % 7 else None, part, f"{part}-{k - k % 3}", "x") for k in range(n)]
    return rows, spark.createDataFrame(rows or [(None, None, None, None)], "doc_id long, lang string, text string, leaf string").limit(len(rows))


@pytest.mark.parametrize("sizes", [{}, {"a": 1}, {"a": 8, None: 9}, {"a": 65, "é": 1, "": 3, None: 64, "b": 30, "Z": 1, "c": 2, "d": 1, "e": 17, "f": 1}])
def test_proofs_of_small_superblocks(spark, sizes):
    rows, docs = manifest_rows(spark, sizes)
    proofs, manifest = merkle.merkle(docs, merkle.leaf_hash(F.col("text")), fan=2, levels=2)
    got = plain((r.id, r.leaf, tuple(r.lefts), tuple(r.rights), r.subroot, r.root) for r in proofs.collect())
    if not rows:
        assert not got and not manifest.count()
        return
    flat = [(i, part, sha(f"{len(text.encode())}:{text}")) for i, part, text, _ in rows]
    root, want = brute_manifest(flat, fan=2)
    # equal leaves of one id are interchangeable, and so are their proofs
    assert got == plain((i, leaf, tuple(a), tuple(b), s, r) for i, leaf, a, b, s, r in want)
    assert {(r.part, r.n) for r in manifest.collect()} == {(p, n) for p, n in sizes.items()} and {r.root for r in manifest.collect()} == {root}
    ok = proofs.select((merkle.folded(F.col("leaf"), F.col("lefts"), F.col("rights")) == F.col("root")).alias("ok"))
    assert ok.where("not ok").count() == 0
    forged = proofs.select((merkle.folded(F.sha2(F.lit("other").cast("binary"), 256), F.col("lefts"), F.col("rights")) == F.col("root")).alias("ok"))
    assert forged.where("ok").count() == 0


def test_many_copies_of_a_row_are_numbered_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(merkle, "COPIES", 4)
    docs = spark.createDataFrame([(1, "a", "same")] * 23 + [(2, "a", "other")], "doc_id long, lang string, text string")
    proofs, _ = merkle.merkle(docs, merkle.leaf_hash(F.col("text")))
    assert sorted(r.place for r in proofs.collect()) == list(range(24))
    assert proofs.where(merkle.folded(F.col("leaf"), F.col("lefts"), F.col("rights")) != F.col("root")).count() == 0


def test_leaf_fields(spark):
    row = spark.createDataFrame([(12, None, "é")], "a long, b string, c string").select(merkle.leaf_hash(F.col("a"), F.col("b"), F.col("c")).alias("h")).first()
    assert row.h == sha("2:12-2:é")


def test_merkle_query_on_odd_rows(spark, tmp_path, docs, nulls):
    """Nulls in every column, repeated rows, and which rows are tampered with."""
    every = docs.unionByName(nulls)
    every.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_merkle(spark, str(tmp_path)).collect()
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in every.collect()]
    field = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    leaves = [(r[0], r[2], sha("".join(map(field, r)))) for r in rows]
    root, want = brute_manifest(leaves)
    assert plain((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256) for r in got) == plain((i, leaf, s, r, sha("".join(x + y for x, y in zip(a, b)))) for i, leaf, a, b, s, r in want)
    bad = collections.Counter(r[0] for r in rows if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] and re.search("[A-Z]", r[4]))
    assert collections.Counter(r.doc_id for r in got if not r.verified) == bad
    assert all((r.folded_root == root) == r.verified for r in got)


# Vector links


def brute_links(rows, least=0.93):
    """(id, links, component, kept) of rows (id, vector, label) whose ids are distinct."""
    good = [r for r in rows if r[1] and r[2] is not None and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])]
    up = {r[0]: r[0] for r in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    many = collections.Counter()
    for a, b in itertools.combinations(good, 2):
        if a[2] == b[2] and len(a[1]) == len(b[1]):
            x, y = np.array(a[1], np.float32).astype(float), np.array(b[1], np.float32).astype(float)
            if x @ y / math.sqrt((x @ x) * (y @ y)) >= least:
                many[a[0]] += 1
                many[b[0]] += 1
                p, q = root(a[0]), root(b[0])
                up[max(p, q)] = min(p, q)
    return sorted((r[0], many[r[0]], root(r[0]), root(r[0]) == r[0]) for r in rows)


def vector_rows(seed=1, dim=24):
    """Random vectors, a dense group, chains of near copies, copies, and rows that link with nothing."""
    rng, rows = np.random.default_rng(seed), []
    add = lambda v, label: rows.append((len(rows), [float(x) for x in v] if v is not None else None, label))
    base = rng.normal(size=dim)
    for k in range(60):
        add(base + rng.normal(size=dim) * 0.12, k % 4 // 3)
    for k in range(120):
        add(rng.normal(size=dim), k % 3)
    for k in range(25):
        v = rng.normal(size=dim)
        for j in range(5):
            add(v + rng.normal(size=dim) * 0.05 * j, k % 2)
    v = rng.normal(size=dim)
    for _ in range(6):
        add(v, 1)
        add(v * 3, 1)
        add(v, 2)
    add(None, 1)
    add([], 1)
    add([0.0] * dim, 1)
    add([float("nan")] + [1.0] * (dim - 1), 1)
    add([float("inf")] + [1.0] * (dim - 1), 1)
    add(v, None)
    add(v[:7], 1)
    add(v[:7], 1)
    rows.append((len(rows), [None] + [1.0] * (dim - 1), 1))
    return rows


@pytest.mark.parametrize("block, entries", [(2048, 512), (16, 10)])
def test_vector_links(spark, monkeypatch, block, entries):
    monkeypatch.setattr(embed_dedup, "BLOCK", block)
    rows = vector_rows()
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, rid string").repartition(3)
    got = sorted(tuple(r) for r in embed_dedup.near_vectors(df, entries=entries, reach=math.inf).collect())
    assert got == brute_links(rows)
    default = sorted(tuple(r) for r in embed_dedup.near_vectors(df, entries=entries).collect())
    want = brute_links(rows)
    assert sum(r[1] for r in default) >= 0.97 * sum(r[1] for r in want)
    assert all(a[1] <= b[1] for a, b in zip(default, want))


def test_sql_of_links():
    rows = vector_rows()
    con = duckdb.connect()
    con.execute("create table embeddings (vec_id bigint, embedding float[], label int)")
    con.executemany("insert into embeddings values (?, ?, ?)", rows)
    assert sorted(con.execute(embed_dedup.LINK_SQL).fetchall()) == brute_links(rows)


def test_lists_and_codes_keep_every_link():
    """The code's bound holds for every pair, and lists within the distance are asked."""
    rng = np.random.default_rng(4)
    x = embed_dedup.unit(np.concatenate([rng.normal(size=(300, 16)), np.repeat(rng.normal(size=(40, 16)), 5, 0) + rng.normal(size=(200, 16)) * 0.15]))
    distance = math.sqrt(2 - 2 * 0.93)
    c = embed_dedup.fit(x, 20, distance, distance)
    own, _, asks = c.place(x)
    code, err = c.encode(x - c.centroids[own])
    assert len(c.centroids) > 5 and len(np.unique(own)) > 5
    for a, b in zip(*np.nonzero(x @ x.T >= 0.93)):
        assert own[a] == own[b] or asks[a, own[b]]
        table = c.tables(x[a : a + 1] - c.centroids[own[b]])[0]
        assert math.sqrt(max(0, sum(table[m, k] for m, k in enumerate(code[b])))) <= distance + err[b] + 1e-4


def test_repeated_and_null_ids_of_vectors(spark):
    v, other = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(5, v, 0), (5, v, 0), (7, v, 0), (None, v, 0), (None, other, 0), (1, other, 1), (2, None, 0), (None, None, None)]
    got = plain(embed_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect())
    assert got == plain([(5, 3, 5, True), (5, 3, 5, True), (7, 3, 5, False), (None, 3, 5, False), (None, 0, None, True), (1, 0, 1, True), (2, 0, 2, True), (None, 0, None, True)])


def test_no_vectors(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embed_dedup.near_vectors(empty).count() == 0
    none = spark.createDataFrame([(1, None, 1), (2, [], 1)], "vec_id long, embedding array<float>, label int")
    assert sorted(tuple(r) for r in embed_dedup.near_vectors(none).collect()) == [(1, 0, 1, True), (2, 0, 2, True)]


@needs_data
def test_vector_query_recall(spark):
    rows = [(r.vec_id, list(r.embedding), r.label) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    assert sorted(tuple(r) for r in queries.op12_embedding_dedup(spark, DATA).collect()) == brute_links(rows)


# Filter audit

LETTERS = "ABCDE"


def brute_audit(rows, labels):
    """Counter of the audit's rows for rows (id, text, source), one document at a time."""
    quality, toxic = collections.defaultdict(int), collections.defaultdict(int)
    for i, q, t in labels:
        quality[i], toxic[i] = max(quality[i], q or 0), max(toxic[i], t or 0)
    fails = []
    for i, text, _ in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        copy = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows)
        fails.append({x for x, y in zip(LETTERS, (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search("[#$%&*|]", t)), copy)) if y})
    out = []
    for part in {r[2] or "" for r in rows}:
        own = [(r[0], f) for r, f in zip(rows, fails) if (r[2] or "") == part]
        shapley, steps = collections.Counter(), []
        for order in itertools.permutations(LETTERS):
            left = own
            for step, x in enumerate(order, 1):
                gone = [d for d in left if x in d[1]]
                left = [d for d in left if x not in d[1]]
                failing = [d for d in own if x in d[1]]
                shapley[x] += len(gone)
                steps.append((part, "".join(order), step, len(left), len(gone), len(failing) - len(gone), sum(d[1] == {x} for d in own), sum(quality[d[0]] == 1 for d in gone if d[0] is not None), sum(toxic[d[0]] == 1 for d in gone if d[0] is not None), x))
        out += [(*s[:-1], shapley[s[-1]]) for s in steps]
    return plain(out)


def test_audit(spark, docs, nulls):
    odd = spark.createDataFrame([(900, "Some CAPITALS & more " * 80, "en", "b", 1, "s", "c"), (901, "Some CAPITALS & more " * 80, "en", "b", 1, "s", "c"), (902, " ".join(str(k) for k in range(400)), "en", "", 1, "s", "c"), (903, None, None, "b", 1, None, None)], SCHEMA)
    every = docs.unionByName(nulls).unionByName(odd)
    labels = [(k, k % 2, k % 3 // 2) for k in range(0, 30)] + [(900, 1, 1), (901, 0, None), (901, 1, 0), (None, 1, 1), (5000, 1, 1)]
    rows = [(r.doc_id, r.text, r.source) for r in every.collect()]
    table = spark.createDataFrame([(*x, "z") for x in labels], "doc_id long, quality int, toxic int, text string")
    assert plain(filter_audit.filter_audit(every, table).collect()) == brute_audit(rows, labels)


def test_audit_of_nothing(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.filter_audit(empty, labels).count() == 0


def test_transform_is_inverted_exactly(spark):
    cells = [("p", False, k % 2 == 0, k, 17**k % 1009) for k in range(8)]
    masks = spark.createDataFrame(cells, "part string, quality boolean, toxic boolean, mask int, many long")
    got = filter_audit.mask_cells(filter_audit.parity_sums(masks, 3), 3).where("many <> 0").collect()
    assert plain(got) == plain(cells)


def test_audit_with_own_filters(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = filter_audit.filter_audit(docs, labels, filters={"L": F.col("n_chars") < 300})
    assert {r.filter_order for r in got.collect()} == {"LE", "EL"}
