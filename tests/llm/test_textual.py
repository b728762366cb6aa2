"""Operators over texts against brute force."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from knotwork.llm import decontam, induced, jaccard_join, langid, lm, matroska, mixing, sieve, suffix_dedup, token_scan, toxicity
from knotwork.llm.queries import remainder
from knotwork.llm.textkernel import shingle_sets, utf8

from .conftest import SCHEMA, words

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def tokens(text):
    return WORD.findall(bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()))


def brute_sets(rows, k=4):
    out = []
    for r in rows:
        w = tokens(r[1])
        out.append((r[0], frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])))
    return out


def brute_components(rows, k=4, percent=85):
    sets = brute_sets(rows, k)
    up = {i: i for i, _ in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = root(sets[a][0]), root(sets[b][0])
                up[max(p, q)] = min(p, q)
    return sorted((i, len(s), root(i)) for i, s in sets)


def test_jaccard_components(docs, rows):
    got = sorted(tuple(r) for r in jaccard_join.jaccard_components(docs).collect())
    assert got == brute_components(rows)
    assert len({c for _, _, c in got[:6]}) == 1


def test_jaccard_families_in_many_leaves(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "LEAF_VOLUME", 400)
    monkeypatch.setattr(jaccard_join, "LEAF_DOCS", 4)
    rng = random.Random(2)
    rows = []
    for family in range(3):
        base = words(rng, 40 + 20 * family)
        for _ in range(14):
            w = list(base)
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = "new" + str(rng.random())
            rows.append((len(rows), " ".join(w), None, None, None, None, None))
    got = sorted(tuple(r) for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, SCHEMA), percent=80).collect())
    assert got == brute_components(rows, percent=80)


def test_jaccard_repeated_ids_and_rows_without_an_id(spark):
    rng = random.Random(6)
    base = words(rng, 100)
    near = [*base[:50], "other", *base[51:]]
    far = words(rng, 80)
    rows = [(1, base), (1, far), (2, near), (None, far), (None, base), (5, base), (5, base), (7, far)]
    rows = [(i, " ".join(w), None, None, None, None, None) for i, w in rows]
    got = [(r.doc_id, r.component_id) for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, SCHEMA), percent=80).collect()]
    assert collections.Counter(got) == collections.Counter([(1, 1), (1, 1), (2, 1), (None, 1), (None, 1), (5, 1), (5, 1), (7, 1)])


def test_common_passages_link_nothing(spark, monkeypatch):
    """Texts that share a passage are no group; with small leaves the trees have several levels."""
    for name, value in (("LEAF_BITS", 1 << 10), ("LEAST_BITS", 256), ("FAN", 2), ("LEAF_VOLUME", 300), ("LEAF_DOCS", 4)):
        monkeypatch.setattr(jaccard_join, name, value)
    rng = random.Random(12)
    passage, rows = words(rng, 30), []
    for i in range(90):
        own = words(rng, rng.randint(40, 70))
        rows.append((i, " ".join([*own, *passage]), None, None, None, None, None))
        if i % 5 == 0:
            for k in range(3):
                w = [*own, *passage]
                w[7 * k] = f"new{i}"
                rows.append((1000 + 10 * i + k, " ".join(w), None, None, None, None, None))
    for proposed in (0, 1 << 14):
        monkeypatch.setattr(jaccard_join, "PROPOSED", proposed)
        got = sorted(tuple(r) for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, SCHEMA).repartition(3), k=5, percent=80).collect())
        assert got == brute_components(rows, k=5, percent=80)


def some_set(rng, n):
    return np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))


def test_prefixes_of_linked_sets_meet():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 13, 33, 150, 400):
        for _ in range(60):
            t = some_set(rng, n)
            drop = int(rng.integers(0, n // 7 + 1))
            other = np.unique(np.concatenate([t[drop:], some_set(rng, int(rng.integers(0, n // 6 + 1)))]))
            if 100 * len(np.intersect1d(t, other)) < 85 * len(np.union1d(t, other)):
                continue
            often = np.unique(np.concatenate([rng.choice(t, rng.integers(0, n + 1), replace=False), some_set(rng, 5)]))
            for common in (np.zeros(0, np.uint64), often):
                a, b = (jaccard_join.prefix(x, 85, common, np.arange(len(common))[::-1]) for x in (t, other))
                assert np.intersect1d(a, b).size


def test_bounds_of_trees_and_bitmaps_keep_every_link():
    rng = np.random.default_rng(3)
    for size in (20, 200, 3000):
        base, leaves = some_set(rng, size), []
        for i in range(16):
            keep = base if i % 3 == 0 else some_set(rng, size + size * i // 12)
            leaves.append([np.unique(np.concatenate([keep[j:], some_set(rng, j)])) for j in rng.integers(0, size // 4, 3)])
        sizes = [np.array([len(t) for t in x]) for x in leaves]
        bits = [jaccard_join._unpack_bits(b"".join(jaccard_join.bitmap(t).tobytes() for t in x), n) for x, n in zip(leaves, sizes)]
        want = {(i, j) for i in range(16) for j in range(16) if i != j and len(jaccard_join.linked(leaves[i], leaves[j], 85))}
        left = {(i, j) for i in range(16) for j in range(16) if i != j and jaccard_join.survivors(sizes[i], bits[i], sizes[j], bits[j], 85).any()}
        assert want <= left and len(left) < 100
        for i, j in want:
            ok = jaccard_join.survivors(sizes[i], bits[i], sizes[j], bits[j], 85)
            assert all(ok[x, y] for x, y in jaccard_join.linked(leaves[i], leaves[j], 85))
        width = min(128, *(b.shape[1] for b in bits))
        short = [jaccard_join.fold(b, width) for b in bits]
        page = (np.array([n.min() for n in sizes]), np.array([n.max() for n in sizes]), np.stack([b.max(0) for b in short]), np.stack([b.min(0) for b in short]), np.zeros(16, np.int64))
        fits = jaccard_join._fits(page, page, 85)
        assert all(fits[i, j] for i, j in want)


def brute_repeats(rows, length=200):
    raw = [(r[1] or "").encode() for r in rows]
    seen = collections.Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for r, b in zip(rows, raw):
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = gone.count(b"\0\1") + (gone[:1] == b"\1")
        out.append((r[0], len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("length", [200, 32, 45])
def test_suffix_dedup(docs, rows, length):
    got = sorted(tuple(r) for r in suffix_dedup.repeat_table(docs, length=length).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())
    assert got == brute_repeats(rows, length)


@pytest.mark.parametrize("parts", [1, 2, 8])
def test_suffix_dedup_of_hot_grams(spark, monkeypatch, parts):
    """One passage of 150 bytes with different surroundings everywhere: its grams are split."""
    monkeypatch.setattr(suffix_dedup, "HOT", 2)
    monkeypatch.setattr(suffix_dedup, "PARTS", parts)
    rng = random.Random(parts)
    passage, rows = "".join(rng.choice("abc ") for _ in range(150)), []
    for i in range(40):
        left, right = ("".join(rng.choice("abcdefgh ") for _ in range(90)) for _ in range(2))
        rows.append((i, left + passage + right, None, None, None, None, None))
        if i % 4 == 0:
            rows.append((100 + i, "other words " + left[-60:] + passage + right[: rng.randint(0, 40)], None, None, None, None, None))
        if i % 5 == 0:
            rows.append((200 + i, passage[40:] + passage + right, None, None, None, None, None))
    got = sorted(tuple(r) for r in suffix_dedup.repeat_table(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect())
    assert got == brute_repeats(rows) and sum(r[2] > 0 for r in got) > 10


def test_contexts_of_long_texts_in_blocks(spark, rows, docs, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK", 300)
    got = sorted(tuple(r) for r in suffix_dedup.repeat_table(docs).collect())
    assert got == brute_repeats(rows)


def test_removed_text(docs, rows):
    want = {i: sha for i, _, n, _, sha in brute_repeats(rows)}
    for r in suffix_dedup.remove_repeats(docs, length_col="n_chars").collect():
        before = dict((x[0], x[1]) for x in rows)[r.doc_id]
        if r.text == before:
            assert want[r.doc_id] == hashlib.sha256((before or "").encode()).hexdigest()
        else:
            assert r.n_chars == len(r.text) and r.score == "x"


@pytest.mark.parametrize("small", [0, 5, 1 << 18])
def test_induced_sorting(small, monkeypatch):
    monkeypatch.setattr(induced, "SMALL", small)
    monkeypatch.setattr(induced, "SPILL", 16)
    rng = np.random.default_rng(small)
    for k in range(120):
        t = np.append(rng.integers(1, rng.integers(2, 30_000 if k % 5 == 0 else 5), rng.integers(1, 70)), 0)
        if k % 3 == 0:
            t = np.append(np.tile(t[:-1][:5], 9), 0)
        assert induced.suffix_array(t).tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())


def test_matroska_round_trip(docs, rows):
    for n in (0, 1, 64, 511, 513, 4096, 4097, 70_000):
        payload = matroska.padded(bytes(i * 7 % 256 for i in range(n)))
        data = matroska.mux(payload)
        m = matroska.parse(data)
        assert matroska.payload_of(data, m) == payload and [c[2] for c in m.cues] == m.clusters
        assert [p[2] for p in m.packets] == [64_000_000 * i for i in range(len(m.packets))]
    by = {r[0]: r[1] for r in rows}
    for r in matroska.media_digest(docs).collect():
        p = matroska.padded((by[r.doc_id] or "").encode())
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert r.media_sha256 == hashlib.sha256(matroska.mux(p)).hexdigest()
    packets = matroska.packet_table(matroska.media_column(docs))
    total = packets.groupBy("id").agg(F.sum("size").alias("n")).collect()
    assert {r.id for r in total} == set(by) and packets.where("not cued").count() == 0


@pytest.mark.parametrize("mode", [matroska.XIPH, matroska.FIXED, matroska.EBML_LACING])
def test_lacing(mode):
    sizes = [300] * 4 if mode == matroska.FIXED else [0, 255, 256, 20_000, 3, 70_000, 1]
    frames = [bytes([i % 251]) * n for i, n in enumerate(sizes)]
    body = matroska.block(3, -5, frames, mode)
    track, relative, flags, found = matroska._frames(body, 0, len(body))
    assert (track, relative) == (3, -5) and [body[a : a + n] for a, n in found] == frames


def test_unknown_sizes_and_bad_files():
    simple = matroska.element(matroska.SIMPLE, matroska.block(1, 0, [b"abc"]))
    group = matroska.element(matroska.GROUP, matroska.element(matroska.BLOCK, matroska.block(1, 2, [b"xy", b"z1"], matroska.FIXED)) + matroska.element(matroska.REFERENCE, b"\x01"))
    cluster = matroska.CLUSTER.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + matroska.unsigned(matroska.TIMESTAMP, 5)
    data = matroska._HEADER + matroska.SEGMENT.to_bytes(4, "big") + b"\xff" + matroska._TRACKS + cluster + simple + cluster + group
    m = matroska.parse(data)
    assert [p[1] for p in m.packets] == [0, 1, 1] and [p[5] for p in m.packets] == [True, False, False] and m.packets[1][2] == 7_000_000
    assert matroska.payload_of(data, m) == b"abcxyz1"
    for bad in (b"", b"hello", matroska._HEADER, data[:40]):
        with pytest.raises(ValueError):
            matroska.parse(bad)


def test_token_files(docs, rows):
    got = {r.doc_id: r.n_tokens for r in token_scan.token_counts(docs).collect()}
    enc = lm.encoder()
    want = {r[0]: sum(len(enc.encode_ordinary(" " + w)) for w in re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows}
    assert got == want


@pytest.mark.parametrize("block", [1, 2, 3, 7, 1000])
def test_stitching_blocks(spark, tmp_path, block):
    rng = np.random.default_rng(block)
    docs = [list(rng.integers(3, 9, rng.integers(0, 6))) for _ in range(12)] + [[4, 4]]
    flat = np.concatenate([np.array([*d, 2]) for d in docs])[:-1].astype(">u2")
    (tmp_path / "part-0").write_bytes(flat.tobytes())
    (tmp_path / "part-1").write_bytes(b"")
    got = token_scan.stitch(token_scan.scan_blocks(spark, str(tmp_path), 2, 3, block), 3).orderBy("ordinal").collect()
    assert [(r.n, list(r["first"])) for r in got] == [(len(d), d[:3]) for d in docs]
    assert [r.closed for r in got] == [True] * 12 + [False]


def test_language(docs, rows):
    model = langid.fit(docs, train_rows=remainder(5) != 0)
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    right = [got[r[0]].lang_pred == r[2] for r in rows if r[1] and len(r[1]) > 100 and r[2] and "aaaa" not in r[1]]
    assert sum(right) >= 0.95 * len(right)
    assert all(got[r[0]].lang_pred == "und" and got[r[0]].score == 0 for r in rows if not (r[1] or "").strip())


def test_scripts_without_spaces_are_cut_between_characters():
    texts = ["語" * 5000 + " " + "x" * 200, "é" * 23 + "a" + "é" * 40, "short"]
    data, offsets = utf8(pa.array(texts))
    low, starts, ends, per = langid._units(*langid.words(data, offsets, langid.LETTER_SEP))
    raw = low.tobytes()
    for d, text in enumerate(texts):
        own = [raw[a:b] for a, b in zip(starts[per[d] : per[d + 1]], ends[per[d] : per[d + 1]])]
        assert b"".join(own) == text.replace(" ", "").encode() and max(map(len, own)) <= langid.UNIT
        assert all(x.decode() for x in own)


def test_many_languages_in_blocks(monkeypatch):
    rng = random.Random(1)
    texts = [" ".join(words(rng, 30, lang)) for lang in ("en", "fr") * 6]
    names = [f"{lang}{k}" for k, lang in enumerate(("en", "fr") * 6)]
    vocabulary = [bytes([b]) for b in range(256)] + [b"th", b"eau", b"er"]
    one = langid.train(texts, names, vocabulary)
    monkeypatch.setattr(langid, "TOGETHER", 5)
    two = langid.train(texts, names, vocabulary)
    assert np.allclose(one.p, two.p)


def test_forward_sums_all_segmentations():
    pieces = [bytes([b]) for b in range(256)] + ["▁a".encode(), b"ab", b"abc", b"bc"]
    rng = np.random.default_rng(0)
    p = rng.random((len(pieces), 2))
    model = langid.Model(["x", "y"], np.zeros(2), pieces, p / p.sum(0))

    def brute(word, g):
        @__import__("functools").cache
        def f(rest):
            return 1.0 if not rest else sum(model.p[i, g] * f(rest[len(q) :]) for i, q in enumerate(pieces) if rest.startswith(q))

        return math.log(f("▁".encode() + word))

    texts = [b"abc", b"a", b"bcabcab", b"cab"]
    low = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    got = langid.forward(low, ends - [len(t) for t in texts], ends, model)
    want = [[brute(t, g) for g in (0, 1)] for t in texts]
    assert np.allclose(got, want)
    weights = np.array([[2.0, 1.0]] * 4)
    _, counts = langid.forward(low, ends - [len(t) for t in texts], ends, model, weights)
    covered = sum(counts[1 + i, 0] * len(q) for i, q in enumerate(pieces))
    assert np.isclose(covered, 2 * sum(3 + len(t) for t in texts))


def test_lm_scores(docs, rows, monkeypatch):
    monkeypatch.setattr(lm, "STEPS", 60)
    got = collections.defaultdict(list)
    for r in lm.score(docs, remainder(7) != 2).collect():
        got[r.doc_id].append(r)
    count = collections.Counter()
    split = {}
    for r in rows:
        w = [*tokens(r[1]), None]
        split[r[0]] = w
        if zlib.crc32(str(r[0]).encode()) % 7 != 2:
            count.update(w)
    n, v = count.total(), len(count)
    for i, w in split.items():
        for r in got[i]:
            assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(count[x] > 0 for x in w), n)
            assert math.isclose(r.base_score, sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w), abs_tol=1e-6) and r.score < 0


def test_lm_is_a_distribution():
    rng = np.random.default_rng(0)
    ids = rng.integers(0, 300, 4000).astype(np.int64)
    ids[::50] = lm.END_ID
    model = lm.train(ids, np.array([0, 1500, 1500, 4000]), steps=5)
    look = lm.tables(model)
    base = lm.log10_probability(ids[:20], np.array([0, 20]), model, look)[0]
    every = np.concatenate([np.tile(ids[:20], (lm.IDS, 1)), np.arange(lm.IDS)[:, None]], 1)
    step = lm.log10_probability(every.ravel(), np.arange(lm.IDS + 1) * 21, model, look) - base
    assert step.max() < 0 and math.isclose((10**step).sum(), 1, rel_tol=1e-3)
    assert np.allclose(np.bincount(model.klass, model.share, minlength=lm.CLASSES), 1)


def test_lm_against_plain_attention():
    """Token by token with plain loops over the window, and pair counts from a dictionary."""
    rng = np.random.default_rng(4)
    ids = np.where(rng.random(600) < 0.5, rng.integers(0, 30, 600), rng.integers(0, 900, 600)).astype(np.int64)
    offsets = np.array([0, 5, 5, 38, 200, 600])
    model = lm.train(ids, offsets, steps=30)
    pairs, w, d = collections.Counter(), model.weights, lm.WIDTH
    for a, b in zip(offsets, offsets[1:]):
        pairs.update(zip([lm.END_ID, *ids[a : b - 1].tolist()], ids[a:b].tolist()))

    def within(before, token):
        own = {i: n for (x, i), n in pairs.items() if x == before and model.klass[i] == model.klass[token]}
        total = sum(own.values())
        if not total:
            return model.share[token]
        return max(own.get(token, 0) - lm.DISCOUNT, 0) / total + sum(min(n, lm.DISCOUNT) for n in own.values()) / total * model.share[token]

    got = lm.log10_probability(ids, offsets, model, lm.tables(model), chunk=3)
    for k, (a, b) in enumerate(zip(offsets, offsets[1:])):
        doc, want = ids[a:b].tolist(), 0.0
        for t, token in enumerate(doc):
            first = t // lm.STRIDE * lm.STRIDE - lm.STRIDE
            seen = [(j, lm.BEFORE_ROW if j == 0 else doc[j - 1]) for j in range(max(0, first), t + 1)]
            x = np.stack([w["E"][i] + w["P"][j - first] for j, i in seen]).astype(float)
            e = np.exp((x[-1] @ w["q"]) @ (x @ w["k"]).T / np.sqrt(d))
            z = (x[-1] + e / e.sum() @ (x @ w["v"])) @ w["o"] + w["b"]
            want += math.log10(math.exp(z[model.klass[token]]) / np.exp(z).sum()) + math.log10(within(doc[t - 1] if t else lm.END_ID, token))
        assert math.isclose(got[k], want, rel_tol=1e-4, abs_tol=1e-9)


def test_lm_causality_and_windows():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 200, 300).astype(np.int64)
    model = lm.train(ids, np.array([0, 300]), steps=5)
    look = lm.tables(model)
    part = [lm.log10_probability(ids[:n], np.array([0, n]), model, look)[0] for n in (1, 16, 17, 40, 300)]
    assert part == sorted(part, reverse=True)
    two = lm.log10_probability(np.concatenate([ids[:40], ids[:17]]), np.array([0, 40, 57]), model, look)
    assert np.allclose(two, [part[3], part[2]], rtol=1e-5)


def test_lm_beats_words_out_of_context(spark, monkeypatch):
    """Held-out texts in which a word depends on the word before it score above the base."""
    monkeypatch.setattr(lm, "STEPS", 150)
    rng = random.Random(21)
    names = ["time", "people", "water", "house", "world", "school", "family", "group", "country", "problem", "hand", "place", "case", "week", "company", "system"]
    after = {n: rng.sample(names, 3) for n in names}
    rows = []
    for i in range(300):
        w = [rng.choice(names)]
        for _ in range(rng.randint(20, 60)):
            w.append(rng.choice(after[w[-1]]))
        rows.append((i, " ".join(w)))
    got = lm.score(spark.createDataFrame(rows, "doc_id long, text string"), remainder(7) != 2).where(remainder(7) == 2).collect()
    tokens_ = sum(r.n_tokens for r in got)
    assert len(got) > 20 and sum(r.score for r in got) / tokens_ > sum(r.base_score for r in got) / tokens_ + 0.3


def test_toxicity_finds_the_sentence(spark):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(300):
        s = [" ".join(words(rng, 8)) for _ in range(6)]
        toxic = i % 4 == 0
        if toxic:
            s[i % 6] += " " + rng.choice(["vilest", "scumbag"]) + " " + rng.choice(["vilest", "fool"])
        rows.append((i, ". ".join(s) + ".", "en", "a", 0, None, None))
        labels.append((i, int(toxic)))
    docs, marks = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, marks, train_rows=remainder(4) != 2)
    for r in toxicity.score(docs, model).collect():
        assert r.predicted == int(r.doc_id % 4 == 0) == int(r.score >= 0.3)
        if r.predicted:
            assert r.worst_start <= rows[r.doc_id][1].encode().index(b"vilest" if "vilest" in rows[r.doc_id][1] else b"scumbag") < r.worst_end


def test_toxicity_without_labels(docs, spark):
    model = toxicity.fit(docs, spark.createDataFrame([(1, 0), (None, 1), (2, None)], "doc_id long, toxic int"))
    assert toxicity.score(docs, model).agg(F.max("score")).first()[0] < 0.01


def test_decontamination(spark):
    rng = random.Random(4)
    items = [(i, " ".join(words(rng, rng.randint(12, 40))).capitalize() + ".") for i in range(12)] + [(12, None), (13, ""), (14, "two words"), (15, "unseen")]
    rows, want = [], set()
    for i in range(60):
        w = words(rng, 200)
        if i % 3 == 0:
            k = (i // 3) % 12
            leak = items[k][1].upper().split()
            if i % 2:
                for j in range(3, len(leak), 7):
                    leak[j] = "edited"
            w[50:50] = leak
            want.add((i, k))
        rows.append((i, " ".join(w), "en", "a", 0, None, None))
    docs, bench = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(items, "item_id long, text string")
    found = decontam.leak_table(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} == want
    for r in found:
        assert r.start <= 53 and r.end >= 50 + len(items[r.item_id][1].split()) - 3
    left = decontam.clean(docs, bench)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == set(range(60)) - {i for i, _ in want}
    decontam.BLOCK, old = 30, decontam.BLOCK
    try:
        assert {(r.doc_id, r.item_id) for r in decontam.leak_table(docs, bench).collect()} == want
    finally:
        decontam.BLOCK = old


@pytest.mark.parametrize("total", [60, 1500])
def test_decontamination_of_one_edited_version(spark, total):
    rng = random.Random(total)
    item = words(rng, 80)
    edited = [f"edit{j}" if j % 4 == 3 else w for j, w in enumerate(item)]
    rows = [(i, " ".join([*words(rng, 20), *(edited if i % 15 == 0 else words(rng, 20)), *words(rng, 20)]), "en", "a", 0, None, None) for i in range(total)]
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    for more in ([], [(total, " ".join(item), "en", "a", 0, None, None)]):
        found = decontam.leak_table(spark.createDataFrame(rows + more, SCHEMA), bench).collect()
        assert {r.doc_id for r in found} == {*range(0, total, 15), *(r[0] for r in more)}


def test_recall_against_exhaustive_alignment(spark):
    """Paraphrases that lose, gain and change one word in four to one in ten, in long and short
    documents, against the alignment of every document with every item."""
    rng = random.Random(14)
    items = [words(rng, rng.randint(15, 60)) for _ in range(25)]
    rows = []
    for i in range(250):
        w = words(rng, rng.randint(10, 400))
        if i % 2:
            rate, leak = rng.uniform(0.1, 0.25), []
            for x in items[rng.randrange(25)]:
                r = rng.random()
                leak += [x] if r > rate else [] if r < rate / 3 else [rng.choice(["one", "more", "edit"])] if r < rate * 2 / 3 else [x, "word"]
            at = rng.randrange(len(w))
            w[at:at] = leak
        rows.append((i, " ".join(w), "en", "a", 0, None, None))
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    found = {(r.doc_id, r.item_id): r.score for r in decontam.leak_table(spark.createDataFrame(rows, SCHEMA), bench).collect()}
    hashed = decontam.Items(list(range(25)), [" ".join(x) for x in items]).words
    docs_ = decontam.Items(list(range(250)), [r[1] for r in rows]).words
    want = {}
    for k, x in enumerate(hashed):
        score, _ = decontam.align(docs_, [x] * 250)
        want |= {(d, k): s / (2 * len(x)) for d, s in enumerate(score.tolist()) if s / (2 * len(x)) >= decontam.THRESHOLD}
    hit = set(want) & set(found)
    assert len(want) > 60 and len(hit) >= 0.9 * len(want) and set(found) <= set(want)
    assert sum(math.isclose(found[p], want[p]) for p in hit) >= 0.95 * len(hit)


def test_repeated_item_in_one_long_passage(spark):
    rng = random.Random(15)
    item = words(rng, 20)
    rows = [(0, " ".join(x for _ in range(300) for x in [*item, "between"]), "en", "a", 0, None, None), (1, " ".join([*words(rng, 900), *item]), "en", "a", 0, None, None)]
    found = decontam.leak_table(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(5, " ".join(item))], "item_id long, text string")).collect()
    assert {(r.doc_id, r.score, r.end - r.start) for r in found} == {(0, 1.0, 20), (1, 1.0, 20)}


def test_alignment_against_plain_table():
    rng = np.random.default_rng(2)
    for _ in range(40):
        a, b = rng.integers(0, 6, rng.integers(1, 25)).astype(np.uint64), rng.integers(0, 6, rng.integers(1, 15)).astype(np.uint64)
        h = np.zeros((len(b) + 1, len(a) + 1), int)
        for i in range(len(b)):
            for j in range(len(a)):
                h[i + 1, j + 1] = max(0, h[i, j] + (2 if a[j] == b[i] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
        assert decontam.align([a], [b])[0][0] == h.max()


def test_mixing(docs, rows):
    got = mixing.mix_rows(docs).collect()
    again = {(r.doc_id, r.copies) for r in mixing.mix_rows(docs.repartition(7)).collect()}
    assert len(got) == len(rows) and {(r.doc_id, r.copies) for r in got} == again
    size = {r[0]: len(WORD.findall((r[1] or "").encode())) for r in rows}
    assert all(r["size"] == size[r.doc_id] and 0 <= r.taken <= 2 * r["size"] for r in got)
    by = collections.defaultdict(list)
    for r in got:
        by[r.source].append(r)
    for s, own in by.items():
        assert own[0].source_size == sum(r["size"] for r in own)
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r["size"] for r in own) and own[0].target <= 2 * own[0].source_size + 1e-6
    names = sorted((s for s in by if s is not None)) + [None]
    total, weight = 1.5 * sum(size[r[0]] for r in rows), dict(zip(names, [5, 2, 1] * 3))
    cap = {s: 2 * by[s][0].source_size for s in names}
    full: set = set()
    while True:
        rest = [s for s in names if s not in full]
        level = (total - sum(cap[s] for s in full)) / max(1e-9, sum(weight[s] for s in rest))
        over = {s for s in rest if weight[s] * level > cap[s]}
        if not over:
            break
        full |= over
    for s in names:
        assert math.isclose(by[s][0].target, cap[s] if s in full else weight[s] * level, rel_tol=1e-9, abs_tol=1e-6)
    mixed = mixing.mixed_documents(docs)
    assert collections.Counter(r.doc_id for r in mixed.collect()) == collections.Counter({i: n for i, n in ((r.doc_id, sum(x.copies for x in got if x.doc_id == r.doc_id)) for r in got) if n})


def test_many_documents_mix_close_to_target(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.array_join(F.array_repeat(F.lit("w"), (F.col("id") % 97 + 1).cast("int")), " ").alias("text"), F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b").otherwise("c").alias("source"))
    for r in mixing.mix_rows(df).groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("w")).collect():
        assert abs(r.t - r.w) <= 97


def test_repeated_rows_mix_close_to_target(spark):
    """One row a thousand times beside distinct rows: both sources come as near as one document."""
    rows = [(1, "five words are in here", "a")] * 1000 + [(i, "w " * (i % 9 + 1), "b") for i in range(2, 900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = mixing.mix_rows(df)
    for r in got.groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("w"), F.max("size").alias("s")).collect():
        assert abs(r.t - r.w) <= r.s
    assert got.where("taken > 2 * size").count() == 0
    want = {r.doc_id: r.n for r in got.groupBy("doc_id").agg(F.sum("copies").alias("n")).collect() if r.n}
    mixed = mixing.mixed_documents(df)
    assert {r.doc_id: r.n for r in mixed.groupBy("doc_id").agg(F.count("*").alias("n")).collect()} == want
    assert mixed.where("doc_id = 1").select("copy_no").distinct().count() == want[1]


def test_one_long_document_does_not_miss_the_target(spark):
    """A document of a third of its source's words: small ones fill what it leaves, to a hundredth of the target."""
    rng = random.Random(8)
    rows = [(1000 * k, "w " * 5000, f"s{k}") for k in range(6)] + [(1000 * k + i, "w " * rng.randint(20, 180), f"s{k}") for k in range(6) for i in range(1, 101)]
    got = mixing.mix_rows(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    for r in got.groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("w")).collect():
        assert abs(r.t - r.w) <= 0.01 * r.w
    assert got.where("taken > 2 * size").count() == 0


def test_rounding_keeps_expectations(spark):
    """Over many seeds a document is taken as often as its source's rate says."""
    rng = random.Random(2)
    df = spark.createDataFrame([(i, "w " * rng.randint(1, 40), "a" if i % 2 else "b") for i in range(24)], "doc_id long, text string, source string").coalesce(1).cache()
    runs = [{r.doc_id: r for r in mixing.mix_rows(df, seed=s).collect()} for s in range(8)]
    z = [(sum(run[i].copies for run in runs) / len(runs) - runs[0][i].target / runs[0][i].source_size) for i in range(24)]
    assert abs(sum(z)) / 24 < 0.1 and max(map(abs, z)) < 0.6


OPERATORS = {
    "toxicity": lambda d, s: toxicity.score(d, toxicity.fit(d, s.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int"))),
    "decontam": lambda d, s: decontam.leak_table(d, s.createDataFrame([(1, "some words here")], "item_id long, text string")),
    "token_scan": lambda d, s: token_scan.token_counts(d),
    "suffix_dedup": lambda d, s: suffix_dedup.repeat_table(d),
    "langid": lambda d, s: langid.predict(d, langid.fit(d)),
    "jaccard": lambda d, s: jaccard_join.jaccard_components(d),
    "mixing": lambda d, s: mixing.mix_rows(d),
    "matroska": lambda d, s: matroska.media_digest(d),
    "lm": lambda d, s: lm.score(d, remainder(7) != 2),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_and_null_tables(name, empty, nulls, spark):
    assert OPERATORS[name](empty, spark).count() == 0
    n = OPERATORS[name](nulls, spark).count()
    assert n == 4 or name == "decontam" and n == 1


def test_shingle_sets_of_slices():
    texts = pa.array(["a b c d e", None, "", "x Y", "a b c d e"] * 3)
    got = [s.tolist() for s in shingle_sets(texts.slice(1, 9), 4)]
    assert [len(s) for s in got] == [0, 0, 1, 2, 2, 0, 0, 1, 2] and got[3] == got[4] == got[8]


def test_lm_gathers_from_every_document(spark, monkeypatch):
    rng = random.Random(11)
    texts = [" ".join(words(rng, 12, "fr" if i % 2 else "en")) + f" x{i}   y café{i}" for i in range(900)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    got, shards = lm._gathered(docs, F.lit(True), (np.zeros(0, np.uint64), np.zeros(0, np.int64)), 4)
    monkeypatch.setattr(lm, "STEPS", 2)
    model = lm._fit(got, 4, shards)
    enc, count, pairs = lm.encoder(), np.zeros(lm.IDS), collections.Counter()
    for t in texts:
        ids = [i for w in re.findall(r"[^\x20\x09-\x0D]+", t) for i in enc.encode_ordinary(" " + w.lower())] + [lm.END_ID]
        np.add.at(count, ids, 1)
        pairs.update(zip([lm.END_ID, *ids], ids))
    soft = count + 0.02
    assert np.allclose(model.share, soft / np.bincount(model.klass, soft, minlength=lm.CLASSES)[model.klass])
    assert set(np.argsort(-count, kind="stable")[: lm.SINGLE]) == set(np.flatnonzero(model.klass < lm.SINGLE))
    assert {divmod(c, lm.IDS): n for c, n in zip(model.pairs[0].tolist(), model.pairs[1].tolist())} == pairs


def test_worker_keeps_words_up_to_its_bound(monkeypatch):
    monkeypatch.setattr(lm, "KEPT", 40)
    lm._held().pop("pieces", None)
    rng, enc = random.Random(3), lm.encoder()
    for _ in range(6):
        w = [x.encode() for x in words(rng, 25, "fr")]
        low = np.frombuffer(b"".join(w), np.uint8)
        ends = np.cumsum([len(x) for x in w])
        starts = ends - [len(x) for x in w]
        ids, at = lm.subwords(low, starts, ends, lm.word_hashes(low, starts, ends), np.array([0, 10, 25]))
        want = [[i for x in part for i in enc.encode_ordinary(" " + x.decode())] + [lm.END_ID] for part in (w[:10], w[10:])]
        assert [ids[at[k] : at[k + 1]].tolist() for k in (0, 1)] == want and len(lm._held()["pieces"][0]) <= 40
    lm._held().pop("pieces")


def test_lm_trains_on_windows_of_every_shard(spark, docs, monkeypatch):
    ids, offsets = np.arange(100).astype(np.int64), np.array([0, 30, 30, 100])
    inputs, targets, _ = lm._windows(ids, offsets)
    _, span = lm._draw(ids, offsets, np.arange(3).astype(np.uint64), 1.0)
    span = span.astype(int)
    rows = np.where(span < lm.IDS, span, span - lm.BEFORE + lm.BEFORE_ROW)
    assert np.array_equal(rows[:, : lm.WINDOW], inputs)
    assert np.array_equal(np.where(span[:, lm.STRIDE + 1 :] < lm.IDS, span[:, lm.STRIDE + 1 :], -1), targets)
    monkeypatch.setattr(lm, "STEPS", 20)
    monkeypatch.setattr(lm, "SHARD", 300)
    none = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    narrow = docs.select("doc_id", "text")
    one, two = (lm._fit(*(lambda got, shards: (got, 4, shards))(*lm._gathered(d, F.lit(True), none, 4))) for d in (narrow, narrow.repartition(7)))
    assert all(np.allclose(one.weights[n], two.weights[n], atol=1e-4) for n in one.weights)
    assert np.array_equal(one.klass, two.klass)


def test_slots_of_repeated_shingles_come_last(spark):
    """Gaps are read back, the passage that texts of many tasks share is full, and no prefix starts with it."""
    rng = np.random.default_rng(3)
    for at in ([], [0], [0, 0, 254, 255, 256, 5000, 5000], np.sort(rng.integers(0, 1 << 22, 500)).tolist()):
        assert jaccard_join.ungaps(jaccard_join.gaps(np.array(at, np.int64))).tolist() == at
    word = lambda: "".join(map(chr, rng.integers(97, 123, 9)))
    passage = [word() for _ in range(60)]
    texts = [" ".join([word() for _ in range(80)] + passage) for _ in range(24)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(12)
    sketch = jaccard_join.sketches(docs, "doc_id", "text", 4, 85).cache()
    full = jaccard_join._full(sketch, sum(r.n_shingles or 0 for r in sketch.select("n_shingles").collect()))
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    shared = next(jaccard_join.shingle_sets(pa.array([" ".join(passage)]), 4))
    for t in jaccard_join.shingle_sets(pa.array(texts), 4):
        assert not np.isin(jaccard_join.prefix(t, 85, *none, full), shared).any() and np.isin(jaccard_join.prefix(t, 85, *none), shared).any()


def test_pairs_of_a_rare_key_are_compared_at_once(spark):
    """Texts that share a passage only form no group; copies with a changed word do."""
    rng = np.random.default_rng(4)
    word = lambda: "".join(map(chr, rng.integers(97, 123, 9)))
    passage, other = [word() for _ in range(100)], [word() for _ in range(200)]
    texts = [" ".join([word() for _ in range(100)] + passage) for _ in range(2)] + [" ".join(passage)] + [" ".join(other), " ".join([*other[:-1], "x"])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sketch = jaccard_join.sketches(docs, "doc_id", "text", 4, 85).where("node is not null").select("doc_id", "node", F.col("n_shingles").alias("n"), "bits").cache()
    edges = jaccard_join._coarse_edges(jaccard_join._routed(docs.select("text"), 4, 85, 2, (np.zeros(0, np.uint64), np.zeros(0, np.int64))), 85).cache()
    name = {r.node: r.doc_id for r in sketch.collect()}
    assert {frozenset((name[r.u], name[r.v])) for r in edges.collect()} == {frozenset((0, 1)), frozenset((3, 4))}
    assert {frozenset((name[r.u], name[r.v])) for r in jaccard_join._compared(edges, sketch, 85).collect()} == {frozenset((3, 4))}


def test_lm_trains_on_every_window_of_a_corpus_above_a_megabyte(spark, monkeypatch):
    """Over the turns every training document comes up once, in one shard, with all of its windows."""
    rng = random.Random(5)
    texts = [" ".join(words(rng, 240)) + f" x{i}" for i in range(1200)]
    docs = spark.createDataFrame([(i if i % 9 else None, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    monkeypatch.setattr(lm, "SHARD", 2000)
    monkeypatch.setattr(lm, "HELD", 30_000)
    none = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    got, shards = lm._gathered(docs, F.col("text").endswith("3") == F.lit(False), none, 4)
    enc, want, seen, held = lm.encoder(), collections.Counter(), collections.Counter(), 0
    for t in texts:
        if not t.endswith("3"):
            want[tuple(i for w in t.lower().split() for i in enc.encode_ordinary(" " + w)) + (lm.END_ID,)] += 1
    assert sum(map(len, texts)) > 1_000_000 and shards > 5
    for turn in range(2):
        for r in lm._taught(got, 3, turn, 2).collect():
            salt, size, ids = np.frombuffer(r.salts, np.uint64), np.frombuffer(r.sizes, np.int64), np.frombuffer(r.pieces, np.uint16)
            ends = np.cumsum(size)
            seen.update(tuple(ids[a:b].tolist()) for a, b in zip(ends - size, ends))
            held += sum(len(x) for x, _ in lm._passes(salt, size, ids, 1))
    assert seen == want and held == sum(-(-len(x) // lm.STRIDE) * n for x, n in want.items())


def test_driver_gets_filters_in_few_jobs_and_slots_in_pieces(spark, monkeypatch):
    """A sieve is no job for each partition, and slots that come in pieces are the same."""
    sc, held = spark.sparkContext, {n: spark.conf.get(n) for n in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    names = [int(x) for x in np.random.default_rng(4).integers(0, sieve.SIEVE, 2000)]
    bits = spark.createDataFrame([(x,) for x in names], "bit long")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        sc.setJobGroup("sieve", "sieve")
        got = sieve.sieve(bits)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        for n, x in held.items():
            spark.conf.set(n, x)
    assert len(sc.statusTracker().getJobIdsForGroup("sieve")) < 10
    assert np.array_equal(np.flatnonzero(np.unpackbits(got)), np.unique(names))
    rng = random.Random(8)
    docs = spark.createDataFrame([(i, " ".join(words(rng, 60) + ["same old line again"] * 3)) for i in range(40)], "doc_id long, text string").repartition(6)
    sketch = jaccard_join.sketches(docs, "doc_id", "text", 4, 85).cache()
    whole = jaccard_join._full(sketch, 2400)
    monkeypatch.setattr(jaccard_join, "PIECE", len(whole) // 5)
    assert whole.any() and np.array_equal(jaccard_join._full(sketch, 2400), whole)
