import collections
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from knotwork.llm import decontam, mixing, queries, suffix_dedup, toxicity

from .conftest import SCHEMA, make_rows, words
from .test_textual import brute_components, brute_repeats

#: Names that operators use inside, as columns of the input.
CLASHES = ["predicted", "leaks", "row", "key", "t", "whole", "first", "last", "kept", "copy_no", "many", "taken", "copy", "comp", "node", "worst_start", "id_", "n_hits", "repeated"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables of a small corpus with toxic documents, copies, passages, leaks, nulls and clashing columns."""
    rng, rows, labels = random.Random(17), [list(r) for r in make_rows()], []
    items = [" ".join(words(rng, 25)) for _ in range(4)]
    for i in range(120):
        w = words(rng, rng.randint(40, 160))
        toxic = i % 4 == 0
        if toxic:
            w[20:20] = ["you", "vilest", rng.choice(["scumbag", "fool"])]
        if i % 9 == 5:
            w[10:10] = items[i % 4].split()
        rows.append([200 + i, " ".join(w) + ".", "en", "abc"[i % 3], 0, "x", "y"])
        labels.append((200 + i, int(toxic)))
        if i % 6 == 1:
            near = list(w)
            near[-3] = "changed"
            rows.append([400 + i, " ".join(near) + ".", "en", "b", 0, "x", "y"])
    rows += [[None, rows[60][1], "en", "a", 0, "x", "y"]]
    df = spark.createDataFrame([tuple(r) for r in rows], SCHEMA)
    for c in CLASHES:
        df = df.withColumn(c, F.lit(f"own {c}"))
    path = str(tmp_path_factory.mktemp("corpus"))
    df.repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def collected(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_every_stage_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").cache()
    before = collected(docs)

    def whole(df):
        assert df.columns == docs.columns
        assert df.where(" or ".join(f"{c} <> 'own {c}'" for c in CLASHES)).count() == 0
        return collected(df)

    model = toxicity.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"), train_rows=queries.remainder(4) != 2)
    narrow = toxicity.score(docs.select("doc_id", "text"), model)
    bad = collections.Counter(r.doc_id for r in narrow.collect() if r.predicted)
    got = whole(corpus_pipeline.toxicity_stage(spark, docs, folder))
    assert collections.Counter(got) == collections.Counter(x for x in before if x[0] not in bad)
    assert {200 + i for i in range(0, 120, 4)} <= set(bad) and len(bad) <= 32

    # brute force over distinct rows, numbered so that the smallest id comes first and null ones last
    distinct = sorted(set(before), key=lambda x: (x[0] is None, x[0] or 0, x[1] or ""))
    comps = {i: c for i, _, c in brute_components([(k, t) for k, (_, t) in enumerate(distinct)], k=5, percent=80)}
    got = whole(corpus_pipeline.near_duplicate_stage(spark, docs, folder))
    assert sorted(map(str, got)) == sorted(str(x) for k, x in enumerate(distinct) if comps[k] == k)

    removed = brute_repeats([(k, t) for k, (_, t) in enumerate(before)])
    got = whole(corpus_pipeline.repeated_passage_stage(spark, docs, folder))
    assert len(got) == len(before)
    assert sum(len((t or "").encode()) for _, t in got) == pytest.approx(sum(n - gone for _, n, gone, _, _ in removed), abs=3 * len(before))
    assert collections.Counter(i for i, _ in got) == collections.Counter(i for i, _ in before)
    untouched = {before[k] for k, _, gone, _, _ in removed if gone == 0}
    assert untouched <= set(got)

    leaks = {r.doc_id for r in decontam.leak_table(docs, spark.read.parquet(f"{folder}/benchmark.parquet")).collect()}
    got = whole(corpus_pipeline.decontamination_stage(spark, docs, folder))
    assert collections.Counter(got) == collections.Counter(x for x in before if x[0] not in leaks)
    assert leaks == {200 + i for i in range(120) if i % 9 == 5} | {400 + i for i in range(120) if i % 9 == 5 and i % 6 == 1}

    mixed = corpus_pipeline.mixing_stage(spark, docs, folder)
    assert set(mixed.columns) == set(docs.columns)
    want = collections.Counter()
    for r in mixing.mix_rows(docs).collect():
        want[r.doc_id] += r.copies
    assert collections.Counter(r.doc_id for r in mixed.collect()) == +want


def test_run_equals_its_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder).cache()
    got, want = corpus_pipeline.run(spark, folder), docs
    assert got.columns == want.columns
    assert collections.Counter(map(str, collected(got))) == collections.Counter(map(str, collected(want))) and got.count() > 100
    texts = [t for _, t in collected(got.dropDuplicates(["doc_id"])) if t]
    assert not any("vilest" in t for t in texts)
    assert all(r.n_removed == 0 for r in suffix_dedup.repeat_table(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")).collect())


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES])
def test_stages_of_empty_and_null_tables(spark, folder, empty, nulls, stage):
    assert stage(spark, empty, folder).count() == 0
    # two of the four rows are equal, and one stays of them in the near-duplicate stage; nulls have no words to mix
    many = {"near_duplicate_stage": 3, "mixing_stage": 2}.get(stage.__name__, 4)
    assert stage(spark, nulls, folder).count() == many


def test_repeated_rows_leave_one_document(spark):
    rng = random.Random(3)
    text = [" ".join(words(rng, 100)) for _ in range(5)]
    near = text[2].split()
    near[50] = "changed"
    rows = [(i, t, "en", "a", len(t), None, None) for i, t in ((1, text[0]), (1, text[0]), (1, text[0]), (None, text[1]), (None, text[1]), (None, text[2]), (7, " ".join(near)), (8, text[3]), (8, text[4]), (9, None), (10, ""), (11, "one two"), (None, None), (None, None)) for t in [t or ""]]
    rows = [(i, None if i in (None, 9) and not t else t, *rest) for i, t, *rest in rows]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = {(1, text[0]), (None, text[1]), (7, " ".join(near)), (8, text[3]), (8, text[4]), (9, None), (10, ""), (11, "one two"), (None, None)}
    stage = corpus_pipeline.near_duplicate_stage(spark, docs, "")
    assert stage.columns == docs.columns
    kept = [(r.doc_id, r.text) for r in stage.collect()]
    assert len(kept) == len(want) and set(kept) == want
    passed = [(r.doc_id, r.text) for r in corpus_pipeline.repeated_passage_stage(spark, stage, "").collect()]
    assert len(passed) == len(want) and set(passed) == want
    assert corpus_pipeline.near_duplicate_stage(spark, docs.limit(0), "").count() == 0
