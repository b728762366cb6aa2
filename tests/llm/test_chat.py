"""Perspective rotation against plain Python and DuckDB."""

import duckdb
import pytest

from knotwork.llm import chat

ROWS = [
    (1, 0, "system", "be kind", "x"), (1, 1, "ann", "hi", "x"), (1, 2, "bob", "hello ann", "x"), (1, 3, "cy", None, "x"), (1, 3, "ann", "", "x"), (1, 3, "ann", "", "x"),
    (2, None, None, "who?", "x"), (2, 5, "ann", "é", "x"), (3, 0, "system", "alone", "x"), (None, 0, "ann", "lost", "x"), (4, 300, "ann", "b", "x"), (4, 1, "bob", "a", "x"), (4, 700, "bob", "c", "x"),
]


@pytest.fixture(scope="module")
def turns(spark):
    return spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string, mask string")


def test_rotation(turns):
    got = chat.render(chat.rotate(turns)).collect()
    assert {(r.conv_id, r.perspective) for r in got} == {(1, "ann"), (1, "bob"), (1, "cy"), (2, "ann"), (2, "unknown"), (4, "ann"), (4, "bob")}
    one = next(r for r in got if (r.conv_id, r.perspective) == (1, "bob"))
    assert one.text.startswith("<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>user name=ann\nhi<|im_end|>\n<|im_start|>assistant\nhello ann<|im_end|>\n")
    for r in got:
        for s in r.spans:
            assert r.text[s.start : s.end].startswith("<|im_start|>assistant\n") and r.text[s.start : s.end].endswith("<|im_end|>\n")
    assert next(r for r in got if (r.conv_id, r.perspective) == (1, "ann")).n_turns == 6
    four = next(r for r in got if (r.conv_id, r.perspective) == (4, "ann"))
    assert [four.text.index(x) for x in ("a<|", "b<|", "c<|")] == sorted(four.text.index(x) for x in ("a<|", "b<|", "c<|"))


def test_rotation_matches_sql(turns):
    conversations = turns.toPandas().astype({"conv_id": "Int64", "turn": "Int64"})  # noqa: F841
    con = duckdb.connect()
    con.register("conversations", conversations)
    cols = ["conv_id", "perspective", "turn", "speaker", "as_role", "as_name", "segment", "start", "size", "mask"]
    want = con.sql(chat.ROTATE_SQL).df()[cols].astype(object)
    got = chat.rotate(turns).toPandas()[cols].astype(object)
    clean = lambda df: sorted((tuple(None if x is None or str(x) in ("nan", "<NA>", "None") else x for x in r) for r in df.values.tolist()), key=repr)
    norm = lambda rows: [tuple(int(x) if isinstance(x, float) else x for x in r) for r in rows]
    assert sorted(norm(clean(got)), key=repr) == sorted(norm(clean(want)), key=repr)


def test_empty(turns):
    assert chat.rotate(turns.limit(0)).count() == 0
