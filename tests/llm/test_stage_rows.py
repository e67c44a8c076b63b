"""Stages judge each row by itself: repeated and missing keys, clashing names, distant contexts."""

import pytest

import corpus_pipeline
from conftest import passage
from loomspan.llm import decontam, pii, simhash

STAGES = dict(corpus_pipeline.STAGES)
LEAK = passage(6, 20)
#: Names that the stages use inside.
NAMES = "key row doc long none short decoded __text _key _added _text content _content added own of _doc __key _words _lines _bits _hashes _row component root spans base label part hash item words token_ids"


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    made = tmp_path_factory.mktemp("bench")
    spark.createDataFrame([(0, LEAK)], "item_id long, text string").write.parquet(f"{made}/benchmark.parquet")
    return f"file://{made}"


def texts(df):
    return sorted(((-1 if r.doc_id is None else r.doc_id), r.text or "", r.lang or "") for r in df.collect())


def test_decontamination_takes_the_leaking_rows_alone(spark, folder):
    leak, fine = f"{passage(1)} {LEAK} {passage(2)}", passage(3)
    rows = [(1, leak, "a"), (1, fine, "b"), (None, leak, "c"), (None, passage(4), "d"), (None, None, "e"), (2, passage(5), "f"), (1, leak, "g")]
    assert texts(decontam.stage(spark, table(spark, rows), folder)) == texts(table(spark, [r for r in rows if r[1] != leak]))


def test_near_dedup_takes_the_near_copies_alone(spark):
    one, other, third = passage(1, 120), passage(21, 120), passage(33, 90)
    near = one + " tail"
    rows = [(1, one, "a"), (2, near, "b"), (2, other, "c"), (None, near, "d"), (None, third, "e"), (None, third, "f"), (3, other, "g"), (1, one, "h")]
    got = texts(simhash.stage(spark, table(spark, rows), ""))
    assert [(k, t) for k, t, _ in got] == sorted([(1, one), (2, other), (-1, third)])


def test_near_dedup_of_one_key_with_many_texts(spark):
    """All rows have one key, or none; each text that is unlike the others stays."""
    for key in (7, None):
        rows = [(key, passage(100 + i, 60), "x") for i in range(40)] + [(key, passage(100 + i, 60) + " end", "y") for i in range(5)]
        assert simhash.stage(spark, table(spark, rows), "").count() == 40


@pytest.mark.parametrize("name", list(STAGES))
def test_no_name_clashes(spark, folder, name):
    docs = table(spark, [(1, passage(1, 80), "a"), (2, passage(2, 80), "b"), (2, "mail a.b@example.com", None), (None, None, None)])
    for c in NAMES.split():
        docs = docs.selectExpr("*", f"'{c}!' AS `{c}`")
    out = STAGES[name](spark, docs.selectExpr("*", "1 AS `a.b`"), folder)
    kept = [c for c in docs.columns if c != "token_ids"]
    assert [c for c in out.columns if c not in ("token_ids", "a.b")] == kept
    assert all(r[c] == f"{c}!" for r in out.collect() for c in NAMES.split() if c != "token_ids")


def test_contexts_at_any_distance():
    label, long = "customer number ", "w" * 5_000
    for gap in (" ", " " * 1_000, "\n" * 90_000):
        text = f"our {label}{gap}555001001{gap}{long} end"
        at = text.index("555001001")
        assert pii.patterns(text, at, at + 9) == ["2 customer number", f"1 number {long}"]
    text = f"see {long} 555001001"
    assert pii.patterns(text, len(text) - 9, len(text)) == [f"2 see {long}", f"1 {long} $"]


def test_discovery_per_text_not_per_key(spark):
    """A discovered place belongs to one text of a key, and to each text without a key."""
    rows = [(i, f"call the number: +1 555 000 {1000 + i} now", "s") for i in range(6)]
    rows += [(50, "call the number: 555001001 now", "a"), (50, "nothing here", "b"), (None, "my 555001001", "c"), (None, "x " * 40 + "555001001", "d"), (None, "clean", "e")]
    out = {r.lang: r.text for r in pii.masked(table(spark, rows)).collect()}
    assert out["a"] == "call the number: [PHONE] now" and out["b"] == "nothing here" and out["e"] == "clean"
    assert out["c"] == "my [PHONE]" and out["d"].endswith(" [PHONE]")
