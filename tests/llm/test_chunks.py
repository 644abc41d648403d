"""Pieces of oversized texts."""

import pytest
from hypothesis import given, settings, strategies as st

from quire.llm.chunks import cut_text, pages_of, split_oversized


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .\n\fü。", max_size=400), st.integers(5, 60), st.integers(0, 4))
def test_round_trip(text, limit, overlap):
    pieces = cut_text(text, limit, overlap)
    rebuilt, at = "", 0
    for a, b in pieces:
        assert a < b <= a + limit and at - overlap <= a <= at
        rebuilt += text[at:b]
        at = b
    assert rebuilt == text


def test_natural_boundaries_and_hard_cut():
    text = "First sentence here. " * 10
    pieces = cut_text(text, 50, 10)
    assert all(text[b - 1] == " " or b == len(text) for _, b in pieces)
    assert cut_text("x" * 95, 40, 5) == [(0, 40), (35, 75), (70, 95)]
    with pytest.raises(ValueError):
        cut_text("x", 10, 10)


def test_frame(spark):
    rows = [(1, "a" * 3000 + "\f" + "b c. " * 700, [{"number": 9}, {"number": 4}]), (2, None, None), (3, "", None), (4, "x\f" + "y" * 3001, None), (4, "x\f" + "y" * 3001, None)]
    df = spark.createDataFrame(rows, "request_id long, text string, pages array<struct<number:int>>")
    pages = pages_of(df)
    assert {(r.request_id, r.number) for r in pages.collect()} == {(1, 4), (1, 9), (3, 1), (4, 1), (4, 2)}
    out = split_oversized(pages.withColumnRenamed("number", "pieces_").withColumnRenamed("pieces_", "number"), "page_text").collect()
    assert {(r.request_id, r.number, r.pieces) for r in out if r.pieces > 1} == {(1, 9, 2), (4, 2, 2)}
    assert all(len(r.piece) <= 3000 and r.end_offset - r.start_offset == len(r.piece) for r in out)
    assert split_oversized(pages.limit(0), "page_text").count() == 0


def test_clashing_columns(spark):
    df = spark.createDataFrame([("a b", 7, "k")], "t string, piece_no int, pieces string")
    assert [(r.piece_no, r.pieces, r.piece) for r in split_oversized(df, "t").collect()] == [(0, 1, "a b")]
