"""Tokenizers, pages, lines and interval operators against plain Python."""

import re

import pytest

from quire.operators import spans

TEXTS = [(1, "Total: 12,50 EUR  paid\n\nJohn Smith, Berlin\f A1-B2 end."), (2, None), (3, ""), (4, "  \n"), (5, "ü€ 😀 x" * 2000)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(TEXTS, "doc_id long, text string").selectExpr("*", "1 as start_offset", "'x' as tokenizer")


@pytest.mark.parametrize("name", sorted(spans.PATTERNS))
def test_tokenizers(docs, name):
    got = {(r.doc_id, r.start_offset, r.end_offset) for r in spans.tokenize(docs, "doc_id", "text", name).collect()}
    want = set()
    for i, t in TEXTS:
        for m in re.finditer(spans.PATTERNS[name], t or ""):
            s, e = m.span(1) if m.re.groups else m.span()
            if e > s and not re.search("[\n\f]", t[s:e]):
                want.add((i, s, e))
    assert got == want


def test_offsets_cut_the_text(docs):
    text = dict(TEXTS)
    for r in spans.tokenize(docs, "doc_id", "text", "whitespace").collect():
        assert text[r.doc_id][r.start_offset : r.end_offset] == r.offset_string
    for r in spans.pages(docs, "doc_id", "text").collect():
        assert text[r.doc_id][r.start_offset : r.end_offset] == r.page_text
    for r in spans.lines(docs, "doc_id", "text").collect():
        assert text[r.doc_id][r.start_offset : r.end_offset] == r.line_text
    assert spans.pages(docs, "doc_id", "text").filter("doc_id = 1").count() == 2
    assert spans.tokenize(docs.limit(0), "doc_id", "text", "whitespace").count() == 0


def test_list_tokenizer_first_wins(docs):
    out = spans.list_tokenizer(docs, "doc_id", "text", ["numbers", "whitespace"]).filter("doc_id = 1").collect()
    assert len({(r.start_offset, r.end_offset) for r in out}) == len(out)
    assert {r.offset_string for r in out} >= {"Total:", "12,50", "end."}


def test_missing_offsets(spark):
    covered = spark.createDataFrame([(1, 2, 4), (1, 3, 6), (1, 6, 7), (2, 0, 5)], "doc_id long, start_offset long, end_offset long")
    sizes = spark.createDataFrame([(1, 10), (2, 5), (3, 4), (4, 0)], "doc_id long, length int")
    got = {tuple(r) for r in spans.missing_offsets(covered, sizes, "doc_id").collect()}
    assert got == {(1, 0, 2), (1, 7, 10), (3, 0, 4)}


def test_merge_contain_locate_and_neighbours(spark):
    text = spark.createDataFrame([(1, "aa bb      cc\ndd")], "doc_id long, text string")
    t = spans.tokenize(text, "doc_id", "text", "whitespace").selectExpr("*", "'l' as label", "0.5 as confidence")
    merged = {(r.start_offset, r.end_offset, r.parts) for r in spans.merge_horizontal(t, text, "doc_id", ["doc_id", "label"]).collect()}
    assert merged == {(0, 5, 2), (11, 13, 1), (14, 16, 1)}
    gold = spark.createDataFrame([(1, 0, 5, "g"), (1, 1, 2, "h")], "doc_id long, start_offset long, end_offset long, label string")
    assert {(r.start_offset, r.label) for r in spans.contained_in(t.drop("label"), gold, "doc_id", "label").collect()} == {(0, "g"), (3, "g"), (11, None), (14, None)}
    lines = spans.lines(text, "doc_id", "text").select("doc_id", "line_index", "start_offset", "end_offset")
    near = {r.start_offset: (r.line_index, r.l_dist0, r.r_text0) for r in spans.neighbours(spans.locate(t, "doc_id", lines, "line_index"), "doc_id", "line_index").collect()}
    assert near == {0: (0, 100000, "bb"), 3: (0, 1, "cc"), 11: (0, 6, ""), 14: (1, 100000, "")}


def test_vocabulary(spark):
    t = spark.createDataFrame([(w,) for w in "b b b a a c d d <unk>".split()] + [(None,)], "token string")
    out = {r.token: r.idx for r in spans.vocabulary(t, "token", max_size=3).collect()}
    assert out == {"<unk>": 0, "<pad>": 1, "b": 2, "a": 3, "d": 4}
    assert spans.vocabulary(t.limit(0), "token").count() == 2
