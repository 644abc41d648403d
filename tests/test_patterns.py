"""The regular expression engine: groups, candidates, proposals, evaluation, choice and context."""

import re

import pytest

from quire.operators import label_patterns as lp, spans


def test_matches():
    def got(pattern, text, **options):
        return list(lp.matches(lp.compile_pattern(pattern), text, **options))

    assert got(r" ([^ ]*) ", " my name ", overlapped=True) == [("1", 1, 3), ("0", 0, 4), ("1", 4, 8), ("0", 3, 9)]
    assert got(r"(?P<Label_8_W>a)|(?P<Label_86>b)", "ab", group="Label_8", keep_full_match=False) == [("Label_8_W", 0, 1), ("Label_86", 1, 2)]
    assert got(r"(?P<Label_8>a)|(?P<Label_86>b)", "ab", group="Label_8", exact=True) == [("Label_8", 0, 1)]
    assert got(r"(?P<8_a>x)y?", "xy", keep_full_match=False) == [("_8_a", 0, 1)]
    assert got(r"x*", "ab") == [] and got("b", "ab") == [("0", 1, 2)]


def test_frames(spark):
    df = spark.createDataFrame([(1, "a1b22"), (2, None), (3, ""), (1, "a1b22")], "doc_id long, text string").selectExpr("*", "'x' as value")
    found = sorted(tuple(r) for r in lp.find_matches(df, "doc_id", "text", r"(\d)\d*").collect())
    assert found[:2] == [(1, "0", "1", 1, 2), (1, "0", "1", 1, 2)] and len(found) == 8
    pieces = sorted((r.doc_id, r.piece_no, r.is_candidate, r.value) for r in lp.candidates(df, "doc_id", "text", r"\d+").distinct().collect())
    assert pieces == [(1, 0, False, "a"), (1, 1, True, "1"), (1, 2, False, "b"), (1, 3, True, "22"), (1, 4, False, ""), (3, 0, False, "")]


@pytest.mark.parametrize("text", ["Ab 12", "a.b*c", "Größe  7", "x\ny", "ÄÖ-ü"])
def test_suggestions_match(text):
    for options in ({"numbers": False}, {}, {"characters": True}):
        assert re.fullmatch(lp.suggested(text, **options), text)
    assert lp.suggested("Ab 12", True) == r"[A-ZÄÖÜ][a-zäöüß][ ]{1,2}\d\d" and lp.plausible("(", "x") == "" and lp.merged(["a", "bbb", "cc"]) == "(?:bbb|cc|a)"


def test_learning(spark):
    texts = [f"Betrag {i}{i},50 EUR\nNummer {i}7 und Datum 0{i}.05.2021" for i in range(1, 8)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(90, None), (91, "")], "doc_id long, text string")
    amounts = spans.regex_spans(docs, "doc_id", "text", r"\d\d,\d\d").selectExpr("*", "'amount' as label")
    numbers = spans.regex_spans(docs, "doc_id", "text", r"\d7(?= und)").selectExpr("*", "'number' as label")
    gold = amounts.unionByName(numbers)
    kinds = {(r.label, r.pattern): r.quality for r in lp.proposals(gold).collect()}
    assert kinds["amount", r"\d\d,\d\d"] == 1 and kinds["amount", "11,50"] == 0
    judged = {r.pattern: r for r in lp.evaluate(docs, gold, lp.proposals(gold).filter("label = 'amount'")).collect()}
    best = judged[r"\d\d,\d\d"]
    assert (best.findings, best.correct, best.annotations, best.documents, best.f1, best.document_recall) == (7, 7, 7, 7, 1.0, 1.0)
    plain = {(r.label, r.pattern): r.new for r in lp.learn_patterns(docs, gold, context=False).collect()}
    assert plain["amount", r"\d\d,\d\d"] == 7 and len([k for k in plain if k[0] == "amount"]) == 1
    full = lp.learn_patterns(docs, gold)
    chosen = {r.label: r for r in full.filter("rank = 1").collect()}
    assert chosen["number"].new == 7 and len(re.findall(chosen["number"].pattern, texts[0])) == 1
    assert lp.learn_patterns(docs, gold.limit(0)).count() == 0


def test_saved_patterns(spark, tmp_path):
    best = spark.createDataFrame([("a", "x", 1, 3), ("b", "y", 1, 2)], "label string, pattern string, rank int, new long")
    lp.save_patterns(best, str(tmp_path / "p"))
    assert {(r.label, r.pattern) for r in lp.load_patterns(spark, str(tmp_path / "p")).collect()} == {("a", "x"), ("b", "y")}
