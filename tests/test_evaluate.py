"""Evaluation: joins, flags, sweeps, votes."""

import random

import pytest

from quire.operators import categorize, evaluate, split
from quire.plans import queries


def frame(spark, rows, extra=""):
    return spark.createDataFrame(rows, "doc_id long, start_offset long, end_offset long, label string" + extra)


@pytest.fixture(scope="module")
def compared(spark):
    gold = frame(spark, [(1, 0, 3, "a"), (1, 4, 6, "b"), (1, 8, 9, None), (2, 0, 3, "a")])
    pred = frame(spark, [(1, 0, 3, "a", 0.9), (1, 4, 6, "a", 0.4), (1, 10, 12, "b", 0.8), (2, 0, 3, "a", None)], ", confidence double")
    return evaluate.compare_strict(gold, pred, ["doc_id", "start_offset", "end_offset"])


def test_strict(compared):
    c = evaluate.with_flags(compared, 0.5).agg(*evaluate.counts()).first()
    assert (c.tp, c.fp, c.fn) == (1, 1, 2)


def test_sweep_and_best(compared):
    # A row of two labels counts, with all its flags, for both.
    sweep = {(r.label, r.threshold): (r.tp, r.fp, r.fn) for r in evaluate.threshold_sweep(compared, thresholds=(0.1, 0.5, 0.95)).collect()}
    assert sweep["a", 0.1] == (1, 1, 2) and sweep["a", 0.5] == (1, 0, 2) and sweep["a", 0.95] == (0, 0, 3) and sweep["b", 0.5] == (0, 1, 1)
    best = {r.label: r.threshold for r in evaluate.best_threshold(evaluate.threshold_sweep(compared, thresholds=(0.1, 0.5, 0.6))).collect()}
    assert best == {"a": 0.5, "b": 0.1}


def test_overlapping(spark):
    gold = frame(spark, [(1, 0, 5, "a"), (1, 20, 25, "a")])
    pred = frame(spark, [(1, 5, 9, "a"), (1, 40, 41, "b")])
    c = evaluate.compare_overlapping(gold, pred, "doc_id").agg(*evaluate.counts()).first()
    assert (c.tp, c.fn) == (1, 1)
    assert evaluate.overlapping_false_positives(frame(spark, [(1, 4, 6, "x"), (1, 5, 6, "x"), (2, 0, 9, "x")]), gold, "doc_id").count() == 1


def test_overlapping_of_many_spans(spark, tmp_path):
    rng = random.Random(7)

    def some(n):
        return sorted({(d, a, a + rng.choice((1, 5, 30, 200)), rng.choice("ab")) for d, a in ((rng.randrange(2), rng.randrange(3000)) for _ in range(n))})

    gold, pred = some(60), some(60)
    pairs = sorted((g, p) for g in gold for p in pred if g[0] == p[0] and g[3] == p[3] and p[1] <= g[2] and p[2] >= g[1])
    order = lambda x: (*x[0][1:3], *x[1][1:3])
    kept = [x for x in pairs if x == min((y for y in pairs if y[0] == x[0]), key=order) or x == min((y for y in pairs if y[1] == x[1]), key=order)]
    want = (len(kept), len(set(pred) - {p for _, p in pairs}), len(set(gold) - {g for g, _ in pairs}))
    c = evaluate.compare_overlapping(frame(spark, gold), frame(spark, pred), "doc_id").agg(*evaluate.counts()).first()
    assert (c.tp, c.fp, c.fn) == want and min(want) > 0
    # Short spans take part in the query.
    docs = spark.createDataFrame([(1, "ab cd, ef")], "doc_id long, text string").selectExpr("*", "'de' as lang", "1L as category_id", "timestamp'2024-01-01' as updated_at")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert tuple(queries.overlapping_comparison(spark, str(tmp_path)).first()) == (2, 1, 1)


def test_votes_and_priority(spark):
    rows = spark.createDataFrame([("g", "x", 0.2), ("g", "y", 0.3), ("g", "x", 0.1), (None, "z", 1.0), ("h", None, 1.0)], "g string, v string, w double")
    assert {r.g: r.v for r in evaluate.weighted_vote(rows, "g", "v", "w").collect()} == {"g": "x", None: "z"}
    assert {r.g: r.v for r in evaluate.weighted_vote(rows, "g", "v").collect()} == {"g": "x", None: "z"}
    flagged = spark.createDataFrame([("s", 1, False, True, False), ("s", 2, True, False, False), (None, 3, True, False, False)], "k string, o int, true_positive boolean, false_positive boolean, false_negative boolean")
    assert [r.o for r in evaluate.prioritize(flagged, ["k"], ["o"]).collect()] == [2]


def test_classes(spark):
    rows = spark.createDataFrame([(1, 1), (1, 2), (2, 2), (3, None)], "actual int, predicted int")
    out = {r["class"]: (r.tp, r.fp, r.fn, r.tn) for r in evaluate.per_class(rows).collect()}
    assert out == {1: (1, 0, 1, 2), 2: (1, 1, 0, 2), 3: (0, 0, 1, 3)}
    assert {(r.actual, r.predicted): r.n for r in evaluate.confusion(rows, [1, 2]).collect()} == {(1, 1): 1, (1, 2): 1, (2, 2): 1}


def test_categories_and_splitting(spark):
    pages = spark.createDataFrame([(1, 0, "An Invoice\nTotal 5"), (1, 1, "more"), (2, 0, "nothing"), (3, 0, "delivery note and invoice")], "doc_id long, page_index int, page_text string")
    names = spark.createDataFrame([(7, "invoice"), (8, "delivery note"), (0, "more"), (9, None)], "category_id long, fallback_name string")
    got = {(r.doc_id, r.page_index): r.category_id for r in categorize.by_name(pages, names, "doc_id").collect()}
    assert got == {(1, 0): 7, (1, 1): 7, (2, 0): None, (3, 0): 8}
    kinds = pages.selectExpr("*", "'k' as kind")
    lines = split.exclusive_first_page_lines(kinds.filter("doc_id = 1"), "doc_id", "kind")
    assert {r.line for r in lines.collect()} == {"An Invoice", "Total 5"}
    first = split.predict_first_pages(kinds.filter("doc_id < 3"), "doc_id", lines, "kind")
    assert {(r.doc_id, r.page_index) for r in first.filter("is_first_page").collect()} == {(1, 0)}
    parts = split.sub_documents(split.group_pages(first, "doc_id"), "doc_id")
    assert {(r.doc_id, r.text, r.n_pages) for r in parts.collect()} == {(1, "An Invoice\nTotal 5\fmore", 2), (2, "nothing", 1)}


def test_grouped_vote(spark):
    rows = [
        (1, "a", True, True, 0.9), (1, "b", True, True, 0.5), (1, "b", True, True, 0.3), (1, "c", False, False, 1.0),  # eligible ones by confidence
        (2, "a", True, True, 0.0), (2, "b", True, True, None), (2, "b", True, True, 0.0),  # eligible ones by number
        (3, None, True, True, 0.9), (3, "a", False, True, 0.9),  # eligible ones without a target
        (4, "a", False, True, 0.2), (4, "b", False, False, 0.7),  # nobody is eligible
        (5, None, False, False, None), (5, None, False, False, None), (5, "a", False, False, None),  # nothing speaks
        (None, "z", True, True, 0.9), (6, "b", True, True, 0.5), (6, "a", True, True, 0.5),
    ]
    df = spark.createDataFrame(rows, "g int, t string, above_threshold boolean, is_matched boolean, confidence_predicted double")
    out = evaluate.grouped_vote(df, "g", "t").collect()
    assert {r.g: r.t_vote for r in out} == {1: "a", 2: "b", 3: None, 4: "b", 5: None, None: "z", 6: "a"}
    assert len(out) == len(rows) and not [r for r in out if r.g in (3, 5) and r.is_correct_t]
    assert evaluate.grouped_vote(df.limit(0), "g", "t").count() == 0


def test_confusion_table(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (2, None), (0, 0), (9, 1)], "actual int, predicted int")
    got = {r.actual: r.asDict() for r in evaluate.confusion_table(df, [0, 1, 2]).collect()}
    assert (got[1]["1"], got[1]["2"], got[2]["2"], got[0]["0"]) == (1, 1, 0, 1) and set(got) == {0, 1, 2}


def test_categories(spark):
    from quire.operators import categorize, layout
    from quire.operators import spans as span_ops

    rows = spark.createDataFrame([(1, 0, 5, 0.9, False), (1, 0, 6, 0.1, True), (1, 1, 5, None, False), (1, 1, 7, None, True)], "d int, p int, category_id long, confidence double, chosen boolean")
    assert {(r.p, r.category_id) for r in categorize.best_per_page(rows, ["d", "p"], human="chosen").collect()} == {(0, 6), (1, 7)}
    stored = spark.createDataFrame([(1, 7, 0.4), (1, 5, 0.3), (2, 5, 0.2)], "d int, category_id long, confidence double")
    assert {(r.d, r.category_id): round(r.confidence, 3) for r in categorize.document_confidence(rows, "d", "p", stored=stored).collect()} == {(1, 5): 0.45, (1, 6): 0.05, (1, 7): 0.4, (2, 5): 0.2}
    nan = float("nan")
    pages = spark.createDataFrame([(1, [0.2, 0.8]), (1, [0.6, 0.4]), (1, [nan, nan]), (2, [nan, nan]), (3, [0.5, 0.5]), (4, None)], "d int, probabilities array<double>")
    assert {r.d: r.category for r in categorize.mean_probabilities(pages, "d").collect()} == {1: 1, 2: None, 3: 0, 4: None}
    text = spark.createDataFrame([(1, "ab cd ef")], "doc_id long, text string")
    s = spark.createDataFrame([(1, 0, 2, 0.9), (1, 3, 5, 0.8), (1, 6, 8, 0.1)], "doc_id long, start_offset long, end_offset long, confidence double")
    assert {(r.start_offset, r.end_offset) for r in span_ops.merge_horizontal(s, text, "doc_id", ["doc_id"], threshold=0.5).collect()} == {(0, 5), (6, 8)}
    chars = spark.createDataFrame([(1, 0, i, c, 10.0 * i, 10.0 * i + 9, 0.0, 9.0) for i, c in enumerate("abc")], "page int, line_index int, char_index long, text string, x0 double, x1 double, y0 double, y1 double")
    sel = spark.createDataFrame([(1, 7, 5.0, 30.0, 0.0, 10.0)], "page int, selection_id int, x0 double, x1 double, y0 double, y1 double")
    assert [(r.start_offset, r.end_offset, r.text, r.x1) for r in layout.selected_spans(chars, sel, ["page"], tolerance=0.0).collect()] == [(1, 3, "bc", 29.0)]


def test_many_names_are_found_alike(spark, monkeypatch):
    from quire.operators import categorize

    pages = spark.createDataFrame([(1, 0, "Eine RECHNUNG"), (1, 1, "x"), (2, 0, "kreditrechnung und rechnung"), (3, 0, None)], "doc_id long, page_index int, page_text string")
    names = spark.createDataFrame([(7, "rechnung"), (8, "kreditrechnung"), (9, "rechnung"), (0, "x"), (5, None)], "category_id long, fallback_name string")
    few = {tuple(r) for r in categorize.by_name(pages, names, "doc_id").collect()}
    monkeypatch.setattr(categorize, "FEW_NAMES", 0)
    assert {tuple(r) for r in categorize.by_name(pages, names, "doc_id").collect()} == few == {(1, 0, 7), (1, 1, 7), (2, 0, 8), (3, 0, None)}
    assert categorize.by_name(pages, names.limit(0), "doc_id").filter("category_id is not null").count() == 0
