"""Views, violations, slices, merging like a template and interval joins on long documents."""

import pytest

from pyspark.sql import functions as F

from quire.operators import evaluate, merge, spans, views

SPAN = "doc_id long, annotation_id long, set_id long, label string, start_offset long, end_offset long, is_correct boolean, confidence double, threshold double"
ROWS = [
    (1, 10, 1, "a", 0, 4, True, None, 0.5), (1, 11, 1, "b", 6, 9, False, 0.9, 0.5), (1, 11, 1, "b", 12, 15, False, 0.9, 0.5), (1, 12, 2, "a", 20, 22, False, 0.2, 0.5), (1, 13, None, "a", 20, 22, False, None, 0.5),
    (1, 14, 2, "c", 30, 31, False, 0.0, 0.0), (2, 10, 1, "a", 5, 7, None, 0.5, 0.5),
]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, SPAN)


def test_documents(spark):
    d = spark.createDataFrame([(1, 2, 7), (2, 3, 7), (3, 0, 8), (None, 2, 7), (5, None, 7), (6, 4, None)], "doc_id long, dataset_status int, category_id long")
    ids = lambda df: {r.doc_id for r in df.collect()}
    assert ids(views.documents_in(d, "training")) == {1} and ids(views.documents_in(d, "virtual")) == {None, 5} and ids(views.documents_in(d, "excluded")) == {6}
    assert ids(views.category_documents(d, 7, "test")) == {2}
    assert views.lookup(d, "doc_id", 3).first().category_id == 8
    for value in (99, 7):
        with pytest.raises(IndexError):
            views.lookup(d, "category_id", value)


def test_annotations(rows):
    def got(**options):
        return [(r.doc_id, r.annotation_id) for r in views.annotations(rows, **options).orderBy("doc_id", "place").collect()]

    assert got() == [(1, 10)]
    assert got(use_correct=False) == [(1, 10), (1, 11), (1, 12), (1, 13), (1, 14), (2, 10)]
    assert got(use_correct=False, ignore_below_threshold=True) == [(1, 10), (1, 11), (2, 10)]
    assert got(use_correct=False, start=9, end=13) == [(1, 11)] and got(use_correct=False, start=9, end=12) == []
    assert got(use_correct=False, label="a", start=-5, end=21) == [(1, 10), (1, 12), (1, 13), (2, 10)]
    assert views.annotations(rows.limit(0)).count() == 0


def test_spans_sets_and_pages(spark, rows):
    texts = spark.createDataFrame([(1, "abcd efgh\nijkl mnop\fqrst uvwx yz"), (2, "0123456789"), (3, None)], "doc_id long, text string")
    one = views.distinct_spans(rows).filter("start_offset = 20").collect()
    assert len(one) == 1 and one[0].annotation_id == 12
    lines = spans.lines(texts, "doc_id", "text").select("doc_id", "line_index", "start_offset", "end_offset")
    sets = {(r.doc_id, r.set_id): (r.start_offset, r.end_offset, r.annotations, r.first_line) for r in views.annotation_sets(rows, lines).collect()}
    assert sets == {(1, 1): (0, 15, 2, 0), (1, 2): (20, 31, 2, 2), (2, 1): (5, 7, 1, 0)}
    pages = spans.pages(texts, "doc_id", "text").select("doc_id", "page_index", "start_offset", "end_offset")
    assert {(r.page_index, r.set_id) for r in views.page_sets(rows.filter("doc_id = 1"), pages).collect()} == {(0, 1), (1, 2)}
    text = {r.doc_id: r.text for r in texts.collect()}
    made = sorted((r.doc_id, r.start_offset, r.end_offset, r.label) for r in views.filled(rows.filter("start_offset < 16"), texts).collect())
    assert "".join(text[1][a:b] for d, a, b, _ in made if d == 1) == text[1] and (1, 9, 10, "NO_LABEL") in made and (1, 10, 12, "NO_LABEL") in made and (2, 7, 10, "NO_LABEL") in made


def test_violations(spark):
    texts = spark.createDataFrame([(1, "ab\ncd")], "doc_id long, text string")
    rows = spark.createDataFrame([(1, 0, 2), (1, 0, 4), (1, 3, 9), (1, 4, 4), (1, None, 3), (7, 0, 1)], "doc_id long, start_offset long, end_offset long")
    judged = views.span_violations(rows, texts.select("doc_id", F.length("text").alias("length")), spans.lines(texts, "doc_id", "text"))
    got = {(r.doc_id, r.start_offset, r.end_offset): r.violation for r in judged.collect()}
    assert got == {(1, 0, 2): None, (1, 0, 4): "lines", (1, 3, 9): "outside", (1, 4, 4): "empty", (1, None, 3): "empty", (7, 0, 1): "outside"}
    assert views.strict(judged.filter("violation is null")).count() == 1
    with pytest.raises(Exception, match="invalid"):
        views.strict(judged).collect()


def test_boxes_and_pages(spark):
    chars = [(1, 0, 0, i, c, float(i), i + 1.0, -1.0, 5.0) for i, c in enumerate("ab c")] + [(1, 0, 1, 5, " ", 0.0, 1.0, 0.0, 1.0)]
    boxes = spark.createDataFrame(chars, "doc_id long, page_index int, line_index int, char_index long, text string, x0 double, x1 double, y0 double, y1 double")
    assert [tuple(r) for r in views.page_lines(boxes, ["doc_id", "page_index"]).collect()] == [(1, 0, 0, 0, 4)]
    got = {(r.start_offset, r.end_offset): (r.x0, r.x1, r.y0) for r in views.span_boxes(spark.createDataFrame([(1, 0, 3), (1, 3, 4), (1, 8, 9)], "doc_id long, start_offset long, end_offset long"), boxes).collect()}
    assert got == {(0, 3): (0.0, 2.0, 0.0), (3, 4): (3.0, 4.0, 0.0), (8, 9): (None, None, None)}
    pages = spark.createDataFrame([(1, 0, "first"), (1, 1, " \n"), (1, 2, "third"), (1, 3, None)], "doc_id long, page_index int, page_text string")
    assert [(r.is_blank, r.previous_text) for r in views.previous_pages(pages).orderBy("page_index").collect()] == [(False, None), (True, "first"), (False, "first"), (True, "third")]
    near = views.before_and_after(pages, ["doc_id"], ["page_index"], "page_index", 1).orderBy("page_index").collect()
    assert [(r.before_1, r.after_1) for r in near] == [(None, 1), (0, 2), (1, 3), (2, None)]


def test_slices(spark):
    gold = spark.createDataFrame([(1, 0, 2, "a"), (1, 3, 5, "b"), (2, 0, 2, "a")], "doc_id long, start_offset long, end_offset long, label string")
    made = spark.createDataFrame([(1, 0, 2, "a", 0.9), (1, 3, 5, "a", 0.9), (2, 7, 9, "b", 0.1)], "doc_id long, start_offset long, end_offset long, label string, confidence double")
    flagged = evaluate.with_stage_flags(evaluate.with_flags(evaluate.compare_strict(gold, made, ["doc_id", "start_offset", "end_offset"]), 0.5))
    sums = flagged.agg(*evaluate.all_counts()).first()
    assert (sums.tp, sums.fp, sums.fn, sums.gt, sums.tn) == (1, 1, 2, 3, 1) and (sums.tokenizer_tp, sums.tokenizer_fp, sums.tokenizer_fn) == (2, 1, 1) and (sums.clf_tp, sums.clf_fp, sums.clf_fn) == (1, 1, 0)
    assert evaluate.query_rows(flagged, "label", "b").count() == 2 and evaluate.query_rows(flagged, "label", None).count() == 4
    assert {r.doc_id: (r.tp, r.fp, r.fn) for r in evaluate.per_slice(flagged, "doc_id").collect()} == {1: (1, 1, 1), 2: (0, 0, 1)}
    assert {(r.label, r.frequency) for r in evaluate.with_frequency(flagged).collect()} == {("a", 2), ("b", 1), (None, 0)}
    ids = evaluate.disambiguated_ids(spark.createDataFrame([(1, 5, 0), (1, 5, 3), (1, 6, 9), (2, 5, 0), (2, None, 1)], "doc_id long, id long, start_offset long"), "doc_id", "id", ["start_offset"])
    assert {r.disambiguated_id for r in ids.collect()} == {"5_1", "5_2", "6", "5", None}
    m = {r.label: r.asDict() for r in evaluate.relation_matrix(flagged.filter("doc_id = 1 or doc_id_predicted = 1"), "label", "label_predicted").collect()}
    assert m["b"]["a"] == "FP" and m["a"]["a"] == "TP"
    with pytest.raises(ValueError):
        evaluate.relation_matrix(flagged, "label", "label_predicted", most=1)


def test_merge_like_and_multiline(spark):
    a = spark.createDataFrame([(1, 0, 2, "x"), (1, 5, 7, "y"), (1, 9, 10, "y"), (1, 20, 21, "z")], "doc_id long, start_offset long, end_offset long, label string")
    t = spark.createDataFrame([(1, 0, 2, 7), (1, 5, 7, 7), (1, 9, 10, 7), (1, 9, 10, 8)], "doc_id long, start_offset long, end_offset long, annotation_id long")
    assert {(r.start_offset, r.annotation_id, r.label) for r in merge.merge_like(a, t, "doc_id").collect()} == {(0, 7, "y"), (5, 7, "y"), (9, 7, "y"), (20, None, "z")}
    m = merge.multiline_labels(spark.createDataFrame([(1, 1, "x"), (1, 1, "x"), (1, 2, "y"), (2, 2, "y")], "doc_id long, annotation_id long, label string"), "doc_id")
    assert {(r.label, r.multiline) for r in m.collect()} == {("x", True), ("y", False)}
    rows = [(1, "x", 0, 0, 4, 10.0, 20.0, 1), (1, "x", 1, 9, 12, 15.0, 25.0, 1), (1, "x", 2, 20, 24, 15.0, 25.0, 2), (1, "y", 0, 5, 6, 10.0, 20.0, 3), (1, "y", 1, 13, 14, 10.0, 20.0, 3)]
    s = spark.createDataFrame(rows, "doc_id long, label string, line_index int, start_offset long, end_offset long, x0 double, x1 double, set_id long")
    v = merge.merge_vertical(s, "doc_id", m.filter("multiline").select("label"))
    assert {r.start_offset: r.annotation_id for r in v.collect()} == {0: 0, 9: 0, 20: 0, 5: 5, 13: 13}


def test_one_document_of_a_million_tokens(spark):
    n = 1_000_000
    tokens = spark.range(n).select(F.lit(1).alias("doc_id"), (F.col("id") * 6).alias("start_offset"), (F.col("id") * 6 + 5).alias("end_offset"))
    lines = spark.range(n // 10).select(F.lit(1).alias("doc_id"), F.col("id").alias("line_index"), (F.col("id") * 60).alias("start_offset"), (F.col("id") * 60 + 59).alias("end_offset"))
    assert spans.locate(tokens, "doc_id", lines, "line_index").agg(F.count(F.lit(1)), F.sum("line_index")).first()[:] == (n, sum(range(n // 10)) * 10)
    gold = lines.withColumn("label", F.lit("l")).filter("line_index % 2 = 0")
    assert spans.contained_in(tokens, gold, "doc_id", "label").filter("label is not null").count() == n // 2
    assert evaluate.overlapping_false_positives(tokens, gold, "doc_id").count() == n // 2
    assert merge.tag_bio(tokens, gold, "doc_id").filter("tag = 'B-l'").count() == n // 20
