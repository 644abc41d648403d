"""Merging, layout, patterns, features, sources, streaming and the entry points."""

import json
import re
import zipfile

import duckdb
import pytest

from pyspark.sql import functions as F

import __spark_entry__ as entry
from quire.functions import geometry, strings
from quire.operators import features, layout, merge, patterns, spans
from quire.sources import payloads, project
from quire.streaming import documents as stream

DATA = "/root/testdata/sf0.001"


def test_folds(spark):
    text = spark.createDataFrame([(1, "1 234 5 x")], "doc_id long, text string")
    t = spans.regex_spans(text, "doc_id", "text", r"\d+").selectExpr("*", "'n' as label", "0.5 as confidence")
    shape = re.compile(r"\d{1,3}( \d{3})*")
    got = {(r.start_offset, r.end_offset, r.parts) for r in merge.merge_while(t, text, "doc_id", lambda s: shape.fullmatch(s) is not None).collect()}
    assert got == {(0, 5, 2), (6, 7, 1)}
    rows = [(1, "l", 0, 0, 4, 10.0, 20.0), (1, "l", 1, 9, 12, 15.0, 25.0), (1, "l", 3, 20, 22, 15.0, 25.0), (1, "l", 1, 14, 16, 40.0, 50.0)]
    v = merge.merge_vertical(spark.createDataFrame(rows, "doc_id long, label string, line_index int, start_offset long, end_offset long, x0 double, x1 double"), "doc_id")
    assert {r.start_offset: r.annotation_id for r in v.collect()} == {0: 0, 9: 0, 20: 20, 14: 14}


def test_view_and_bio(spark):
    rows = [(1, "a", 1, 0, 5, 0.9, 0.1, False, False, False), (1, "b", 1, 3, 8, 0.8, 0.1, True, False, False), (1, "c", 1, 9, 11, 0.05, 0.1, False, False, False), (1, "b", 1, 12, 14, 0.9, 0.1, False, False, False), (1, "d", 1, 12, 14, 0.9, 0.1, False, True, True)]
    ann = spark.createDataFrame(rows, "doc_id long, label string, set_id long, start_offset long, end_offset long, confidence double, threshold double, is_correct boolean, revised boolean, multiple boolean")
    assert [(r.label, r.start_offset) for r in merge.view_annotations(ann, "doc_id").collect()] == [("b", 3)]
    tokens = spark.createDataFrame([(1, 0, 2), (1, 3, 5), (1, 6, 8), (1, 9, 10)], "doc_id long, start_offset long, end_offset long")
    gold = spark.createDataFrame([(1, 3, 8, "x")], "doc_id long, start_offset long, end_offset long, label string")
    assert {r.start_offset: r.tag for r in merge.tag_bio(tokens, gold, "doc_id").collect()} == {0: "O", 3: "B-x", 6: "I-x", 9: "O"}


def test_layout_and_geometry(spark):
    boxes = [(1, 0, 0, 9, 90, 100, "A"), (1, 0, 10, 19, 90, 100, "one."), (1, 1, 0, 9, 79, 89, "two"), (1, 2, 0, 9, 40, 50, "three")]
    b = spark.createDataFrame(boxes, "page int, line int, x0 int, x1 int, y0 int, y1 int, text string").selectExpr("page", "line", *[f"double({c}) as {c}" for c in ("x0", "x1", "y0", "y1")], "text")
    thr, lines = layout.median_line_height(b, ["page"]), layout.line_boxes(b, ["page"], "line")
    assert thr.first().threshold == 8.0 and lines.filter("line = 0").first().text == "A one."
    assert {r.line: (r.paragraph, r.sentence) for r in layout.sentences(lines, ["page"], "line", thr).collect()} == {0: (0, 0), 1: (0, 1), 2: (1, 2)}
    sel = spark.createDataFrame([(1, 7, 0.0, 12.0, 70.0, 101.0)], "page int, selection_id int, x0 double, x1 double, y0 double, y1 double")
    assert {r.text for r in layout.select_boxes(b, sel, ["page"], 0.0).collect()} == {"A", "two"}
    one = b.filter("line = 0 and x0 = 0").select(geometry.area(*[F.col(c) for c in ("x0", "x1", "y0", "y1")]), geometry.is_valid(*[F.col(c) for c in ("x0", "x1", "y0", "y1")], F.lit(5.0), F.lit(100.0))).first()
    assert tuple(one) == (90.0, False)


def test_patterns(spark):
    m = spark.createDataFrame([("p", "1"), ("p", "2"), ("q", "2"), ("r", "3"), ("r", "1")], "pattern string, annotation_id string")
    ranks = spark.createDataFrame([("p", 1), ("q", 2), ("r", 3)], "pattern string, rank int")
    assert {(r.pattern, r.new) for r in patterns.greedy_cover(m, ranks).collect()} == {("p", 2), ("r", 1)}
    t = spark.createDataFrame([("Ab 12",), ("a.b",), (None,)], "s string")
    assert [r[0] for r in t.select(strings.suggest_pattern(F.col("s"))).collect()] == [r"[A-ZÄÖÜ]+[a-zäöüß]+[ ]{1,2}\d\d", r"[a-zäöüß]+\.[a-zäöüß]+", None]
    assert t.select(strings.slugify(F.lit("Größe & Form (x)"))).first()[0] == "groe-form-x"
    docs, ann = project.local_project(spark)
    e = {r.pattern: (r.findings, r.correct) for r in patterns.evaluate_patterns(docs, ann, "doc_id", {"n": r"\d+,\d+", "f": r"(?<=like )\w+"}).collect()}
    assert e == {"n": (2, 2), "f": (2, 2)}


def test_features_and_sections(spark):
    docs, _ = project.local_project(spark)
    frame = features.feature_frame(spans.tokenize(docs, "doc_id", "text", "whitespace"), docs, "doc_id")
    row = frame.filter("offset_string = '12,50'").first()
    assert row.feat_num == 12.5 and row.feat_digit_len == 4 and row.r_text0 == "EUR" and row.line_index == 1
    train = spark.createDataFrame([(float(i % 2), float(i), "ab"[i % 2]) for i in range(40)], "x double, y double, label string")
    model = features.fit_label_classifier(train, ["x", "y"], "label", trees=5, depth=3)
    assert features.predict_labels(model, train, ["x", "y"]).filter("label <> label_predicted").count() == 0
    assert {tuple(r) for r in features.separate_labels(spark.createDataFrame([("s__l",), ("l",)], "label string")).collect()} == {("l", "s"), ("l", None)}
    rows = spark.createDataFrame([(1, 0, 5), (1, 3, 9), (1, 8, 20)], "doc_id long, line_index int, start_offset long")
    marks = spark.createDataFrame([(1, 2, "A"), (1, 8, "B")], "doc_id long, line_index int, section string")
    assert {r.start_offset: r.section for r in features.assign_sections(rows, marks, "doc_id").collect()} == {5: None, 9: "A", 20: "B"}


def test_project_files(spark, tmp_path):
    doc = tmp_path / "documents" / "44"
    doc.mkdir(parents=True)
    (doc / "document.txt").write_text("Hi all\fbye")
    old = {"id": 1, "label": 5, "section": 9, "section_label_id": 3, "accuracy": 0.7, "is_correct": True, "revised": False, "start_offset": 0, "end_offset": 2, "bboxes": [{"start_offset": 0, "end_offset": 2, "page_index": 0}, {"start_offset": 3, "end_offset": 6}]}
    new = {"id": 2, "label": {"id": 6, "name": "x"}, "annotation_set": 8, "label_set": {"id": 4}, "confidence": 0.5, "is_correct": False, "revised": False, "span": [{"start_offset": 7, "end_offset": 10}]}
    (doc / "annotations.json5").write_text(json.dumps([old, new]))
    with zipfile.ZipFile(doc / "bbox.zip", "w") as z:
        z.writestr("bbox.json5", json.dumps({"0": {"x0": 1.0, "x1": 2.0, "y0": 3.0, "y1": 4.0, "text": "H", "page_number": 1}}))
    (tmp_path / "labels.json5").write_text(json.dumps([{"id": 5, "text": "L", "get_data_type_display": "Number"}]))
    assert [tuple(r) for r in project.read_texts(spark, f"{tmp_path}/documents/*/document.txt").collect()] == [(44, "Hi all\fbye")]
    got = {(r.annotation_id, r.label_id, r.annotation_set_id, r.label_set_id, r.confidence, r.start_offset) for r in project.read_annotations(spark, f"{tmp_path}/documents/*/annotations.json5").collect()}
    assert got == {(1, 5, 9, 3, 0.7, 0), (1, 5, 9, 3, 0.7, 3), (2, 6, 8, 4, 0.5, 7)}
    assert tuple(project.read_character_boxes(spark, f"{tmp_path}/documents/*/bbox.zip").first()) == (44, 0, 0, "H", 1.0, 2.0, 3.0, 4.0)
    assert tuple(project.read_labels(spark, f"{tmp_path}/labels.json5").first()) == (5, "L", "Number", 0.1, False)
    docs, ann = project.local_project(spark)
    project.write_project(docs, ann, f"{tmp_path}/out")
    assert spark.read.json(f"{tmp_path}/out/documents").count() == 4


def test_changes(spark):
    a = spark.createDataFrame([(1, 1), (2, 1), (3, None), (4, 5)], "id long, s int")
    b = spark.createDataFrame([(1, 1), (2, 3), (3, 1), (5, 1), (5, 2)], "id long, s int")
    assert {r.id: r.change for r in project.changes(a, b, "id", "s").collect()} == {1: "unchanged", 2: "updated", 3: "updated", 4: "deleted", 5: "new"}


def test_payloads(spark):
    rows = spark.createDataFrame([(1, 1, 5, "a", 0.2), (1, 1, 6, None, None), (1, 2, 5, "a", 0.9)], "request_id long, number int, category_id long, category_name string, confidence double")
    r = payloads.categorize_responses(rows).select(payloads.decode(F.col("payload"), "categorize_response", "20241227").alias("r")).first().r
    assert [(p.number, [c.id for c in p.categories]) for p in r.pages] == [(1, [5, 6]), (2, [5])]
    assert rows.select(payloads.decode(F.lit("{broken"), "categorize_response", "20241227").alias("r")).first().r in (None, (None,))


def test_large_request_keeps_all_rows(spark, tmp_path):
    rows = spark.range(12_000).selectExpr("1L as request_id", "int(id div 12 + 1) as number", "id % 12 as category_id", "'n' as category_name", "0.5 as confidence")
    rows = rows.unionByName(spark.range(130).selectExpr("2L as request_id", "7 as number", "id % 3 as category_id", "string(null) as category_name", "0.5 as confidence"))
    rows.write.parquet(f"{tmp_path}/page_categories.parquet")
    got = {r.request_id: (r.pages, r.categories) for r in entry.queries()["response_payloads"](spark, str(tmp_path)).collect()}
    assert got == {1: (1000, 12_000), 2: (1, 130)}
    sizes = payloads.categorize_responses(rows).select(F.size(payloads.decode(F.col("payload"), "categorize_response", "20241227")["pages"]).alias("n"))
    assert sizes.agg(F.max("n")).first()[0] <= payloads.PAGES


def test_boxes_without_line_or_text_count(spark, tmp_path):
    rows = [(1, 0, 1, None, 0.0, 10.0, 0.0, 10.0, "a"), (1, 0, 1, None, 0.0, 10.0, 0.0, 10.0, "a"), (1, 5, 1, None, 0.0, 900.0, 0.0, 20.0, None), (2, 0, 1, 0, 0.0, 10.0, 0.0, 10.0, None), (2, 5, 1, 0, 0.0, 10.0, 0.0, 30.0, "b")]
    spark.createDataFrame(rows, "request_id long, bbox_key long, page_number int, line_index int, x0 double, x1 double, y0 double, y1 double, text string").write.parquet(f"{tmp_path}/extract_bboxes.parquet")
    q = entry.queries()
    assert {r.request_id: (r.invalid, r.area) for r in q["box_checks"](spark, str(tmp_path)).collect()} == {1: (1, 18100.0), 2: (0, 400.0)}
    assert {r.request_id: r.threshold for r in q["line_heights"](spark, str(tmp_path)).collect()} == {1: 12.0, 2: 16.0}
    assert {r.request_id for r in q["line_boxes"](spark, str(tmp_path)).collect()} == {2}


def test_stream(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "updated_at")
    docs.repartition(3).write.parquet(f"{tmp_path}/in")
    live = stream.read_documents(spark, f"{tmp_path}/in", docs.schema, 1)
    counted = stream.token_counts(live, "doc_id", "text", "updated_at", "365 days")
    q = counted.writeStream.format("memory").queryName("counted").outputMode("complete").start()
    try:
        q.processAllAvailable()
        got = spark.sql("select sum(tokens) from counted").first()[0]
    finally:
        q.stop()
    assert got == spans.tokenize(docs.filter("updated_at is not null"), "doc_id", "text", "whitespace").count()
    assert stream.upsert_latest(docs.unionByName(docs), "doc_id", "updated_at").count() == docs.count()


@pytest.mark.parametrize("name", ["tokenizer_comparison", "threshold_sweep", "horizontal_merge", "line_distance_paragraphs", "name_categories", "document_categories"])
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "categories", "page_categories", "extract_bboxes", "split_requests"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    result = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in result.description]
    df = entry.queries()[name](spark, DATA)

    def key(rows, columns):
        order = sorted(range(len(columns)), key=lambda i: columns[i])
        return sorted(str([round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order]) for r in rows)

    assert sorted(names) == sorted(df.columns)
    assert key(df.collect(), df.columns) == key(result.fetchall(), names)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_plans_have_no_cross_join_of_rows(spark):
    for name in ("evaluation_by_label", "span_lines", "overlapping_errors"):
        plan = entry.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
