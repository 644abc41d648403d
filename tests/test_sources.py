"""Project folders, changes, sinks and payloads."""

import json

import pytest

from pyspark.sql import functions as F

from quire.sources import payloads, project


def _folder(tmp_path):
    (tmp_path / "documents/7").mkdir(parents=True)
    (tmp_path / "documents/8").mkdir()
    write = lambda name, what: (tmp_path / name).write_text(json.dumps(what))
    write("labels.json5", [{"id": 1, "text": "Total", "get_data_type_display": "Number", "threshold": 0.3}, {"id": 2, "text": "Date"}])
    write("label_sets.json5", [{"id": 63, "name": "Slip", "is_default": True, "labels": [1]}, {"id": 64, "name": "Position", "is_default": False, "default_section_labels": [63, 99], "labels": [2]}])
    write("documents_meta.json5", [{"id": 7, "dataset_status": 2, "category_template": 63, "updated_at": "2021-01-02T03:04:05"}, {"id": 8, "dataset_status": 3}])
    for doc, text, pages in ((7, "one 12,50\fzwei", [1, 2]), (8, "x", [1, 2])):
        (tmp_path / f"documents/{doc}/document.txt").write_text(text)
        write(f"documents/{doc}/pages.json5", [{"id": 10 * doc + n, "number": n, "original_size": [595.0, 842.0], "size": [1, 2]} for n in pages])
        write(f"documents/{doc}/annotations.json5", [{"id": doc, "label": 1, "section": 5, "section_label_id": 63, "accuracy": 0.5, "start_offset": 4, "end_offset": 9, "is_correct": True, "revised": False, "bboxes": []}])
    write("documents/7/annotation_sets.json5", [{"id": 5, "section_label": 63}, {"id": 6, "label_set": {"id": 64}, "labels": [{"annotations": []}]}, {"id": 9, "label_set": {"id": 64}, "labels": [{"annotations": []}, {"annotations": [{"id": 1}]}]}])
    write("documents/8/annotation_sets.json5", [])
    return str(tmp_path)


def test_project(spark, tmp_path):
    p = project.read_project(spark, _folder(tmp_path))
    assert {(r.label_id, r.threshold) for r in p.labels.collect()} == {(1, 0.3), (2, 0.1)}
    assert {(r.category_id, r.name) for r in p.categories.collect()} == {(0, "NO_CATEGORY"), (63, "Slip")}
    assert {tuple(r) for r in p.category_sets.collect()} == {(63, 63), (63, 64)}
    assert {tuple(r) for r in p.annotation_sets.collect()} == {(7, 5, 63), (7, 9, 64)}
    assert {(r.doc_id, r.page_index, r.page_id, r.width) for r in p.pages.collect()} == {(7, 0, 71, 595.0), (7, 1, 72, 595.0), (8, 0, 81, 595.0)}
    assert {(r.doc_id, r.start_offset, r.confidence) for r in p.annotations.collect()} == {(7, 4, 0.5), (8, 4, 0.5)}
    from quire.operators import spans

    sizes = project.read_page_sizes(spark, f"{tmp_path}/documents/*/pages.json5")
    assert project.pages_with_sizes(spans.pages(p.texts.filter("doc_id = 7"), "doc_id", "text"), sizes.filter("doc_id = 7")).count() == 2
    with pytest.raises(Exception, match="document 8"):
        project.pages_with_sizes(spans.pages(p.texts, "doc_id", "text"), sizes).collect()


def test_apply_changes(spark):
    schema = "id long, v string, s int"
    known = spark.createDataFrame([(1, "a", 1), (2, "b", 1), (2, "old", 0), (4, "d", 3)], schema)
    arrived = spark.createDataFrame([(1, "x", 1), (2, "y", 2), (2, "z", 3), (5, "n", None)], schema)
    assert {(r.id, r.v) for r in project.apply_changes(known, arrived, "id", "s").collect()} == {(1, "a"), (2, "z"), (5, "n")}
    assert {r.id for r in project.apply_changes(known, arrived, "id", "s", delete=False).collect()} == {1, 2, 4, 5}


def test_bio_files(spark, tmp_path):
    texts = spark.createDataFrame([(d, "ab cd") for d in range(50)], "doc_id long, text string")
    tags = texts.select("doc_id", F.explode(F.array(F.struct(F.lit(3).alias("start_offset"), F.lit(5).alias("end_offset"), F.lit("O").alias("tag")), F.struct(F.lit(0).alias("start_offset"), F.lit(2).alias("end_offset"), F.lit("B-x").alias("tag")))).alias("t")).select("doc_id", "t.*")
    project.write_bio(tags, texts, "doc_id", str(tmp_path / "bio"), files=2)
    found = [f.read_text().splitlines() for f in (tmp_path / "bio").glob("part-*")]
    assert len(found) <= 2 and sum(map(len, found)) == 100
    assert all(a.split("\t")[0] == b.split("\t")[0] and a.endswith("ab B-x") and b.endswith("cd O") for lines in found for a, b in zip(lines[::2], lines[1::2]))


def test_payloads(spark):
    body = {"text": "t", "bboxes": {"0": {"x0": 1, "x1": 2, "y0": 3, "y1": 4, "page_number": 1, "text": "t"}}, "pages": [{"number": 1, "original_size": [5, 6]}]}
    df = spark.createDataFrame([(1, json.dumps(body)), (2, "{"), (3, None)], "request_id long, payload string")
    decoded = df.select("request_id", payloads.decode(F.col("payload"), "extract_request", "20240117").alias("body"))
    assert [tuple(r)[:3] for r in payloads.boxes_of(decoded).collect()] == [(1, 0, 1)]
    ann = [(1, 63, 1, 5, 9, "Total", False, "Number", 0.1, "1.0", 0.9, 0, 2, "12", 0, 0.0, 1.0, 0.0, 1.0), (1, 63, 1, 5, 9, "Total", False, "Number", 0.1, "1.0", 0.9, 3, 5, "34", 0, 0.0, 1.0, 0.0, 1.0)]
    names = "doc_id long, label_set_id long, set_id long, annotation_id long, label_id long, label string, multiple boolean, data_type string, threshold double, normalized string, confidence double, start_offset int, end_offset int, offset_string string, page_index int, x0 double, x1 double, y0 double, y1 double"
    sent = payloads.extract_responses(spark.createDataFrame(ann, names))
    back = sent.select(payloads.decode(F.col("payload"), "extract_response", "20240117").alias("r")).first().r
    assert back.annotation_sets[0].label_set_id == 63 and back.annotation_sets[0].annotations[0].offset_string == "12 34" and len(back.annotation_sets[0].annotations[0].span) == 2
    pages = spark.createDataFrame([(1, 11, 0, 0, 7), (1, 12, 1, 0, 7), (1, 13, 2, 1, 8)], "request_id long, page_id long, page_index int, split_id long, category_id long")
    parts = payloads.split_responses(pages).select(payloads.decode(F.col("payload"), "split_response", "20240930").alias("r")).first().r.splitting_results
    assert [([p.id for p in x.pages], x.category) for x in parts] == [([11, 12], 7), ([13], 8)]
    assert all(spark.range(1).select(payloads.decode(F.lit("{}"), *k)).count() == 1 for k in payloads.SCHEMAS)
