"""Features, classifiers and the extraction pipeline, with training and test documents apart."""

import pytest

from pyspark.sql import functions as F

from quire.functions import normalize
from quire.operators import extraction, features, spans, split
from quire.operators.extraction import LabelSet


def test_readings(spark):
    rows = [("1.5", 1.5), (" 7 ", 7.0), ("1_000", 1000.0), ("1__0", 0.0), ("1,5", 0.0), ("inf", 0.0), ("nan", 0.0), ("-inf", float("-inf")), (".5e2", 50.0), ("1e39", 0.0), ("x", 0.0), ("", 0.0), (None, 0.0)]
    df = spark.createDataFrame(rows, "s string, want double")
    assert all(r.got == r.want for r in df.withColumn("got", normalize.to_python_float(F.col("s"))).collect())
    dates = spark.createDataFrame([("01.01.2010", 1), ("02.01.2010", 1), ("11.01.2010", 10), ("31/12/2009", -1), ("1.1.2010", 0), ("99.99.2010", 0), ("abc", 0), (None, 0)], "s string, want int")
    assert all(r.got == r.want for r in dates.withColumn("got", normalize.days_since_2010(F.col("s"))).collect())
    y, m, d = normalize.date_parts(F.lit("05.03.2021"))
    assert tuple(spark.range(1).select(y, m, d).first()) == (2021, 3, 5)


def test_frames(spark):
    texts = spark.createDataFrame([(1, "Total 12,50 EUR\nam 05.03.2021"), (2, None)], "doc_id long, text string")
    tokens = spans.tokenize(texts, "doc_id", "text", "whitespace").withColumns({"x0": F.col("start_offset").cast("double"), "x1": F.col("end_offset").cast("double"), "y0": F.lit(1.0), "y1": F.lit(3.0), "page_index": F.lit(0), "page_width": F.lit(100.0), "page_height": F.lit(50.0)})
    f = {r.offset_string: r for r in features.feature_frame(tokens, texts, "doc_id").collect()}
    assert f["12,50"].feat_num_count == 12.5 and f["12,50"].r0_feat_len == 3 and f["12,50"].first_word_feat_len == 5 and f["05.03.2021"].feat_duplicate_count == 7 and f["Total"].feat_duplicate_count == 0
    assert (f["05.03.2021"].feat_year_count, f["05.03.2021"].feat_month_count, f["05.03.2021"].feat_date_count) == (2021, 3, 4081)
    assert f["12,50"].x0_relative == pytest.approx(0.06) and f["12,50"].area == 10.0 and f["Total"].l0_feat_len == 0
    lines = spark.createDataFrame([(1, 0, 2), (1, 1, 0), (1, 2, 5)], "doc_id long, line_index int, a long")
    assert [(r.prev_line_1_a, r.next_line_1_a, r.next_line_2_a) for r in features.relative_lines(lines, "doc_id", ["a"], 2).orderBy("line_index").collect()] == [(0, 0, 5), (2, 5, 0), (0, 0, 0)]


def test_annotation_sets(spark):
    rows = [(1, "date", 0, 0, 2, 0.9), (1, "item", 2, 10, 12, 0.9), (1, "price", 3, 20, 22, 0.9), (1, "item", 5, 30, 32, 0.8), (1, "item", 1, 5, 6, 0.7), (1, "iban", 9, 90, 95, 0.9), (1, "other", 9, 96, 97, 0.9)]
    r = spark.createDataFrame(rows, "doc_id long, label string, line_index int, start_offset long, end_offset long, confidence double")
    sections = spark.createDataFrame([(1, 2, "Position"), (1, 5, "Position"), (1, 7, "Unknown")], "doc_id long, line_index int, section string")
    sets = [LabelSet("Position", ("item", "price"), multiple=True), LabelSet("Bank", ("iban",)), LabelSet("Document", ("date", "item"), is_default=True)]
    got = {r.start_offset: (r.label_set, r.set_id) for r in extraction.annotation_sets(r, sections, sets).collect()}
    assert got == {0: ("Document", 1), 5: ("Document", 1), 10: ("Position", 2), 20: ("Position", 2), 30: ("Position", 3), 90: ("Bank", 4)}
    twice = r.unionByName(r.withColumn("confidence", F.lit(0.1)))
    assert {x.confidence for x in extraction.without_duplicates(twice).collect()} == {0.9, 0.8, 0.7}
    assert extraction.annotation_sets(r.limit(0), sections, sets).count() == 0


def _text(i):
    return f"Rechnung\nDatum 0{i % 9 + 1}.05.2021\nPosition Schraube {i % 7}\nPreis {i + 10},50\nPosition Mutter {i % 5}\nPreis {i + 3},20\nGruss"


def test_pipeline(spark, tmp_path):
    texts = spark.createDataFrame([(i, _text(i)) for i in range(60)] + [(90, None), (91, "")], "doc_id long, text string")
    gold = spans.regex_spans(texts, "doc_id", "text", r"\d+,\d\d").selectExpr("*", "'price' as label").unionByName(spans.regex_spans(texts, "doc_id", "text", r"\d\d\.\d\d\.\d{4}").selectExpr("*", "'date' as label")).select("doc_id", "start_offset", "end_offset", "label")
    train, test = texts.filter("doc_id < 40"), texts.filter("doc_id >= 40")
    tokens = spans.tokenize(texts, "doc_id", "text", "whitespace")
    lines = spans.lines(texts, "doc_id", "text").select("doc_id", "line_index", "start_offset", "end_offset")
    starts = spans.regex_spans(texts, "doc_id", "text", r"Position").select("doc_id", "start_offset", F.lit("Item").alias("label_set"))
    sections = extraction.section_starts(starts, lines)
    frame = extraction.training_frame(tokens.filter("doc_id < 40"), train, gold)
    model = extraction.fit(frame, lines.filter("doc_id < 40"), sections.filter("doc_id < 40"), trees=12, depth=8, n_lines=2)
    sets = [LabelSet("Item", ("price",), multiple=True), LabelSet("Document", ("date", "price"), is_default=True)]
    found = extraction.extract(model, tokens.filter("doc_id >= 40"), test, sets).cache()
    scores = {r.label: r.f1 for r in extraction.evaluate_full(gold.filter("doc_id >= 40"), found).collect()}
    assert scores["price"] > 0.9 and scores["date"] > 0.9
    assert extraction.evaluate_full(gold.filter("doc_id >= 40"), found, by=None).first().f1 > 0.9
    assert found.filter("label_set = 'Item'").select("doc_id", "set_id").distinct().count() >= 36
    tok = extraction.evaluate_tokenizer(tokens, gold).first()
    assert tok.recall == 1.0 and tok.precision < 0.5
    assert all(r.f1 > 0.9 for r in extraction.evaluate_classifier(model, extraction.training_frame(tokens.filter("doc_id >= 40"), test, gold)).collect())
    features.save_model(model.labels, str(tmp_path / "m"))
    again = extraction.Extractor(features.load_model(str(tmp_path / "m")), model.features)
    said = extraction.predict(again, extraction.training_frame(tokens.filter("doc_id >= 40"), test, gold), spark.createDataFrame([("price", 1.1)], "label string, threshold double"))
    assert said.filter("label = 'price' and above").count() == 0 and said.filter("label = 'date' and above").count() > 0
    judged = extraction.evaluate_sections(model, said, lines.filter("doc_id >= 40"), sections.filter("doc_id >= 40"))
    assert {r["class"] for r in judged.collect()} == {"No", "Item"}


def test_context_aware_split(spark):
    docs = spark.createDataFrame([(1, "RECHNUNG\nKopf A\nx1\fSeite\ny"), (2, "RECHNUNG\nKopf A\nx2\fSeite\nz"), (3, "BRIEF\nGuten Tag\nx\fSeite\nw"), (4, "BRIEF\nGuten Tag\nq")], "doc_id long, text string")
    pages = spans.pages(docs, "doc_id", "text").withColumn("category", F.when(F.col("doc_id") < 3, "invoice").otherwise("letter"))
    lines = split.exclusive_first_page_lines(pages, "doc_id", "category")
    assert {(r.category, r.line) for r in lines.collect()} == {("invoice", "RECHNUNG"), ("invoice", "Kopf A"), ("letter", "BRIEF"), ("letter", "Guten Tag")}
    file = spark.createDataFrame([(9, "RECHNUNG\nKopf A\nneu\fSeite\nmehr\f \fBRIEF\nGuten Tag\nanders\fSeite")], "doc_id long, text string")
    judged = split.predict_first_pages(spans.pages(file, "doc_id", "text"), "doc_id", lines, "category")
    grouped = split.group_pages(judged, "doc_id")
    assert [r.split_id for r in grouped.orderBy("page_index").collect()] == [0, 0, 0, 1, 1]


def test_vocabulary_numbers_and_sentences(spark):
    vocab = spark.createDataFrame([("<unk>", 0), ("<pad>", 1), ("a", 2), ("b", 3)], "token string, idx long")
    t = spark.createDataFrame([(1, 0, "b"), (1, 2, "x"), (1, 4, "a"), (2, None, None)], "doc_id long, start_offset long, token string")
    assert {r.doc_id: r.indices for r in spans.numericalize(t, "doc_id", "start_offset", "token", vocab).collect()} == {1: [3, 0, 2], 2: [1]}
    assert {r.doc_id: r.indices for r in spans.numericalize(t, "doc_id", "start_offset", "token", vocab, max_length=2).collect()}[1] == [3, 0]
    s = spark.createDataFrame([(1, 0, "One. Two"), (1, 10, "goes on! Three"), (1, 30, "")], "doc_id long, start_offset long, offset_string string")
    got = [(r.start_offset, r.offset_string, r.sentence) for r in spans.sentences_of_spans(s, "doc_id").orderBy("start_offset").collect()]
    assert got == [(0, "One.", 0), (4, " Two", 1), (10, "goes on!", 1), (18, " Three", 2)]
