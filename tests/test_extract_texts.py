"""Extraction from texts whose tokens stay in their batch: what it gives is what the pipeline over tokens gives, and no token is shuffled."""

import pytest

from pyspark.sql import functions as F

from quire.operators import extraction, spans


def _text(i):
    gap = " " * (i % 7 + 1)
    return f"Rechnung\nDatum 0{i % 9 + 1}.05.2021{gap}{i + 3},20 EUR\n\n{i + 10},50 {i},00{gap}x\f{i},10\n 1.{100 + i},5{i % 10}\tGruss é"


def _gold(texts):
    prices = spans.regex_spans(texts, "doc_id", "text", r"\d+,\d\d").withColumn("label", F.lit("price"))
    dates = spans.regex_spans(texts, "doc_id", "text", r"\d\d\.\d\d\.\d{4}").withColumn("label", F.lit("date"))
    return prices.unionByName(dates).select("doc_id", "start_offset", "end_offset", "label")


@pytest.fixture(scope="module")
def fitted(spark):
    rows = [(i, _text(i)) for i in range(40)] + [(90, None), (91, ""), (92, " \n\f "), (93, "x"), (94, "1" * 300 + " 7,50"), (None, "7,50")]
    texts = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    tokens = spans.tokenize(texts.filter("doc_id is not null"), "doc_id", "text", "whitespace")
    whole = extraction.training_frame(tokens, texts, _gold(texts))
    picked = extraction.sample_tokens(texts, 200, "whitespace")
    sampled = extraction.sampled_frame(picked, texts, _gold, "whitespace")
    return texts, tokens, whole, sampled


def test_sampled_frame(fitted):
    _, _, whole, sampled = fitted
    names = extraction.numeric_features(whole)
    assert extraction.numeric_features(sampled) == names

    def rows(frame):
        ordered = frame.orderBy(F.xxhash64("doc_id", "start_offset")).limit(200)
        return [tuple(r) for r in ordered.select("doc_id", "start_offset", "end_offset", "label", *[F.coalesce(F.col(n).cast("double"), F.lit(0.0)) for n in names]).collect()]

    got = rows(sampled)
    assert len(got) == 200 and got == rows(whole)


def test_extract_texts(fitted):
    texts, tokens, _, sampled = fitted
    model = extraction.fit(sampled, trees=5, depth=6)
    columns = ["doc_id", "label", "start_offset", "end_offset", "parts", "line_index", F.round("confidence", 9)]
    found = extraction.extract_texts(model, texts, "whitespace")
    got = sorted(map(tuple, found.select(*columns).collect()))
    assert got == sorted(map(tuple, extraction.extract(model, tokens, texts).select(*columns).collect()))
    assert any(r[4] > 1 for r in got) and {r[1] for r in got} == {"price", "date"}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Join" not in plan
