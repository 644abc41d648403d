"""Personal data."""

from quire.llm import personal
from quire.llm.personal import Model, find_items, find_personal, learn, redact

MODEL = Model({"steuer-id": (1.0, 0.0), "tel": (0.0, 1.0), "unter": (0.0, 1.0)}, frozenset({"käthe", "rowan"}), frozenset({"winterholz", "harlow"}), frozenset({"⏎⏎"}), frozenset({"laut"}))


def items(text):
    return [(k, text[a:b]) for k, a, b in find_items(text, MODEL)]


def test_forms():
    assert items("Mail an info@post.silberbach.example. Ende") == [("EMAIL", "info@post.silberbach.example")]
    assert items("x rocio.villagris [at] kontor-nordhang [dot] example y") == [("EMAIL", "rocio.villagris [at] kontor-nordhang [dot] example")]
    assert items("Unter +49.89.99998.411 meldet") == [("PHONE", "+49.89.99998.411")]
    assert items("Tel. 0221 – 4710 821   Art.-Nr. 0325814-226") == [("PHONE", "0221 – 4710 821")]
    assert items("Steuer-ID   02 465 850 952   Nr. 5") == [("ID_NUMBER", "02 465 850 952")]
    assert items("Konto DE00 5684 5438 0045 2499 91 gehört") == []
    assert items("wohnt Im Krähenfeld 30-32, 00212 Rocheline") == [("STREET_ADDRESS", "Im Krähenfeld 30-32")]
    assert items("at 7 bis chemin des Ardoises  00319") == [("STREET_ADDRESS", "7 bis chemin des Ardoises")]


def test_names():
    assert items("Sehr geehrte Frau Käthe Winterholz,") == [("PERSON_NAME", "Käthe Winterholz")]
    assert items("\n\nWinterholz, Käthe\n00212") == [("PERSON_NAME", "Winterholz, Käthe")]
    assert items("Laut Winterholz (Ausweis") == [("PERSON_NAME", "Winterholz")]
    assert items("Winterholz & Söhne KG liefert") == []
    assert items("Käthe\nWinterholz") == [("PERSON_NAME", "Käthe\nWinterholz")]


def test_learning_and_frames(spark):
    texts = [f"Sehr geehrte Frau {g} {f},\n\nKontakt: {g} {f}\nSteuer-ID 00 131043 W 142\nSteuer-ID 02 465 850 952" for g in ("Wiebke", "Lene") for f in ("Tannholz", "Moorhof") for _ in range(4)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(90, None), (91, ""), (92, "Kontakt: Lene Steinried")], "id long, text string")
    model = learn(df)
    assert {"wiebke", "lene"} <= model.given and {"tannholz", "moorhof"} <= model.family and model.labels["steuer-id"][0] > 0.4
    got = {(r.id, r.pii_type, r.item) for r in find_personal(df, model, ["id"]).collect()}
    assert (92, "PERSON_NAME", "Lene Steinried") in got and (0, "ID_NUMBER", "02 465 850 952") in got
    out = {r.id: r.redacted for r in redact(df, model, {"PERSON_NAME": "[NAME]"}, ["id"]).collect()}
    assert out[92] == "Kontakt: [NAME]" and out[90] is None and out[91] == ""
    assert find_personal(df.limit(0), learn(df.limit(0)), ["id"]).count() == 0


def test_boxes_are_redacted(spark, tmp_path):
    import __spark_entry__ as entry

    texts = [f"Sehr geehrte Frau {g} {f},\n\nKontakt: {g} {f}\nSteuer-ID 00 131043 W 142" for g in ("Wiebke", "Lene") for f in ("Tannholz", "Moorhof") for _ in range(4)]
    body = "Ort   Kontakt: Lene Moorhof   a@b.example\nKontakt: Wiebke\nTannholz"
    rows = [(i, "20241227", t) for i, t in enumerate([*texts, body])] + [(50, "20241227", None), (60, "20240117", body)]
    spark.createDataFrame(rows, "request_id long, schema_version string, text string").selectExpr("*", "string(null) as raw_ocr_response").write.parquet(f"{tmp_path}/extract_requests.parquet")
    cells = ("Ort", "Kontakt: Lene Moorhof", "a@b.example", "Kontakt: Wiebke", "Tannholz")
    boxes = [(16, body.index(c), c) for c in cells] + [(16, 99, None), (50, 0, "Mail a@b.example"), (60, 0, "Ort")]
    spark.createDataFrame(boxes, "request_id long, bbox_key long, text string").write.parquet(f"{tmp_path}/extract_bboxes.parquet")
    spark.createDataFrame([("PERSON_NAME", "[NAME]"), ("EMAIL", "[MAIL]"), ("ID_NUMBER", "[ID]")], "pii_type string, placeholder string").write.parquet(f"{tmp_path}/pii_placeholders.parquet")
    got = {(r.request_id, r.bbox_key): r.redacted for r in entry.queries()["p3_redacted"](spark, str(tmp_path)).collect()}
    want = dict(zip(cells, ("Ort", "Kontakt: [NAME]", "[MAIL]", "Kontakt: [NAME]", "[NAME]")))
    assert {k: v for k, v in got.items() if k[1] >= 0} == {(16, body.index(c)): v for c, v in want.items()} | {(50, 0): "Mail [MAIL]"}
    assert got[16, -1] == "Ort   Kontakt: [NAME]   [MAIL]\nKontakt: [NAME]"


def test_no_window_ends_the_search():
    local = "a" + ".langername" * 40
    assert items(f"Mail an {local}@silberbach.example. Ende") == [("EMAIL", f"{local}@silberbach.example")]
    assert items(f"an x@{'sub.' * 60}example, danke") == [("EMAIL", f"x@{'sub.' * 60}example")]
    assert items("wohnt in Nguyễnstraße 5, 00212 Rocheline") == [("STREET_ADDRESS", "Nguyễnstraße 5")]
    assert items("Frau" + " " * 40 + "Käthe Winterholz") == [("PERSON_NAME", "Käthe Winterholz")]
    assert items("Steuer-ID" + " " * 60 + "02 465 850 952   Nr. 5") == [("ID_NUMBER", "02 465 850 952")]
    assert items("@" * 2000 + "A" * 2000 + "-A" * 2000) == []
    many = "Mail a@b.example und Käthe Winterholz. " * 3000
    assert len(items(many)) == 6000


def test_a_lexicon_that_stays_a_table(spark, monkeypatch):
    texts = [f"Sehr geehrte Frau {g} {f},\n\nKontakt: {g} {f}\nSteuer-ID 00 131043 W 142" for g in ("Wiebke", "Lene") for f in ("Tannholz", "Moorhof") for _ in range(4)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(90, None), (91, ""), (92, "Kontakt: Lene Moorhof-Tannholz und Lene Steinried"), (92, "Kontakt: Lene Moorhof-Tannholz und Lene Steinried")], "id long, text string")
    small = learn(df)
    monkeypatch.setattr(personal, "MOST_NAMES", 2)
    large = learn(df)
    assert small.names is None and large.names is not None and not large.given
    for run in (lambda m: find_personal(df, m, ["id"]), lambda m: redact(df, m, {"PERSON_NAME": "[NAME]"}, ["id"])):
        assert sorted(map(tuple, run(large).collect()), key=str) == sorted(map(tuple, run(small).collect()), key=str)
