"""Noise of scanned pages."""

import json

import numpy as np

from quire.llm import scans
from quire.llm.scans import Chain, broken_word, find_noise, fit_chain, label_pages, observe, repair, respell, tidy, variants

BODY = "Die Buchhaltung genehmigt den Dauerauftrag und prüft die Rechnung der Spedition."


def test_labels():
    pages = [["Bericht 12   Nordhang GmbH", f"Text Nummer {k} eins", f"noch mehr {k * 7} Text", "", f"Seite {k} von 3"] for k in (1, 2, 3)]
    assert label_pages(pages) == [["H", "B", "B", "K", "P"]] * 3
    assert label_pages([["- 1 -", "Nur ein Text"]]) == [["P", "B"]]


def test_broken_words():
    assert broken_word("die Buch-", "haltung prüft") == ("Buch", "haltung", "-")
    assert broken_word("die Lohn-", "und Gehalt") is None
    assert broken_word("der Netto-", "Lohn") is None
    assert broken_word("die Ver¬", "waltung")[2] == "¬"
    assert ("buchhaltung", 2) in [(v, i) for v, i in variants("bucbhaltung")] or any(v == "buchhaltung" for v, _ in variants("bucbhaltung"))


def test_find_and_repair(spark):
    good = [(i, BODY, None) for i in range(20)]
    noisy = [
        (100, "Die Bucbhaltung genehmigt den Dauer-\nauftrag und prüft.\fKopf", None),
        (101, None, json.dumps({"pages": [{"lines": [{"t": "Die Rechn@ng"}, {"t": "der Spedit|on."}]}]})),
        (102, None, None), (103, "", None), (103, "", None),
    ]
    df = spark.createDataFrame(good + noisy, "request_id long, text string, raw_ocr_response string").selectExpr("*", "1 as line_no", "'x' as noise")
    got = {tuple(r) for r in find_noise(df).collect()}
    assert {(100, 0, "misread"), (100, 0, "hyphen"), (101, 1, "misread")} <= got
    assert not [r for r in got if r[0] < 100 or r[0] > 101]
    text = {r.request_id: r.repaired for r in repair(df).collect()}
    assert "Dauerauftrag" in text[100] and text[102] is None and text[103] == ""
    assert find_noise(df.limit(0)).count() == 0


def test_repair_uses_the_words_of_the_corpus(spark):
    long = "Die Abrechnung wurde von der zentralen Stelle geprüft und"
    good = [(i, f"{BODY} Das alt-neue Konto und die Übersendung sind erfasst.", None) for i in range(20)]
    noisy = [(100, f"{long} die Bucbhaltung zahlt (Sp€dition) das alt-\nneue Konto.", None), (101, f"{long} der Dauer-\nauftr@g läuft, die 5pedition auch.", None)]
    df = spark.createDataFrame(good + noisy, "request_id long, text string, raw_ocr_response string")
    text = {r.request_id: r.repaired for r in repair(df).collect()}
    assert "die Buchhaltung zahlt (Spedition) das alt-neue Konto" in text[100] and "Dauerauftrag läuft, die Spedition auch." in text[101]
    assert all(text[i] == good[i][1] for i in range(20))
    assert (respell("BUCBHALTUNG", "buchhaltung", "Buchhaltung"), respell("Bucbhaltung", "buchhaltung", "x"), respell("Cin", "ein", "ein")) == ("BUCHHALTUNG", "Buchhaltung", "Ein")


def test_running_lines_may_stand_anywhere_from_the_end():
    head = [f"Kopf Zeile {c} der Firma" for c in "abcdef"]
    pages = [[*head, *[f"Text {k} und Nummer {i * 31 + k} der Liste ist lang" for i in range(12)], f"Blatt {k + 1}"] for k in range(4)]
    labels = label_pages(pages)
    assert all(page[:6] == ["H"] * 6 and page[6:18] == ["B"] * 12 and page[18] == "P" for page in labels)


def test_chain_against_all_paths():
    rng = np.random.default_rng(4)
    chain = Chain.given()
    sizes = list(scans.FEATURES.items())
    for n in (1, 2, 4):
        obs = np.array([sum(int(rng.integers(0, k)) << scans._SHIFT[f] for f, k in sizes) for _ in range(n)])
        scores = chain.scores(obs)

        def value(path):
            first, step = chain.tables["first"][0], chain.tables["next"]
            return first[path[0]] + sum(scores[t, s] for t, s in enumerate(path)) + sum(step[a, b] for a, b in zip(path, path[1:])) + step[path[-1], 6]

        import itertools

        best = max(itertools.product(range(6), repeat=n), key=value)
        got, other = chain.decode([obs, np.concatenate([obs, obs])])
        assert abs(value(best) - value(list(got))) < 1e-9 and len(other) == 2 * n


def test_chain_is_fitted_alike_at_every_size(spark):
    text = "\n".join(f"Zeile {i} mit einem Text, der bis an den Rand der Seite reicht" for i in range(9)) + "\nKurz.\n\nNeuer Absatz beginnt\fSeite 2"
    df = spark.createDataFrame([(1, text)], "request_id long, text string")
    one = fit_chain(df.mapInArrow(scans._read, scans._READ))
    many = fit_chain(df.union(df).union(df).mapInArrow(scans._read, scans._READ))
    assert all(np.allclose(one.tables[k], many.tables[k]) for k in one.tables)
    assert all(np.allclose(np.exp(t).sum(1), 1, atol=0.02) for t in one.tables.values())
    assert fit_chain(df.limit(0).mapInArrow(scans._read, scans._READ)).tables.keys() == one.tables.keys()


def test_paragraphs_and_page_ends():
    text = "Die Prüfung der Unterlagen hat\nergeben, dass der Betrag nicht\nstimmt.\nDer Vorgang geht zurück an die\nAbteilung.\n\n1  Kugellager   12,30\n2  Schrauben    4,10\f\nSeite 2\nDie Abteilung zahlt den Betrag"
    parts = tidy(text).split("\n\n")
    assert parts[0] == "Die Prüfung der Unterlagen hat ergeben, dass der Betrag nicht stimmt."
    assert parts[1] == "Der Vorgang geht zurück an die Abteilung." and parts[2:4] == ["1  Kugellager   12,30", "2  Schrauben    4,10"]
    assert "Seite 2" not in tidy(text) and tidy("") == "" and tidy(" \n\f ") == ""
    assert len(observe("a\n" * 50_000, [["a"] * 50_000 + [""]])[0]) == 50_000


def test_words_of_one_and_several_confusions(spark):
    good = [(i, f"{BODY} Die Rechnung nennt den Betrag für Verpackungsfolie.", None) for i in range(20)]
    bad = [(100, "Die Rechnnng nennt den Bctrag. Der Daucranftrag und die VerpackungsfoIie.", None), (101, "Die " + "V€rp@ckung$f0l!€" + " und " + "x" * 60 + ".", None)]
    df = spark.createDataFrame(good + bad, "request_id long, text string, raw_ocr_response string")
    text = {r.request_id: r.repaired for r in repair(df).collect()}
    assert text[100].startswith("Die Rechnung nennt den Betrag. Der Dauerauftrag und die") and "Verpackungsfolie" in text[101]
    assert {(r.request_id, r.noise) for r in find_noise(df).collect()} == {(100, "misread"), (101, "misread")}


def test_large_vocabularies_take_the_other_way(spark, monkeypatch):
    df = spark.createDataFrame([(i, BODY, None) for i in range(20)] + [(100, "Die Bucbhaltung prüft. Der Dau€rauftrag.", None)], "request_id long, text string, raw_ocr_response string")
    want = {tuple(r) for r in find_noise(df).collect()}
    monkeypatch.setattr(scans, "FEW", 0)
    monkeypatch.setattr(scans, "FREQUENT", 0.02)
    assert {tuple(r) for r in find_noise(df).collect()} == want and want
