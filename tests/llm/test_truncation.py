"""Texts that break off."""

import math
import random

import numpy as np
import pytest

from quire.llm.truncation import censored_fit, detect_truncated, truncation_report

SENTENCE = "Die Buchhaltung genehmigt den Dauerauftrag ohne weitere Rückfrage. "


def test_limits_and_endings(spark):
    rng = random.Random(3)
    rows = []
    for i in range(300):
        text = (SENTENCE * rng.randint(2, 40)).strip()
        rows.append((i, "limited", text[:1000] if len(text) > 1000 else text))
    rows += [(400 + i, "free", SENTENCE * (i % 9 + 1) + "\nGesamtbetrag  1.284,26 €") for i in range(60)]
    special = {
        500: ("free", "Der Prüfer bestätigt die Mahnung vom 2"), 501: ("free", "Der Prüfer bestätigt …"), 502: ("free", "Alles gut.\n\nMit freundlichen Grüßen\nNordhang Handel GmbH & Co. KG"), 503: (None, "Siehe Nr."),
        504: ("free", "Der Prüfer schreibt am 3."), 505: ("free", None), 506: ("free", ""), 507: ("free", " \n"), 508: ("free", "1  Kugellager  5  12,30 EUR\n2  Kugell"), 509: ("free", "x" * 50_000),
    }
    rows += [(i, s, t) for i, (s, t) in special.items()]
    df = spark.createDataFrame(rows + rows[:3], "doc_id long, source string, text string").selectExpr("*", "1 as ending", "2 as limit")
    found = {r.doc_id: r for r in detect_truncated(df, ["doc_id"]).collect()}
    cut = [i for i, s, t in rows if s == "limited" and len(t) == 1000 and not t.endswith(".")]
    assert cut and all(found[i].truncated and found[i].limit == 1000 for i in cut)
    assert not any(found[i].truncated for i, s, t in rows if i < 500 and i not in cut)
    assert {i for i in special if found[i].truncated} == {500, 501, 503, 504, 508, 509}
    report = {r.source: r for r in truncation_report(detect_truncated(df, ["doc_id"])).collect()}
    assert report[None].truncated == 1
    assert detect_truncated(df.limit(0), ["doc_id"]).count() == 0


def test_the_length_decides_where_the_ending_does_not(spark):
    rng = random.Random(7)
    rows = []
    for i in range(400):
        text = (SENTENCE * rng.randint(2, 40)).strip()
        rows.append((i, "limited", text[:1000]))
    firm = "\nNordhang Handel GmbH"
    at_limit = SENTENCE * 20
    at_limit = at_limit[: 1000 - len(firm)].rstrip(". ") + firm
    rows += [(900, "limited", at_limit.ljust(1000, "x")[:1000] if len(at_limit) > 1000 else at_limit), (901, "limited", SENTENCE * 7 + firm)]
    found = {r.doc_id: r for r in detect_truncated(spark.createDataFrame(rows, "doc_id long, source string, text string"), ["doc_id"]).collect()}
    assert found[900].kind == found[901].kind == "firm" and found[900].ending == found[901].ending
    assert found[900].limit == 1000 and found[900].truncated and found[901].limit is None and not found[901].truncated


def test_fit_with_several_limits():
    rng = np.random.default_rng(1)
    x = rng.normal(7.0, 0.8, 40_000)
    held, free = [], []
    for part, limit in ((x[:20_000], 7.2), (x[20_000:], 8.0)):
        free.append(part[part < limit])
        held.append((limit, float((part >= limit).sum())))
    free = np.concatenate(free)
    mu, sigma = censored_fit(float(len(free)), float(free.sum()), float((free**2).sum()), held)
    assert mu == pytest.approx(7.0, abs=0.03) and sigma == pytest.approx(0.8, abs=0.03)
    assert censored_fit(0.0, 0.0, 0.0, [(3.0, 5.0)])[1] == pytest.approx(1.0) and math.isfinite(censored_fit(2.0, 4.0, 8.0, [])[1])

