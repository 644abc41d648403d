"""Sentence units."""

import itertools
import math
import random
import time

import pytest

from quire.llm.sentences import EXCESS, LONG, SHORT, STUB, _best_spans, fit_openers, sentences, split_sentences

CASES = [
    "Dr. Tannhof prüft den Vorgang.|Die Rate beträgt 1,9 % p. a. ab dem 1. Juni.|Bitte sofort stornieren!",
    "„Wir zahlen nicht vor dem 15.“, schrieb die Buchhaltung.|Er fragte: „Wer hat das freigegeben?“|Das ist … nun ja, ungewöhnlich.",
    "“Why was this approved?” asked the auditor.|He wrote: “We cannot pay before the 15th.”|iPhones are excluded.",
    "« Qui a validé cette facture ? » demande la comptabilité.|Sont exclus les frais, etc.|Il a répondu : « Nous ne paierons pas. »|Merci !",
    "他问：“谁批准了这笔付款？”|“请先付款。”卖方要求说。|系统版本为2.3.1；接口保持不变。",
    "「誰が承認しましたか？」と経理部が尋ねた。|契約は……まだ締結されていません。",
    "“भुगतान कब होगा?” लेखाकार ने पूछा।|श्री. महेन्द्रक ने क्र. 5 पर हस्ताक्षर किए।",
    "Ποιος ενέκρινε την πληρωμή;|Η αποστολή έφθασε· λείπουν 186 κιβώτια.",
]


@pytest.mark.parametrize("case", CASES)
def test_units(case):
    parts = case.split("|")
    sep = "" if any("　" <= c <= "鿿" for c in case) else " "
    text = sep.join(parts)
    assert [text[a:b] for a, b in sentences(text)] == parts


def test_blocks_lists_and_thai():
    text = "Zahlungsbedingungen\n\n2. Die Rechnung ist\nfällig.\fยอดรวมคือ 1,250.50 บาท ไม่รวมค่าขนส่งค่ะ สินค้ามาถึงคลังแล้วครับ"
    assert [text[a:b] for a, b in sentences(text)] == ["Zahlungsbedingungen", "2. Die Rechnung ist\nfällig.", "ยอดรวมคือ 1,250.50 บาท ไม่รวมค่าขนส่งค่ะ", "สินค้ามาถึงคลังแล้วครับ"]
    assert sentences("") == [] and sentences(" \n\f ") == []


def test_frame(spark):
    df = spark.createDataFrame([(1, "Gut so. Sehr gut.", 9), (1, "Gut so. Sehr gut.", 9), (2, None, 9), (3, "", 9), (4, "x " * 50_000, 9)], "id long, text string, start_offset int")
    rows = [tuple(r) for r in split_sentences(df, "text").collect()]
    assert sorted(rows) == [(1, 0, 7), (1, 0, 7), (1, 8, 17), (1, 8, 17), (4, 0, 99_999)]
    assert split_sentences(df.limit(0), "text").count() == 0


def test_no_number_of_borders_ends_a_unit():
    numbers = "Siehe " + ", ".join(f"Nr. {i}" for i in range(80)) + " in der Liste."
    text = numbers + " Danke."
    assert [text[a:b] for a, b in sentences(text)] == [numbers, "Danke."]
    for n in (2, 7, 40):
        quoted = "Er schrieb: „" + " ".join(f"Wir zahlen die Rate {i} nicht." for i in range(n)) + "“"
        text = quoted + " Das war alles."
        assert [text[a:b] for a, b in sentences(text)] == [quoted, "Das war alles."]
    open_only = "Er sagte: „Wir zahlen nicht. Das war alles. Mehr nicht."
    assert len(sentences(open_only)) == 3  # a quotation without an end holds nothing together


def test_programme_against_all_segmentations():
    rng = random.Random(5)
    for _ in range(200):
        n = rng.randint(1, 9)
        ends, at = [], 0
        for _ in range(n):
            at += rng.choice([1, 2, 5, 300, 500, 900])
            ends.append(at)
            at += 1
        starts = [0] + [e + 1 for e in ends[:-1]]
        values = [rng.choice([-2.0, -0.5, 0.25, 1.5, 4.5]) for _ in ends[:-1]] + [0.0]

        def score(spans):
            total = 0.0
            for a, b in spans:
                size = b - a
                total += values[ends.index(b)] - (STUB if size < SHORT else max(0, size - LONG) / EXCESS)
            return total

        best = -math.inf
        for cuts in itertools.product((False, True), repeat=n - 1):
            spans, a = [], 0
            for k, cut in enumerate((*cuts, True)):
                if cut:
                    spans.append((starts[a], ends[k]))
                    a = k + 1
            best = max(best, score(spans))
        assert score(_best_spans(starts, ends, values)) == pytest.approx(best)


@pytest.mark.parametrize("part", ["ยอดรวมคือ 1,250.50 บาท สินค้ามาถึงคลังแล้ว ", "「請付款。」他說。", "Siehe Nr. 5 und 7. ", "« Non. » Il a dit. "])
def test_long_blocks_take_time_in_proportion(part):
    def seconds(n):
        text = part * n
        at = time.perf_counter()
        sentences(text)
        return time.perf_counter() - at

    seconds(500)
    assert seconds(16_000) < 60 * seconds(1000) + 0.2


def test_openers_are_shares(spark):
    df = spark.createDataFrame([("Wir zahlen.\n\n12. Wir gehen.\fOnce",)] * 3, "t string")
    got = fit_openers(df, "t")
    assert got == pytest.approx({"Wir": 5 / 1009, "Once": 2 / 1009})
