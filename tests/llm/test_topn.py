"""Top items per group against a sort."""

import math
import random

import pytest

from quire.llm.topn import top_n


def expected(rows, n):
    best = {}
    for g, i, s in rows:
        if i is not None and s is not None and not math.isnan(s):
            best[g, i] = max(best.get((g, i), -math.inf), s)
    out = set()
    for group in {g for g, _ in best}:
        items = sorted((-s, i) for (g, i), s in best.items() if g == group)
        out |= {(group, i) for _, i in items[:n]}
    return out


@pytest.mark.parametrize("n", [1, 3])
def test_against_sort(spark, n):
    rng = random.Random(n)
    rows = [("hot", i, round(rng.random(), 2)) for i in range(600)] + [("hot", i, round(rng.random(), 2)) for i in range(0, 600, 7)]
    rows += [(g, i, rng.choice([0.5, 0.25, None, math.nan, math.inf, -math.inf, 1e300, -0.0, 0.0, 1e-9])) for g in ("a", "b", None) for i in range(12)]
    rows += [("ties", i, 0.5) for i in range(40)] + [("few", 3, 0.1), ("few", 3, 0.1), ("none", 1, None), ("few", None, 0.9)]
    df = spark.createDataFrame(rows, "g string, i long, s double").selectExpr("*", "1 as need", "2 as lo", "'x' as bucket")
    got = [(r.g, r.i) for r in top_n(df, ["g"], "s", "i", n, ways=4).collect()]
    assert len(got) == len(set(got)) and set(got) == expected(rows, n)


def test_empty(spark):
    assert top_n(spark.createDataFrame([], "g string, i long, s double"), ["g"], "s", "i", 3).count() == 0


def test_wide_identifiers_and_close_scores(spark):
    low, high = -(2**63), 2**63 - 1
    rows = [("near", 2**60 + i, 0.5) for i in range(40)] + [("negative", -(2**60) - i, 0.5) for i in range(40)] + [("ends", i, 0.5) for i in (low, low + 1, -5, 0, 7, high - 1, high)]
    rows += [("hash", (i * 0x9E3779B97F4A7C15) % 2**64 - 2**63, 0.5) for i in range(300)] + [("tiny", i, s) for i, s in enumerate([0.0, 5e-324, 1e-323, 5e-324, 0.0])] + [("steps", i, 2.0**i) for i in range(-300, 300)]
    df = spark.createDataFrame(rows, "g string, i long, s double")
    got = [(r.g, r.i) for r in top_n(df, ["g"], "s", "i", 3).collect()]
    assert len(got) == len(set(got)) and set(got) == expected(rows, 3)
