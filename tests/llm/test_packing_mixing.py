"""Packing into containers and mixing of sources."""

import os

import numpy as np
import pytest

from pyspark.sql import functions as F

from quire.llm import mixing, packing, tokens

needs_vocabulary = pytest.mark.skipif(not os.path.exists(f"{tokens.FOLDER}/{tokens.VOCABULARY}"), reason="no vocabulary files")


@needs_vocabulary
def test_sizes_are_exact():
    count = tokens.Sizer(f"{tokens.FOLDER}/{tokens.VOCABULARY}")
    for text in ("", "Hello world's  end\n\n x", "Überweisung 12,50 € 数量不符 \t…", "a" * 500):
        assert count.size(text) == len(count.encoding.encode_ordinary(text))


def test_hilbert_curve_is_continuous():
    bits = 3
    keys = {packing.hilbert_key((x, y, z), bits): (x, y, z) for x in range(8) for y in range(8) for z in range(8)}
    assert sorted(keys) == list(range(512))
    assert all(sum(abs(a - b) for a, b in zip(keys[k], keys[k + 1])) == 1 for k in range(511))


@needs_vocabulary
def test_pack(spark):
    rng = np.random.default_rng(1)
    words = ["".join(map(chr, rng.integers(97, 123, 6))) for _ in range(200)]
    rows = [(i, " ".join(rng.choice(words, int(rng.integers(1, 25))))) for i in range(400)] + [(900, None), (901, ""), (902, "long text " * 400), (902, "long text " * 400), (903, "€" * 900)]
    df = spark.createDataFrame(rows, "id long, text string").withColumn("container_id", F.lit("x"))
    out = packing.pack(df, "id", "text", 128, tokens_per_task=10_000).toPandas()
    assert out.groupby("container_id")["n_tokens"].sum().max() <= 128
    pieces = out[~out.id.isin([902, 903])].groupby("id").size()
    assert (pieces == 1).all() and len(pieces) == 401
    text = dict(rows)
    for i, g in out[out.id == 903].groupby("id"):
        g = g.sort_values("piece_no")
        assert "".join(text[i][a:b] for a, b in zip(g.start_offset, g.end_offset)) == text[i]
    report = packing.packing_report(spark.createDataFrame(out), 128).first()
    assert report.fill > 0.9
    assert packing.pack(df.limit(0), "id", "text").count() == 0


def test_mix(spark):
    rng = np.random.default_rng(2)
    rows = [(i, "abc"[min(2, i % 7 // 3)], int(rng.lognormal(5, 1)) + 1) for i in range(3000)] + [(9001, None, 50), (9002, "zzz", 50), (9003, "a", None), (9004, "a", 0)]
    sized = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("a", 0.2, 1), ("b", 0.3, 2), ("c", 0.4, 4), ("missing", 0.1, 2)], "source string, target_share double, max_repeats int")
    mixed = mixing.mix(sized, targets)
    shares = {r.source: r for r in mixing.mixing_report(mixed, targets).collect()}
    for s, want in (("a", 0.2), ("b", 0.3), ("c", 0.4)):
        assert shares[s].actual_share == pytest.approx(want / 0.9, abs=0.01) and shares[s].most_copies <= shares[s].max_repeats
    assert shares["missing"].tokens == 0
    assert {r.source for r in mixed.select("source").distinct().collect()} == {"a", "b", "c"}
    assert mixing.mix(sized.limit(0), targets).count() == 0


@needs_vocabulary
def test_hard_cuts_fill_their_containers(spark):
    df = spark.createDataFrame([(1, "a" * 9000)], "id long, text string")
    out = packing.pack(df, "id", "text", 64).toPandas().sort_values("start_offset")
    assert len(out) >= 2 and (out.n_tokens <= 64).all() and (out.n_tokens.iloc[:-1] >= 60).all() and "".join("a" * (b - a) for a, b in zip(out.start_offset, out.end_offset)) == "a" * 9000


def test_mix_meets_the_document(spark):
    rows = [(i, "ab"[i % 2], 1 + i % 3) for i in range(40_000)]
    sized = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("a", 0.3, 1), ("b", 0.7, 1)], "source string, target_share double, max_repeats int")
    got = {r.source: r.t for r in mixing.mix(sized, targets).groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("t")).collect()}
    assert abs(got["a"] - got["b"] * 3 / 7) <= 3
