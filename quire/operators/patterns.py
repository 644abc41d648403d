"""Evaluating patterns against annotations, choosing a covering set, and finding outliers."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window, functions as F

from quire.operators import evaluate, spans


def evaluate_patterns(texts: DataFrame, annotations: DataFrame, key: str, patterns: Mapping[str, str]) -> DataFrame:
    """Per pattern: ``findings``, ``correct`` (findings that are annotations), ``annotations`` in all, ``documents`` matched, measures."""
    found = None
    for name, pattern in patterns.items():
        one = spans.regex_spans(texts, key, "text", pattern, name).withColumnRenamed("tokenizer", "pattern")
        found = one if found is None else found.unionByName(one)
    gold = annotations.select(key, "start_offset", "end_offset").distinct().withColumn("_y", F.lit(1))
    joined = found.join(gold, on=[key, "start_offset", "end_offset"], how="left")
    per = joined.groupBy("pattern").agg(F.count(F.lit(1)).alias("findings"), F.sum(F.coalesce("_y", F.lit(0))).alias("correct"), F.countDistinct(key).alias("documents"))
    total = gold.agg(F.count(F.lit(1)).alias("annotations"))
    out = per.join(F.broadcast(total))  # one row
    tp, fp, fn = F.col("correct"), F.col("findings") - F.col("correct"), F.col("annotations") - F.col("correct")
    return out.withColumn("precision", F.round(evaluate.precision(tp, fp), 6)).withColumn("recall", F.round(evaluate.recall(tp, fn), 6)).withColumn("f1", F.round(evaluate.f1(tp, fp, fn), 6))


def greedy_cover(matches: DataFrame, ranks: DataFrame) -> DataFrame:
    """The patterns, by rank, that each find an annotation no better one has found. ``matches``: ``pattern``, ``annotation_id``; ``ranks``: ``pattern``, ``rank``.

    A pattern adds something exactly if it is the best-ranked one of some annotation, so the running union is a
    minimum per annotation and no order has to be walked.
    """
    best = matches.join(ranks, on="pattern").groupBy("annotation_id").agg(F.min(F.struct("rank", "pattern")).alias("b"))
    return best.groupBy(F.col("b.pattern").alias("pattern"), F.col("b.rank").alias("rank")).agg(F.count(F.lit(1)).alias("new"))


def rare_pattern_outliers(found: DataFrame, share: float = 0.1) -> DataFrame:
    """Annotations found only by patterns beyond the most frequent ones, whose findings make up ``share`` of the correct ones.

    ``found``: ``label``, ``pattern``, ``annotation_id``. Patterns are ranked by findings from the rarest; those within the share are
    rare, and annotations that no other pattern finds are outliers.
    """
    sizes = found.groupBy("label", "pattern").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("label").orderBy("n", "pattern").rowsBetween(Window.unboundedPreceding, 0)
    total = Window.partitionBy("label")
    rare = sizes.withColumn("upto", F.sum("n").over(w)).withColumn("total", F.sum("n").over(total)).withColumn("rare", F.col("upto") <= F.col("total") * share)
    judged = found.join(rare.select("label", "pattern", "rare"), on=["label", "pattern"])
    return judged.groupBy("label", "annotation_id").agg(F.min(F.col("rare").cast("int")).alias("only_rare")).filter("only_rare = 1").select("label", "annotation_id")


def confidence_outliers(rows: DataFrame, limit: float = 0.5) -> DataFrame:
    """Right annotations that the model was not confident of."""
    return rows.filter(F.col("is_correct") & (F.col("confidence") < limit))


def normalization_outliers(rows: DataFrame, value: str) -> DataFrame:
    """Annotations whose text has no value of their label's type; zero and false count as none."""
    v = F.col(value)
    return rows.filter(v.isNull() | v.isin("0.0", "0", "-0.0", "false", ""))


def common_outliers(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Rows that every method names."""
    for o in others:
        first = first.intersect(o)
    return first
