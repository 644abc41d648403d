"""Comparing predictions with what is right: joins, flags, votes, counts and measures over whole corpora."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from quire.operators.spans import in_blocks

#: The thresholds of a sweep: 0.05, 0.10 ... 0.95.
THRESHOLDS = [round(0.05 * i, 2) for i in range(1, 20)]


def true_if(flag: Column) -> Column:
    """A flag as two-valued: null counts as false, so that NOT is safe."""
    return F.coalesce(flag, F.lit(False))


def precision(tp: Column, fp: Column) -> Column:
    return F.coalesce(F.try_divide(tp.cast("double"), (tp + fp).cast("double")), F.lit(0.0))


def recall(tp: Column, fn: Column) -> Column:
    return F.coalesce(F.try_divide(tp.cast("double"), (tp + fn).cast("double")), F.lit(0.0))


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    return F.coalesce(F.try_divide(tp.cast("double"), tp + 0.5 * (fp + fn)), F.lit(0.0))


def compare_strict(gold: DataFrame, predicted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full outer join on document and offsets; the predicted side's other columns get the suffix ``_predicted``.

    ``label`` on either side decides correctness. Flags: ``is_matched``, ``true_positive``, ``false_positive``, ``false_negative``.
    """
    renamed = predicted.withColumnsRenamed({c: f"{c}_predicted" for c in predicted.columns})
    cond = [gold[k] == renamed[f"{k}_predicted"] for k in keys]
    joined = gold.join(renamed, on=cond, how="full_outer")
    matched = F.col(keys[0]).isNotNull() & F.col(f"{keys[0]}_predicted").isNotNull()
    joined = joined.withColumn("is_matched", matched)
    return with_flags(joined)


def with_flags(joined: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Outcome flags of a compared frame with ``label``, ``label_predicted``, ``is_matched`` and maybe ``confidence_predicted``."""
    above = true_if(F.col("confidence_predicted") >= threshold) if "confidence_predicted" in joined.columns else F.col("label_predicted").isNotNull()
    same = true_if(F.col("label") == F.col("label_predicted"))
    hit = true_if(F.col("is_matched")) & above & same
    return (
        joined.withColumn("above_threshold", above)
        .withColumn("true_positive", hit)
        .withColumn("false_positive", F.col("label_predicted").isNotNull() & above & ~hit)
        .withColumn("false_negative", F.col("label").isNotNull() & ~hit)
    )


def counts() -> list[Column]:
    """Sums of the outcome flags as tp, fp, fn."""
    return [F.sum(F.col(c).cast("long")).alias(n) for c, n in (("true_positive", "tp"), ("false_positive", "fp"), ("false_negative", "fn"))]


def all_counts(prefixes: Sequence[str] = ("", "tokenizer_", "clf_")) -> list[Column]:
    """Sums of the outcome flags of the whole, the tokenizer and the classifier (``tp``, ``tokenizer_tp`` ...), ``gt`` (rows with a right label)
    and ``tn`` (rows that are none of the three)."""
    flags = (("true_positive", "tp"), ("false_positive", "fp"), ("false_negative", "fn"))
    sums = [F.sum(true_if(F.col(p + c)).cast("long")).alias(p + n) for p in prefixes for c, n in flags]
    none = ~true_if(F.col("true_positive")) & ~true_if(F.col("false_positive")) & ~true_if(F.col("false_negative"))
    return [*sums, F.count("label").alias("gt"), F.sum(none.cast("long")).alias("tn")]


def with_stage_flags(joined: DataFrame) -> DataFrame:
    """Outcome flags of the tokenizer (a right span was made, was not, or a span is of no use) and, on matched spans, of the classifier alone."""
    matched, made, right = true_if(F.col("is_matched")), F.col("label_predicted").isNotNull(), F.col("label").isNotNull()
    above, same = true_if(F.col("above_threshold")), true_if(F.col("label") == F.col("label_predicted"))
    return joined.withColumns({
        "tokenizer_true_positive": right & matched, "tokenizer_false_positive": ~right & made, "tokenizer_false_negative": right & ~matched,
        "clf_true_positive": matched & right & above & same, "clf_false_positive": matched & right & above & ~same, "clf_false_negative": matched & right & ~above,
    })


def query_rows(joined: DataFrame, column: str, value) -> DataFrame:
    """The rows that have ``value`` on either side, as right or as predicted ``column``. ``None`` gives all rows."""
    return joined if value is None else joined.filter((F.col(column) == value) | (F.col(f"{column}_predicted") == value))


def per_slice(flagged: DataFrame, column: str) -> DataFrame:
    """tp, fp, fn and measures of each value of ``column`` (label, document, label set): a row counts for its right and its predicted value, once if
    they agree. All slices in one pass."""
    both = F.array_distinct(F.array_compact(F.array(column, f"{column}_predicted")))
    rows = flagged.withColumn("_for", F.explode(both))
    return measures(rows.groupBy(F.col("_for").alias(column)).agg(*counts()))


def with_frequency(rows: DataFrame, label: str = "label") -> DataFrame:
    """``rows`` with ``frequency``, the rows of the same label, 0 without one. Counts are joined back, so no label's rows meet in one task."""
    sizes = rows.filter(F.col(label).isNotNull()).groupBy(F.col(label).alias("_l")).agg(F.count(F.lit(1)).alias("frequency"))
    return rows.join(F.broadcast(sizes) if sizes.limit(100_001).count() <= 100_000 else sizes, rows[label] == sizes["_l"], "left").drop("_l").withColumn("frequency", F.coalesce("frequency", F.lit(0)))


def disambiguated_ids(rows: DataFrame, document: str, identifier: str, order: Sequence[str]) -> DataFrame:
    """``rows`` with ``disambiguated_id``: the identifier as text, with ``_1``, ``_2`` ... by ``order`` where it occurs more than once in its document. Null stays null."""
    group = Window.partitionBy(document, identifier)
    n, k = F.count(F.lit(1)).over(group), F.row_number().over(group.orderBy(*order))
    text = F.col(identifier).cast("string")
    return rows.withColumn("disambiguated_id", F.when(n > 1, F.concat_ws("_", text, k.cast("string"))).otherwise(text)).withColumn("disambiguated_id", F.when(F.col(identifier).isNotNull(), F.col("disambiguated_id")))


def relations(flagged: DataFrame, right: str, predicted: str) -> DataFrame:
    """``right``, ``predicted`` and ``relation`` of each compared row: TP, FP, FN or TN; ``no_match`` stands for the side that is missing."""
    kind = F.when(true_if(F.col("true_positive")), "TP").when(true_if(F.col("false_positive")), "FP").when(true_if(F.col("false_negative")), "FN").otherwise("TN")
    return flagged.select(F.coalesce(F.col(right).cast("string"), F.lit("no_match")).alias(right), F.coalesce(F.col(predicted).cast("string"), F.lit("no_match")).alias(predicted), kind.alias("relation"))


def relation_matrix(flagged: DataFrame, right: str, predicted: str, most: int = 1000) -> DataFrame:
    """The matrix of ``relations`` of one document: a row per right id, a column per predicted id, TN where the two do not meet. A matrix of more than
    ``most`` columns raises; ``relations`` has it in long form whatever its size."""
    long = relations(flagged, right, predicted)
    columns = [r[0] for r in long.select(predicted).distinct().orderBy(predicted).limit(most + 1).collect()]
    if len(columns) > most:
        raise ValueError(f"more than {most} predicted ids: use relations")
    return long.groupBy(right).pivot(predicted, columns).agg(F.first("relation")).fillna("TN")


def measures(counted: DataFrame, digits: int = 6) -> DataFrame:
    """``precision``, ``recall`` and ``f1`` of a frame with tp, fp, fn; 0 where nothing can be divided."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counted.withColumn("precision", F.round(precision(tp, fp), digits)).withColumn("recall", F.round(recall(tp, fn), digits)).withColumn("f1", F.round(f1(tp, fp, fn), digits))


def per_label(flagged: DataFrame) -> DataFrame:
    """tp, fp, fn of each label; a row counts for its right and for its predicted label, once if they agree."""
    both = F.array_distinct(F.array_compact(F.array("label", "label_predicted")))
    rows = flagged.withColumn("for_label", F.explode(both))
    return rows.groupBy(F.col("for_label").alias("label")).agg(*counts())


def threshold_sweep(joined: DataFrame, by: str = "label", thresholds: Sequence[float] = tuple(THRESHOLDS)) -> DataFrame:
    """tp, fp, fn and measures per ``by`` and threshold: one pass, each row standing for all thresholds at once. ``by`` and ``{by}_predicted`` are
    columns of ``joined``; a row counts for both.

    Counting by the last threshold a row reaches, then summing from above, avoids multiplying the rows.
    """
    same = true_if(F.col("label") == F.col("label_predicted")) & true_if(F.col("is_matched"))
    conf = F.coalesce("confidence_predicted", F.lit(-1.0))
    reached = sum((conf >= t).cast("int") for t in thresholds) if thresholds else F.lit(0)
    both = F.array_distinct(F.array_compact(F.array(by, f"{by}_predicted")))
    rows = joined.withColumn("for", F.explode(both)).select(F.col("for").alias(by), same.alias("same"), reached.alias("reached"), F.col("label").isNotNull().alias("right"), F.col("label_predicted").isNotNull().alias("made"))
    cells = rows.groupBy(by, "reached").agg(F.sum((F.col("same")).cast("long")).alias("s"), F.sum((F.col("made") & ~F.col("same")).cast("long")).alias("w"), F.sum(F.col("right").cast("long")).alias("g"))
    grid = cells.withColumn("at", F.explode(F.array(*[F.struct(F.lit(i + 1).alias("i"), F.lit(t).alias("threshold")) for i, t in enumerate(thresholds)])))
    hit = (F.col("reached") >= F.col("at.i")).cast("long")
    # A matched row counts as right and as made; below the threshold it is a miss.
    out = grid.groupBy(by, F.col("at.threshold").alias("threshold")).agg(F.sum(F.col("s") * hit).alias("tp"), F.sum(F.col("w") * hit).alias("fp"), (F.sum("g") - F.sum(F.col("s") * hit)).alias("fn"))
    return measures(out)


def best_threshold(sweep: DataFrame, by: str = "label", metric: str = "f1") -> DataFrame:
    """The best threshold of each label; the lowest of equals."""
    best = F.max_by(F.struct("threshold", metric), F.struct(F.col(metric), -F.col("threshold")))
    return sweep.groupBy(by).agg(best.alias("b")).select(by, F.col("b.threshold").alias("threshold"), F.col(f"b.{metric}").alias(metric))


def overlapping_false_positives(false_positives: DataFrame, gold: DataFrame, key: str) -> DataFrame:
    """The false positives that overlap any right span of their document. The two meet by document and block of positions; the offsets
    found pick the rows."""
    f = in_blocks(false_positives.select(F.col(key).alias("_f"), F.col("start_offset").alias("_s"), F.col("end_offset").alias("_e")).distinct(), "_s", "_e", "_fb")
    g = in_blocks(gold.select(F.col(key).alias("_k"), F.col("start_offset").alias("_a"), F.col("end_offset").alias("_b")), "_a", "_b", "_gb")
    hit = f.join(g, (f["_f"] == g["_k"]) & (f["_fb"] == g["_gb"]) & (f["_s"] < g["_b"]) & (g["_a"] < f["_e"]), "left_semi").select("_f", "_s", "_e").distinct()
    return false_positives.join(hit, (false_positives[key] == hit["_f"]) & (false_positives["start_offset"] == hit["_s"]) & (false_positives["end_offset"] == hit["_e"]), "left_semi")


def compare_overlapping(gold: DataFrame, predicted: DataFrame, key: str) -> DataFrame:
    """Pairs of one document and label whose spans touch (ends count), with the flag ``is_matched``, and each span of either side without any.

    Duplicates beyond the first match of either side, by offsets, are dropped where both sides are duplicates. Spans meet by document,
    label and block of positions, each pair in the first block that both reach, so no document is paired with itself.
    """

    p = predicted.select(F.col(key).alias(f"{key}_predicted"), F.col("label").alias("label_predicted"), F.col("start_offset").alias("start_predicted"), F.col("end_offset").alias("end_predicted"), *([F.col("confidence").alias("confidence_predicted")] if "confidence" in predicted.columns else []))
    g, p = in_blocks(gold, "start_offset", "end_offset", "_block", "_first"), in_blocks(p, "start_predicted", "end_predicted", "_block_p", "_first_p")
    touch = (p["start_predicted"] <= g["end_offset"]) & (p["end_predicted"] >= g["start_offset"]) & (g["_block"] == F.greatest(g["_first"], p["_first_p"]))
    joined = g.withColumn("_g", F.lit(True)).join(p.withColumn("_p", F.lit(True)), (g[key] == p[f"{key}_predicted"]) & (g["label"] == p["label_predicted"]) & (g["_block"] == p["_block_p"]) & touch, "full_outer")
    joined = joined.withColumn("is_matched", true_if(F.col("_g") & F.col("_p"))).withColumn("_k", F.coalesce(key, f"{key}_predicted")).withColumn("_l", F.coalesce("label", "label_predicted"))
    order = [F.desc("is_matched"), "start_offset", "end_offset", "start_predicted", "end_predicted"]
    # The document and label stand for the side that is missing, lest all such rows be one group.
    wg = Window.partitionBy("_k", "_l", "_g", "start_offset", "end_offset").orderBy(*order)
    wp = Window.partitionBy("_k", "_l", "_p", "start_predicted", "end_predicted").orderBy(*order)
    ranked = joined.repartition("_k", "_l").select("*", F.row_number().over(wg).alias("_ng"), F.first("is_matched").over(wg).alias("_mg"), F.row_number().over(wp).alias("_np"), F.first("is_matched").over(wp).alias("_mp"))
    ranked = ranked.withColumn("duplicated", F.col("is_matched") & (F.col("_ng") > 1)).withColumn("duplicated_predicted", F.col("is_matched") & (F.col("_np") > 1))
    # A span without a match in one block may have it in another; without any it is left once.
    alone = F.when(F.col("_g"), ~F.col("_mg") & F.col("_block").eqNullSafe(F.col("_first"))).otherwise(~F.col("_mp") & F.col("_block_p").eqNullSafe(F.col("_first_p")))
    kept = ranked.filter(F.when(F.col("is_matched"), ~(F.col("duplicated") & F.col("duplicated_predicted"))).otherwise(alone))
    return with_flags(kept.drop("_g", "_p", "_k", "_l", "_first", "_first_p", "_block", "_block_p", "_ng", "_np", "_mg", "_mp"))


def weighted_vote(rows: DataFrame, group: str, value: str, weight: str | None = None) -> DataFrame:
    """The value of each group with most weight (or rows); the smallest of equals. Null groups are a group; null values do not vote."""
    w = F.coalesce(F.col(weight), F.lit(0.0)) if weight else F.lit(1.0)
    sums = rows.filter(F.col(value).isNotNull()).groupBy(group, value).agg(F.sum(w).alias("_w"))
    ranked = sums.groupBy(group).agg(F.max("_w").alias("_top"))
    best = sums.join(ranked.withColumnRenamed(group, "_g"), F.col(group).eqNullSafe(F.col("_g")) & (F.col("_w") == F.col("_top")))
    return best.groupBy(group).agg(F.min(value).alias(value))


def grouped_vote(rows: DataFrame, group: str, target: str, above: str = "above_threshold", matched: str = "is_matched", confidence: str = "confidence_predicted") -> DataFrame:
    """``rows`` with ``{target}_vote``, the value of ``target`` their group agrees on, and ``is_correct_{target}``, whether the row has it. A null group is a group.

    Rows that are matched and above their threshold are eligible. Without any, the group votes by confidence, or, if no confidence or no target speaks, by the number of rows,
    rows without a target too. With eligible ones only these vote, by confidence if any of them has one, else by number; if none of them has a target the vote is null. 0 and null
    do not speak. The smallest of equal values wins, null last. Votes are summed per value before anything is compared.
    """
    elig, conf, value = true_if(F.col(above)) & true_if(F.col(matched)), F.coalesce(F.col(confidence), F.lit(0.0)), F.col(target)
    kind = rows.schema[target].dataType.typeName()
    truthy = value.isNotNull() & (value != F.lit("" if kind == "string" else 0)) if kind != "boolean" else F.coalesce(value, F.lit(False))
    per = rows.groupBy(F.col(group).alias("_g"), value.alias("_v")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(conf).alias("w"), F.sum(elig.cast("long")).alias("ne"), F.sum(F.when(elig, conf).otherwise(0.0)).alias("we"),
        F.max(conf != 0).alias("c"), F.max(elig & (conf != 0)).alias("ce"), F.max(truthy).alias("t"), F.max(elig & truthy).alias("te"),
    )
    of = per.groupBy(F.col("_g").alias("_h")).agg(F.max(F.col("ne") > 0).alias("any"), F.max("c").alias("ac"), F.max("ce").alias("ace"), F.max("t").alias("at"), F.max("te").alias("ate"))
    joined = per.join(of, per["_g"].eqNullSafe(of["_h"]))
    by_number = F.when(F.col("any"), F.col("ne")).otherwise(F.col("n")).cast("double")
    by_weight = F.when(F.col("any"), F.col("we")).otherwise(F.col("w"))
    plain = F.when(F.col("any"), ~F.col("ace")).otherwise(~F.col("ac") | ~F.col("at"))
    weight = F.round(F.when(plain, by_number).otherwise(by_weight), 9)
    counts_too = F.col("_v").isNotNull() | (~F.col("any") & plain)
    scored = joined.filter(counts_too & (~F.col("any") | ((F.col("ne") > 0) & F.col("ate"))))
    best = scored.groupBy("_g").agg(F.min_by("_v", F.struct(-weight, F.col("_v").isNull(), F.col("_v"))).alias(f"{target}_vote"))
    out = rows.join(best, rows[group].eqNullSafe(best["_g"]), "left").drop("_g")
    return out.withColumn(f"is_correct_{target}", true_if(F.col(target) == F.col(f"{target}_vote")))


def prioritize(rows: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per group: the first true positive, else the first false positive, else the first miss. Rows with a null key are left out."""
    rank = F.when(F.col("true_positive"), 0).when(F.col("false_positive"), 1).when(F.col("false_negative"), 2).otherwise(3)
    keyed = rows.dropna(subset=list(group))
    w = Window.partitionBy(*group).orderBy(rank, *order)
    return keyed.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def confusion(actual: DataFrame, classes: Sequence | None = None, a: str = "actual", p: str = "predicted") -> DataFrame:
    """Counts by actual and predicted class, long form: ``actual``, ``predicted``, ``n``. Only pairs of ``classes``, if given."""
    out = actual.groupBy(F.col(a).alias("actual"), F.col(p).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    return out.filter(F.col("actual").isin(list(classes)) & F.col("predicted").isin(list(classes))) if classes is not None else out


def confusion_table(actual: DataFrame, classes: Sequence, a: str = "actual", p: str = "predicted", missing=-1) -> DataFrame:
    """The square table of counts over ``classes``: a row per actual class, a column per predicted one, 0 where there is none. A prediction that is null counts as
    ``missing``, which like all others outside ``classes`` has no column."""
    rows = actual.select(F.col(a).alias("actual"), F.coalesce(F.col(p), F.lit(missing)).alias("predicted"))
    every = actual.sparkSession.createDataFrame([(c,) for c in classes], rows.select("actual").schema)
    table = rows.groupBy(F.col("actual").alias("_a")).pivot("predicted", list(classes)).count()
    return every.join(table, every["actual"] == table["_a"], "left").drop("_a").fillna(0)


def per_class(actual: DataFrame, a: str = "actual", p: str = "predicted") -> DataFrame:
    """tp, fp, fn, tn of each class against the rest, and measures; one pass over the rows, the rest on the small table of counts."""
    cells = actual.groupBy(F.col(a).alias("a"), F.col(p).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    total = cells.agg(F.sum("n").alias("total"))
    rows = cells.select(F.explode(F.array_distinct(F.array_compact(F.array("a", "p")))).alias("class"), "a", "p", "n")
    isa, isp = true_if(F.col("a") == F.col("class")), true_if(F.col("p") == F.col("class"))
    out = rows.groupBy("class").agg(F.sum(F.when(isa & isp, F.col("n")).otherwise(0)).alias("tp"), F.sum(F.when(~isa & isp, F.col("n")).otherwise(0)).alias("fp"), F.sum(F.when(isa & ~isp, F.col("n")).otherwise(0)).alias("fn"))
    out = out.join(F.broadcast(total)).withColumn("tn", F.col("total") - F.col("tp") - F.col("fp") - F.col("fn")).drop("total")  # one row
    return measures(out)


def weighted_measures(classes: DataFrame) -> DataFrame:
    """Means of the measures over classes, weighted by the number of actual rows (tp + fn)."""
    support = F.col("tp") + F.col("fn")
    return classes.agg(*[F.round(F.sum(F.col(m) * support) / F.sum(support), 6).alias(m) for m in ("precision", "recall", "f1")])
