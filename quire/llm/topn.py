"""The N best items of every group, by simultaneous bisection of all groups (problem 2).

An item's place is given by an order-preserving code: the score, higher first, then the identifier,
lower first. For all groups at once, the range that holds the N-th code is cut into ``ways`` equal
buckets, the rows of each bucket are counted (pre-aggregated before the shuffle), and the range shrinks to
the bucket with the N-th row, until the rows at or above a group's cutoff are exactly N. No group
is ever gathered or sorted: a pass moves one small row per group and bucket, plus the rows that are still
undecided, which get fewer from pass to pass.

The range is re-measured (least and greatest code of the rows left) in each pass, so a pass either
accepts rows or divides the range by ``ways``; the passes are bounded by about 14 N + 16 for any doubles.

Hot groups: at most ``HOT_GROUPS`` groups can each hold more than 1/HOT_GROUPS of all rows; their cutoffs are
copied once per salt and their rows spread over the salts, so no join task holds a whole hot group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from quire.session import Scratch

#: Upper bound of the rows of the broadcast list of hot groups.
HOT_GROUPS = 2000
#: Below this many rows a group is not worth salting.
HOT_LEAST = 20_000


def _salted_join(rows: DataFrame, state: DataFrame, hot: DataFrame, groups: Sequence[str]) -> DataFrame:
    """``rows`` with the columns of ``state`` (one row per group, with ``salts``), hot groups spread over their salts."""
    spread = rows.join(F.broadcast(hot.toDF(*[f"h_{g}" for g in groups], "h_salts")), on=[rows[g].eqNullSafe(F.col(f"h_{g}")) for g in groups], how="left")
    spread = spread.withColumn("_salt", F.when(F.col("h_salts").isNull(), 0).otherwise(F.pmod(F.xxhash64("_id"), F.col("h_salts"))).cast("int")).drop(*[f"h_{g}" for g in groups], "h_salts")
    copies = state.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).withColumnsRenamed({g: f"s_{g}" for g in groups} | {"_salt": "s_salt"})
    on = [spread[g].eqNullSafe(copies[f"s_{g}"]) for g in groups] + [spread["_salt"] == copies["s_salt"]]
    return spread.join(copies, on=on).drop(*[f"s_{g}" for g in groups], "s_salt", "_salt", "salts")


def _place(ways: int) -> Column:
    """The bucket of ``_id`` in ``id_lo``..``id_hi`` by whole numbers, lower identifiers higher. A range too wide for a long is halved first."""
    return F.expr(f"""{ways - 1} - CASE WHEN try_subtract(id_hi, id_lo) IS NOT NULL THEN (_id - id_lo) div ((id_hi - id_lo) div {ways} + 1)
        ELSE (shiftright(_id, 1) - shiftright(id_lo, 1)) div ((shiftright(id_hi, 1) - shiftright(id_lo, 1)) div {ways} + 1) END""")


def top_n(df: DataFrame, groups: Sequence[str], score: str, identifier: str, n: int, ways: int = 16, max_passes: int | None = None) -> DataFrame:
    """The first ``n`` items of each group by ``score`` descending, then ``identifier`` ascending.

    An item is a distinct (group, identifier) with at least one score that is neither null nor NaN; its score is the highest of
    these. Returns the columns ``groups``, ``identifier`` and ``score`` (double). Null group values form a group of their own; rows whose
    identifier is null are no items. Groups with fewer than ``n`` items give all. Repeated rows count once. Infinite
    scores are ordered like any other. Other columns are ignored, whatever their names. An empty table gives an empty result.
    """
    if n < 1 or ways < 2:
        raise ValueError("n must be at least 1 and ways at least 2")
    spark = df.sparkSession
    scratch = Scratch(spark, "topn")
    names = [f"_g{i}" for i in range(len(groups))]
    value = F.col(f"`{score}`").cast("double")
    items = (
        df.filter(value.isNotNull() & ~F.isnan(value) & F.col(f"`{identifier}`").isNotNull())
        .select(*[F.col(f"`{g}`").alias(a) for g, a in zip(groups, names)], F.col(f"`{identifier}`").cast("long").alias("_id"), (value + F.lit(0.0)).alias("_s"))
        .groupBy(*names, "_id").agg(F.max("_s").alias("_s"))
    )
    items = scratch.write(items, "items")
    stats = items.groupBy(*names).agg(F.count(F.lit(1)).alias("rows"), F.min("_s").alias("lo"), F.max("_s").alias("hi"), F.min("_id").alias("id_lo"), F.max("_id").alias("id_hi"))
    stats = scratch.write(stats, "stats")
    total = stats.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    per_salt = max(HOT_LEAST, total // HOT_GROUPS)
    stats = stats.withColumn("salts", F.greatest(F.lit(1), F.ceil(F.col("rows") / F.lit(per_salt))).cast("int"))
    hot = stats.filter(F.col("rows") > per_salt).select(*names, "salts")  # at most HOT_GROUPS rows
    least = F.lit(float("-inf"))
    cutoffs = [stats.filter(F.col("rows") <= n).select(*names, "salts", least.alias("cut_s"), F.lit(None).cast("long").alias("cut_id"))]
    state = stats.filter(F.col("rows") > n).select(*names, "salts", F.lit(n).cast("long").alias("need"), (F.col("lo") == F.col("hi")).alias("by_id"), "lo", "hi", "id_lo", "id_hi")
    rows, bound = items, max_passes or 14 * n + 40
    for turn in range(bound + 1):
        if not state.head(1):
            break
        if turn == bound:
            raise RuntimeError("bisection did not end")
        j = _salted_join(rows, state, hot, names).filter((F.col("_s") >= F.col("lo")) & (F.col("_s") <= F.col("hi")) & (~F.col("by_id") | F.col("_id").between(F.col("id_lo"), F.col("id_hi"))))
        # Halves keep the width of the range finite; infinite scores get buckets of their own. A width of 0 is two neighbouring doubles.
        width = F.col("hi") / 2 - F.col("lo") / 2
        part = F.when(width > 0, (F.col("_s") / 2 - F.col("lo") / 2) / width).otherwise(F.when(F.col("_s") > F.col("lo"), 1.0).otherwise(0.0))
        by_score = F.when(F.col("_s") == float("inf"), ways + 1).when(F.col("_s") == float("-inf"), -1).when(F.col("hi") == float("inf"), F.when(F.col("_s") > 0, ways).otherwise(0)).when(F.col("lo") == float("-inf"), F.when(F.col("_s") > 0, ways).otherwise(0)).when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.floor(part * ways), F.lit(ways - 1)))
        bucket = F.when(F.col("by_id"), _place(ways)).otherwise(by_score).cast("int").alias("bucket")
        binned = scratch.write(j.select(*names, "need", "by_id", "_id", "_s", bucket), "binned")
        counts = binned.groupBy(*names, "need", "by_id", "bucket").agg(F.count(F.lit(1)).alias("rows"), F.min("_s").alias("lo"), F.max("_s").alias("hi"), F.min("_id").alias("id_lo"), F.max("_id").alias("id_hi"))
        down = Window.partitionBy(*names).orderBy(F.desc("bucket"))  # at most ways + 3 rows a group
        above = F.col("upto") - F.col("rows")
        cut = (
            counts.withColumn("upto", F.sum("rows").over(down))
            .filter((F.col("upto") >= F.col("need")) & (above < F.col("need")))
            .select(*names, (F.col("need") - above).alias("left"), "rows", "by_id", "lo", "hi", "id_lo", "id_hi")
        )
        cut = cut.join(F.broadcast(hot.toDF(*[f"h_{g}" for g in names], "h_salts")), on=[cut[g].eqNullSafe(F.col(f"h_{g}")) for g in names], how="left")
        cut = cut.withColumn("salts", F.coalesce("h_salts", F.lit(1))).drop(*[f"h_{g}" for g in names], "h_salts")
        cut = scratch.write(cut, "cut")
        # Exactly as many rows as are needed: the group is done, the cutoff is the bucket's last code.
        done = F.col("left") == F.col("rows")
        cutoffs.append(cut.filter(done).select(*names, "salts", F.col("lo").alias("cut_s"), F.when(F.col("by_id"), F.col("id_hi")).alias("cut_id")))
        state = cut.filter(~done).select(*names, "salts", F.col("left").alias("need"), (F.col("lo") == F.col("hi")).alias("by_id"), "lo", "hi", "id_lo", "id_hi")
        scratch.drop("binned", keep=1)  # the pass before
        rows = binned.select(*names, "_id", "_s")
    scratch.drop("binned")
    every = cutoffs[0]
    for c in cutoffs[1:]:
        every = every.unionByName(c)
    kept = _salted_join(items, every, hot, names).filter((F.col("_s") > F.col("cut_s")) | ((F.col("_s") == F.col("cut_s")) & (F.col("cut_id").isNull() | (F.col("_id") <= F.col("cut_id")))))
    return kept.select(*[F.col(a).alias(g) for a, g in zip(names, groups)], F.col("_id").cast(df.schema[identifier].dataType).alias(identifier), F.col("_s").alias(score))
