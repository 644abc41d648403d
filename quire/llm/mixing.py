"""Mixing sources to target weights (problem 8).

Entropy balancing: among all document rates that give every source its share of the tokens, those nearest to one use of each
document in relative entropy have the form exp(lambda_s * size), cut at the source's cap. The dual is convex; Newton steps for all
sources at once are taken on a histogram of sizes per source, which Spark aggregates. The rates become copies by a
threshold on a hash of the document, whose offset per source is again found by counting, so the tokens meet the
target to within about one document.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from quire.session import Scratch

#: Newton steps at most (more raises); relative error at which they end; ways of the search for the rounding offset, and the bits of its hash.
STEPS, PRECISION, WAYS, BITS = 200, 1e-7, 16, 40
#: Targets are a list of sources held by the driver; more than this raises.
MOST_SOURCES = 100_000


def solve_rates(histogram: DataFrame, wanted: dict[str, float], caps: dict[str, int], scale: dict[str, float]) -> dict[str, float]:
    """lambda per source so that the capped, tilted sizes sum to ``wanted``: Newton, kept inside a shrinking bracket."""
    low, high = {s: -60.0 for s in wanted}, {s: 60.0 for s in wanted}
    at = {s: 0.0 for s in wanted}
    spark = histogram.sparkSession
    open_sources = set(wanted)
    for _ in range(STEPS):
        if not open_sources:
            break
        lam = spark.createDataFrame([(s, at[s], float(caps[s]), scale[s]) for s in open_sources], "_s string, lam double, cap double, scale double")
        x = F.col("n_tokens") / F.col("scale")
        rate = F.least(F.exp(F.least(F.col("lam") * x, F.lit(700.0))), F.col("cap"))
        free = (rate < F.col("cap")).cast("double")
        sums = histogram.join(F.broadcast(lam), on=histogram["source"] == lam["_s"]).groupBy("source").agg(F.sum(F.col("n") * rate * F.col("n_tokens")).alias("g"), F.sum(F.col("n") * rate * free * F.col("n_tokens") * x).alias("h"))
        for r in sums.collect():  # one row per source
            s, error = r["source"], r["g"] - wanted[r["source"]]
            if abs(error) <= PRECISION * max(1.0, wanted[s]) or high[s] - low[s] < 1e-12:
                open_sources.discard(s)
                continue
            if error > 0:
                high[s] = at[s]
            else:
                low[s] = at[s]
            step = at[s] - error / r["h"] if r["h"] > 0 else math.inf
            at[s] = step if low[s] < step < high[s] else (low[s] + high[s]) / 2
    if open_sources:
        raise RuntimeError("the dual did not converge")
    return at


def mix(sized: DataFrame, targets: DataFrame, key: str = "doc_id", source: str = "source", total: float | None = None) -> DataFrame:
    """Rows of the mixture: ``key``, ``source``, ``n_tokens``, ``rate``, ``copies`` (at least 1).

    ``sized`` has the key, the source and ``n_tokens``; ``targets`` has ``source``, ``target_share``, ``max_repeats``. ``total`` is the size of
    the mixture in tokens; by default the largest in which every source that occurs reaches its share, shares of
    sources that do not occur being spread over the rest in proportion. With a larger ``total`` a source that does not suffice gives all it may.

    Rows of unlisted or null sources, and rows without tokens, take no part. Repeated keys are rows of their own. An empty table
    gives no rows. Null shares count as 0, null repeats as 1.
    """
    scratch = Scratch(sized.sparkSession, "mix")
    listed = targets.limit(MOST_SOURCES + 1).collect()
    if len(listed) > MOST_SOURCES:
        raise ValueError("too many sources")
    share = {r["source"]: float(r["target_share"] or 0.0) for r in listed if r["source"] is not None}
    caps = {r["source"]: int(r["max_repeats"] if r["max_repeats"] is not None else 1) for r in listed if r["source"] is not None}
    rows = sized.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{source}`").alias("source"), "n_tokens").filter("n_tokens > 0 and source is not null")
    rows = scratch.write(rows.join(F.broadcast(targets.select(F.col("source").alias("_t")).distinct()), on=rows["source"] == F.col("_t"), how="left_semi"), "rows")
    histogram = scratch.write(rows.groupBy("source", "n_tokens").agg(F.count(F.lit(1)).alias("n")), "histogram")
    have = {r["source"]: (float(r["t"]), float(r["m"])) for r in histogram.groupBy("source").agg(F.sum(F.col("n") * F.col("n_tokens")).alias("t"), (F.sum(F.col("n") * F.col("n_tokens")) / F.sum("n")).alias("m")).collect() if share.get(r["source"], 0) > 0 and caps[r["source"]] > 0}
    present = sum(share[s] for s in have)
    if have and total is None:
        total = min(caps[s] * have[s][0] / (share[s] / present) for s in have)
    wanted = {s: (total or 0.0) * share[s] / present for s in have}
    full = {s for s in have if wanted[s] >= caps[s] * have[s][0] * (1 - 1e-9)}
    lam = solve_rates(histogram, {s: wanted[s] for s in have if s not in full}, caps, {s: have[s][1] for s in have})
    table = [(s, 0.0 if s in full else lam[s], float(caps[s]), have[s][1], s in full, min(wanted[s], caps[s] * have[s][0])) for s in have]
    plan = sized.sparkSession.createDataFrame(table, "_s string, lam double, cap double, scale double, full boolean, wanted double")
    rate = F.when(F.col("full"), F.col("cap")).otherwise(F.least(F.exp(F.least(F.col("lam") * F.col("n_tokens") / F.col("scale"), F.lit(700.0))), F.col("cap")))
    uniform = (F.pmod(F.xxhash64("_key", F.lit(20240930)), F.lit(1 << BITS)) + 0.5) / float(1 << BITS)
    rated = rows.join(F.broadcast(plan), on=rows["source"] == plan["_s"]).select("_key", "source", "n_tokens", "cap", "wanted", rate.alias("rate"), uniform.alias("u"))
    rated = scratch.write(rated, "rated")

    def copies(offset):
        return F.least(F.floor("rate") + (F.col("u") < F.col("rate") - F.floor("rate") + offset).cast("int"), F.col("cap")).cast("int")

    # The offset per source: so many ways at a time, keeping the bracket in which the tokens cross the target, until it holds one document
    # or has the width of the hash's last bit.
    bracket = {s: (-1.0, 1.0) for s in have}
    coarse = set(have)
    while coarse:
        grid = sized.sparkSession.createDataFrame([(s, *bracket[s]) for s in coarse], "_s string, a double, b double")
        tried = [F.sum(F.col("n_tokens") * copies(F.col("a") + (F.col("b") - F.col("a")) * k / WAYS)).alias(f"t{k}") for k in range(WAYS + 1)]
        known = [F.first(c).alias(c) for c in ("wanted", "a", "b")] + [F.max("n_tokens").alias("largest")]
        for r in rated.join(F.broadcast(grid), on=rated["source"] == grid["_s"]).groupBy("source").agg(*tried, *known).collect():  # one row per source
            sums = [r[f"t{k}"] for k in range(WAYS + 1)]
            k = max((k for k in range(WAYS) if sums[k] <= r["wanted"]), default=0)
            step = (r["b"] - r["a"]) / WAYS
            bracket[r["source"]] = (r["a"] + k * step, r["a"] + (k + 1) * step)
            if sums[k + 1] - sums[k] <= r["largest"] or step < 2.0**-BITS:
                coarse.discard(r["source"])
    chosen = sized.sparkSession.createDataFrame([(s, a) for s, (a, _) in bracket.items()], "_s string, offset double")
    out = rated.join(F.broadcast(chosen), on=rated["source"] == chosen["_s"]).select(F.col("_key").alias(key), "source", "n_tokens", "rate", copies(F.col("offset")).alias("copies"))
    return out.filter("copies > 0")


def mixing_report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Per listed source: ``source``, ``target_share``, ``actual_share`` of the tokens, ``tokens``, ``documents``, ``most_copies``, ``max_repeats``."""
    got = mixed.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("copies").alias("most_copies"))
    whole = got.agg(F.sum("tokens")).first()[0] or 1  # one number
    out = targets.join(F.broadcast(got), on="source", how="left")
    tokens = F.coalesce("tokens", F.lit(0)).cast("long")
    return out.select("source", "target_share", (tokens / F.lit(float(whole))).alias("actual_share"), tokens.alias("tokens"), F.coalesce("documents", F.lit(0)).cast("long").alias("documents"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"), "max_repeats")
