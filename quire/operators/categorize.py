"""Categories of pages and documents."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window, functions as F

#: Names of categories at most; so many are tried by compiled code, which an array of names is not.
MOST_NAMES, FEW_NAMES = 100_000, 200


def by_name(pages: DataFrame, categories: DataFrame, key: str) -> DataFrame:
    """``key``, ``page_index``, ``category_id``: the longest category name found in the page's text in lower case, else the category
    of the document's first page that has one, else null. ``categories`` has ``category_id`` and ``fallback_name``.

    A page is scanned in place and nothing is multiplied or shuffled but by document: few names are tried one after the other in compiled code, more stand in one array,
    longest first; the result is the same. More than ``MOST_NAMES`` raise.
    """
    names = categories.filter("fallback_name is not null and category_id <> 0").select("category_id", "fallback_name").distinct()
    rows = sorted(((r["fallback_name"], r["category_id"]) for r in names.limit(MOST_NAMES + 1).collect()), key=lambda x: (-len(x[0]), x[1]))
    if len(rows) > MOST_NAMES:
        raise ValueError(f"more than {MOST_NAMES} category names")
    pages = pages.withColumn("_low", F.lower("page_text"))
    listed = F.from_json(F.lit(json.dumps([{"name": n, "id": i} for n, i in rows])), "array<struct<name:string,id:bigint>>")
    first_of = F.get(F.filter(listed, lambda x: F.col("_low").contains(x["name"])), F.lit(0))["id"]
    found = F.lit(None).cast("bigint") if len(rows) <= FEW_NAMES else first_of
    for name, cid in reversed(rows) if len(rows) <= FEW_NAMES else ():
        found = F.when(F.col("_low").contains(name), F.lit(cid)).otherwise(found)
    hit = pages.select(key, "page_index", found.alias("own"))
    first = F.first("own", ignorenulls=True).over(Window.partitionBy(key).orderBy("page_index").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return hit.withColumn("category_id", F.coalesce("own", first)).drop("own")


def best_per_page(rows: DataFrame, page: list[str], category: str = "category_id", confidence: str = "confidence", human: str | None = None) -> DataFrame:
    """The category of highest confidence of each page; the lowest id of equals. Null and NaN confidences do not count.

    With ``human``, a boolean column, a category that a person has chosen comes first, whatever its confidence.
    """
    good = F.col(confidence).isNotNull() & ~F.isnan(confidence)
    chosen = F.coalesce(F.col(human), F.lit(False)) if human else F.lit(False)
    value = F.when(good, F.col(confidence))
    best = F.max_by(F.struct(category, value.alias(confidence)), F.struct(chosen, F.coalesce(value, F.lit(float("-inf"))), -F.col(category)))
    return rows.filter(good | chosen).groupBy(*page).agg(best.alias("b")).select(*page, F.col(f"b.{category}").alias(category), F.col(f"b.{confidence}").alias(confidence))


def document_confidence(rows: DataFrame, document: str, page: str, category: str = "category_id", confidence: str = "confidence", stored: DataFrame | None = None) -> DataFrame:
    """Mean confidence of each category over the document's pages; a page without the category counts as 0.

    With ``stored`` (``document``, ``category``, ``confidence`` on record) a category that no page speaks for has the confidence on record.
    """
    good = rows.groupBy(document, page, category).agg(F.max(F.when(~F.isnan(confidence), F.col(confidence))).alias("c"))
    pages = good.groupBy(document).agg(F.countDistinct(page).alias("pages"))
    # Decimals add up to the same sum in any order.
    sums = good.groupBy(document, category).agg(F.sum(F.coalesce("c", F.lit(0.0)).cast("decimal(18,9)")).alias("s"))
    out = sums.join(pages, on=document).select(document, category, (F.col("s").cast("double") / F.col("pages")).alias("confidence"))
    if stored is None:
        return out
    kept = stored.select(document, category, F.col(confidence).alias("_stored"))
    mean = F.coalesce(F.col("confidence"), F.lit(0.0))
    return out.join(kept, on=[document, category], how="full_outer").select(document, category, F.when(mean == 0, F.coalesce("_stored", F.lit(0.0))).otherwise(mean).alias("confidence"))


def mean_probabilities(pages: DataFrame, document: str, probabilities: str = "probabilities") -> DataFrame:
    """``document``, ``category`` (the class of highest mean, the first of equals) and ``confidence``: class probabilities of pages (arrays of one length) averaged over a document's
    pages. Pages whose probabilities are null or all NaN do not count; a document without any other has a null category."""
    told = pages.withColumn("_ok", F.coalesce(F.exists(probabilities, lambda x: ~F.isnan(x)), F.lit(False)))
    means = told.filter("_ok").select(document, F.posexplode(probabilities).alias("category", "p")).groupBy(document, "category").agg(F.avg(F.when(~F.isnan("p"), F.col("p"))).alias("p"))
    best = means.groupBy(document).agg(F.max_by(F.struct("category", "p"), F.struct("p", -F.col("category"))).alias("b")).select(F.col(document).alias("_d"), F.col("b.category").alias("category"), F.col("b.p").alias("confidence"))
    every = pages.select(document).distinct()
    return every.join(best, every[document] == best["_d"], "left").drop("_d")


def consensus(best: DataFrame, document: str, page: str, category: str = "category_id") -> DataFrame:
    """The one category that all pages of a document agree on (pages without one are ignored), else 0."""
    agg = best.groupBy(document).agg(F.countDistinct(category).alias("k"), F.min_by(category, page).alias("c"))
    return agg.select(document, F.when(F.col("k") == 1, F.col("c")).otherwise(F.lit(0)).cast("long").alias(category))
