"""Splitting files of several documents at page borders, and judging the split."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from quire.operators import evaluate


def exclusive_first_page_lines(pages: DataFrame, document: str, group: str) -> DataFrame:
    """Per group (category) the lines that all first pages have and that not all other pages have: ``group``, ``line``.

    Counting documents per line replaces intersecting sets: a line is on all first pages if it occurs on as many as there are.
    ``pages`` has ``document``, ``group``, ``page_index``, ``page_text``.
    """
    flagged = pages.select(document, group, "page_index", (F.col("page_index") == 0).alias("first"), F.explode(F.array_distinct(F.split("page_text", "\n"))).alias("line")).filter(F.trim("line") != "")
    sizes = pages.groupBy(group).agg(F.sum((F.col("page_index") == 0).cast("long")).alias("firsts"), F.sum((F.col("page_index") > 0).cast("long")).alias("others"))
    seen = flagged.groupBy(group, "line").agg(F.sum(F.col("first").cast("long")).alias("on_first"), F.sum((~F.col("first")).cast("long")).alias("on_other"))
    joined = seen.join(sizes.withColumnRenamed(group, "_g"), F.col(group).eqNullSafe(F.col("_g"))).drop("_g")
    return joined.filter((F.col("on_first") == F.col("firsts")) & ~((F.col("others") > 0) & (F.col("on_other") == F.col("others")))).select(group, "line")


def predict_first_pages(pages: DataFrame, document: str, lines: DataFrame, group: str, share: float = 0.25) -> DataFrame:
    """``pages`` with ``is_first_page``: the page has more than ``share`` of the smaller of its own and any group's exclusive lines."""
    own = pages.select(document, "page_index", F.size(F.array_distinct(F.filter(F.split("page_text", "\n"), lambda x: F.trim(x) != ""))).alias("own"))
    each = pages.select(document, "page_index", F.explode(F.array_distinct(F.split("page_text", "\n"))).alias("line"))
    hits = each.join(lines, on="line").groupBy(document, "page_index", group).agg(F.count(F.lit(1)).alias("hits"))
    sizes = lines.groupBy(F.col(group).alias("_g")).agg(F.count(F.lit(1)).alias("size"))
    judged = hits.join(sizes, hits[group].eqNullSafe(sizes["_g"])).join(own, on=[document, "page_index"])
    first = judged.filter(F.col("hits") > F.least("own", "size") * share).select(document, "page_index").distinct().withColumn("_f", F.lit(True))
    return pages.join(first, on=[document, "page_index"], how="left").withColumn("is_first_page", F.coalesce("_f", F.lit(False))).drop("_f")


def group_pages(pages: DataFrame, document: str, first: str = "is_first_page") -> DataFrame:
    """``pages`` with ``split_id``, counted from 0: a new part begins at each first page; page one always begins one."""
    w = Window.partitionBy(document).orderBy("page_index")
    begins = F.when((F.row_number().over(w) == 1) | F.coalesce(F.col(first), F.lit(False)), 1).otherwise(0)
    return pages.withColumn("_b", begins).withColumn("split_id", (F.sum("_b").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("long")).drop("_b")


def sub_documents(pages: DataFrame, document: str) -> DataFrame:
    """Parts as documents of their own: ``document``, ``split_id``, ``text`` with page ends, ``first_page``, ``n_pages``."""
    parts = pages.groupBy(document, "split_id").agg(F.array_sort(F.collect_list(F.struct("page_index", "page_text"))).alias("p"))  # the pages of one part
    return parts.select(document, "split_id", F.array_join(F.transform("p", lambda x: x["page_text"]), "\f").alias("text"), F.get("p", F.lit(0))["page_index"].alias("first_page"), F.size("p").alias("n_pages"))


def evaluate_split(judged: DataFrame, group: str) -> DataFrame:
    """tp, fp, fn, tn and measures of ``predicted`` against ``actual`` first pages, overall (null group) and per group in one pass."""
    a, p = F.col("actual"), F.col("predicted")
    sums = [F.sum((a & p).cast("long")).alias("tp"), F.sum((~a & p).cast("long")).alias("fp"), F.sum((a & ~p).cast("long")).alias("fn"), F.sum((~a & ~p).cast("long")).alias("tn")]
    out = judged.rollup(group).agg(F.grouping(group).cast("int").alias("overall"), *sums)
    return evaluate.measures(out)
