"""Lines, paragraphs and sentences from boxes on pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from quire.functions import geometry


def line_boxes(boxes: DataFrame, page: list[str], line: str) -> DataFrame:
    """The box that holds each line's boxes, and its text from left to right."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "text"))), lambda x: x["text"]), " ").alias("text")  # the cells of one line
    return boxes.filter(F.col(line).isNotNull()).groupBy(*page, line).agg(*geometry.union_aggregates(), text)


def median_line_height(boxes: DataFrame, page: list[str], ratio: float = 0.8) -> DataFrame:
    """``threshold`` per page: the exact median box height times the ratio, six decimals."""
    return boxes.groupBy(*page).agg(F.round(F.median(F.col("y1") - F.col("y0")) * ratio, 6).alias("threshold"))


def paragraphs(lines: DataFrame, page: list[str], line: str, thresholds: DataFrame) -> DataFrame:
    """Lines with ``paragraph``: a new one begins where the gap to the line above reaches the page's threshold."""
    joined = lines.join(thresholds, on=page)
    w = Window.partitionBy(*page).orderBy(F.desc("y1"), line)
    gap = F.lag("y0").over(w) - F.col("y1")
    new = F.when(F.coalesce(gap >= F.col("threshold"), F.lit(False)), 1).otherwise(0)
    return joined.withColumn("_new", new).withColumn("paragraph", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_new", "threshold")


def sentences(lines: DataFrame, page: list[str], line: str, thresholds: DataFrame) -> DataFrame:
    """Lines with ``sentence``: a new one begins with a paragraph or after a line that ends in ``.``, ``!`` or ``?``.

    Each page ends its last sentence, finished or not.
    """
    p = paragraphs(lines, page, line, thresholds)
    w = Window.partitionBy(*page).orderBy(F.desc("y1"), line)
    new = (F.col("paragraph") != F.lag("paragraph").over(w)) | F.lag("text").over(w).rlike(r"[.!?]\s*$")
    return p.withColumn("_new", F.when(F.coalesce(new, F.lit(False)), 1).otherwise(0)).withColumn("sentence", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_new")


def select_boxes(boxes: DataFrame, selections: DataFrame, page: list[str], tolerance: float = 10.0) -> DataFrame:
    """Boxes that lie in a selection on their page, each with the ``selection_id``: an equi-join on the page, then containment."""
    s = selections.select(*[F.col(c).alias(f"_{c}") for c in page], "selection_id", F.struct("x0", "x1", "y0", "y1").alias("_outer"))
    inner = F.struct("x0", "x1", "y0", "y1")
    hit = boxes.withColumn("_inner", inner).join(s, [boxes[c] == s[f"_{c}"] for c in page])
    return hit.filter(geometry.contains(F.col("_outer"), F.col("_inner"), tolerance)).drop("_inner", "_outer", *[f"_{c}" for c in page])


def selected_spans(chars: DataFrame, selections: DataFrame, page: list[str], line: str = "line_index", tolerance: float = 10.0) -> DataFrame:
    """What a selection on a page holds, line by line: ``selection_id``, ``page``, ``line``, ``start_offset``, ``end_offset``, the box that holds the line's characters, and their ``text``.

    ``chars`` has ``page``, ``line``, ``char_index``, ``text`` and the box. Selections meet the characters of their page; a page has a bounded number of them.
    """
    inside = select_boxes(chars, selections, page, tolerance)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("char_index", "text"))), lambda x: x["text"]), "").alias("text")  # the characters of one line
    return inside.groupBy("selection_id", *page, line).agg(F.min("char_index").alias("start_offset"), (F.max("char_index") + 1).alias("end_offset"), *geometry.union_aggregates(), text)
