"""Views of documents, annotations and annotation sets: which of them count, in which order, and what lies between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quire.operators import spans as span_ops

# The states of a document in its project.
STATUS = {"no_status": 0, "preparation": 1, "training": 2, "test": 3, "excluded": 4}


def documents_in(documents: DataFrame, view: str, status: str = "dataset_status", key: str = "doc_id") -> DataFrame:
    """The documents of a view: ``no_status``, ``preparation``, ``training``, ``test``, ``excluded``, or ``virtual`` (no id or no status)."""
    if view == "virtual":
        return documents.filter(F.col(key).isNull() | F.col(status).isNull())
    return documents.filter(F.col(key).isNotNull() & (F.col(status) == STATUS[view]))


def category_documents(documents: DataFrame, category, view: str = "training", column: str = "category_id") -> DataFrame:
    """The documents of a view that are of one category."""
    return documents_in(documents, view).filter(F.col(column) == category)


def lookup(table: DataFrame, column: str, value) -> DataFrame:
    """The one row of ``table`` with this value. None, or several, raises: at most two rows are fetched for that."""
    found = table.filter(F.col(column) == value)
    n = len(found.limit(2).collect())
    if n != 1:
        raise IndexError(f"{'no row' if n == 0 else 'several rows'} with {column} = {value!r}")
    return found


def _sure(threshold: Column) -> Column:
    return F.coalesce((F.col("confidence") != 0) & (F.col("confidence") >= threshold), F.lit(False))


def usable(rows: DataFrame, use_correct: bool = True, ignore_below_threshold: bool = False) -> DataFrame:
    """The spans of annotations that count. ``rows``: a row per span with ``is_correct``, ``confidence`` and the label's ``threshold``.

    ``use_correct`` takes right ones only; else ``ignore_below_threshold`` leaves out those not right whose confidence is null, 0 or below.
    """
    right = F.coalesce(F.col("is_correct"), F.lit(False))
    if use_correct:
        return rows.filter(right)
    return rows.filter(right | _sure(F.col("threshold"))) if ignore_below_threshold else rows


def annotations(
    rows: DataFrame, key: str = "doc_id", *, label=None, use_correct: bool = True, ignore_below_threshold: bool = False, start: int = 0, end: int | None = None
) -> DataFrame:
    """``key``, ``annotation_id`` and the annotation's ``label``, ``start_offset``, ``end_offset`` and ``parts``, in order of their place in the document
    (``place``, from 0). ``rows`` has a row per span.

    An annotation counts if any of its spans does; with ``end``, a span counts if it overlaps ``start``..``end`` by a character at least.
    """
    own = usable(rows, use_correct, ignore_below_threshold)
    hit = F.lit(True) if end is None else F.greatest(F.col("start_offset"), F.lit(max(start, 0))) < F.least(F.col("end_offset"), F.lit(end))
    if label is not None:
        own = own.filter(F.col("label") == label)
    whole = own.groupBy(key, "annotation_id", "label").agg(F.min("start_offset").alias("start_offset"), F.max("end_offset").alias("end_offset"), F.count(F.lit(1)).alias("parts"), F.max(hit).alias("_hit"))
    w = Window.partitionBy(key).orderBy("start_offset", "end_offset", "annotation_id")
    return whole.filter("_hit").drop("_hit").withColumn("place", F.row_number().over(w) - 1)


def distinct_spans(rows: DataFrame, key: str = "doc_id", order: tuple[str, ...] = ("annotation_id",)) -> DataFrame:
    """One row per document and offsets: that of the first annotation by ``order``."""
    columns = [c for c in rows.columns if c not in (key, "start_offset", "end_offset")]
    first = F.min_by(F.struct(*columns), F.struct(*order)).alias("r")
    return rows.groupBy(key, "start_offset", "end_offset").agg(first).select(key, "start_offset", "end_offset", "r.*")


def on_pages(rows: DataFrame, pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """``rows`` with the ``page_index`` of the page that holds their start."""
    return span_ops.locate(rows, key, pages, "page_index")


def page_sets(rows: DataFrame, pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """The annotation sets of each page: ``key``, ``page_index``, ``set_id``."""
    return on_pages(rows.filter("set_id is not null"), pages, key).select(key, "page_index", "set_id").distinct()


def annotation_sets(rows: DataFrame, lines: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """Each set's ``start_offset``, ``end_offset`` and number of ``annotations``, and with a table of ``lines`` its ``first_line``. Sets without annotations do not appear."""
    sets = rows.filter("set_id is not null").groupBy(key, "set_id").agg(F.min("start_offset").alias("start_offset"), F.max("end_offset").alias("end_offset"), F.countDistinct("annotation_id").alias("annotations"))
    return sets if lines is None else span_ops.locate(sets, key, lines, "line_index").withColumnRenamed("line_index", "first_line")


def filled(rows: DataFrame, texts: DataFrame, key: str = "doc_id", label: str = "NO_LABEL") -> DataFrame:
    """``rows`` and what no span covers, as spans of ``label`` that end with their line: ``key``, offsets, ``label``."""
    gaps = span_ops.missing_offsets(rows, texts.filter("text is not null").select(key, F.length("text").alias("length")), key)
    lines = span_ops.lines(texts, key, "text").select(F.col(key).alias("_k"), F.col("start_offset").alias("_a"), (F.col("end_offset")).alias("_b"))
    g = span_ops.in_blocks(gaps, "start_offset", "end_offset", "_gb", "_gf")
    t = span_ops.in_blocks(lines, "_a", "_b", "_tb", "_tf")
    hit = g.join(t, (g[key] == t["_k"]) & (g["_gb"] == t["_tb"]) & (g["_gb"] == F.greatest("_gf", "_tf")) & (g["start_offset"] <= t["_b"]) & (t["_a"] <= g["end_offset"]))
    inside = hit.select(key, F.greatest("start_offset", "_a").alias("start_offset"), F.least("end_offset", "_b").alias("end_offset"))
    breaks = hit.filter((F.col("_b") >= F.col("start_offset")) & (F.col("_b") < F.col("end_offset"))).select(key, F.col("_b").alias("start_offset"), (F.col("_b") + 1).alias("end_offset"))
    made = inside.unionByName(breaks).filter("end_offset > start_offset").withColumn("label", F.lit(label))
    return rows.select(key, "start_offset", "end_offset", F.col("label").cast("string").alias("label")).unionByName(made)


def page_lines(boxes: DataFrame, page: list[str], line: str = "line_index") -> DataFrame:
    """The span of each line of character boxes: from its first to its last character that is no white space. ``boxes`` has ``page``, ``line``, ``char_index`` and ``text``."""
    seen = boxes.filter(~F.col("text").rlike(r"^\s*$") & F.col(line).isNotNull())
    return seen.groupBy(*page, line).agg(F.min("char_index").alias("start_offset"), (F.max("char_index") + 1).alias("end_offset"))


def span_boxes(rows: DataFrame, boxes: DataFrame, key: str = "doc_id") -> DataFrame:
    """``rows`` with the box that holds their characters, blanks left out: each span opened to its characters, which meet their boxes by equality.

    Characters without a box are left out; a span without any gets a null box. y0 is not below 0. ``boxes`` has ``key``, ``char_index``, ``text`` and the box.
    """
    opened = rows.select(key, "start_offset", "end_offset").distinct().withColumn("char_index", F.explode(F.sequence("start_offset", F.col("end_offset") - 1)))
    found = opened.join(boxes.filter("text <> ' '").select(key, "char_index", "x0", "x1", "y0", "y1"), on=[key, "char_index"])
    held = found.groupBy(key, "start_offset", "end_offset").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.greatest(F.min("y0"), F.lit(0.0)).alias("y0"), F.max("y1").alias("y1"))
    return rows.join(held, on=[key, "start_offset", "end_offset"], how="left")


def previous_pages(pages: DataFrame, key: str = "doc_id", text: str = "page_text") -> DataFrame:
    """``pages`` with ``previous_text``, the text of the last page before that is not blank, and ``is_blank``."""
    w = Window.partitionBy(key).orderBy("page_index").rowsBetween(Window.unboundedPreceding, -1)
    blank = F.coalesce(F.trim(F.regexp_replace(text, r"\s+", "")) == "", F.lit(True))
    return pages.withColumn("is_blank", blank).withColumn("previous_text", F.last(F.when(~F.col("is_blank"), F.col(text)), ignorenulls=True).over(w))


def before_and_after(rows: DataFrame, group: list[str], order: list[str], column: str, n: int = 1) -> DataFrame:
    """``rows`` with the values of ``column`` in the ``n`` rows before and after, null beyond the ends."""
    w = Window.partitionBy(*group).orderBy(*order)
    return rows.withColumns({f"before_{i}": F.lag(column, i).over(w) for i in range(1, n + 1)} | {f"after_{i}": F.lead(column, i).over(w) for i in range(1, n + 1)})


def span_violations(rows: DataFrame, lengths: DataFrame, lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """``rows`` with what is wrong with their offsets: ``violation`` is ``empty``, ``outside`` (of the text), ``lines`` (more than one) or null."""
    sized = rows.join(lengths.select(F.col(key).alias("_k"), F.col("length").alias("_n")), rows[key] == F.col("_k"), "left").drop("_k")
    t = span_ops.in_blocks(lines.select(F.col(key).alias("_k"), F.col("start_offset").alias("_a"), F.col("end_offset").alias("_b")), "_a", "_b", "_tb")
    own = sized.withColumn("_sb", F.floor(F.col("start_offset") / span_ops.BLOCK))
    at = own.join(t, (own[key] == t["_k"]) & (own["_sb"] == t["_tb"]) & (own["start_offset"] >= t["_a"]) & (own["start_offset"] <= t["_b"]), "left")
    wrong = F.when(F.coalesce(F.col("end_offset") <= F.col("start_offset"), F.lit(True)), "empty").when((F.col("start_offset") < 0) | F.coalesce(F.col("end_offset") > F.col("_n"), F.lit(True)), "outside").when(F.coalesce(F.col("end_offset") > F.col("_b"), F.lit(False)), "lines")
    return at.withColumn("violation", wrong).drop("_k", "_a", "_b", "_tb", "_sb", "_n")


def strict(rows: DataFrame, violation: str = "violation") -> DataFrame:
    """``rows``, of which none may have a violation: the first one met raises, where and when it is met."""
    return rows.withColumn(violation, F.when(F.col(violation).isNotNull(), F.raise_error(F.concat(F.lit("invalid: "), F.col(violation))).cast("string")))
