"""Queries of the corpus operators over the tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quire.llm import chunks, mixing, packing, personal, scans, sentences, tokens, topn, truncation
from quire.session import Scratch


def _read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def _old_pages(spark: SparkSession, folder: str) -> DataFrame:
    requests = _read(spark, folder, "extract_requests").filter(F.col("schema_version") == "20240117")
    return chunks.pages_of(requests.select("request_id", "text", "pages"))


def p1_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """All pages of version 20240117 as pieces of at most 3,000 characters, with up to 200 repeated."""
    return chunks.split_oversized(_old_pages(spark, folder), "page_text", 3000, 200).distinct()


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    pieces = chunks.split_oversized(_old_pages(spark, folder), "page_text", 3000, 200)
    return pieces.filter(F.col("pieces") > 1).select("request_id", "number").distinct()


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    best = topn.top_n(_read(spark, folder, "page_categories"), ["request_id", "category_id"], "confidence", "number", 3)
    return best.select("request_id", "category_id", F.col("number").cast("long").alias("number"))


def _scanned(spark: SparkSession, folder: str) -> DataFrame:
    return _read(spark, folder, "extract_requests").filter(F.col("schema_version") == "20241227")


def _personal_texts(spark: SparkSession, folder: str) -> DataFrame:
    whole = scans.whole_text(F.col("text"), F.col("raw_ocr_response"))
    return _scanned(spark, folder).select("request_id", F.col("text").isNotNull().alias("own"), whole.alias("text"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    texts = _personal_texts(spark, folder)
    model = personal.learn(texts)
    items = Scratch(spark, "p3").write(personal.find_personal(texts, model, ["request_id", "own"]), "items")
    columns = ["request_id", "bbox_key", "pii_type", "start_offset", "end_offset"]
    in_text = items.filter("own").select("request_id", F.lit(-1).cast("long").alias("bbox_key"), "pii_type", "start_offset", "end_offset")
    # A box holds one cell of a line, and its key is the cell's place in the text.
    boxes = _read(spark, folder, "extract_bboxes").filter("text is not null").select("request_id", "bbox_key", F.col("text").alias("box"))
    joined = boxes.join(items.select("request_id", F.col("cell").alias("bbox_key"), "pii_type", "start_offset", "end_offset", "item"), on=["request_id", "bbox_key"])
    at = F.col("start_offset") - F.col("bbox_key")
    in_box = joined.filter(F.substring("box", (at + 1).cast("int"), F.length("item")) == F.col("item")).select("request_id", "bbox_key", "pii_type", at.alias("start_offset"), (F.col("end_offset") - F.col("bbox_key")).alias("end_offset"))
    # Boxes of requests that have neither text nor recognised lines are read by themselves.
    silent = _scanned(spark, folder).select("request_id", scans.whole_text(F.col("text"), F.col("raw_ocr_response")).isNull().alias("none")).groupBy("request_id").agg(F.min("none").alias("none")).filter("none")
    alone = boxes.join(silent, on="request_id", how="left_semi").select("request_id", "bbox_key", F.col("box").alias("text"))
    by_box = personal.find_personal(alone, model, ["request_id", "bbox_key"]).select(*columns)
    return in_text.unionByName(in_box).unionByName(by_box).distinct()


def p3_redacted(spark: SparkSession, folder: str) -> DataFrame:
    """Request texts (``bbox_key`` -1) and the texts of their boxes, with placeholders."""
    texts = _personal_texts(spark, folder)
    model = personal.learn(texts)
    kinds = _read(spark, folder, "pii_placeholders").filter(F.col("pii_type").isin(*personal.TYPES))
    marks = {r["pii_type"]: r["placeholder"] for r in kinds.groupBy("pii_type").agg(F.min("placeholder").alias("placeholder")).collect()}  # one row per type
    done = Scratch(spark, "p3").write(personal.redact(texts, model, marks, ["request_id", "own"], parts=True), "redacted")
    whole = done.filter("own").select("request_id", F.lit(-1).cast("long").alias("bbox_key"), "redacted")
    # Boxes of requests that have neither text nor recognised lines are read by themselves.
    states = done.groupBy("request_id").agg(F.max(F.col("redacted").isNotNull()).alias("read"))
    boxes = _read(spark, folder, "extract_bboxes").filter("text is not null").select("request_id", "bbox_key", "text").join(states, on="request_id")
    in_box = personal.redact_cells(boxes.filter("read").drop("read"), done, marks, "request_id", "bbox_key", "text")
    by_box = personal.redact(boxes.filter("not read"), model, marks, ["request_id", "bbox_key"])
    return whole.unionByName(in_box).unionByName(by_box).distinct()


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return scans.find_noise(_scanned(spark, folder))


def p4_repaired(spark: SparkSession, folder: str) -> DataFrame:
    return scans.repair(_scanned(spark, folder)).distinct()


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    requests = _read(spark, folder, "categorize_requests").select("request_id", "text")
    return sentences.split_sentences(requests, "text").distinct()


def p7_packed(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(_read(spark, folder, "documents"), "doc_id", "text")


def p7_report(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packing_report(p7_packed(spark, folder))


def p8_mixture(spark: SparkSession, folder: str) -> DataFrame:
    sized = tokens.with_sizes(_read(spark, folder, "documents"), ["doc_id", "source"], "text")
    return mixing.mix(sized, _read(spark, folder, "mix_targets"))


def p8_report(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixing_report(p8_mixture(spark, folder), _read(spark, folder, "mix_targets"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    found = truncation.detect_truncated(_read(spark, folder, "documents"), ["doc_id"])
    return found.filter("truncated").select("doc_id").distinct()


def p9_report(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.truncation_report(truncation.detect_truncated(_read(spark, folder, "documents"), ["doc_id"]))


def queries() -> dict:
    return {f.__name__: f for f in (p1_pieces, p1_found, p2_found, p3_found, p3_redacted, p4_found, p4_repaired, p5_found, p7_packed, p7_report, p8_mixture, p8_report, p9_found, p9_report)}


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": r"""
            WITH parts AS (
              SELECT request_id, pages, string_split(text, chr(12)) AS p FROM extract_requests
              WHERE schema_version = '20240117' AND text IS NOT NULL),
            numbered AS (
              SELECT request_id, unnest(p) AS page_text, unnest(range(1, len(p) + 1)) AS k,
                     list_sort(list_transform(pages, lambda x: x.number)) AS numbers FROM parts)
            SELECT DISTINCT request_id, CAST(coalesce(numbers[k], k) AS BIGINT) AS number
            FROM numbered WHERE length(page_text) > 3000""",
        "p2_found": """
            WITH items AS (
              SELECT request_id, category_id, number, max(confidence) AS score FROM page_categories
              WHERE confidence IS NOT NULL AND NOT isnan(confidence) GROUP BY ALL),
            ranked AS (
              SELECT *, row_number() OVER (PARTITION BY request_id, category_id ORDER BY score DESC, number) AS r FROM items)
            SELECT request_id, category_id, CAST(number AS BIGINT) AS number FROM ranked WHERE r <= 3""",
    }
