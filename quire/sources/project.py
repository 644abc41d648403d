"""Reading and writing the files of an annotation project, and keeping tables in step with them."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd

from pyspark.sql import DataFrame, SparkSession, functions as F

from quire.operators import spans

_BOX = "x0 double, x1 double, y0 double, y1 double"
ANNOTATION = (
    "id long, label string, label_text string, section long, annotation_set long, label_set string, section_label_id long, accuracy double, confidence double, is_correct boolean, revised boolean, "
    f"start_offset int, end_offset int, offset_string string, normalized string, bboxes array<struct<start_offset:int,end_offset:int,page_index:int,line_number:int,x0:double,x1:double,y0:double,y1:double>>, "
    "span array<struct<start_offset:int,end_offset:int,page_index:int,line_number:int,x0:double,x1:double,y0:double,y1:double>>"
)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a project: id, status, category, pages, ``updated_at``. Missing fields are null."""
    schema = "id long, data_file_name string, dataset_status int, category_template long, category_confidence double, number_of_pages int, updated_at string, extraction_time double, ocr_time double"
    return spark.read.schema(schema).json(path, multiLine=True).withColumn("updated_at", F.to_timestamp("updated_at"))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Labels: id, name, data type, threshold (0.1 where missing), whether several top candidates may stand."""
    schema = "id long, text string, get_data_type_display string, has_multiple_top_candidates boolean, threshold double"
    raw = spark.read.schema(schema).json(path, multiLine=True)
    return raw.select(F.col("id").alias("label_id"), F.col("text").alias("name"), F.col("get_data_type_display").alias("data_type"), F.coalesce("threshold", F.lit(0.1)).alias("threshold"), F.coalesce("has_multiple_top_candidates", F.lit(False)).alias("multiple"))


def read_label_sets(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Label sets, and the bridge from sets to labels."""
    raw = spark.read.schema("id long, name string, is_default boolean, has_multiple_sections boolean, labels array<long>").json(path, multiLine=True)
    return raw.select(F.col("id").alias("label_set_id"), "name", "is_default", F.col("has_multiple_sections").alias("multiple")), raw.select(F.col("id").alias("label_set_id"), F.explode("labels").alias("label_id"))


def read_categories(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Categories, which are the default label sets, with the one for none (id 0); and the bridge from them to their label sets."""
    raw = spark.read.schema("id long, name string, is_default boolean, default_section_labels array<long>").json(path, multiLine=True)
    none = spark.createDataFrame([(0, "NO_CATEGORY")], "category_id long, name string")
    own = raw.filter("is_default").select(F.col("id").alias("category_id"), "name")
    linked = raw.filter("not is_default").select(F.explode("default_section_labels").alias("category_id"), F.col("id").alias("label_set_id"))
    return none.unionByName(own), own.select("category_id", F.col("category_id").alias("label_set_id")).unionByName(linked.join(own.select("category_id"), on="category_id")).distinct()


def read_page_sizes(spark: SparkSession, pattern: str) -> DataFrame:
    """``doc_id``, ``page_id``, ``page_index`` (place in the file, from 0), ``number``, ``width``, ``height`` of each page of the page files."""
    shape = "array<struct<id:long,number:int,original_size:array<double>,size:array<int>>>"
    raw = spark.read.text(pattern, wholetext=True).withColumn("path", F.input_file_name())
    pages = raw.select(F.regexp_extract("path", r"/(\d+)/[^/]+$", 1).cast("long").alias("doc_id"), F.posexplode(F.from_json("value", shape)).alias("page_index", "p"))
    return pages.select("doc_id", F.col("p.id").alias("page_id"), "page_index", F.col("p.number").alias("number"), F.get("p.original_size", F.lit(0)).alias("width"), F.get("p.original_size", F.lit(1)).alias("height"))


def pages_with_sizes(pages: DataFrame, sizes: DataFrame, key: str = "doc_id", check: bool = True) -> DataFrame:
    """The pages of the texts with what the page files say of them, in order. With ``check`` a document whose counts differ raises when it is met."""
    counts = pages.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).join(sizes.groupBy(key).agg(F.count(F.lit(1)).alias("_m")), on=key, how="left")
    joined = pages.join(sizes, on=[key, "page_index"], how="left").join(counts, on=key)
    if check:
        joined = joined.filter(F.when(F.coalesce("_m", F.lit(0)) != F.col("_n"), F.raise_error(F.concat(F.lit("pages and page file differ in document "), F.col(key).cast("string"))).cast("boolean")).otherwise(True))
    return joined.drop("_n", "_m")


def read_annotation_sets(spark: SparkSession, pattern: str) -> DataFrame:
    """``doc_id``, ``set_id``, ``label_set_id`` of the sets of the set files, of either generation; sets that list labels of which none has annotations are left out."""
    shape = "array<struct<id:long,section_label:long,label_set:struct<id:long>,labels:array<struct<annotations:array<string>>>>>"
    raw = spark.read.text(pattern, wholetext=True).withColumn("path", F.input_file_name())
    sets = raw.select(F.regexp_extract("path", r"/(\d+)/[^/]+$", 1).cast("long").alias("doc_id"), F.explode(F.from_json("value", shape)).alias("s"))
    empty = F.col("s.labels").isNotNull() & F.forall("s.labels", lambda x: F.coalesce(F.size(x["annotations"]), F.lit(0)) <= 0)
    return sets.filter(~empty).select("doc_id", F.col("s.id").alias("set_id"), F.coalesce("s.label_set.id", "s.section_label").alias("label_set_id"))


@dataclass
class Project:
    """The tables of an annotation project."""

    labels: DataFrame
    label_sets: DataFrame
    set_labels: DataFrame
    categories: DataFrame
    category_sets: DataFrame
    documents: DataFrame
    texts: DataFrame
    annotations: DataFrame
    annotation_sets: DataFrame
    pages: DataFrame


def read_project(spark: SparkSession, folder: str) -> Project:
    """All files of a project folder: labels, label sets, categories, documents, and what each document's folder holds. Everything is read when it is needed."""
    sets, bridge = read_label_sets(spark, f"{folder}/label_sets.json5")
    categories, category_sets = read_categories(spark, f"{folder}/label_sets.json5")
    texts = read_texts(spark, f"{folder}/documents/*/document.txt")
    pages = pages_with_sizes(spans.pages(texts, "doc_id", "text"), read_page_sizes(spark, f"{folder}/documents/*/pages.json5"), check=False)
    return Project(
        read_labels(spark, f"{folder}/labels.json5"), sets, bridge, categories, category_sets, read_metadata(spark, f"{folder}/documents_meta.json5"), texts,
        read_annotations(spark, f"{folder}/documents/*/annotations.json5"), read_annotation_sets(spark, f"{folder}/documents/*/annotation_sets.json5"), pages,
    )


def read_texts(spark: SparkSession, pattern: str) -> DataFrame:
    """``doc_id`` (the folder's name) and ``text`` of each ``document.txt``."""
    raw = spark.read.text(pattern, wholetext=True).withColumn("path", F.input_file_name())
    return raw.select(F.regexp_extract("path", r"/(\d+)/[^/]+$", 1).cast("long").alias("doc_id"), F.col("value").alias("text"))


def read_annotations(spark: SparkSession, pattern: str) -> DataFrame:
    """One row per span of each annotation, from either generation of the files (``section`` or ``annotation_set``; ``bboxes`` or ``span``)."""
    raw = spark.read.schema(ANNOTATION).json(pattern, multiLine=True).withColumn("path", F.input_file_name())
    parts = F.coalesce(F.when(F.size("bboxes") > 0, F.col("bboxes")), F.when(F.size("span") > 0, F.col("span")))
    whole = F.array(F.struct(F.col("start_offset"), F.col("end_offset"), F.lit(None).cast("int").alias("page_index"), F.lit(None).cast("int").alias("line_number"), *[F.lit(None).cast("double").alias(c) for c in ("x0", "x1", "y0", "y1")]))
    label = F.coalesce(F.get_json_object("label", "$.id"), F.col("label")).cast("long")
    label_set = F.coalesce(F.get_json_object("label_set", "$.id"), F.col("label_set")).try_cast("long")
    out = raw.select(
        F.regexp_extract("path", r"/(\d+)/[^/]+$", 1).cast("long").alias("doc_id"), F.col("id").alias("annotation_id"), label.alias("label_id"), F.coalesce("section", "annotation_set").alias("annotation_set_id"),
        F.coalesce("section_label_id", label_set).alias("label_set_id"), F.coalesce("confidence", "accuracy", F.lit(1.0)).alias("confidence"), "is_correct", "revised", F.explode(F.coalesce(parts, whole)).alias("s"),
    )
    return out.select(*[c for c in out.columns if c != "s"], *[F.col(f"s.{c}").alias(c) for c in ("start_offset", "end_offset", "page_index", "line_number", "x0", "x1", "y0", "y1")])


def read_character_boxes(spark: SparkSession, pattern: str) -> DataFrame:
    """Character boxes from zipped JSON maps: ``doc_id``, ``char_index``, ``page_index``, ``text`` and the box."""
    raw = spark.read.format("binaryFile").load(pattern).select(F.regexp_extract("path", r"/(\d+)/[^/]+$", 1).cast("long").alias("doc_id"), "content")

    def unzip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, content in zip(pdf["doc_id"], pdf["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    boxes = json.loads(z.read(z.namelist()[0]))
                for index, b in boxes.items():
                    page = b.get("page_index", b["page_number"] - 1 if b.get("page_number") is not None else None)
                    rows.append((doc, int(index), page, b.get("text"), b.get("x0"), b.get("x1"), b.get("y0"), b.get("y1")))
            yield pd.DataFrame(rows, columns=["doc_id", "char_index", "page_index", "text", "x0", "x1", "y0", "y1"])

    return raw.mapInPandas(unzip, f"doc_id long, char_index long, page_index int, text string, {_BOX}")


def changes(known: DataFrame, arrived: DataFrame, key: str, stamp: str) -> DataFrame:
    """``key`` and ``change``: ``new``, ``updated`` (a later stamp), ``unchanged`` or ``deleted``. Repeated keys count by their latest stamp; a null
    stamp is older than any."""
    a = known.groupBy(F.col(key).alias("_a")).agg(F.max(stamp).alias("_sa"))
    b = arrived.groupBy(F.col(key).alias("_b")).agg(F.max(stamp).alias("_sb"))
    later = F.col("_sb").isNotNull() & (F.col("_sa").isNull() | (F.col("_sb") > F.col("_sa")))
    change = F.when(F.col("_a").isNull(), "new").when(F.col("_b").isNull(), "deleted").when(later, "updated").otherwise("unchanged")
    return a.join(b, F.col("_a") == F.col("_b"), "full_outer").select(F.coalesce("_a", "_b").alias(key), change.alias("change"))


def apply_changes(known: DataFrame, arrived: DataFrame, key: str, stamp: str, delete: bool = True) -> DataFrame:
    """``known`` brought up to date: new and updated keys have their latest row of ``arrived``, unchanged ones the row they had, deleted ones go (or stay, without ``delete``).

    Both tables have the same columns. Repeated keys count once, by their latest stamp.
    """
    others = [c for c in known.columns if c != key]

    def latest(df: DataFrame) -> DataFrame:
        return df.groupBy(key).agg(F.max_by(F.struct(*others), F.struct(F.coalesce(F.col(stamp).cast("string"), F.lit("")), F.struct(*others).cast("string"))).alias("r")).select(key, "r.*")

    kinds = changes(known, arrived, key, stamp)
    fresh = latest(arrived).join(kinds.filter("change in ('new', 'updated')").select(key), on=key, how="left_semi")
    kept = latest(known).join(kinds.filter("change = 'unchanged'" + ("" if delete else " or change = 'deleted'")).select(key), on=key, how="left_semi")
    return fresh.select(*known.columns).unionByName(kept.select(*known.columns))


def write_project(documents: DataFrame, annotations: DataFrame, path: str) -> None:
    """Documents and annotations as JSON lines under ``path``, parted by data set status."""
    documents.write.mode("overwrite").partitionBy("dataset_status").json(f"{path}/documents")
    annotations.write.mode("overwrite").json(f"{path}/annotations")


def write_bio(tags: DataFrame, texts: DataFrame, key: str, path: str, files: int | None = None) -> None:
    """``document<TAB>word tag`` lines, the words of a document in order and together in one file of ``files`` (by default as many as there are shuffle partitions)."""
    words = tags.join(texts.select(key, "text"), on=key).select(key, "start_offset", F.concat(F.col(key).cast("string"), F.lit("\t"), F.expr("substring(text, CAST(start_offset AS INT) + 1, CAST(end_offset - start_offset AS INT))"), F.lit(" "), F.col("tag")).alias("value"))
    parts = words.repartition(files, key) if files else words.repartition(key)
    parts.sortWithinPartitions(key, "start_offset").select("value").write.mode("overwrite").text(path)


def local_project(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """A small project in memory: documents, and annotations over them."""
    docs = [(1, "All of us like opera.\nTotal 12,50 EUR\fThe second page", 63, 2), (2, "All of us like jazz.\nTotal 8,00 EUR", 63, 3), (3, "", 735, 2), (4, None, None, 0)]
    ann = [(1, "item", 15, 20, True, 1.0), (1, "amount", 28, 33, True, 0.9), (2, "item", 15, 19, True, 0.4), (2, "amount", 27, 31, False, 0.05)]
    return spark.createDataFrame(docs, "doc_id long, text string, category_id long, dataset_status int"), spark.createDataFrame(ann, "doc_id long, label string, start_offset long, end_offset long, is_correct boolean, confidence double")
