"""Versioned request and response payloads of the services, as JSON of fixed shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# The shapes of the services' payloads, by kind and version. Recognition responses are objects or lists and stay JSON text.
_BOX = "struct<page_number:int,line_index:int,x0:double,x1:double,y0:double,y1:double,text:string>"
_OLD_BOX = "struct<page_number:int,x0:double,x1:double,y0:double,y1:double,text:string>"
_PAGE = "struct<number:int,image:string,original_size:array<double>,segmentation:string>"
_CATEGORY = "struct<id:bigint,name:string,confidence:double>"
_SPLIT_PAGE = f"struct<id:bigint,number:int,image:string,original_size:array<double>,segmentation:string,categories:array<{_CATEGORY}>>"
_SPAN = "struct<x0:double,x1:double,y0:double,y1:double,page_index:int,start_offset:int,end_offset:int,offset_string:string,offset_string_original:string>"
_LABEL = "struct<id:bigint,name:string,has_multiple_top_candidates:boolean,data_type:string,threshold:double>"
_ANNOTATION = f"struct<offset_string:string,translated_string:string,normalized:string,label:{_LABEL},annotation_set:bigint,confidence:double,span:array<{_SPAN}>>"
SCHEMAS = {
    ("extract_request", "20240117"): f"struct<text:string,bboxes:map<string,{_OLD_BOX}>,pages:array<{_PAGE}>>",
    ("extract_request", "20241223"): f"struct<text:string,bboxes:map<string,{_BOX}>,pages:array<{_PAGE}>>",
    ("extract_request", "20241227"): f"struct<text:string,bboxes:map<string,{_BOX}>,pages:array<{_PAGE}>,raw_ocr_response:string>",
    ("extract_response", "20240117"): f"struct<annotation_sets:array<struct<label_set_id:bigint,annotations:array<{_ANNOTATION}>>>>",
    ("categorize_request", "20240729"): f"struct<text:string,bboxes:map<string,{_OLD_BOX}>,pages:array<{_PAGE}>>",
    ("categorize_request", "20241227"): f"struct<text:string,bboxes:map<string,{_OLD_BOX}>,pages:array<{_PAGE}>,raw_ocr_response:string>",
    ("categorize_response", "20241227"): f"struct<pages:array<struct<number:int,categories:array<{_CATEGORY}>>>>",
    ("split_request", "20240930"): f"struct<text:string,bboxes:map<string,{_OLD_BOX}>,pages:array<{_SPLIT_PAGE}>>",
    ("split_request", "20241227"): f"struct<text:string,bboxes:map<string,{_OLD_BOX}>,pages:array<{_SPLIT_PAGE}>,raw_ocr_response:string>",
    ("split_response", "20240930"): f"struct<splitting_results:array<struct<pages:array<struct<id:bigint>>,page_ids:array<bigint>,category:bigint,categories:array<{_CATEGORY}>>>>",
}


def decode(payload: Column, kind: str, version: str) -> Column:
    """JSON text as a struct of the version's shape; null where it is no valid JSON."""
    return F.from_json(payload, SCHEMAS[kind, version])


def encode(body: Column) -> Column:
    return F.to_json(body)


#: A payload of responses holds the pages of one range of so many numbers, and so many categories of each: 10,000 at most.
PAGES, CATEGORIES = 200, 50


def categorize_responses(rows: DataFrame, request: str = "request_id") -> DataFrame:
    """``request_id``, ``part``, ``piece`` and ``payload``: each request's pages with their categories, by falling confidence, as response payloads.

    A request has a payload for each range of ``PAGES`` page numbers (``part``). A page of more than ``CATEGORIES`` categories continues
    in the payloads of the same range with the next ``piece``; every page is in piece 0.
    """
    category = F.struct(F.col("category_id").alias("id"), F.col("category_name").alias("name"), "confidence")
    place = Window.partitionBy(request, "number").orderBy(F.desc("c"), F.desc("v"))
    cut = rows.select(request, "number", F.coalesce("confidence", F.lit(-1.0)).alias("c"), category.alias("v")).withColumn("piece", F.floor((F.row_number().over(place) - 1) / CATEGORIES))
    page = cut.groupBy(request, "number", "piece").agg(F.sort_array(F.collect_list(F.struct("c", "v")), asc=False).alias("cs"))  # at most CATEGORIES
    pages = page.select(request, F.floor(F.col("number") / PAGES).alias("part"), "piece", F.struct("number", F.transform("cs", lambda x: x["v"]).alias("categories")).alias("p"))
    return pages.groupBy(request, "part", "piece").agg(F.array_sort(F.collect_list("p")).alias("pages")).select(request, "part", "piece", F.to_json(F.struct("pages")).alias("payload"))  # at most PAGES


def boxes_of(requests: DataFrame, request: str = "request_id", body: str = "body") -> DataFrame:
    """The boxes of decoded requests as rows: ``request_id``, ``bbox_key`` (a character's place) and the box. Requests without boxes give none."""
    opened = requests.select(request, F.explode(F.col(f"{body}.bboxes")).alias("k", "b"))
    return opened.select(request, F.col("k").try_cast("bigint").alias("bbox_key"), "b.*")


def extract_responses(annotations: DataFrame, document: str = "doc_id") -> DataFrame:
    """``document`` and ``payload``: each document's annotation sets as one extraction response. ``annotations`` has a row per span, with ``label_set_id``, ``set_id``,
    ``annotation_id``, ``label_id``, ``label``, ``multiple``, ``data_type``, ``threshold``, ``normalized``, ``confidence``, offsets, ``offset_string``, ``page_index`` and the box."""
    span = F.struct("x0", "x1", "y0", "y1", "page_index", "start_offset", "end_offset", "offset_string", F.col("offset_string").alias("offset_string_original"))
    label = F.struct(F.col("label_id").alias("id"), F.col("label").alias("name"), F.col("multiple").alias("has_multiple_top_candidates"), "data_type", "threshold")
    whole = annotations.groupBy(document, "label_set_id", "set_id", "annotation_id").agg(F.first(label).alias("label"), F.max("confidence").alias("confidence"), F.first("normalized", ignorenulls=True).alias("normalized"), F.array_sort(F.collect_list(F.struct("start_offset", span.alias("s")))).alias("spans"))
    spans = F.transform("spans", lambda x: x["s"])
    one = F.struct(F.array_join(F.transform(spans, lambda x: x["offset_string"]), " ").alias("offset_string"), F.lit(None).cast("string").alias("translated_string"), "normalized", "label", F.col("set_id").alias("annotation_set"), "confidence", spans.alias("span"))
    sets = whole.groupBy(document, "label_set_id", "set_id").agg(F.array_sort(F.collect_list(F.struct("annotation_id", one.alias("a")))).alias("as"))
    body = sets.groupBy(document).agg(F.array_sort(F.collect_list(F.struct("set_id", F.struct("label_set_id", F.transform("as", lambda x: x["a"]).alias("annotations")).alias("s")))).alias("ss"))  # the sets of one document
    return body.select(document, F.to_json(F.struct(F.transform("ss", lambda x: x["s"]).alias("annotation_sets"))).alias("payload"))


def split_responses(pages: DataFrame, document: str = "request_id") -> DataFrame:
    """``document`` and ``payload``: the parts of each file with their pages, as one splitting response. ``pages`` has ``page_id``, ``page_index``, ``split_id`` and maybe ``category_id``."""
    category = F.max("category_id") if "category_id" in pages.columns else F.lit(None).cast("bigint")
    parts = pages.groupBy(document, "split_id").agg(F.array_sort(F.collect_list(F.struct("page_index", "page_id"))).alias("p"), category.alias("category"))
    body = parts.groupBy(document).agg(F.array_sort(F.collect_list(F.struct("split_id", F.struct(F.transform("p", lambda x: F.struct(x["page_id"].alias("id"))).alias("pages"), "category").alias("r")))).alias("rs"))  # the parts of one file
    return body.select(document, F.to_json(F.struct(F.transform("rs", lambda x: x["r"]).alias("splitting_results"))).alias("payload"))
