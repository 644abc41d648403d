"""Nested records to flat tables, against a walk over the parsed JSON."""

import json

from pyspark.sql import functions as F

from quire.operators.nested import flatten_records
from quire.plans.queries import p6_found

DATA = "/root/testdata/sf0.001"
LISTS = {"label_sets": ("label_sets", "schema", "schema_"), "labels": ("labels",), "categories": ("categories",)}


def members(value):
    if value is None or value == {}:
        return []
    if isinstance(value, dict) and all(k.isdigit() for k in value):
        return [(k, v) for k, v in value.items() if v is not None]
    if isinstance(value, list):
        return [(None, v) for v in value if v is not None]
    return [(None, value)]


def ident(key, v):
    if isinstance(v, dict):
        return int(v["id"]) if v.get("id") is not None else int(key)
    return int(v)


def walk(payload):
    try:
        j = json.loads(payload)
        j = json.loads(j) if isinstance(j, str) else j
    except (TypeError, ValueError):
        return
    if isinstance(j, dict):
        j = j.get("categories") or (j.get("project") or {}).get("categories") or (j.get("data") or {}).get("categories")
    for ck, c in members(j):
        sets = members(next((c[k] for k in ("schema", "schema_", "label_sets") if c.get(k) is not None), None))
        if not sets:
            yield ident(ck, c), -1, -1
        for sk, s in sets:
            labels = members(s.get("labels") if isinstance(s, dict) else None)
            if not labels:
                yield ident(ck, c), ident(sk, s), -1
            for lk, x in labels:
                yield ident(ck, c), ident(sk, s), ident(lk, x)


def expected(spark, folder):
    want = set()
    for r in spark.read.parquet(f"{folder}/project_metadata.parquet").collect():
        want |= {("project", r.record_id, *ids) for ids in walk(r.payload)}
    for r in spark.read.parquet(f"{folder}/split_requests.parquet").collect():
        for p in r.pages or []:
            for c in p["categories"] or [{"id": -1}]:
                want.add(("split", r.request_id, p["id"], c["id"], -1))
    return want


def test_found_equals_walk(spark):
    got = [tuple(r) for r in p6_found(spark, DATA).collect()]
    assert len(got) == len(set(got))
    assert set(got) == expected(spark, DATA)


def test_shapes_and_links(spark):
    rows = [
        (1, '{"categories": [{"id": 5, "schema": {"id": 7, "labels": [1, "2", null]}}], "id": 9, "node_id": "x"}'),
        (2, '[{"id": "6", "schema_": []}, {"id": 8}]'),
        (3, json.dumps('{"categories": {"12": {"label_sets": null}}}')),
        (4, None),
        (5, "{broken"),
        (6, "{}"),
        (7, ""),
    ]
    df = spark.createDataFrame(rows, "rid long, payload string").withColumn("node_id", F.lit("clash"))
    top = flatten_records(df, ["rid"], "payload", root="categories", lists=LISTS)
    cats = top.children["categories"]
    assert {(r.rid, r.ordinal, r.id, r.item_key) for r in cats.table.collect()} == {(1, 0, "5", None), (2, 0, "6", None), (2, 1, "8", None), (3, 0, None, "12")}
    sets = cats.children["label_sets"]
    labels = sets.children["labels"].table.collect()
    assert {(r.ordinal, r.bare_value) for r in labels} == {(0, "1"), (1, "2")}
    nodes = {r.node_id for r in sets.table.collect()}
    assert all(r.parent_id in nodes for r in labels)
    assert top.table.count() == 7
    assert top.schema["node_id"] == "string" and "node_id_2" in top.table.columns


def test_typed_nested_and_empty(spark):
    df = spark.sql("select 1L as k, array(named_struct('a', 1, 'b', array(named_struct('c', 2.5D), null)), null) as v union all select 2L, null")
    top = flatten_records(df, ["k"], "v")
    assert [(r.ordinal, r.a) for r in top.children["items"].table.collect()] == [(0, 1)]
    assert [r.c for r in top.children["items"].children["b"].table.collect()] == [2.5]
    none = flatten_records(df.limit(0), ["k"], "v")
    assert none.table.count() == 0 and none.children["items"].table.count() == 0
