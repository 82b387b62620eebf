import json

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lavra.operators import nested


def found(spark, payloads):
    df = spark.createDataFrame([(i, p, "x", "y", "z") for i, p in enumerate(payloads)], "record_id bigint, payload string, tag string, pk string, item string")
    return {tuple(r) for r in nested.found(nested.flatten(df)).collect()}


DOC = {"sources": {"sql": {"tables": {"a": {"columns": {"x": "int", "y": {"type": "object", "fields": [{"name": "z", "type": "int"}, {"name": "w", "fields": {"v": "int"}}]}, "gone": None}, "foreign_keys": {"columns": ["x", "y"], "references_table": "b"}}, "none": None}}, "spreadsheets": {"files": {"f": {"sheets": [{"name": "s", "columns": ["c1", "c2"]}]}}}, "api": {"endpoints": {"e": {"response_schema": {"result_object_fields": {"k": "int"}}}}}}}
ROWS = {
    ("source", "sql.a", "", ""), ("column", "sql.a", "", "x"), ("column", "sql.a", "", "y"), ("column", "sql.a", "", "y/z"), ("column", "sql.a", "", "y/w"), ("column", "sql.a", "", "y/w/v"), ("foreign_key", "sql.a", "", "x,y>b"),
    ("source", "spreadsheets.f", "", ""), ("sheet", "spreadsheets.f", "s", ""), ("column", "spreadsheets.f", "s", "c1"), ("column", "spreadsheets.f", "s", "c2"), ("source", "api.e", "", ""), ("column", "api.e", "", "k"),
}


def test_shapes_and_damage(spark):
    text = json.dumps(DOC)
    got = found(spark, [text, "﻿" + text, json.dumps(text), text + "\n\x00", text[:-3], "", None, "[]", "null"])
    assert got == {(i, *r) for i in (0, 1, 2, 3) for r in ROWS}


def test_sources_as_list_and_single(spark):
    one = {"type": "sql", "key": "a", "columns": "x"}
    got = found(spark, [json.dumps({"sources": [one, None, {"type": "api", "key": "e"}]}), json.dumps({"sources": one}), json.dumps({"sources": None}), json.dumps({})])
    assert got == {(0, "source", "sql.a", "", ""), (0, "column", "sql.a", "", "x"), (0, "source", "api.e", "", ""), (1, "source", "sql.a", "", ""), (1, "column", "sql.a", "", "x")}


def test_repeats_are_marked_and_parents_exist(spark):
    text = json.dumps({"sources": [{"type": "sql", "key": "a", "columns": ["x", "x"]}, {"type": "sql", "key": "a"}]})
    df = spark.createDataFrame([(1, text), (None, text)], "record_id bigint, payload string")
    tables = nested.flatten(df)
    assert tables["column"].count() == 4 and tables["column"].where("is_first").count() == 2
    assert tables["record"].count() == 2 and tables["record"].select("pk").distinct().count() == 2
    assert tables["column"].select("pk").distinct().count() == 4
    assert tables["column"].join(tables["source"].select(F.col("pk").alias("parent_pk")), "parent_pk", "left_anti").count() == 0


def test_every_parent_key_is_a_key(spark):
    df = spark.createDataFrame([(1, json.dumps(DOC)), (1, json.dumps(DOC)), (None, json.dumps(DOC))], "record_id bigint, payload string")
    tables = nested.flatten(df)
    keys = [r.pk for tag in ("record", "source", "sheet", "column") for r in tables[tag].collect()]
    assert len(keys) == len(set(keys))
    for tag, t in tables.items():
        assert tag == "record" or {r.parent_pk for r in t.collect()} <= set(keys)
    branches = {(r.item, r.branch) for r in tables["column"].collect()}
    assert {("x", "columns"), ("k", "response"), ("y/z", "fields"), ("c1", "columns")} <= branches


def test_nothing_said_is_dropped(spark):
    column = {"name": "c", "type": "float", "stats": {"min": 4, "max": "2020-01-01", "mean": 1.5, "p50": 2}, "cardinality": "many", "is_pk": True, "unit": "kg"}
    source = {"type": "api", "key": "e", "data_quality": {"null_rates": {"c": 0.5}}, "response_schema": {"format": "paginated", "next": "n", "result_object_fields": [column]}, "owner": ["x"], "embedding_hint": "h"}
    tables = nested.flatten(spark.createDataFrame([(1, json.dumps({"_schema_version": "1.0", "metadata": {"a": 1}, "sources": source, "else": 5}))], "record_id bigint, payload string"))
    r, s, c = (tables[t].first() for t in ("record", "source", "column"))
    assert (r.schema_version, json.loads(r.metadata), json.loads(r.rest)) == ("1.0", {"a": 1}, {"else": 5})
    assert (s.response_format, json.loads(s.data_quality), s.embedding_hint, json.loads(s.rest)) == ("paginated", {"null_rates": {"c": 0.5}}, "h", {"owner": ["x"], "response_schema": {"next": "n"}})
    assert (c.type, c.min, c.max, c["mean"], c.is_pk, c.cardinality, json.loads(c.rest)) == ("float", "4", "2020-01-01", 1.5, True, None, {"stats": {"p50": 2}, "cardinality": "many", "unit": "kg"})


def test_entries_of_lists_without_a_name():
    assert list(nested.entries([{"name": None, "type": "x"}, {"type": "int"}, {"a": "int"}, ["b"], 3, None, True])) == [("a", "int"), ("b", {}), ("3", {})]


def test_empty_table(spark):
    assert found(spark, []) == set()


def test_depth_has_no_limit():
    field = {"name": "x"}
    for _ in range(3000):
        field = {"name": "x", "fields": [field]}
    assert sum(r[0] == "column" for r in nested.visit(1, {"sources": [{"type": "sql", "key": "a", "columns": [field]}]})) == 3001


json_values = st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=5), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.sampled_from(["sources", "sql", "tables", "columns", "fields", "name", "key", "type", "foreign_keys", "sheets"]), x, max_size=4), max_leaves=20)


@given(json_values)
def test_any_document_is_walked(value):
    document = nested.parse(json.dumps({"sources": value}))
    for row in nested.visit(1, document):
        assert row[0] in nested.PAYLOADS and json.loads(row[-2]) is not None and (row[-1] is None or json.loads(row[-1]))
