import io

import pytest
from pyspark.sql import functions as F

from ingestloom.functions.serial import row_dict, row_fingerprint, row_items, row_json, row_map
from ingestloom.model import ColumnModel, IdAllocator, SerializableLike, TableLike, TableModel, model_by_name
from ingestloom.operators import merge, quality, references
from ingestloom.plans.settings import Capabilities, quote_identifier, resolve_index_strategy
from ingestloom.plans.store import VersionedStore
from ingestloom.plans.views import MaterializedView, ViewStore, refresh_order
from ingestloom.registry import Level, ModelCatalog, run_validators

EXAMPLE = TableModel("example", (ColumnModel("id", "integer"), ColumnModel("a", "integer", nullable=False), ColumnModel("b", "integer")), ("id",))


def test_required_columns_and_keys():
    assert EXAMPLE.required_columns() == ["a"]
    assert TableModel("t", (ColumnModel("k"),), ("k",)).required_columns() == ["k"]
    pair = TableModel("t", (ColumnModel("x", "integer"), ColumnModel("y", "integer")), ("x", "y"))
    assert pair.required_columns() == ["x", "y"] and pair.key_of({"x": 1, "y": 2}) == (1, 2)
    with pytest.raises(ValueError):
        TableModel("t", (ColumnModel("x"),)).key()
    assert isinstance(EXAMPLE, TableLike) and isinstance(EXAMPLE, SerializableLike)
    assert model_by_name(" EXAMPLE ", [EXAMPLE]) is EXAMPLE and model_by_name("x", [EXAMPLE]) is None


def test_rows_from_dictionaries(spark):
    df = EXAMPLE.from_rows(spark, [{"id": 1, "a": 2, "b": "null", "junk": 3}], strict=True)
    assert [tuple(r) for r in df.collect()] == [(1, 2, None)]
    with pytest.raises(ValueError):
        EXAMPLE.from_rows(spark, [{"id": 1}], strict=True)
    with pytest.raises(TypeError):
        EXAMPLE.from_rows(spark, [{"id": "x", "a": 1}])


def test_serialisation(spark):
    df = spark.createDataFrame([(1, 2, None)], "id long, b long, a long")
    row = df.select(row_json(df.columns).alias("j"), row_json(df.columns, include_nulls=False).alias("k"), row_fingerprint(df.columns).alias("f"), row_map(df).alias("m")).first()
    assert row.j == '{"a":null,"b":2,"id":1}' and row.k == '{"b":2,"id":1}' and len(row.f) == 64 and row.m == {"id": "1", "b": "2"}
    assert row_dict(df.first()) == {"id": 1, "b": 2} and row_dict(df.first(), only=set(), exclude={"id"}, include_nulls=True) == {"b": 2, "a": None}
    assert row_items(df.first()) == [("id", 1), ("b", 2)]


def test_allocator():
    ids = IdAllocator(10)
    assert ids.next() == 11 and list(ids.reserve(3)) == [12, 13, 14] and ids.next() == 15


def test_first_per_key_and_nulls(spark):
    df = spark.createDataFrame([(1, "a", 0), (1, "b", 1), (None, "c", 2), (None, "d", 3)], "k long, v string, _rownum long")
    assert sorted(r.v for r in quality.first_per_key(df, ["k"]).collect()) == ["a", "c", "d"]
    assert sorted(r.v for r in quality.first_per_key(df, ["k"], keep_null_keys=False).collect()) == ["a", "c"]


def test_merge_laws(spark):
    target = spark.createDataFrame([(1, "x"), (2, "y")], "k long, v string")
    staged = spark.createDataFrame([(2, "Y", 0), (3, "Z", 1), (3, "W", 2)], "k long, v string, _rownum long")
    up = merge.upsert(target, staged, ["k"])
    assert sorted(map(tuple, up.collect())) == [(1, "x"), (2, "y"), (3, "Z")]
    assert sorted(map(tuple, merge.upsert(up, staged, ["k"]).collect())) == sorted(map(tuple, up.collect()))
    unique = staged.where("v <> 'W'")
    once = merge.replace(target, unique, ["k"])
    assert sorted(map(tuple, merge.replace(once, unique, ["k"]).collect())) == sorted(map(tuple, once.collect()))
    assert [tuple(r) for r in merge.repeated_keys(staged, ["k"]).collect()] == [(3, 2)]


def test_orphans(spark):
    child = spark.createDataFrame([(1, 1), (2, 9), (3, None)], "id long, p long")
    parent = spark.createDataFrame([(1,)], "id long")
    assert [r.id for r in references.orphans(child, parent, {"p": "id"}).collect()] == [2]


def test_views(spark, tmp_path):
    store = VersionedStore(spark, str(tmp_path))
    base = MaterializedView("v_base", lambda s: s.range(3).withColumn("x", F.col("id") * 2))
    top = MaterializedView("v_top", "select sum(x) as total from v_base", ("v_base", "no_view"))
    assert [v.name for v in refresh_order([top, base])] == ["v_base", "v_top"]
    views = ViewStore(spark, store)
    with pytest.raises(ValueError):
        views.refresh(base)
    views.create(base)
    views.create(top)
    assert views.refresh_all([top, base]) == ["v_base", "v_top"] and views.read(top).first().total == 6
    with pytest.raises(RuntimeError):
        refresh_order([MaterializedView("a", "", ("b",)), MaterializedView("b", "", ("a",))])
    with pytest.raises(NotImplementedError):
        ViewStore(spark, store, Capabilities(materialized_views=False)).create(base)


def test_settings():
    assert resolve_index_strategy("auto") == "keep" and quote_identifier("a`b", "s") == "`s`.`a``b`"
    with pytest.raises(ValueError):
        resolve_index_strategy("x")


class Resource:
    def __init__(self, text):
        self.text = text

    def open(self, mode="r"):
        return io.StringIO(self.text)


TABLES = Resource("cdmTableName,schema,isRequired,tableDescription\nPerson,cdm,Yes,people\nVisit,cdm,Yes,visits\n")
HEAD = "cdmTableName,cdmFieldName,isRequired,cdmDatatype,isPrimaryKey,isForeignKey,fkCdmTableName,fkCdmFieldName\n"


def report(fields, model, **options):
    catalog = ModelCatalog("demo")
    catalog.load_specs(TABLES, Resource(HEAD + fields))
    catalog.register(model)
    assert catalog.missing_required_tables() == {"visit"} and catalog.known_tables() == {"person", "visit"}
    return run_validators(catalog, **options)


PERSON = TableModel("person", (ColumnModel("person_id", "integer"), ColumnModel("name", nullable=False)), ("person_id",))
GOOD = "Person,person_id,Yes,integer,Yes,No,,\nPerson,name,Yes,varchar,No,No,,\n"


def test_validation():
    good = report(GOOD, PERSON)
    assert good.is_valid and good.exit_code == 0
    missing = report(GOOD + "Person,age,No,integer,No,No,,\n", PERSON)
    assert [i.code for i in missing.issues] == ["COLUMN_MISSING"] and missing.exit_code == 1 and "age" in missing.text()
    loose = TableModel("person", (ColumnModel("person_id", "integer", nullable=True), ColumnModel("name", nullable=False)), ("person_id",))
    assert "PRIMARY_KEY_COLUMN_NULLABLE" in [i.code for i in report(GOOD, loose).issues]
    linked = TableModel("person", (*PERSON.columns, ColumnModel("place", "integer")), ("person_id",), {"place": ("location", "id")})
    assert [(i.code, i.level) for i in report(GOOD, linked).issues] == [("FOREIGN_KEY_NOT_IN_SPEC", Level.WARN)]
    keyless = TableModel("person", PERSON.columns)
    first = report(GOOD + "Person,a,No,x,No,No,,\nPerson,b,No,x,No,No,,\n", keyless, fail_fast=True)
    assert len(first.issues) == 1 and first.issues[0].level is Level.ERROR
    assert report(GOOD, PERSON, required_tables=True).issues[0].code == "REQUIRED_TABLE_MISSING"
    assert '"valid": false' in missing.to_json() and missing.summary() == "demo: 1 ERROR"
