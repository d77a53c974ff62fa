"""Descriptors of stored tables."""

from ingestloom.model import ColumnModel, TableModel
from ingestloom.registry import Level, ModelCatalog, run_validators
from ingestloom.registry.observed import common_kind, describe_table, describe_tables, fits, is_key, observed_frame, type_differences
from ingestloom.registry.specs import FieldSpec


def test_kinds_are_a_lattice():
    kinds = ("boolean", "integer", "float", "date", "datetime", "string")
    assert all(fits(k, k) and fits(k, "string") for k in kinds)
    assert all(fits(a, c) for a in kinds for b in kinds for c in kinds if fits(a, b) and fits(b, c))
    assert common_kind("integer", "float") == "float" and common_kind("boolean", "integer") == "integer" and common_kind("date", "datetime") == "datetime"
    assert common_kind("date", "integer") == "string" and common_kind("string") == "string" and common_kind("array<int>") is None
    assert not fits("float", "integer") and not fits("datetime", "date")


def test_keys_nulls_and_types_of_stored_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(k % 4, k // 4, f"n{k}" if k else None, k / 2, [k], {"a": k}) for k in range(12)], "a int, b long, c string, d double, e array<int>, f map<string,int>").write.parquet(path)
    df = spark.read.parquet(path)
    model = describe_table("t", df, ("a", "b"))
    assert model.primary_key == ("a", "b") and [c.name for c in model.columns if c.nullable] == ["c"]
    assert [c.kind if isinstance(c.kind, str) else c.kind.simpleString() for c in model.columns] == ["integer", "integer", "string", "float", "array<int>", "map<string,int>"]
    assert describe_table("t", df).primary_key == ("d",) and describe_table("t", df, ("a",)).primary_key == ("d",)
    assert describe_table("t", df.select("a", "c")).primary_key == () and describe_table("t", df.where("false")).primary_key == ()
    assert is_key(df, ["a", "b"]) and not is_key(df, ["c"]) and not is_key(df, ["absent"])


def test_stored_tables_against_specification_and_models(spark):
    parent = spark.createDataFrame([(1,), (2,)], "id long")
    child = spark.createDataFrame([(1, 1, 9), (2, None, 1)], "id long, up long, other long")
    models = describe_tables({"parent": parent, "child": child}, {"parent": ("id",)}, {("child", "up"): ("parent", "id"), ("child", "other"): ("parent", "id")})
    assert models[1].foreign_keys == {"up": ("parent", "id")} and models[1].primary_key == ("id",)
    assert observed_frame(spark, models).where("is_pk").count() == 2
    catalog = ModelCatalog("stored")
    catalog.register(*models)
    catalog.fields = {"child": {n: FieldSpec("child", n, True, primary_key=n == "id") for n in ("id", "up", "gone")}, "parent": {"id": FieldSpec("parent", "id", primary_key=True)}}
    found = {(i.code, i.field) for i in run_validators(catalog).issues if i.level is Level.ERROR}
    assert found == {("COLUMN_MISSING", "gone"), ("REQUIRED_COLUMN_NULLABLE", "up")}
    declared = TableModel("child", (ColumnModel("id", "float"), ColumnModel("up", "date"), ColumnModel("more")))
    assert type_differences(models, [declared]) == [("child", "up", "integer", "date"), ("child", "more", "absent", "string")]
