import enum

import pytest
from pyspark.sql import functions as F

from ingestloom.errors import IngestError
from ingestloom.functions.casting import ColumnRules
from ingestloom.model import ColumnModel, TableModel
from ingestloom.operators import ids
from ingestloom.plans.ingest import load_file
from ingestloom.plans.store import VersionedStore
from ingestloom.streaming.landing import watch

TABLE = TableModel("test_table", (ColumnModel("id", "integer"), ColumnModel("name", nullable=False), ColumnModel("slug", computed="lower(name)")), ("id",))
COMPOSITE = TableModel("composite_table", (ColumnModel("a", "integer"), ColumnModel("b", "integer"), ColumnModel("value", nullable=False)), ("a", "b"))


@pytest.fixture
def store(spark, tmp_path):
    return VersionedStore(spark, str(tmp_path / "tables"))


def put(tmp_path, text, name="test_table.tsv"):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


def rows(store, model=TABLE):
    return sorted(tuple(r) for r in store.read(model).select(*[c.name for c in model.insertable]).collect())


FIRST = "id\tname\n1\talpha\n2\tbeta\n3\tgamma\n"
SECOND = "id\tname\n2\tbeta_updated\n3\tgamma_updated\n"


def test_replace_and_upsert(spark, store, tmp_path):
    assert load_file(spark, store, TABLE, put(tmp_path, FIRST)).rows == 3
    assert load_file(spark, store, TABLE, put(tmp_path, SECOND), merge_strategy="upsert").rows == 2
    assert rows(store) == [(1, "alpha"), (2, "beta"), (3, "gamma")]
    assert load_file(spark, store, TABLE, put(tmp_path, SECOND)).rows == 2
    assert rows(store) == [(1, "alpha"), (2, "beta_updated"), (3, "gamma_updated")]
    load_file(spark, store, TABLE, put(tmp_path, SECOND))  # once more changes nothing
    assert rows(store) == [(1, "alpha"), (2, "beta_updated"), (3, "gamma_updated")]
    assert {r.slug for r in store.read(TABLE).collect()} == {"alpha", "beta_updated", "gamma_updated"}
    assert store.max_id(TABLE) == 3 and list(store.allocator(TABLE).reserve(2)) == [4, 5]


def test_insert_if_empty(spark, store, tmp_path):
    load_file(spark, store, TABLE, put(tmp_path, FIRST), merge_strategy="insert_if_empty")
    with pytest.raises(ValueError):
        load_file(spark, store, TABLE, put(tmp_path, FIRST), merge_strategy="insert_if_empty")
    assert not store.files.exists(f"{store.root}/_staging_test_table_cast")
    assert len(rows(store)) == 3


def test_composite_keys(spark, store, tmp_path):
    path = put(tmp_path, "a,b,value\n1,1,x\n1,1,x\n1,2,y\n", "composite_table.csv")
    assert load_file(spark, store, COMPOSITE, path, dedupe=True).rows == 2
    load_file(spark, store, COMPOSITE, put(tmp_path, "a,b,value\n1,1,x_updated\n", "composite_table.csv"))
    assert rows(store, COMPOSITE) == [(1, 1, "x_updated"), (1, 2, "y")]


def test_required_values(spark, store, tmp_path):
    result = load_file(spark, store, TABLE, put(tmp_path, "id,name\n1,ok\n2,null\n", "test_table.csv"))
    assert result.rows == 1 and result.nulls == {"name": 1}
    with pytest.raises(IngestError, match="test_table.*name"):
        load_file(spark, store, TABLE, put(tmp_path, "id\n1\n", "test_table.csv"))


def test_failures_are_counted(spark, store, tmp_path):
    model = TableModel("test_table", (ColumnModel("id", "integer"), ColumnModel("n", "integer"), ColumnModel("d", "date")), ("id",))
    path = put(tmp_path, "id,n,d\n1,x,2020-01-01\n2,y,bad\n3,z,\n4,w,\n5,7,\n", "test_table.csv")
    stats = load_file(spark, store, model, path).stats
    assert stats.total == 5 and stats.total_recorded == 4
    assert stats.to_dict()["columns"] == {"n": {"count": 4, "examples": ["x", "y", "z"]}, "d": {"count": 1, "examples": ["bad"]}}


def test_bad_loads_change_nothing(spark, store, tmp_path):
    load_file(spark, store, TABLE, put(tmp_path, FIRST))
    with pytest.raises(IngestError, match="repeated"):
        load_file(spark, store, TABLE, put(tmp_path, "id\tname\n9\ta\n9\tb\n"))
    for wrong in ({"merge_strategy": "bogus"}, {"index_strategy": "bogus"}, {"quote_mode": "bogus"}):
        with pytest.raises(ValueError):
            load_file(spark, store, TABLE, put(tmp_path, FIRST), **wrong)
    with pytest.raises(ValueError):
        load_file(spark, store, TABLE, put(tmp_path, FIRST, "wrong_name.tsv"))
    assert len(rows(store)) == 3
    assert load_file(spark, store, TABLE, put(tmp_path, "id\tname\n9\ta\n9\tb\n"), merge_strategy="upsert").rows == 2
    assert rows(store)[-1] == (9, "a")


def test_empty_file_and_fast_path(spark, store, tmp_path):
    assert load_file(spark, store, TABLE, put(tmp_path, "")).rows == 0
    assert load_file(spark, store, TABLE, put(tmp_path, FIRST), fast=True).rows == 3


def test_enum_rule_and_parquet(spark, store, tmp_path):
    class Role(enum.Enum):
        FIRST_AUTHOR = "first author"
        LAST_AUTHOR = "last author"

    model = TableModel("enum_table", (ColumnModel("id", "integer"), ColumnModel("role")), ("id",))
    rules = ColumnRules()
    rules.register("enum_table", "role", enum_type=Role)
    path = str(tmp_path / "enum_table.parquet")
    spark.createDataFrame([(1, "first author"), (2, "BOGUS"), (3, "last author")], "ID long, role string").write.parquet(path)
    load_file(spark, store, model, path, rules=rules)
    assert rows(store, model) == [(1, "FIRST_AUTHOR"), (2, None), (3, "LAST_AUTHOR")]


def test_many_rows(spark, store, tmp_path):
    assert load_file(spark, store, TABLE, put(tmp_path, "id,name\n" + "".join(f"{i},n{i}\n" for i in range(9999)), "test_table.csv")).rows == 9999
    assert store.read(TABLE).count() == 9999


def test_bootstrap_and_ids(spark, store):
    store.bootstrap([TABLE, COMPOSITE])
    assert store.exists("test_table") and store.read(COMPOSITE).count() == 0 and store.max_id(TABLE) == 0
    with pytest.raises(ValueError):
        store.max_id(COMPOSITE)
    new = spark.createDataFrame([(f"n{i}",) for i in range(50)], "name string")
    target = spark.createDataFrame([(7,)], "id long")
    got = ids.assign_ids(new, target, "id", ["name"]).orderBy("name").collect()
    assert [r.id for r in got] == list(range(8, 58))


def test_ids_of_many_rows(spark):
    """Ranges that follow from a sample are the same where rows are counted and where they are numbered."""
    new = spark.range(200_000).select(F.xxhash64("id").alias("at"), F.concat(F.lit("n"), "id").alias("name"))
    got = ids.assign_ids(new, spark.createDataFrame([(7,)], "id long"), "id", ["at"]).toPandas().sort_values("at")
    assert got.id.tolist() == list(range(8, 200_008))


def test_landing_folder(spark, store, tmp_path):
    folder = tmp_path / "landing"
    folder.mkdir()
    (folder / "a.csv").write_text("name,more,id\na,x,1\n,x,2\nno key,x,\n")
    for _ in range(2):
        watch(spark, store, TABLE, str(folder), str(tmp_path / "checkpoint")).awaitTermination(120)
        (folder / "b.csv").write_text("id,name\n1,changed\n3,c\n")
    assert rows(store) == [(1, "a"), (3, "c")]
