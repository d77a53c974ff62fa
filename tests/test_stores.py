"""Stores of buckets and of the catalog: the rows of a whole merge, steps that resume, files that stay."""

import random
import uuid
from pathlib import Path

import pytest

from ingestloom.model import ColumnModel, TableModel
from ingestloom.operators import quality
from ingestloom.plans.buckets import BucketedStore
from ingestloom.plans.catalog import STORES, register_store, resolve_store
from ingestloom.plans.ingest import load_file
from ingestloom.plans.store import VersionedStore
from ingestloom.plans.views import MaterializedView, ViewStore

TABLE = TableModel("t", (ColumnModel("id", "integer"), ColumnModel("part"), ColumnModel("v"), ColumnModel("up", computed="upper(v)")), ("id", "part"))
ONE = TableModel("t", (ColumnModel("id", "integer"), ColumnModel("v")), ("id",))


def staged(spark, rows):
    return spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "id long, part string, v string, _rownum long")


def held(store, model=TABLE):
    return sorted((tuple(r) for r in store.read(model).collect()), key=lambda r: [(x is not None, x if x is not None else 0) for x in r])


def files(root):
    return {str(p): p.stat().st_mtime_ns for p in Path(root).rglob("*.parquet")}


@pytest.mark.parametrize("kind", ["bucketed", "catalog"])
def test_merges_equal_whole_merges(spark, tmp_path, kind):
    rng = random.Random(5)
    store, whole = resolve_store(spark, kind, str(tmp_path / "b") if kind == "bucketed" else f"stores_{uuid.uuid4().hex}", buckets=5), VersionedStore(spark, str(tmp_path / "v"))
    for strategy in ("insert_if_empty", "replace", "upsert", "replace"):
        keys = rng.sample([(k, p) for k in range(-20, 40) for p in ("a", "b")], 30)
        rows = staged(spark, [(*k, rng.choice(["x", "y", None])) for k in keys])
        store.merge_rows(TABLE, rows, strategy, batch_rows=8)
        whole.merge_rows(TABLE, rows, strategy)
        assert held(store) == held(whole) and store.exists("t") and not store.is_empty(TABLE)
    with pytest.raises(ValueError):
        store.merge_rows(TABLE, rows, "insert_if_empty")
    with pytest.raises(ValueError):
        store.merge_rows(TABLE, rows, "bogus")
    store.drop("t")
    assert not store.exists("t") and held(store) == []
    store.bootstrap([TABLE])
    assert store.exists("t") and held(store) == []


def test_a_stopped_load_goes_on_behind_its_last_step(spark, tmp_path, monkeypatch):
    store, whole = BucketedStore(spark, str(tmp_path / "b"), buckets=12), VersionedStore(spark, str(tmp_path / "v"))
    first, second = staged(spark, [(k, "a", "old") for k in range(60)]), staged(spark, [(k, "a", "new") for k in range(0, 90, 3)])
    for s in (store, whole):
        s.merge_rows(TABLE, first, "replace")
    put, left = store._put_state, [3]

    def stops(name, state):
        if not left[0]:
            raise InterruptedError
        left[0] -= 1
        put(name, state)

    monkeypatch.setattr(store, "_put_state", stops)
    with pytest.raises(InterruptedError):
        store.merge_rows(TABLE, second, "replace", batch_rows=4, load="second")
    assert store.state("t")["done"] == [0, 1, 2]
    part = held(store)  # whole steps only
    assert {r[0] for r in part if r[2] == "new"} and len({r[:2] for r in part}) == len(part)
    again = BucketedStore(spark, str(tmp_path / "b"))
    before = files(tmp_path / "b")
    taken = again.merge_rows(TABLE, second, "replace", batch_rows=4, load="second")
    whole.merge_rows(TABLE, second, "replace")
    assert held(again) == held(whole) and "done" not in again.state("t")
    done = {b for b in range(12)} - {b for step in taken for b in step}
    kept = {f for f in before if any(f"_bucket={b}/" in f for b in done)}
    assert taken and done and kept and all(files(tmp_path / "b").get(f) == before[f] for f in kept)


def test_only_touched_buckets_are_written(spark, tmp_path):
    store = BucketedStore(spark, str(tmp_path), buckets=16)
    store.merge_rows(TABLE, staged(spark, [(k, "a", "x") for k in range(400)]), "replace")
    before = files(tmp_path)
    [[bucket]] = store.merge_rows(TABLE, staged(spark, [(7, "a", "y")]), "replace")
    after = files(tmp_path)
    assert {f for f in after if f not in before} == {f for f in after if f"_bucket={bucket}/" in f}
    assert all(after[f] == t for f, t in before.items() if f"_bucket={bucket}/" not in f)
    assert (7, "a", "y", "Y") in held(store) and len(held(store)) == 400


def test_later_keys_are_appended(spark, tmp_path):
    store = BucketedStore(spark, str(tmp_path), buckets=2)
    want = []
    for load in range(10):
        rows = [(load * 50 + k, "a", f"v{load}") for k in range(50)]
        before = files(tmp_path)
        store.merge_rows(TABLE, staged(spark, rows), "replace")
        want += rows
        if load in (1, 5):  # nothing that was there is written anew
            assert all(files(tmp_path).get(f) == t for f, t in before.items())
    assert [r[:3] for r in held(store)] == want
    assert all(len(b["folders"]) <= 8 for b in store.state("t")["buckets"].values())


def test_keys_of_other_types_and_negative_ones(spark, tmp_path):
    store = BucketedStore(spark, str(tmp_path), buckets=1)
    frame = lambda ids: spark.createDataFrame([(k, "x", 0) for k in ids], "id long, v string, _rownum long")
    for ids in ([-5, -1], [3, 10], [-(1 << 63)], [-3, 7], [(1 << 63) - 1]):
        store.merge_rows(ONE, frame(ids), "replace")
    assert [r[0] for r in held(store, ONE)] == sorted([-5, -1, 3, 10, -(1 << 63), -3, 7, (1 << 63) - 1])
    model = TableModel("f", (ColumnModel("id", "float"), ColumnModel("v")), ("id",))
    for v in ("a", "b"):
        store.merge_rows(model, spark.createDataFrame([(1.5, v, 0), (None, v, 1)], "id double, v string, _rownum long"), "replace")
    assert (1.5, "b") in held(store, model)


def test_resolver(spark, tmp_path):
    with pytest.raises(ValueError, match="unknown store"):
        resolve_store(spark, "bogus", "x")
    register_store("Mine", VersionedStore)
    try:
        assert isinstance(resolve_store(spark, "mine", str(tmp_path)), VersionedStore)
    finally:
        STORES.pop("mine")


@pytest.mark.parametrize("kind", ["versioned", "bucketed", "catalog"])
def test_loads_and_views_on_every_store(spark, tmp_path, kind):
    store = resolve_store(spark, kind, f"views_{uuid.uuid4().hex}" if kind == "catalog" else str(tmp_path / "s"))
    path = tmp_path / "t.csv"
    path.write_text("id,v\n1,a\n2,b\n2,c\nx,d\n")
    result = load_file(spark, store, ONE, str(path), dedupe=True, merge_batch_size=1)
    assert result.rows == 3 and result.stats.examples == {"id": ["x"]}
    assert [r for r in held(store, ONE) if r[0]] == [(1, "a"), (2, "b")]
    views = ViewStore(spark, store)
    view = MaterializedView("counted", lambda s: store.read(ONE).groupBy("v").count())
    with pytest.raises(ValueError):
        views.refresh(view)
    views.create(view)
    load_file(spark, store, ONE, str(path.write_text("id,v\n5,a\n") and path), merge_strategy="upsert")
    views.refresh(view)
    assert {(r.v, r["count"]) for r in views.read(view).collect()} >= {("a", 2), ("b", 1)}
    for name in ("t", "counted"):
        store.drop(name)


def test_first_failures_of_all_columns_in_one_scan(spark, tmp_path):
    model = TableModel("m", (ColumnModel("a", "integer"), ColumnModel("b", "date"), ColumnModel("c", "integer")), ())
    frame = spark.createDataFrame([(f"x{k}", f"y{k}" if k % 2 else "2020-01-01", "1", k) for k in range(50, 0, -1)], "a string, b string, c string, _rownum long").repartition(7)
    path = str(tmp_path / "cast")
    quality.cast_rows(frame, model).write.parquet(path)
    found = quality.failure_examples(spark.read.parquet(path))
    assert sorted(tuple(r) for r in found.collect()) == [("a", 1, "x1"), ("a", 2, "x2"), ("a", 3, "x3"), ("b", 1, "y1"), ("b", 2, "y3"), ("b", 3, "y5")]
    assert found._jdf.queryExecution().sparkPlan().toString().count("FileScan") == 1
