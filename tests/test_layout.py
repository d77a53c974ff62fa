"""Index strategies: what a lookup reads, and when a version is laid out."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ingestloom.model import ColumnModel, TableModel
from ingestloom.plans import layout
from ingestloom.plans.buckets import BucketedStore
from ingestloom.plans.ingest import load_file
from ingestloom.plans.store import VersionedStore

COLUMNS = (ColumnModel("id", "integer"), ColumnModel("owner", "integer"), ColumnModel("tag"), ColumnModel("up", computed="upper(tag)"))
PLAIN = TableModel("t", COLUMNS, ("id",))
INDEXED = TableModel("t", COLUMNS, ("id",), indexes=(("owner",), ("tag",)))
SMALL = {"parquet.page.row.count.limit": "200", "parquet.block.size": "65536"}


def rows(spark, n=20_000):
    """Owners in no order, a third of all rows the same one; some null."""
    rng = random.Random(3)
    owner = lambda k: 7 if k % 3 == 0 else None if k % 1000 == 1 else rng.randrange(5000)
    return spark.createDataFrame([(k, owner(k), f"tag{rng.randrange(2000)}", 0) for k in range(n)], "id long, owner long, tag string, _rownum int")


def scanned(df):
    """Rows that the scan of a plan hands on."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().get("numOutputRows").get().value() for i in range(leaves.size()))


def test_a_lookup_reads_few_rows_of_a_laid_out_table(spark, tmp_path):
    data = rows(spark).repartition(4)
    plain, indexed = (VersionedStore(spark, str(tmp_path / name), options=SMALL) for name in ("plain", "indexed"))
    plain.write(PLAIN, data)
    indexed.write(INDEXED, data)
    for where in ("owner = 1234", "owner between 40 and 60", "owner is null", "owner = 7 and id = 300"):
        a, b = plain.read(PLAIN).where(where), indexed.read(INDEXED).where(where)
        assert sorted(a.collect(), key=str) == sorted(b.collect(), key=str) and b.count() > 0
        assert scanned(b) * 10 < scanned(a), where
    assert not plain.is_laid_out(INDEXED) and indexed.is_laid_out(INDEXED) and plain.is_laid_out(PLAIN)


def test_a_value_that_many_rows_share_is_in_several_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = layout.clustered(rows(spark), INDEXED).withColumn("part", F.spark_partition_id()).where("owner = 7").groupBy("part").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(parts) > 1 and sum(r["count"] for r in parts) > 20_000 // 3


@pytest.mark.parametrize("strategy", ["auto", "keep", "drop_rebuild"])
def test_strategies_give_the_same_rows_and_a_layout(spark, tmp_path, strategy):
    store = VersionedStore(spark, str(tmp_path))
    data = rows(spark, 300)
    with layout.manage_layout(store, INDEXED, strategy):
        store.write(INDEXED, data.where("id < 200"))
        assert store.is_laid_out(INDEXED) == (strategy != "drop_rebuild")
        store.merge_rows(INDEXED, data.where("id >= 100").withColumn("tag", F.lit("new")), "replace")
    assert store.is_laid_out(INDEXED) and not store.plain
    assert Counter(r.up for r in store.read(INDEXED).collect())["NEW"] == 200 and store.read(INDEXED).count() == 300


def test_a_failed_block_leaves_a_layout(spark, tmp_path):
    store = VersionedStore(spark, str(tmp_path))
    with pytest.raises(InterruptedError), layout.manage_layout(store, INDEXED, "drop_rebuild"):
        store.write(INDEXED, rows(spark, 50))
        raise InterruptedError
    assert store.is_laid_out(INDEXED) and store.read(INDEXED).count() == 50
    before = store.current("t")
    with pytest.raises(InterruptedError), layout.manage_layout(store, INDEXED, "drop_rebuild"):
        raise InterruptedError
    assert store.current("t") == before  # nothing was written, nothing is rebuilt


def test_odd_tables_and_stores(spark, tmp_path):
    store = VersionedStore(spark, str(tmp_path / "v"))
    with layout.manage_layout(store, INDEXED, "drop_rebuild"):
        pass
    assert not store.exists("t")
    store.write(INDEXED, rows(spark, 3).where("false"))
    assert store.is_laid_out(INDEXED) and store.is_empty(INDEXED)
    buckets = BucketedStore(spark, str(tmp_path / "b"))
    with layout.manage_layout(buckets, INDEXED, "drop_rebuild"):
        buckets.write(INDEXED, rows(spark, 30))
    assert buckets.read(INDEXED).count() == 30
    with pytest.raises(ValueError), layout.manage_layout(store, INDEXED, "bogus"):
        pass
    for wrong in ((("absent",),), ((),)):
        with pytest.raises(ValueError):
            TableModel("t", COLUMNS, ("id",), indexes=wrong)


def test_loads_take_the_strategy(spark, tmp_path):
    model = TableModel("t", COLUMNS[:3], ("id",), indexes=(("owner",), ("tag",)))
    (tmp_path / "t.csv").write_text("id,owner,tag\n" + "".join(f"{k},{k % 5},a{k}\n" for k in range(40)))
    store = VersionedStore(spark, str(tmp_path / "v"), keep_versions=9)
    for strategy, versions in (("keep", 1), ("drop_rebuild", 3)):
        assert load_file(spark, store, model, str(tmp_path / "t.csv"), index_strategy=strategy).rows == 40
        assert store.is_laid_out(model) and store.read(model).count() == 40 and int(store.current("t")[-8:]) == versions
