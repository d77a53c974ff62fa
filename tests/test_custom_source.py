"""Sources of one's own: pieces, row numbers, odd files, streams that go on, and a load through one."""

import pytest
from pyspark.sql import functions as F

from ingestloom.model import ColumnModel, TableModel
from ingestloom.plans.ingest import load_file
from ingestloom.plans.store import VersionedStore
from ingestloom.sources.custom import FixedWidthSource, SourceLoader
from ingestloom.sources.readers import ROWNUM

MODEL = TableModel("item", (ColumnModel("key", "integer", nullable=False), ColumnModel("name")), primary_key=("key",))


def write(folder, name, rows):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_bytes(b"".join(str(k).encode().ljust(6) + text.encode().ljust(9) + b"\n" for k, text in rows))


def loader(**more):
    return SourceLoader(FixedWidthSource, layout="KEY:0:6,name_hash:6:15", recordBytes=16, **more)


def test_rows_in_file_order_over_pieces(spark, tmp_path):
    rows = [(k, f"n{k}") for k in range(100)]
    for name, part in (("b", rows[7:60]), ("a", rows[:7]), ("c", rows[60:]), ("_aside", rows), (".hidden", rows)):
        write(tmp_path / "in", name, part)
    frame = loader(pieceBytes=160).frame(spark, str(tmp_path / "in"))
    assert frame.rdd.getNumPartitions() == 1 + 6 + 4
    assert [(int(r.KEY), r.name_hash) for r in frame.orderBy(ROWNUM).collect()] == rows
    assert [r[0] for r in frame.select(ROWNUM).orderBy(ROWNUM).collect()] == list(range(100))


def test_load_takes_the_first_of_a_key(spark, tmp_path):
    write(tmp_path / "item.dat", "b", [(1, "late"), (2, "größe"), (3, "")])
    write(tmp_path / "item.dat", "a", [(1, "first"), (4, " a ")])
    store = VersionedStore(spark, str(tmp_path / "tables"))
    result = load_file(spark, store, MODEL, str(tmp_path / "item.dat"), loader=loader(), dedupe=True)
    assert result.rows == 4
    assert sorted(map(tuple, store.read(MODEL).collect())) == [(1, "first"), (2, "größe"), (3, None), (4, "a")]


def test_odd_inputs(spark, tmp_path):
    (tmp_path / "none").mkdir()
    write(tmp_path / "empty", "a", [])
    for name in ("none", "empty"):
        assert loader().frame(spark, str(tmp_path / name)).count() == 0
    write(tmp_path / "short", "a", [(1, "x")])
    (tmp_path / "short" / "b").write_bytes(b"12345")
    (tmp_path / "bytes").mkdir()
    (tmp_path / "bytes" / "a").write_bytes(b"1     caf\xe9     \n")
    for path, message in (("short", "whole number of records"), ("bytes", "UTF8|UTF-8"), ("absent", "does not exist")):
        with pytest.raises(Exception, match=message):
            loader().frame(spark, str(tmp_path / path)).collect()
    with pytest.raises(Exception, match="within a record"):
        SourceLoader(FixedWidthSource, layout="a:0:20", recordBytes=16).frame(spark, str(tmp_path / "short")).collect()


def test_stream_goes_on_and_refuses_late_names(spark, tmp_path):
    def run():
        rows = loader().stream(spark, str(tmp_path / "in"))
        query = rows.writeStream.option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).format("parquet").option("path", str(tmp_path / "rows")).start()
        query.awaitTermination()

    write(tmp_path / "in", "b", [(1, "x"), (2, "y")])
    run()
    write(tmp_path / "in", "c", [(3, "z")])
    run()
    run()
    rows = spark.read.parquet(str(tmp_path / "rows"))
    assert [tuple(r) for r in rows.select(F.col("KEY").cast("int"), "name_hash", ROWNUM).orderBy(ROWNUM).collect()] == [(1, "x", 0), (2, "y", 1), (3, "z", 2)]
    write(tmp_path / "in", "a", [(9, "late")])
    write(tmp_path / "in", "d", [(4, "w")])
    with pytest.raises(Exception, match="arrived under a name before"):
        run()
