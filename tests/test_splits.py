"""Files cut at any byte: the same rows, in the same order, as a reader that reads all of it at once."""

import csv
import io
import random
from contextlib import contextmanager

import pytest

from ingestloom.errors import IngestError
from ingestloom.model import ColumnModel, TableModel
from ingestloom.operators.quality import first_per_key
from ingestloom.sources import splits
from ingestloom.sources.readers import CsvLoader, LoadOptions, ParquetLoader

TABLE = TableModel("t", (ColumnModel("a"), ColumnModel("b"), ColumnModel("c")), ())


@contextmanager
def small_splits(spark, size):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def rows_of(spark, path, **options):
    df = CsvLoader().read(spark, LoadOptions(TABLE, path if isinstance(path, list) else str(path), **options))
    rows = df.collect()
    numbers = [r["_rownum"] for r in rows]
    assert len(set(numbers)) == len(numbers)
    return [tuple("" if v is None else v for v in r[:3]) for _, r in sorted(zip(numbers, rows, strict=True))]


def made(seed, n, quotes=True):
    rng = random.Random(seed)
    words = ["x", "yy", "é", "", "1.5", 'a "b" c', "line\nend", "\n\n", 'q"', "c,d", "long text " * 6] if quotes else ["x", "yy", "é", "", "1.5", "long text " * 6]
    out = io.StringIO()
    csv.writer(out, lineterminator=rng.choice(["\n", "\r\n"])).writerows([["a", "b", "c"], *([rng.choice(words) or "-", rng.choice(words), rng.choice(words)] for _ in range(n))])
    return out.getvalue()


def plain(text):
    return [tuple(r) for r in csv.reader(io.StringIO(text, newline=""))][1:]


@pytest.mark.parametrize(("seed", "size"), [(1, 37), (2, 100), (3, 1000), (4, 1 << 20)])
def test_quoted_line_ends_at_any_cut(spark, tmp_path, seed, size):
    text = made(seed, 120)
    path = tmp_path / "t.csv"
    path.write_bytes(text.encode())
    with small_splits(spark, size):
        n = len(splits.survey(splits.lines(spark, str(path))))
        assert n <= 8 if size > len(text) * 2 else n > len(text.encode()) // size // 3
        assert rows_of(spark, path, quote_mode="csv") == plain(text)


def test_a_value_over_many_splits(spark, tmp_path):
    text = 'a,b,c\n1,"' + "line, of text\n" * 200 + 'end",2\n3,4,5\n6,"' + "more\n" * 100 + '",7\n'
    path = tmp_path / "t.csv"
    path.write_text(text)
    with small_splits(spark, 90):
        assert rows_of(spark, path, quote_mode="csv") == plain(text)


def test_quotes_inside_plain_values_open_nothing(spark, tmp_path):
    text = 'a,b,c\n1,5" pipe,x\n2,6" pipe,y\n' * 1 + "".join(f'{k},"v ""{k}""\nw",{k}" z\n' for k in range(40))
    path = tmp_path / "t.csv"
    path.write_text(text)
    with small_splits(spark, 50):
        assert rows_of(spark, path, quote_mode="csv") == plain(text)


def test_hypotheses():
    opens = splits._opens(",")
    after = lambda line, state: splits._after(line, state, opens)
    assert [after('a,"b', s) for s in (0, 1)] == [1, 0]
    assert [after("plain", s) for s in (0, 1)] == [0, 1]
    assert [after('end",x', s) for s in (0, 1)] == [0, 0]
    assert [after('a,"say ""', s) for s in (0, 1)] == [1, 0]
    assert after('"' * 200_001, 0) == 1 and after('"a",' * 100_000 + '"', 0) == 1


def test_plain_lines_at_any_cut(spark, tmp_path):
    text = made(9, 300, quotes=False)
    path = tmp_path / "t.csv"
    path.write_bytes((text + "\n\n").encode())
    with small_splits(spark, 64):
        assert rows_of(spark, path) == plain(text)


def test_rows_of_many_files_are_in_the_order_of_paths(spark, tmp_path):
    rng, want = random.Random(4), []
    for k in range(10):
        rows = [(f"{k}", f"{n}", "x" * rng.randint(0, 30)) for n in range(rng.choice([1, 1, 3, 400]))]
        (tmp_path / f"{k}.csv").write_text("a,b,c\n" + "".join(",".join(r) + "\n" for r in rows))
        want += rows
    assert rows_of(spark, tmp_path) == want
    assert rows_of(spark, [str(tmp_path / f"{k}.csv") for k in (3, 1, 2)]) == [r for r in want if r[0] in "123"]
    with small_splits(spark, 200):
        assert rows_of(spark, tmp_path) == want
        read = CsvLoader().read(spark, LoadOptions(TABLE, str(tmp_path)))
        assert [r.a for r in first_per_key(read, ["c"]).where("b = '0' and a = '0'").collect()] == ["0"]
        first = {}
        for r in want:
            first.setdefault(r[2], r)
        got = {r.c or "": (r.a, r.b, r.c or "") for r in first_per_key(read.na.fill(""), ["c"]).collect()}
        assert got == first


def test_first_row_of_a_key_over_uneven_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b,c\n1,from_a,x\n")
    (tmp_path / "b.csv").write_text("a,b,c\n" + "".join(f"{k},from_b,x\n" for k in range(2000)))
    read = CsvLoader().read(spark, LoadOptions(TABLE, str(tmp_path)))
    assert first_per_key(read, ["a"]).where("a = '1'").first().b == "from_a"


def test_parquet_files_are_in_order(spark, tmp_path):
    for k, n in ((0, 1), (1, 3000), (2, 5)):
        spark.range(n).selectExpr(f"'{k}' as a", "cast(id as string) as b", "'x' as c").coalesce(1).write.parquet(str(tmp_path / f"t.parquet/p{k}"))
    model = TableModel("t", TABLE.columns, ())
    from pathlib import Path

    folder = tmp_path / "flat.parquet"
    folder.mkdir()
    for k in range(3):
        next(Path(tmp_path / f"t.parquet/p{k}").glob("*.parquet")).rename(folder / f"{k}.parquet")
    rows = ParquetLoader().read(spark, LoadOptions(model, str(folder))).orderBy("_rownum").collect()
    assert [(r.a, int(r.b)) for r in rows] == [("0", 0), *[("1", k) for k in range(3000)], *[("2", k) for k in range(5)]]


def test_encoding_is_decided_by_all_bytes(spark, tmp_path):
    path = tmp_path / "t.csv"
    body = "".join(f"{k},plain,x\n" for k in range(3000))
    for late, want in ((b"z,caf\xe9,x\n", "café"), ("z,café,x\n".encode(), "café"), (b"z,5 \x80,x\n", "5 €")):
        path.write_bytes(b"a,b,c\n" + body.encode() + late)
        with small_splits(spark, 5000):
            assert rows_of(spark, path)[-1][1] == want
    path.write_bytes(b"a,b,c\n1," + "é".encode() + b",x\n" + body.encode() + b"z,caf\xe9,x\n")
    with pytest.raises(IngestError):
        rows_of(spark, path)
    assert rows_of(spark, path, encoding="iso-8859-1")[-1][1] == "café"
    path.write_bytes(b"a,b,c\n" + body.encode() + b"z,caf\xe9,x\n")
    with pytest.raises(IngestError):
        rows_of(spark, path, encoding="utf-8")


@pytest.mark.parametrize("encoding", ["utf-16", "utf-16-le", "utf-16-be"])
def test_wide_encodings_with_and_without_a_mark(spark, tmp_path, encoding):
    path = tmp_path / "t.csv"
    path.write_bytes('a,b,c\n1,"é\nx",y\n2,z,w\n'.encode(encoding))
    assert rows_of(spark, path) == [("1", "é\nx", "y"), ("2", "z", "w")]
