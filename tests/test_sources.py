import pytest

from ingestloom.errors import IngestError
from ingestloom.model import ColumnModel, TableModel
from ingestloom.plans.ingest import staging_rows
from ingestloom.sources import sniff
from ingestloom.sources.readers import CsvLoader, LoadOptions, ParquetLoader, check_file_name, normalise_header

TABLE = TableModel("test_table", (ColumnModel("id", "integer"), ColumnModel("name", nullable=False)), ("id",))


def test_header():
    assert normalise_header(['"id"', ' "Name"', "my_hash_col", "x_hash"]) == ["id", "name", "my_col", "x"]
    with pytest.raises(IngestError):
        normalise_header(["a", "A"])


def test_delimiter_and_encoding():
    assert sniff.infer_delimiter(b"a\tb\n1,2,3") == "\t"
    assert sniff.infer_delimiter(b"a,b\tc") == ","
    assert sniff.infer_encoding(b"\xef\xbb\xbfid") == "utf-8"
    assert sniff.infer_encoding("é".encode()) == "utf-8"
    assert sniff.infer_encoding(b"caf\xe9 x") == "iso-8859-1"
    assert sniff.infer_encoding(("a" * 9999 + "é").encode()) == "utf-8"


@pytest.mark.parametrize(
    ("text", "mode"),
    [
        ("a\tb\n1\tx\n", "csv"),
        ('a\tb\n1\t"a long quoted text"\n', "csv"),
        ('a\tb\n1\t"with\ttab"\n', "csv"),
        ('a\tb\n1\t"x\n2\t"y\n3\tz\n', "literal"),
        ("", "csv"),
        ("one\nx\n", "csv"),
    ],
)
def test_quote_mode(text, mode):
    assert sniff.infer_quote_mode(text.encode(), "\t") == mode


@pytest.mark.parametrize("rows", [9, 5_000, 20_000])
def test_quote_mode_of_many_rows(rows):
    """Rows of both readings are counted over the same lines, however many there are."""
    unclosed = "a,b,c\n" + "".join(f'{i},"x,z\n' if i % 5 == 0 else f"{i},x,z\n" for i in range(rows))
    assert sniff.infer_quote_mode(unclosed.encode(), ",") == "literal"
    line_ends = "a,b,c\n" + "".join(f'{i},"x\ny, ""z""",w\n' for i in range(rows))
    assert sniff.infer_quote_mode(line_ends.encode(), ",") == "csv"


def test_explicit_modes_do_not_read():
    def never():
        raise AssertionError

    assert sniff.resolve_quote_mode("csv", never, "\t") == "csv"
    assert sniff.resolve_quote_mode("literal", never, ",") == "literal"
    assert sniff.resolve_quote_mode("by_delimiter", never, "\t") == "literal"
    assert sniff.resolve_quote_mode("by_delimiter", never, ",") == "csv"
    with pytest.raises(ValueError):
        sniff.resolve_quote_mode("bogus", never, ",")


def test_line_endings():
    assert [sniff.line_ending(h) for h in (b"a\r\n", b"a\n", b"a\r", b"a")] == ["\r\n", "\n", "\r", "\n"]


def read(spark, path, loader=None, **options):
    rows = (loader or CsvLoader()).read(spark, LoadOptions(TABLE, str(path), **options)).orderBy("_rownum").collect()
    return [(r.id, r.name) for r in rows]


def test_embedded_breaks_and_tabs(spark, tmp_path):
    path = tmp_path / "test_table.tsv"
    path.write_text('id\tname\n1\t"hello\nworld"\n2\t"foo\tbar"\n3\t"say ""hi"""\n')
    assert read(spark, path) == [("1", "hello\nworld"), ("2", "foo\tbar"), ("3", 'say "hi"')]


def test_breaks_behind_the_head_and_in_later_files(spark, tmp_path):
    want = [(str(i), "x" * 1000) for i in range(4300)] + [("a", "hello\nworld")]
    path = tmp_path / "test_table.csv"
    path.write_text("id,name\n" + "".join(f"{i},{n}\n" for i, n in want[:-1]) + 'a,"hello\nworld"\n')
    assert sorted(read(spark, path)) == sorted(want)
    folder = tmp_path / "parts"
    folder.mkdir()
    (folder / "a.csv").write_text("id,name\n1,x\n")
    (folder / "b.csv").write_text('id,name\n2,"hello\nworld"\n')
    assert sorted(read(spark, folder)) == [("1", "x"), ("2", "hello\nworld")]


def test_literal_and_csv_quotes(spark, tmp_path):
    path = tmp_path / "test_table.csv"
    path.write_text('ID,Name,extra\n1,"hello",x\n')
    assert read(spark, path) == [("1", "hello")]
    assert read(spark, path, quote_mode="literal") == [("1", '"hello"')]


def test_malformed_rows_are_dropped(spark, tmp_path):
    path = tmp_path / "test_table.csv"
    path.write_text("id,name\n1,a\n2,b,c\n3\n4,d\n")
    assert read(spark, path, ParquetLoader()) == [("1", "a"), ("4", "d")]


def test_latin1_and_carriage_returns(spark, tmp_path):
    path = tmp_path / "test_table.csv"
    path.write_bytes(b"id,name\r\n1,caf\xe9\r\n")
    assert read(spark, path) == [("1", "café")]


def test_empty_file_and_names(spark, tmp_path):
    path = tmp_path / "test_table.csv"
    path.write_text("")
    assert read(spark, path) == []
    with pytest.raises(ValueError):
        check_file_name(TABLE, "wrong.csv")
    with pytest.raises(ValueError):
        ParquetLoader().read(spark, LoadOptions(TABLE, "test_table.json"))


def test_records_are_parsed_once(spark, tmp_path):
    """Neither filters on parsed columns nor rows without a key read or parse a file again."""
    path = tmp_path / "test_table.csv"
    path.write_text("id,name\n1,a\n1,b\n,c\n,d\n2,\n")
    rows = staging_rows(spark, LoadOptions(TABLE, str(path), dedupe=True))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_csv") == 1 and plan.count("Relation [") == 1
    assert sorted(r.name for r in rows.collect()) == ["a", "c", "d"]
