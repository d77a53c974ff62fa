"""Driver queries, one or more for each operator, and the SQL that gives the same rows."""

from __future__ import annotations

import enum
from dataclasses import replace
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ingestloom.functions import casting
from ingestloom.functions.nulls import null_if_sentinel
from ingestloom.functions.serial import row_fingerprint, row_json
from ingestloom.model import ColumnModel, TableModel
from ingestloom.operators import ids, merge, quality, references
from ingestloom.plans.buckets import BucketedStore
from ingestloom.plans.catalog import resolve_store
from ingestloom.plans.ingest import load_file, staging_rows
from ingestloom.plans.layout import manage_layout
from ingestloom.plans.settings import scratch_folder
from ingestloom.plans.store import VersionedStore
from ingestloom.plans.views import MaterializedView, ViewStore
from ingestloom.registry import observed, validators
from ingestloom.registry.specs import FieldSpec, ModelCatalog
from ingestloom.sources.custom import FixedWidthSource, SourceLoader
from ingestloom.sources.readers import ROWNUM, LoadOptions, ParquetLoader
from ingestloom.streaming.landing import watch

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLE_SQL[function.__name__] = sql
        return function

    return keep


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


CUSTOMER = TableModel(
    "customer",
    (ColumnModel("c_custkey", "integer"), ColumnModel("c_name", "string", nullable=False), ColumnModel("c_nationkey", "integer"), ColumnModel("c_mktsegment", "string", length=8)),
    primary_key=("c_custkey",),
)
PART = TableModel("part", (ColumnModel("p_partkey", "integer"), ColumnModel("p_name"), ColumnModel("p_brand"), ColumnModel("p_size", "integer")), primary_key=("p_partkey",))


# --- sources -----------------------------------------------------------------


@query("select c_custkey, c_name, cast(c_nationkey as bigint) as c_nationkey, left(c_mktsegment, 8) as c_mktsegment from customer")
def load_csv_customer(spark, sf_dir):
    """Written as CSV with an upper-case header, sniffed, cast and staged."""
    folder = f"{scratch_folder(spark)}/customer.csv"
    rows = _t(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    rows.toDF(*[c.upper() for c in rows.columns]).write.option("header", True).csv(folder)
    return staging_rows(spark, LoadOptions(CUSTOMER, folder))


@query("""select c_custkey, '"' || c_name as c_name, left(c_mktsegment, 8) as c_mktsegment from customer""")
def load_tsv_literal_quotes(spark, sf_dir):
    """Tab-separated text whose quotes are plain text."""
    folder = f"{scratch_folder(spark)}/customer.tsv"
    line = F.concat_ws("\t", F.col("c_custkey").cast("string"), F.concat(F.lit('"'), F.col("c_name")), F.col("c_mktsegment"))
    rows = _t(spark, sf_dir, "customer").select(line.alias("value"))
    _write_lines(rows, "c_custkey\tc_name\tc_mktsegment", folder)
    model = TableModel("customer", tuple(c for c in CUSTOMER.columns if c.name != "c_nationkey"), ("c_custkey",))
    return staging_rows(spark, LoadOptions(model, folder, quote_mode="literal"))


def _write_lines(rows: DataFrame, header: str, folder: str) -> None:
    """One line a row, each file under the header."""
    number = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # within the partition, so within the file
    lines = F.when(F.col("number") == 0, F.array(F.lit(header), F.col("value"))).otherwise(F.array("value"))
    rows.select("value", number.alias("number")).select(F.explode(lines).alias("value")).write.text(folder)


@query(
    """select c_custkey, case when c_custkey = (select max(c_custkey) from customer) then c_name || ' "x"' || chr(10) || 'end' else c_name end as c_name,
 left(c_mktsegment, 8) as c_mktsegment from customer"""
)
def load_csv_late_quote(spark, sf_dir):
    """The only quotes, and a line end inside them, are in the last row of the file."""
    folder = f"{scratch_folder(spark)}/customer.csv"
    customers = _t(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    last = customers.agg(F.max("c_custkey").alias("last"))
    name = F.when(F.col("c_custkey") == F.col("last"), F.concat("c_name", F.lit(' "x"\nend'))).otherwise(F.col("c_name"))
    rows = customers.join(F.broadcast(last)).select("c_custkey", name.alias("c_name"), "c_mktsegment")  # one row is joined
    rows.write.option("header", True).option("escape", '"').csv(folder)
    model = TableModel("customer", tuple(c for c in CUSTOMER.columns if c.name != "c_nationkey"), ("c_custkey",))
    return staging_rows(spark, LoadOptions(model, folder, quote_mode="csv"))


@query("select c_custkey, c_name, left(c_mktsegment, 8) as c_mktsegment from customer where c_custkey % 7 <> 0 and c_custkey % 11 <> 0")
def load_csv_malformed(spark, sf_dir):
    """Rows of too many and of too few fields are left out and counted."""
    folder = f"{scratch_folder(spark)}/customer.csv"
    key = F.col("c_custkey").cast("string")
    whole = F.concat_ws(",", key, "c_name", "c_mktsegment")
    line = F.when(F.col("c_custkey") % 7 == 0, F.concat(whole, F.lit(",more"))).when(F.col("c_custkey") % 11 == 0, F.concat_ws(",", key, "c_name")).otherwise(whole)
    _write_lines(_t(spark, sf_dir, "customer").select(line.alias("value")), "c_custkey,c_name,c_mktsegment", folder)
    model = TableModel("customer", tuple(c for c in CUSTOMER.columns if c.name != "c_nationkey"), ("c_custkey",))
    return quality.cast_rows(ParquetLoader().read(spark, LoadOptions(model, folder)), model, track=False).drop(ROWNUM)


@query("""select c_custkey, case when c_custkey % 5 = 0 then '"' || c_name else c_name end as c_name, left(c_mktsegment, 8) as c_mktsegment from customer""")
def load_csv_auto_quotes(spark, sf_dir):
    """Quotes that open and never close, found to be plain text by sniffing."""
    folder = f"{scratch_folder(spark)}/customer.csv"
    name = F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit('"'), "c_name")).otherwise(F.col("c_name"))
    line = F.concat_ws(",", F.col("c_custkey").cast("string"), name, "c_mktsegment")
    _write_lines(_t(spark, sf_dir, "customer").select(line.alias("value")), "c_custkey,c_name,c_mktsegment", folder)
    model = TableModel("customer", tuple(c for c in CUSTOMER.columns if c.name != "c_nationkey"), ("c_custkey",))
    return staging_rows(spark, LoadOptions(model, folder, quote_mode="auto"))


@query("select c_custkey, c_name, left(c_mktsegment, 8) as c_mktsegment from customer")
def load_csv_quoted_header(spark, sf_dir):
    """A quoted header name that holds the delimiter shifts no column."""
    folder = f"{scratch_folder(spark)}/customer.csv"
    line = F.concat_ws(",", F.lit("aside"), F.col("c_custkey").cast("string"), "c_name", "c_mktsegment")
    _write_lines(_t(spark, sf_dir, "customer").select(line.alias("value")), '"not, wanted",C_CUSTKEY,"c_name",c_mktsegment_hash', folder)
    model = TableModel("customer", tuple(c for c in CUSTOMER.columns if c.name != "c_nationkey"), ("c_custkey",))
    return staging_rows(spark, LoadOptions(model, folder, quote_mode="csv"))


@query("select c_custkey, c_name, cast(c_nationkey as bigint) as c_nationkey, left(c_mktsegment, 8) as c_mktsegment from customer")
def load_csv_fast(spark, sf_dir):
    """The fast path: no null words, no rules, no de-duplication."""
    root = scratch_folder(spark)
    _t(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment").write.option("header", True).csv(f"{root}/in/customer.csv")
    store = VersionedStore(spark, f"{root}/tables")
    load_file(spark, store, CUSTOMER, f"{root}/in/customer.csv", fast=True)
    return store.read(CUSTOMER).select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")


@query("select c_custkey, c_name, cast(c_nationkey as bigint) as c_nationkey, left(c_mktsegment, 8) as c_mktsegment from customer")
def stream_landing_reordered(spark, sf_dir):
    """Files of a landing folder in two orders of columns, one with a null key; merged by a stream."""
    root = scratch_folder(spark)
    rows = _t(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    rows.where("c_custkey % 2 = 0").write.option("header", True).csv(f"{root}/in/a")
    odd = rows.where("c_custkey % 2 = 1").select("c_mktsegment", "c_nationkey", F.upper("c_name").alias("unused"), "c_custkey", F.col("c_name").alias("C_NAME_hash"))
    odd.unionByName(odd.limit(1).withColumn("c_custkey", F.lit(None))).write.option("header", True).csv(f"{root}/in/b")
    store = VersionedStore(spark, f"{root}/tables")
    watch(spark, store, CUSTOMER, f"{root}/in/*/*.csv", f"{root}/checkpoint").awaitTermination()
    return store.read(CUSTOMER).select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")


@query("select c_custkey, c_name || chr(10) || '\"' || c_mktsegment || '\", ' || c_nationkey as c_name, left(c_mktsegment, 8) as c_mktsegment from customer")
def load_csv_quoted_line_ends(spark, sf_dir):
    """Every row has a line end, quotes and a comma inside quotes; the files are split all the same."""
    folder = f"{scratch_folder(spark)}/customer.csv"
    name = F.concat("c_name", F.lit('\n"'), "c_mktsegment", F.lit('", '), F.col("c_nationkey").cast("string"))
    _t(spark, sf_dir, "customer").select("c_custkey", name.alias("c_name"), "c_mktsegment").write.option("header", True).option("escape", '"').csv(folder)
    model = TableModel("customer", tuple(c for c in CUSTOMER.columns if c.name != "c_nationkey"), ("c_custkey",))
    return staging_rows(spark, LoadOptions(model, folder, quote_mode="csv"))


@query("""select o_custkey as c_custkey, (array_agg(cast(o_orderkey as varchar) order by o_orderdate, o_orderkey))[1] as c_name, 'x' as c_mktsegment from orders group by o_custkey""")
def load_csv_many_files(spark, sf_dir):
    """The first row of a key in file order, over files of uneven sizes whose order is that of their names."""
    folder = f"{scratch_folder(spark)}/customer.csv"
    rows = _t(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey").repartitionByRange(10, F.year("o_orderdate"), "o_orderdate", "o_orderkey").sortWithinPartitions("o_orderdate", "o_orderkey")
    rows.select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("c_name"), F.lit("x").alias("c_mktsegment")).write.option("header", True).csv(folder)
    model = TableModel("customer", tuple(c for c in CUSTOMER.columns if c.name != "c_nationkey"), ("c_custkey",))
    return staging_rows(spark, LoadOptions(model, folder, dedupe=True))


@query("select c_custkey, case when c_custkey = (select max(c_custkey) from customer) then 'Café' else c_name end as c_name, left(c_mktsegment, 8) as c_mktsegment from customer")
def load_csv_late_latin1(spark, sf_dir):
    """One byte of the last row says that the files are no UTF-8."""
    folder = f"{scratch_folder(spark)}/customer.csv"
    customers = _t(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    last = customers.agg(F.max("c_custkey").alias("last"))
    name = F.when(F.col("c_custkey") == F.col("last"), F.lit("Café")).otherwise(F.col("c_name"))
    customers.join(F.broadcast(last)).select("c_custkey", name.alias("c_name"), "c_mktsegment").write.option("header", True).option("encoding", "ISO-8859-1").csv(folder)  # one row is joined
    model = TableModel("customer", tuple(c for c in CUSTOMER.columns if c.name != "c_nationkey"), ("c_custkey",))
    return staging_rows(spark, LoadOptions(model, folder))


_CUSTOMER_WIDTHS = (("c_custkey", 12), ("c_name", 28), ("c_nationkey", 6), ("c_mktsegment", 14))


def _fixed_width(spark, sf_dir, folder: str, *names: str) -> SourceLoader:
    """Customers as records of one length, dealt over folders by key; the loader that reads them."""
    line = F.concat(*[F.rpad(F.coalesce(F.col(c).cast("string"), F.lit("")), width, " ") for c, width in _CUSTOMER_WIDTHS])
    rows = _t(spark, sf_dir, "customer")
    for k, name in enumerate(names):
        rows.where(F.col("c_custkey") % len(names) == k).select(line).write.text(f"{folder}/{name}")
    ends = list(accumulate(width for _, width in _CUSTOMER_WIDTHS))
    layout = ",".join(f"{c}:{end - width}:{end}" for (c, width), end in zip(_CUSTOMER_WIDTHS, ends, strict=True))
    return SourceLoader(FixedWidthSource, layout=layout, recordBytes=ends[-1] + 1, pieceBytes=1 << 22)


@query("select c_custkey, c_name, cast(c_nationkey as bigint) as c_nationkey, left(c_mktsegment, 8) as c_mktsegment from customer")
def load_custom_source(spark, sf_dir):
    """A loader of one's own, planned by Spark as a data source, in a load."""
    root = scratch_folder(spark)
    loader = _fixed_width(spark, sf_dir, f"{root}/in/customer.dat", "a", "b")
    store = VersionedStore(spark, f"{root}/tables")
    load_file(spark, store, CUSTOMER, f"{root}/in/customer.dat", loader=loader, dedupe=True)
    return store.read(CUSTOMER).select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")


@query("select c_custkey, c_name, cast(c_nationkey as bigint) as c_nationkey, left(c_mktsegment, 8) as c_mktsegment from customer")
def stream_custom_source(spark, sf_dir):
    """The same source as a stream: files of two arrivals, appended as they come; a checkpoint holds how far it is."""
    root = scratch_folder(spark)
    loader = _fixed_width(spark, sf_dir, f"{root}/halves", "a", "b")
    for arrived in ("a", "b"):
        spark.read.text(f"{root}/halves/{arrived}").write.text(f"{root}/in/{arrived}")
        rows = loader.stream(spark, f"{root}/in")
        writer = rows.writeStream.option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True)
        writer.format("parquet").option("path", f"{root}/rows").start().awaitTermination()
    return quality.cast_rows(spark.read.parquet(f"{root}/rows"), CUSTOMER, track=False).drop(ROWNUM)


@query("select p_partkey, p_name, p_brand, cast(p_size as bigint) as p_size from part")
def load_parquet_part(spark, sf_dir):
    return staging_rows(spark, LoadOptions(PART, f"{sf_dir}/part.parquet"))


@query("select c_custkey, c_name, cast(c_nationkey as bigint) as c_nationkey, left(c_mktsegment, 8) as c_mktsegment from customer")
def load_end_to_end(spark, sf_dir):
    """The whole load: stage, merge, switch versions; then the table is read."""
    root = scratch_folder(spark)
    _t(spark, sf_dir, "customer").write.option("header", True).csv(f"{root}/in/customer.csv")
    store = VersionedStore(spark, f"{root}/tables")
    load_file(spark, store, CUSTOMER, f"{root}/in/customer.csv", dedupe=True)
    load_file(spark, store, CUSTOMER, f"{root}/in/customer.csv", merge_strategy="upsert")
    return store.read(CUSTOMER).select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")


# --- casts -------------------------------------------------------------------

_MESSY = """case o_orderkey % 9 when 0 then ' NULL ' when 1 then cast(o_orderkey as string) || '.0' when 2 then 'abc'
 when 3 then '  ' || cast(o_orderkey as string) || '  ' when 4 then '+00' || cast(o_orderkey as string) when 5 then '1.80'
 when 6 then 'n/a' when 7 then '-' || cast(o_orderkey as string) || '.500' else cast(o_orderkey as string) end"""
_MESSY_SQL = _MESSY.replace("as string", "as varchar")
_WITH_MESSY = f"with m as (select o_orderkey, {_MESSY_SQL} as s from orders) "


def _messy(spark, sf_dir):
    return _t(spark, sf_dir, "orders").select("o_orderkey", F.expr(_MESSY).alias("s"))


@query(_WITH_MESSY + "select o_orderkey, case when lower(trim(s)) in ('','null','none','na','n/a','nan') then null else s end as v from m")
def null_sentinels(spark, sf_dir):
    return _messy(spark, sf_dir).select("o_orderkey", null_if_sentinel(F.col("s")).alias("v"))


def _cast(spark, sf_dir, kind, length=None):
    value, failed = casting.cast_column(F.col("s"), ColumnModel("s", kind, length=length))
    return _messy(spark, sf_dir).select("o_orderkey", value.alias("v"), failed.alias("failed"))


_NOT_NULL = "(lower(trim(s)) not in ('','null','none','na','n/a','nan'))"


@query(
    _WITH_MESSY
    + f""", c as (select o_orderkey, s, case when {_NOT_NULL} and regexp_matches(trim(s), '^[+-]?\\d+(\\.0+)?$')
 then try_cast(regexp_extract(trim(s), '^\\+?(-?\\d+)', 1) as bigint) end as v from m)
 select o_orderkey, v, ({_NOT_NULL} and v is null) as failed from c"""
)
def cast_int(spark, sf_dir):
    return _cast(spark, sf_dir, "integer")


@query(_WITH_MESSY + f", c as (select *, case when {_NOT_NULL} then try_cast(trim(s) as double) end as v from m) select o_orderkey, v, ({_NOT_NULL} and v is null) as failed from c")
def cast_float(spark, sf_dir):
    return _cast(spark, sf_dir, "float")


_FLAGS = "case event_id % 8 when 0 then 'yes' when 1 then ' F ' when 2 then 'TRUE' when 3 then '0' when 4 then 'on' when 5 then '1.0' when 6 then null else 'n' end"


@query(
    f"""with m as (select event_id, {_FLAGS} as s from events)
 select event_id, case when lower(trim(s)) in ('true','t','yes','y','1') then true when lower(trim(s)) in ('false','f','no','n','0') then false end as v from m"""
)
def cast_bool(spark, sf_dir):
    value, _ = casting.cast_column(F.col("s"), ColumnModel("s", "boolean"))
    return _t(spark, sf_dir, "events").select("event_id", F.expr(_FLAGS).alias("s")).select("event_id", value.alias("v"))


_DATES = """case o_orderkey % 6 when 0 then date_format(o_orderdate, 'yyyyMMdd') when 1 then upper(date_format(o_orderdate, 'dd-MMM-yyyy'))
 when 2 then date_format(o_orderdate, 'yyyy-MM-dd') when 3 then date_format(o_orderdate, 'dd/MM/yyyy') when 4 then '2017-99-99' else 'Aug 24 2017' end"""
_DATES_SQL = """case o_orderkey % 6 when 0 then strftime(o_orderdate, '%Y%m%d') when 1 then upper(strftime(o_orderdate, '%d-%b-%Y'))
 when 2 then strftime(o_orderdate, '%Y-%m-%d') when 3 then strftime(o_orderdate, '%d/%m/%Y') when 4 then '2017-99-99' else 'Aug 24 2017' end"""


@query(f"with m as (select o_orderkey, {_DATES_SQL} as s from orders) select o_orderkey, cast(try_strptime(s, ['%Y%m%d','%d-%b-%Y','%Y-%m-%d','%d/%m/%Y']) as date) as v from m")
def cast_date_formats(spark, sf_dir):
    value, _ = casting.cast_column(F.col("s"), ColumnModel("s", "date"))
    return _t(spark, sf_dir, "orders").select("o_orderkey", F.expr(_DATES).alias("s")).select("o_orderkey", value.alias("v"))


_TIMES = """case event_id % 5 when 0 then date_format(ts, "yyyy-MM-dd'T'HH:mm:ss") when 1 then date_format(ts, 'yyyy-MM-dd HH:mm') when 2 then date_format(ts, 'yyyyMMdd')
 when 3 then date_format(ts, 'yyyy-MM-dd') || ' something' else date_format(ts, "yyyyMMdd'T'HHmmss") end"""
_TIMES_SQL = """case event_id % 5 when 0 then strftime(ts, '%Y-%m-%dT%H:%M:%S') when 1 then strftime(ts, '%Y-%m-%d %H:%M') when 2 then strftime(ts, '%Y%m%d')
 when 3 then strftime(ts, '%Y-%m-%d') || ' something' else strftime(ts, '%Y%m%dT%H%M%S') end"""


@query(f"with m as (select event_id, {_TIMES_SQL} as s from events) select event_id, try_strptime(s, ['%Y-%m-%dT%H:%M:%S','%Y-%m-%d %H:%M','%Y%m%d','%Y%m%dT%H%M%S']) as v from m")
def cast_datetime(spark, sf_dir):
    value, _ = casting.cast_column(F.col("s"), ColumnModel("s", "datetime"))
    return _t(spark, sf_dir, "events").select("event_id", F.expr(_TIMES).alias("s")).select("event_id", value.alias("v"))


@query(
    _WITH_MESSY
    + f""", t as (select o_orderkey, case when {_NOT_NULL} then trim(s) end as s from m), n as (select o_orderkey, s,
 regexp_replace(regexp_replace(s, '^\\+', ''), '^(-?)0+(\\d)', '\\1\\2') as p from t), f as (select *, case when contains(p, '.') then regexp_replace(regexp_replace(p, '0+$', ''), '\\.$', '') else p end as q from n)
 select o_orderkey, left(case when regexp_matches(s, '^[+-]?\\d+(\\.\\d+)?$') then q else s end, 5) as v from f"""
)
def cast_string_canonical(spark, sf_dir):
    return _cast(spark, sf_dir, "string", 5).select("o_orderkey", "v")


class Priority(enum.Enum):
    URGENT = "1-URGENT"
    HIGH = "2-HIGH"
    MEDIUM = "3-MEDIUM"


@query(
    """select o_orderkey, case o_orderpriority when '1-URGENT' then 'URGENT' when '2-HIGH' then 'HIGH' when '3-MEDIUM' then 'MEDIUM' end as v,
 (o_orderpriority is not null and o_orderpriority not in ('1-URGENT','2-HIGH','3-MEDIUM')) as failed from orders"""
)
def enum_rule(spark, sf_dir):
    rules = casting.ColumnRules()
    rules.register("orders", "o_orderpriority", enum_type=Priority)
    value, failed = casting.cast_column(F.concat(F.lit(" "), "o_orderpriority"), ColumnModel("o_orderpriority"), rules=rules, table="orders")
    return _t(spark, sf_dir, "orders").select("o_orderkey", value.alias("v"), failed.alias("failed"))


@query("select event_id, upper(event_type) as v from events")
def scalar_rule(spark, sf_dir):
    rules = casting.ColumnRules()
    rules.register("events", "event_type", scalar=str.upper)
    value, _ = casting.cast_column(F.col("event_type"), ColumnModel("event_type"), rules=rules, table="events")
    return _t(spark, sf_dir, "events").select("event_id", value.alias("v"))


MESSY_ORDERS = TableModel("messy", (ColumnModel("o_orderkey", "integer"), ColumnModel("s", "integer", nullable=False)), ("o_orderkey",))


@query(
    _WITH_MESSY
    + f"""select 's' as column_name, count(*) filter (where {_NOT_NULL} and (not regexp_matches(trim(s), '^[+-]?\\d+(\\.0+)?$'))) as n_failed from m
 union all select 'o_orderkey', cast(0 as bigint)"""
)
def cast_failure_stats(spark, sf_dir):
    return quality.failure_table(quality.cast_rows(_messy(spark, sf_dir), MESSY_ORDERS))


# --- row quality -------------------------------------------------------------


@query(_WITH_MESSY + f"select o_orderkey, try_cast(regexp_extract(trim(s), '^\\+?(-?\\d+)', 1) as bigint) as s from m where {_NOT_NULL} and regexp_matches(trim(s), '^[+-]?\\d+(\\.0+)?$')")
def required_null_filter(spark, sf_dir):
    return quality.drop_incomplete(quality.cast_rows(_messy(spark, sf_dir), MESSY_ORDERS, track=False), MESSY_ORDERS.required_columns())


@query(_WITH_MESSY + f"select 's' as column_name, count(*) filter (where not ({_NOT_NULL} and regexp_matches(trim(s), '^[+-]?\\d+(\\.0+)?$'))) as n_null from m")
def required_null_counts(spark, sf_dir):
    return quality.null_counts(quality.cast_rows(_messy(spark, sf_dir), MESSY_ORDERS, track=False), ["s"])


_LINE_KEY = ("l_orderkey", "l_linenumber")
_LINE_ORDER = ("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")


@query(f"select * from lineitem qualify row_number() over (partition by {', '.join(_LINE_KEY)} order by {', '.join(_LINE_ORDER)}) = 1")
def dedupe_first_by_pk(spark, sf_dir):
    return quality.first_per_key(_t(spark, sf_dir, "lineitem"), _LINE_KEY, _LINE_ORDER)


_NULL_KEYS = "select case when l_orderkey % 10 = 0 then null else l_orderkey end as k, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice from lineitem"
_NULL_ORDER = ("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")


@query(f"with m as ({_NULL_KEYS}) select * from m where k is null union all select * from (select * from m where k is not null qualify row_number() over (partition by k, l_linenumber order by {', '.join(_NULL_ORDER)}) = 1)")
def dedupe_nulls_kept(spark, sf_dir):
    k = F.when(F.col("l_orderkey") % 10 != 0, F.col("l_orderkey")).alias("k")
    rows = _t(spark, sf_dir, "lineitem").select(k, "l_linenumber", *_NULL_ORDER)
    return quality.first_per_key(rows, ["k", "l_linenumber"], _NULL_ORDER)


@query(f"with m as ({_NULL_KEYS}) select * from m qualify row_number() over (partition by k, l_linenumber order by {', '.join(_NULL_ORDER)}) = 1")
def dedupe_nulls_equal(spark, sf_dir):
    k = F.when(F.col("l_orderkey") % 10 != 0, F.col("l_orderkey")).alias("k")
    rows = _t(spark, sf_dir, "lineitem").select(k, "l_linenumber", *_NULL_ORDER)
    return quality.first_per_key(rows, ["k", "l_linenumber"], _NULL_ORDER, keep_null_keys=False)


@query("select o_orderkey, o_custkey, o_totalprice from orders order by o_custkey, o_orderkey")
def sort_by_pk(spark, sf_dir):
    return quality.sorted_by_key(_t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), ["o_custkey", "o_orderkey"])


# --- merges ------------------------------------------------------------------

_ORDER_COLUMNS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
_TARGET = "select o_orderkey, o_custkey, o_orderstatus, o_totalprice from orders where o_orderkey % 3 <> 0"
_STAGED = "select o_orderkey, o_custkey, 'X' as o_orderstatus, o_totalprice + 1 as o_totalprice from orders where o_orderkey % 2 = 0"


def _sides(spark, sf_dir):
    orders = _t(spark, sf_dir, "orders").select(*_ORDER_COLUMNS)
    staged = orders.where("o_orderkey % 2 = 0").withColumn("o_orderstatus", F.lit("X")).withColumn("o_totalprice", F.col("o_totalprice") + 1)
    return orders.where("o_orderkey % 3 <> 0"), staged


@query(f"with t as ({_TARGET}), s as ({_STAGED}) select * from t where not exists (select 1 from s where s.o_orderkey = t.o_orderkey) union all select * from s")
def merge_replace(spark, sf_dir):
    return merge.replace(*_sides(spark, sf_dir), ["o_orderkey"])


@query(f"with t as ({_TARGET}), s as ({_STAGED}) select * from t union all select * from s where not exists (select 1 from t where s.o_orderkey = t.o_orderkey)")
def merge_upsert(spark, sf_dir):
    return merge.upsert(*_sides(spark, sf_dir), ["o_orderkey"], ["o_custkey"])


_LINE = "select l_orderkey, l_linenumber, l_partkey, l_quantity from lineitem"


@query(
    f"""with t as ({_LINE} where l_orderkey % 3 <> 0), s as (select l_orderkey, l_linenumber, l_partkey, l_quantity + 1 as l_quantity from lineitem where l_orderkey % 2 = 0)
 select * from t where not exists (select 1 from s where s.l_orderkey = t.l_orderkey and s.l_linenumber = t.l_linenumber) union all select * from s"""
)
def merge_replace_composite(spark, sf_dir):
    line = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return merge.replace(line.where("l_orderkey % 3 <> 0"), line.where("l_orderkey % 2 = 0").withColumn("l_quantity", F.col("l_quantity") + 1), ["l_orderkey", "l_linenumber"])


@query(
    f"""with t as ({_LINE} where l_orderkey % 3 <> 0), s as (select *, row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, l_quantity) as nth from ({_LINE} where l_orderkey % 2 = 0))
 select * from t union all select l_orderkey, l_linenumber, l_partkey, l_quantity from s where nth = 1 and not exists (select 1 from t where s.l_orderkey = t.l_orderkey and s.l_linenumber = t.l_linenumber)"""
)
def merge_upsert_composite(spark, sf_dir):
    line = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return merge.upsert(line.where("l_orderkey % 3 <> 0"), line.where("l_orderkey % 2 = 0"), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_quantity"])


@query(_STAGED)
def merge_insert_if_empty(spark, sf_dir):
    target, staged = _sides(spark, sf_dir)
    return merge.plan(target.where("false"), staged, ["o_orderkey"], "insert_if_empty", True)


@query(_STAGED)
def merge_empty_reroute(spark, sf_dir):
    target, staged = _sides(spark, sf_dir)
    return merge.plan(target.where("false"), staged, ["o_orderkey"], "replace", True)


ORDER = TableModel("orders", (ColumnModel("o_orderkey", "integer"), ColumnModel("o_custkey", "integer"), ColumnModel("o_orderstatus"), ColumnModel("o_totalprice", "float")), ("o_orderkey",))
_BIGINTS = "select cast(o_orderkey as bigint) as o_orderkey, cast(o_custkey as bigint) as o_custkey, o_orderstatus, cast(o_totalprice as double) as o_totalprice from "


def _merged_in_steps(spark, sf_dir, kind, strategy):
    store = resolve_store(spark, kind, scratch_folder(spark))
    target, staged = _sides(spark, sf_dir)
    store.write(ORDER, target)
    store.merge_rows(ORDER, staged.withColumn(ROWNUM, F.lit(0)), strategy, batch_rows=max(1, staged.count() // 5))
    return store.read(ORDER)


@query(_BIGINTS + f"(with t as ({_TARGET}), s as ({_STAGED}) select * from t where not exists (select 1 from s where s.o_orderkey = t.o_orderkey) union all select * from s)")
def merge_batched(spark, sf_dir):
    """A replace in steps of ranges of buckets, each committed for itself."""
    return _merged_in_steps(spark, sf_dir, "bucketed", "replace")


@query(_BIGINTS + f"(with t as ({_TARGET}), s as ({_STAGED}) select * from t union all select * from s where not exists (select 1 from t where s.o_orderkey = t.o_orderkey))")
def merge_batched_upsert(spark, sf_dir):
    return _merged_in_steps(spark, sf_dir, "bucketed", "upsert")


@query(_BIGINTS + "(select o_orderkey, o_custkey, o_orderstatus, case when o_orderkey > (select max(o_orderkey) - 100 from orders) then o_totalprice + 1 else o_totalprice end as o_totalprice from orders)")
def merge_resumed(spark, sf_dir):
    """Later keys are appended beside what is there; then a load of the last keys is stopped after a step and goes on."""
    store = BucketedStore(spark, scratch_folder(spark))
    orders = _t(spark, sf_dir, "orders").select(*_ORDER_COLUMNS).withColumn(ROWNUM, F.lit(0))
    middle = orders.agg(F.max("o_orderkey").alias("last")).first()["last"] // 2
    store.merge_rows(ORDER, orders.where(F.col("o_orderkey") <= middle), "replace")
    store.merge_rows(ORDER, orders.where(F.col("o_orderkey") > middle), "upsert")
    newest = orders.join(F.broadcast(orders.agg((F.max("o_orderkey") - 100).alias("after"))), F.col("o_orderkey") > F.col("after")).drop("after")  # one row is joined
    newest = newest.withColumn("o_totalprice", F.col("o_totalprice") + 1)
    put, store._put_state = store._put_state, _Stops(store._put_state, 2)
    try:
        store.merge_rows(ORDER, newest, "replace", batch_rows=10, load="newest")
    except InterruptedError:
        store._put_state = put
    store.merge_rows(ORDER, newest, "replace", batch_rows=10, load="newest")
    return store.read(ORDER)


INDEXED = replace(ORDER, indexes=(("o_custkey",), ("o_orderstatus",)))


def _looked_up(spark, sf_dir, strategy):
    store = VersionedStore(spark, scratch_folder(spark))
    target, staged = _sides(spark, sf_dir)
    with manage_layout(store, INDEXED, strategy):
        store.write(INDEXED, target)
        store.merge_rows(INDEXED, staged.withColumn(ROWNUM, F.lit(0)), "replace")
    if not store.is_laid_out(INDEXED):
        raise RuntimeError("the table has no layout")
    return store.read(INDEXED).where(F.col("o_custkey").between(100, 160) & (F.col("o_orderstatus") == "F"))


_LOOKUP = f"(with t as ({_TARGET}), s as ({_STAGED}) select * from t where not exists (select 1 from s where s.o_orderkey = t.o_orderkey) union all select * from s) where o_custkey between 100 and 160 and o_orderstatus = 'F'"


@query(_BIGINTS + _LOOKUP)
def index_kept_lookup(spark, sf_dir):
    """Merged rows by an indexed column; every version is laid out as it is written."""
    return _looked_up(spark, sf_dir, "keep")


@query(_BIGINTS + _LOOKUP)
def index_rebuilt_lookup(spark, sf_dir):
    """Merged rows by an indexed column; versions are written plainly, and the last one is laid out."""
    return _looked_up(spark, sf_dir, "drop_rebuild")


class _Stops:
    """Calls a function a number of times, then fails as a killed driver would."""

    def __init__(self, function, times: int):
        self.function, self.left = function, times

    def __call__(self, *args):
        if not self.left:
            raise InterruptedError
        self.left -= 1
        self.function(*args)


@query("select c_custkey, c_name, cast(c_nationkey as bigint) as c_nationkey, left(c_mktsegment, 8) as c_mktsegment from customer")
def load_into_catalog(spark, sf_dir):
    """The whole load into a bucketed table of Spark's catalog."""
    root = scratch_folder(spark)
    _t(spark, sf_dir, "customer").write.option("header", True).csv(f"{root}/in/customer.csv")
    store = resolve_store(spark, "catalog", "loads_" + root.rsplit("-", 1)[-1])
    load_file(spark, store, CUSTOMER, f"{root}/in/customer.csv", dedupe=True)
    load_file(spark, store, CUSTOMER, f"{root}/in/customer.csv", merge_strategy="upsert")
    return store.read(CUSTOMER).select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")


@query("select c_custkey, c_name, cast(c_nationkey as bigint) as c_nationkey, left(c_mktsegment, 8) as c_mktsegment from customer")
def load_into_buckets(spark, sf_dir):
    """The whole load into a store of buckets."""
    root = scratch_folder(spark)
    _t(spark, sf_dir, "customer").write.option("header", True).csv(f"{root}/in/customer.csv")
    store = resolve_store(spark, "bucketed", f"{root}/tables")
    load_file(spark, store, CUSTOMER, f"{root}/in/customer.csv", dedupe=True, merge_batch_size=500)
    load_file(spark, store, CUSTOMER, f"{root}/in/customer.csv", merge_batch_size=500)
    return store.read(CUSTOMER).select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")


@query("select l_orderkey, l_linenumber, count(*) as n_rows from lineitem group by all having count(*) > 1")
def pk_duplicates(spark, sf_dir):
    return merge.repeated_keys(_t(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("select o_orderkey, o_custkey from orders o where not exists (select 1 from customer c where c.c_custkey = o.o_custkey and c_custkey % 5 <> 0) and o_custkey is not null")
def fk_orphans(spark, sf_dir):
    parents = _t(spark, sf_dir, "customer").where("c_custkey % 5 <> 0")
    return references.orphans(_t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), parents, {"o_custkey": "c_custkey"})


# --- ids and serialisation -----------------------------------------------------


@query("select coalesce(max(o_orderkey), 0) as max_id from orders")
def max_id(spark, sf_dir):
    return ids.max_id(_t(spark, sf_dir, "orders"), ["o_orderkey"])


@query("select c_name, (select max(o_orderkey) from orders) + row_number() over (order by c_custkey) as new_id from customer")
def assign_ids(spark, sf_dir):
    rows = _t(spark, sf_dir, "customer").select("c_name", "c_custkey")
    target = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("new_id"))
    return ids.assign_ids(rows, target, "new_id", ["c_custkey"]).select("c_name", "new_id")


_JSON = "json_object('c_custkey', c_custkey, 'c_mktsegment', nullif(c_mktsegment, 'BUILDING'), 'c_name', c_name, 'c_nationkey', c_nationkey)"


def _json_rows(spark, sf_dir):
    return _t(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", F.expr("nullif(c_mktsegment, 'BUILDING')").alias("c_mktsegment"))


@query(f"select c_custkey, cast({_JSON} as varchar) as v from customer")
def row_as_json(spark, sf_dir):
    rows = _json_rows(spark, sf_dir)
    return rows.select("c_custkey", row_json(rows.columns).alias("v"))


@query(f"select c_custkey, sha256(cast({_JSON} as varchar)) as v from customer")
def row_as_fingerprint(spark, sf_dir):
    rows = _json_rows(spark, sf_dir)
    return rows.select("c_custkey", row_fingerprint(rows.columns).alias("v"))


@query("select c_custkey, cast(json_object('c_custkey', c_custkey, 'c_name', c_name) as varchar) as v from customer")
def row_json_only(spark, sf_dir):
    rows = _json_rows(spark, sf_dir)
    return rows.select("c_custkey", row_json(rows.columns, only=["c_name", "c_custkey"], exclude=[]).alias("v"))


# --- validation ------------------------------------------------------------------

# What a specification says of the given tables: (table, field, required, in the key, reference, its table and field).
_SPEC_ROWS = (
    ("customer", "c_custkey", True, True, False, None, None), ("customer", "c_name", True, False, False, None, None), ("customer", "c_phone", False, False, False, None, None), ("customer", "c_nationkey", True, False, True, "nation", "n_nationkey"),
    ("supplier", "s_suppkey", True, True, False, None, None), ("supplier", "s_nationkey", True, False, True, "nation", "n_nationkey"), ("part", "p_partkey", True, True, False, None, None), ("part", "p_size", True, False, False, None, None),
    ("orders", "o_orderkey", True, False, False, None, None), ("orders", "o_custkey", True, False, False, None, None), ("orders", "o_clerk", False, False, False, None, None),
    ("lineitem", "l_orderkey", True, True, False, None, None), ("lineitem", "l_linenumber", True, True, False, None, None), ("nation", "n_nationkey", True, True, False, None, None), ("region", "r_name", True, True, False, None, None),
)
#: Keys and references to look for in the given tables.
_KEYS = {"lineitem": ("l_orderkey", "l_linenumber"), "customer": ("c_custkey",), "orders": ("o_orderkey",), "part": ("p_partkey",), "supplier": ("s_suppkey",), "nation": ("n_nationkey",), "region": ("r_regionkey",)}
_LINKS = {
    ("customer", "c_nationkey"): ("nation", "n_nationkey"), ("supplier", "s_nationkey"): ("nation", "n_nationkey"), ("nation", "n_regionkey"): ("region", "r_regionkey"),
    ("orders", "o_custkey"): ("customer", "c_custkey"), ("lineitem", "l_orderkey"): ("orders", "o_orderkey"), ("lineitem", "l_partkey"): ("part", "p_partkey"), ("lineitem", "l_suppkey"): ("supplier", "s_suppkey"),
}
_COLUMNS = {
    "region": ("r_regionkey", "r_name"), "nation": ("n_nationkey", "n_name", "n_regionkey"), "customer": ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"), "supplier": ("s_suppkey", "s_name", "s_nationkey", "s_acctbal"),
    "part": ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"), "orders": ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"),
    "lineitem": ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"),
}


def _described(spark, sf_dir):
    """Models of the given tables as they are stored; some orders and parts get nulls, and some lines no order."""
    tables = {name: _t(spark, sf_dir, name).select(*columns) for name, columns in _COLUMNS.items()}
    tables["orders"] = tables["orders"].withColumn("o_custkey", F.expr("case when o_orderkey % 97 <> 0 then o_custkey end"))
    tables["part"] = tables["part"].withColumn("p_size", F.expr("case when p_partkey % 89 <> 0 then p_size end"))
    tables["lineitem"] = tables["lineitem"].withColumn("l_suppkey", F.expr("case when l_orderkey % 83 = 0 then -1 else l_suppkey end"))
    return observed.describe_tables(tables, _KEYS, _LINKS)


_STORED = """orders_ as (select * replace (case when o_orderkey % 97 <> 0 then o_custkey end as o_custkey) from orders),
 part_ as (select * replace (case when p_partkey % 89 <> 0 then p_size end as p_size) from part),
 lineitem_ as (select * replace (case when l_orderkey % 83 = 0 then -1 else l_suppkey end as l_suppkey) from lineitem)"""


def _stored(table: str) -> str:
    return f"{table}_" if table in ("orders", "part", "lineitem") else table


def _observed_sql() -> str:
    """A row for each column of the stored tables, as SQL."""
    parts = []
    for table, columns in _COLUMNS.items():
        at, n = _stored(table), len(_KEYS[table])
        whole = "(" + ", ".join(_KEYS[table]) + ")"
        is_key = lambda key: f"(select count(*) = count(distinct {key}) and count(*) > 0 from {at})"
        named = f"({is_key(whole if n > 1 else _KEYS[table][0])} and (select count(*) filter ({' or '.join(c + ' is null' for c in _KEYS[table])}) = 0 from {at}))"
        for k, column in enumerate(columns):
            earlier = " and ".join([f"not {is_key(c)}" for c in columns[:k]]) or "true"
            key = f"case when {named} then {'true' if column in _KEYS[table] else 'false'} else {is_key(column)} and {earlier} end"
            link = _LINKS.get((table, column))
            held = f"not exists (select 1 from {at} x where x.{column} is not null and x.{column} not in (select {link[1]} from {_stored(link[0])} where {link[1]} is not null))" if link else "false"
            fk_table, fk_field = (f"case when {held} then '{x}' end" for x in link or ("", ""))
            kind = f"(select case when typeof({column}) in ('BIGINT', 'INTEGER') then 'integer' when typeof({column}) in ('DOUBLE', 'FLOAT') then 'float' when typeof({column}) like 'TIMESTAMP%' then 'datetime' when typeof({column}) = 'VARCHAR' then 'string' end from {at} limit 1)"
            parts.append(f"select '{table}' as tbl, '{column}' as fld, (select count(*) > count({column}) from {at}) as nullable, {key} as is_pk, {fk_table} as fk_table, {fk_field} as fk_field, {kind} as kind")
    return " union all ".join(parts)


def _values(rows) -> str:
    spell = lambda v: "null" if v is None else str(v).lower() if isinstance(v, bool) else f"'{v}'"
    return ", ".join("(" + ", ".join(map(spell, r)) + ")" for r in rows)


_CTES = f"""with {_STORED}, spec(tbl, fld, required, is_pk, is_fk, fk_table, fk_field) as (values {_values(_SPEC_ROWS)}),
 model as materialized ({_observed_sql()}) """


def catalog(models) -> ModelCatalog:
    """The specification and given models."""
    out = ModelCatalog("given tables")
    for table, name, required, key, fk, fk_table, fk_field in _SPEC_ROWS:
        out.fields.setdefault(table, {})[name] = FieldSpec(table, name, required, "integer", key, fk, fk_table, fk_field)
    out.register(*models)
    return out


def _frames(spark, sf_dir):
    models = _described(spark, sf_dir)
    return catalog(models).spec_frame(spark), observed.observed_frame(spark, models)


@query(_CTES + 'select tbl as "table", fld as field, nullable, is_pk, fk_table, fk_field, kind from model')
def describe_stored_tables(spark, sf_dir):
    """Columns, types, nulls, keys and references of the stored tables."""
    return observed.observed_frame(spark, _described(spark, sf_dir))


_DECLARED = (CUSTOMER, PART, TableModel("orders", (ColumnModel("o_orderkey", "string"), ColumnModel("o_totalprice", "integer"), ColumnModel("o_orderdate", "date"), ColumnModel("o_orderpriority", "integer"), ColumnModel("o_clerk"))))
_DECLARED_ROWS = [(m.name, c.name, c.kind) for m in _DECLARED for c in m.insertable]


@query(
    _CTES
    + f""", declared(tbl, fld, kind) as (values {_values(_DECLARED_ROWS)}), wider(narrow, wide) as (values ('integer', 'float'), ('integer', 'string'), ('float', 'string'), ('datetime', 'string'))
 select d.tbl as "table", d.fld as field, coalesce(m.kind, 'absent') as stored, d.kind as declared from declared d left join model m on m.tbl = d.tbl and m.fld = d.fld
 where coalesce(m.kind, 'absent') <> d.kind and not exists (select 1 from wider w where w.narrow = m.kind and w.wide = d.kind)"""
)
def stored_type_differences(spark, sf_dir):
    """Stored columns whose values a declared type cannot hold."""
    return spark.createDataFrame(observed.type_differences(_described(spark, sf_dir), _DECLARED), "table string, field string, stored string, declared string")


@query(_CTES + 'select s.tbl as "table", s.fld as field from spec s where s.tbl in (select tbl from model) and not exists (select 1 from model m where m.tbl = s.tbl and m.fld = s.fld)')
def spec_missing_columns(spark, sf_dir):
    return validators.missing_columns(*_frames(spark, sf_dir))


@query(_CTES + 'select s.tbl as "table", s.fld as field from spec s join model m on m.tbl = s.tbl and m.fld = s.fld where s.required and m.nullable')
def spec_required_nullable(spark, sf_dir):
    return validators.nullable_required(*_frames(spark, sf_dir))


@query(
    _CTES
    + """, ours as (select tbl, fld from model where is_pk), theirs as (select tbl, fld from spec where is_pk)
 select tbl as "table", fld as field, 'PRIMARY_KEY_MISSING_FROM_MODEL' as code from (select * from theirs where tbl in (select tbl from ours) except select * from ours)
 union all select tbl, fld, 'PRIMARY_KEY_NOT_DECLARED_IN_SPEC' from (select * from ours except select * from theirs)
 union all select distinct tbl, null, 'TABLE_HAS_NO_PRIMARY_KEY' from model where tbl not in (select tbl from ours)
 union all select tbl, null, 'COMPOSITE_PRIMARY_KEY' from ours group by tbl having count(*) > 1"""
)
def spec_pk_mismatch(spark, sf_dir):
    return validators.key_mismatches(*_frames(spark, sf_dir))


@query(_CTES + 'select m.tbl as "table", m.fld as field from model m where m.fk_table is not null and not exists (select 1 from spec s where s.is_fk and m.tbl = s.tbl and m.fld = s.fld)')
def spec_fk_not_in_spec(spark, sf_dir):
    return validators.unspecified_references(*_frames(spark, sf_dir))


@query(
    _CTES
    + """, ours as (select tbl, fld from model where is_pk), theirs as (select tbl, fld from spec where is_pk), found as (
 select 'ERROR' as level from spec s where s.tbl in (select tbl from model) and not exists (select 1 from model m where m.tbl = s.tbl and m.fld = s.fld)
 union all select 'ERROR' from spec s join model m on m.tbl = s.tbl and m.fld = s.fld where s.required and m.nullable
 union all select 'ERROR' from (select * from theirs where tbl in (select tbl from ours) except select * from ours)
 union all select 'WARN' from (select * from ours except select * from theirs)
 union all select 'ERROR' from (select distinct tbl from model where tbl not in (select tbl from ours))
 union all select 'INFO' from (select tbl from ours group by tbl having count(*) > 1)
 union all select 'WARN' from model m where m.fk_table is not null and not exists (select 1 from spec s where s.is_fk and m.tbl = s.tbl and m.fld = s.fld))
 select level, count(*) as n_issues from found group by level"""
)
def validation_summary(spark, sf_dir):
    report = validators.run_validators(catalog(_described(spark, sf_dir)))
    return report.to_df(spark).groupBy("level").agg(F.count("*").alias("n_issues"))


# --- views ---------------------------------------------------------------------


@query(
    """select o.o_orderkey, c.c_name, o.o_totalprice from orders o join customer c on c.c_custkey = o.o_custkey
 where o.o_orderdate >= (select max(o_orderdate) from orders) - interval 30 days"""
)
def mv_recent_join(spark, sf_dir):
    orders, customer = _t(spark, sf_dir, "orders"), _t(spark, sf_dir, "customer")
    newest = orders.agg(F.max("o_orderdate").alias("newest"))  # one row
    recent = orders.crossJoin(F.broadcast(newest)).where(F.col("o_orderdate") >= F.col("newest") - F.expr("interval 30 days"))
    return recent.join(customer, F.col("c_custkey") == F.col("o_custkey")).select("o_orderkey", "c_name", "o_totalprice")


def _views(sf_dir):
    daily = MaterializedView("mv_daily", lambda s: _t(s, sf_dir, "events").groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n")))
    top = MaterializedView("mv_top", "select day, sum(n) as n_events from mv_daily group by day", ("mv_daily",))
    return daily, top


@query(
    """select row_number() over (order by day, event_type) as mv_id, day, event_type, n from
 (select cast(ts as date) as day, event_type, count(*) as n from events group by all)"""
)
def mv_daily_counts(spark, sf_dir):
    views = ViewStore(spark, VersionedStore(spark, scratch_folder(spark)))
    daily, _ = _views(sf_dir)
    views.create(daily)
    views.refresh(daily)
    # a view of counts is small; its numbering is a single ordered pass
    return views.read(daily).select(F.row_number().over(Window.orderBy("day", "event_type")).cast("bigint").alias("mv_id"), "day", "event_type", "n")


@query("select cast(ts as date) as day, cast(count(*) as bigint) as n_events from events group by all")
def mv_on_mv(spark, sf_dir):
    views = ViewStore(spark, VersionedStore(spark, scratch_folder(spark)))
    daily, top = _views(sf_dir)
    for view in (daily, top):
        views.create(view)
    views.refresh_all([top, daily])
    return views.read(top)


@query("select cast(ts as date) as day, count(*) as n_events from events group by all order by n_events desc, day limit 5")
def mv_top_days(spark, sf_dir):
    return _t(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n_events")).orderBy(F.desc("n_events"), "day").limit(5)


_STAMPS = """case event_id % 6 when 0 then date_format(ts, 'HH:mm:ss yyyy-MM-dd') when 1 then date_format(ts, 'yyyy-MM-dd H:mm') when 2 then date_format(ts, "yyyy-MM-dd, 'at' HH:mm:ss")
 when 3 then date_format(ts, 'yyyy/MM/dd HH:mm') when 4 then date_format(ts, 'yyyy-MM-dd hh:mm a') else date_format(ts, 'yyyy-MM-dd') || ' at noon' end"""


@query("select event_id, case when event_id % 6 in (0, 2) then date_trunc('second', ts) when event_id % 6 in (1, 4) then date_trunc('minute', ts) end as v from events")
def cast_datetime_layouts(spark, sf_dir):
    """The further layouts that a date-time may have."""
    value, _ = casting.cast_column(F.col("s"), ColumnModel("s", "datetime"))
    return _t(spark, sf_dir, "events").select("event_id", F.expr(_STAMPS).alias("s")).select("event_id", value.alias("v"))


# (Spark's layout of a moment, the part of it that the spelling keeps)
_SPELLINGS = (
    ("yyyy-MM-dd'T'HH:mm:ss", "second"), ("yyyy-MM-dd HH:mm", "minute"), ("yyyy-MM-dd HH", "hour"), ("yyyyMMdd", "day"), ("yyyyMMdd'T'HHmmss", "second"),
    ("yyyyMMdd HHmm", "minute"), ("yyyy-MM-dd'T'HHmm", "minute"), ("yyyy-MM-dd'x'HH:mm:ss", "second"), ("yyyy-MM-dd'T'HH:mm:ss'Z'", "second"), ("yyyy-MM-dd'T'HH:mm'+03:00'", "minute"),
    ("dd/MM/yyyy", "day"), ("d-MMM-yyyy", "day"), ("yyyy-MM-dd h:mm a", "minute"), ("yyyy-MM-dd h:mm:ss a", "second"), ("yyyy-MM-dd h a", "hour"),
    ("yyyy-MM-dd, 'at' H:mm", "minute"), ("yyyy-MM-dd 'at' HH:mm:ss", "second"), ("H:mm yyyy-MM-dd", "minute"), ("HH:mm:ss, yyyy-MM-dd", "second"), ("h:mm a 'on' yyyy-MM-dd", "minute"),
    ("EEEE, yyyy-MM-dd", "day"), ("EEE yyyy-MM-dd H:mm", "minute"), ("yyyy-MM-dd EEEE H:mm 'EST'", "minute"), ("yyyy-MM-dd H:mm 'UTC'", "minute"), ("yyyy-MM-dd H:mm '-0300'", "minute"),
    ("yyyy-MM-dd HH'h'mm'm'ss's'", "second"), ("yyyy-MM-dd H'h'mm", "minute"), ("yyyy-MM-dd H 'hours' m 'minutes'", "minute"), ("yyyy/MM/dd HH:mm", None), ("yyyy-MM-dd 'at noon'", None),
    ("MMM d yyyy HH:mm", None), ("yyyy-MM-dd HH:mm 'o''clock'", None), ("yyyy-MM-dd yyyy-MM-dd", None), ("HH:mm", None),
)


@query(
    f"select event_id, case event_id % {len(_SPELLINGS)} "
    + " ".join(f"when {k} then cast(date_trunc('{part}', ts) as timestamp)" for k, (_, part) in enumerate(_SPELLINGS) if part)
    + " end as v from events"
)
def cast_datetime_spellings(spark, sf_dir):
    """Moments in 34 spellings, of which the last six are none that can be read."""
    value, _ = casting.cast_column(F.col("s"), ColumnModel("s", "datetime"))
    layouts = [F.when(F.col("event_id") % len(_SPELLINGS) == k, F.date_format("ts", layout)) for k, (layout, _) in enumerate(_SPELLINGS)]
    return _t(spark, sf_dir, "events").select("event_id", F.coalesce(*layouts).alias("s")).select("event_id", value.alias("v"))


@query(
    _WITH_MESSY
    + f""", f as (select o_orderkey, s from m where {_NOT_NULL} and not (regexp_matches(trim(s), '^[+-]?\\d+(\\.0+)?$')))
 select s as example, cast(row_number() over (order by o_orderkey) as integer) as nth from f order by o_orderkey limit 3"""
)
def cast_failure_examples(spark, sf_dir):
    """The first inputs that failed a cast, in order."""
    model = TableModel("m", (ColumnModel("s", "integer"),), ())
    cast = quality.cast_rows(_messy(spark, sf_dir).withColumn(ROWNUM, F.col("o_orderkey")), model)
    return quality.failure_examples(cast).select("example", "nth")
