"""Tables in buckets of their keys, merged a range of buckets at a time.

A row's bucket follows from a hash of its key, so staged rows meet only target
rows of their own bucket. A merge reads and writes the buckets that staged rows
fall into, in steps of about ``batch_rows`` staged rows. A step writes a new
folder beside the old ones and then moves the state file into place, which
names the folders of every bucket and the steps that are done: a load that was
killed goes on behind its last step, and no file of another bucket is touched.

Where the staged keys of a bucket lie outside the range of its stored keys they
are appended as a further folder; what is there is neither read nor written.
The state has a row a bucket.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ingestloom.model import IdAllocator, TableModel
from ingestloom.operators import ids, merge
from ingestloom.plans.store import Files, with_computed
from ingestloom.sources.readers import ROWNUM

_STATE, _BUCKET = "_STATE", "_bucket"
#: Folders of a bucket beyond which the next merge writes it anew.
MOST_FOLDERS = 8


def bucket_of(key: Sequence[str], n: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(n)).cast("int")


def _spelled(kind: T.DataType, value: Column) -> Column | None:
    """A key as text that sorts as the key does, for types that have one; nothing for others."""
    if isinstance(kind, T.StringType):
        return value
    if isinstance(kind, T.DateType):
        return value.cast("string")
    if isinstance(kind, T.IntegralType):  # shifted above zero and padded
        return F.lpad((value.cast("decimal(20,0)") + F.lit("9223372036854775808").cast("decimal(20,0)")).cast("string"), 20, "0")
    return None


class BucketedStore:
    """Tables below a root folder; ``buckets`` holds for tables that are made from then on."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 16):
        if buckets < 1:
            raise ValueError("buckets must be positive")
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self.files = Files(spark)

    def state(self, name: str) -> dict | None:
        """buckets: folders and key range of each; load and done: an unfinished load and its finished steps."""
        path = f"{self.root}/{name}/{_STATE}"
        return json.loads(self.files.read_text(path)) if self.files.exists(path) else None

    def _put_state(self, name: str, state: dict) -> None:
        self.files.replace_text(f"{self.root}/{name}/{_STATE}", json.dumps(state))

    def exists(self, name: str) -> bool:
        return self.state(name) is not None

    def _read_buckets(self, name: str, state: dict, schema: T.StructType | None, wanted: Iterable[str] | None = None) -> DataFrame | None:
        chosen = state["buckets"].items() if wanted is None else [(b, state["buckets"][b]) for b in wanted if b in state["buckets"]]
        paths = [f"{self.root}/{name}/{folder}/{_BUCKET}={b}" for b, held in chosen for folder in held["folders"]]
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        return reader.parquet(*paths) if paths else None

    def read(self, model: TableModel) -> DataFrame:
        state = self.state(model.name)
        rows = self._read_buckets(model.name, state, model.schema) if state else None
        return self.spark.createDataFrame([], model.schema) if rows is None else rows

    def is_empty(self, model: TableModel) -> bool:
        return self.read(model).isEmpty()

    def read_rows(self, name: str) -> DataFrame:
        state = self.state(name)
        rows = self._read_buckets(name, state, None) if state else None
        if rows is None:
            raise ValueError(f"{name} does not exist")
        return rows

    def write(self, model: TableModel, df: DataFrame, max_records_per_file: int | None = None) -> None:
        """The table anew."""
        self._write_all(model.name, with_computed(df, model), list(model.primary_key))

    def write_rows(self, name: str, df: DataFrame, max_records_per_file: int | None = None) -> None:
        self._write_all(name, df, [])

    def _write_all(self, name: str, df: DataFrame, key: list[str]) -> None:
        old = self.state(name) or {"buckets": {}}
        n = self.buckets if key else 1
        held = self._append(name, df, key, n)
        self._put_state(name, {"n": n, "buckets": held or {"0": {"folders": [self._empty(name, df)], "low": None, "high": None}}})
        for folder in {f for b in old["buckets"].values() for f in b["folders"]}:
            self.files.delete(f"{self.root}/{name}/{folder}")

    def _empty(self, name: str, df: DataFrame) -> str:
        folder = f"v{uuid.uuid4().hex}"
        df.limit(0).coalesce(1).write.parquet(f"{self.root}/{name}/{folder}/{_BUCKET}=0")
        return folder

    def _append(self, name: str, df: DataFrame, key: list[str], n: int) -> dict:
        """Writes rows to a fresh folder; what each bucket then has there, from counts of its key column."""
        folder = f"v{uuid.uuid4().hex}"
        bucket = bucket_of(key, n) if key else F.lit(0)
        path = f"{self.root}/{name}/{folder}"
        rows = df.withColumn(_BUCKET, bucket)
        try:
            # a bucket may be split over tasks by adaptive execution, as it is a rebalance
            (rows.hint("rebalance", _BUCKET) if key else rows).write.partitionBy(_BUCKET).parquet(path)
        except Exception:
            self.files.delete(path)
            raise
        first = key[0] if key else None
        spelled = _spelled(df.schema[first].dataType, F.col(first)) if first else None
        ranges = [F.min(spelled).alias("low"), F.max(spelled).alias("high")] if spelled is not None else [F.lit(None).alias("low"), F.lit(None).alias("high")]
        if not any(f.startswith(_BUCKET) for f in self.files.children(path)):
            return {}
        found = self.spark.read.parquet(path).groupBy(_BUCKET).agg(F.count("*").alias("n"), *ranges).collect()  # a row a bucket
        return {str(r[_BUCKET]): {"folders": [folder], "low": r["low"], "high": r["high"]} for r in found}

    def merge_rows(self, model: TableModel, staged: DataFrame, strategy: str, batch_rows: int | None = None, load: str | None = None) -> list[list[int]]:
        """Merges staged rows; the buckets of every step taken are returned.

        ``load`` names the load: with a name that the state holds as unfinished
        the steps that are done are left out. Steps depend on the staged rows
        only, which have to be the same then.
        """
        merge.check_strategy(strategy)
        computed = [c.name for c in model.columns if c.computed is not None]
        if not model.primary_key:
            self._write_all(model.name, with_computed(merge.insert(self.read(model).drop(*computed), staged), model), [])
            return [[0]]
        key, load = model.key(), load or uuid.uuid4().hex
        state = self.state(model.name) or {"n": self.buckets, "buckets": {}}
        if strategy == "insert_if_empty" and state.get("load") != load and not self.is_empty(model):
            raise ValueError("insert_if_empty needs an empty target")
        done = set(state["done"]) if state.get("load") == load else set()
        n = state["n"]
        first = staged.schema[key[0]].dataType
        spelled = _spelled(first, F.col(key[0]))
        ranges = [F.min(spelled).alias("low"), F.max(spelled).alias("high")] if spelled is not None else []
        staged = staged.withColumn(_BUCKET, bucket_of(key, n))
        touched = staged.groupBy(_BUCKET).agg(F.count("*").alias("rows"), *ranges).orderBy(_BUCKET).collect()  # a row a bucket
        steps: list[list] = []
        size = 0
        for row in touched:
            if not steps or (batch_rows and size + row["rows"] > batch_rows):
                steps, size = [*steps, []], 0
            steps[-1].append(row)
            size += row["rows"]
        taken = []
        for at, step in enumerate(steps):
            if at in done:
                continue
            state = self._step(model, staged, strategy, state | {"load": load, "done": sorted(done | {at})}, step, computed)
            done.add(at)
            taken.append([row[_BUCKET] for row in step])
        self._put_state(model.name, {k: v for k, v in state.items() if k not in ("load", "done")})
        return taken

    def _step(self, model: TableModel, staged: DataFrame, strategy: str, state: dict, step: list, computed: list[str]) -> dict:
        """One step: buckets whose stored keys may be staged are merged and written anew, others get a further folder."""
        name, key, n = model.name, model.key(), state["n"]
        apart, mixed = [], []
        for row in step:
            held = state["buckets"].get(str(row[_BUCKET]))
            known = held and held["low"] is not None and "low" in row and row["low"] is not None
            outside = not held or (known and (row["high"] < held["low"] or row["low"] > held["high"]))
            (apart if outside and len((held or {"folders": []})["folders"]) < MOST_FOLDERS else mixed).append(row[_BUCKET])
        fresh: dict[str, dict] = {}
        for some, rewrite in ((apart, False), (mixed, True)):
            if not some:
                continue
            rows = staged.where(F.col(_BUCKET).isin(some)).drop(_BUCKET)
            target = self._read_buckets(name, state, model.schema, map(str, some)) if rewrite else None
            target = self.spark.createDataFrame([], model.schema) if target is None else target
            merged = merge.plan(target.drop(*computed), rows, key, strategy if strategy != "insert_if_empty" else "replace", not rewrite)
            for b, held in self._append(name, with_computed(merged.drop(ROWNUM), model), key, n).items():
                before = state["buckets"].get(b)
                if before and not rewrite:
                    lows, highs = [x for x in (before["low"], held["low"]) if x is not None], [x for x in (before["high"], held["high"]) if x is not None]
                    held = {"folders": before["folders"] + held["folders"], "low": min(lows, default=None), "high": max(highs, default=None)}
                fresh[b] = held
        buckets = state["buckets"] | fresh
        old = [(f, b) for b in fresh for f in state["buckets"].get(b, {"folders": []})["folders"] if f not in fresh[b]["folders"]]
        state = state | {"buckets": buckets}
        self._put_state(name, state)
        for folder, b in old:  # a reader of an older state fails rather than sees half
            self.files.delete(f"{self.root}/{name}/{folder}/{_BUCKET}={b}")
        return state

    def drop(self, name: str) -> None:
        self.files.delete(f"{self.root}/{name}")

    def bootstrap(self, models: Iterable[TableModel], create: bool = True) -> None:
        """An empty table for each model that has none."""
        for model in models if create else ():
            if not self.exists(model.name):
                self._put_state(model.name, {"n": self.buckets if model.primary_key else 1, "buckets": {}})

    def stage(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def max_id(self, model: TableModel) -> int:
        return ids.max_id(self.read(model), model.key()).first()["max_id"]

    def allocator(self, model: TableModel) -> IdAllocator:
        return ids.allocator(self.read(model), model.key())
