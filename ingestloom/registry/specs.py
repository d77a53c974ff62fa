"""External table and field specifications, and descriptors of our own tables."""

from __future__ import annotations

import csv
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ingestloom.model import ColumnModel, TableModel, find_models, model_by_name


@dataclass(frozen=True)
class TableSpec:
    name: str
    schema: str | None = None
    required: bool = False
    description: str | None = None
    guidance: str | None = None


@dataclass(frozen=True)
class FieldSpec:
    """A specified field. The referenced table and field are kept as written; they are compared without case."""

    table: str
    name: str
    required: bool = False
    data_type: str | None = None
    primary_key: bool = False
    foreign_key: bool = False
    fk_table: str | None = None
    fk_field: str | None = None


@dataclass(frozen=True)
class ModelDescriptor:
    """What validation asks of a model: its columns, keys and references."""

    table: str
    columns: dict[str, ColumnModel]
    nullable: dict[str, bool]
    primary_key: frozenset[str]
    foreign_keys: dict[str, tuple[str, str]]

    @classmethod
    def of(cls, model: TableModel) -> ModelDescriptor:
        if not isinstance(model, TableModel):
            raise TypeError(f"{model!r} is not a table model")
        return cls(model.name, model.by_name, {c.name: model.is_nullable(c) for c in model.columns}, frozenset(model.primary_key), dict(model.foreign_keys))


def _yes(value: str | None) -> bool:
    return (value or "").strip().lower() == "yes"


def _rows(source, spark: SparkSession | None) -> list[dict[str, str]]:
    """Rows of a specification file with lower-case names. ``source`` is a path, or an object with ``open``."""
    if hasattr(source, "open"):
        with source.open("r") as file:
            rows = [dict(r) for r in csv.DictReader(file)]
    else:
        spark = spark or SparkSession.getActiveSession()
        frame = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(str(source))
        rows = [r.asDict() for r in frame.collect()]  # one row a specified field
    return [{k.strip().lower(): v for k, v in r.items() if k} for r in rows]


def read_table_specs(source, spark: SparkSession | None = None) -> dict[str, TableSpec]:
    specs = [TableSpec(r["cdmtablename"].lower(), r.get("schema"), _yes(r.get("isrequired")), r.get("tabledescription"), r.get("userguidance")) for r in _rows(source, spark)]
    return {s.name: s for s in specs}


def read_field_specs(source, spark: SparkSession | None = None) -> dict[str, dict[str, FieldSpec]]:
    out: dict[str, dict[str, FieldSpec]] = {}
    for r in _rows(source, spark):
        spec = FieldSpec(
            r["cdmtablename"].lower(), r["cdmfieldname"].lower(), _yes(r.get("isrequired")), r.get("cdmdatatype"), _yes(r.get("isprimarykey")), _yes(r.get("isforeignkey")), r.get("fkcdmtablename") or None, r.get("fkcdmfieldname") or None
        )
        out.setdefault(spec.table, {})[spec.name] = spec
    return out


@dataclass
class ModelCatalog:
    """Specifications and registered models, by table name."""

    name: str = "MODEL"
    version: str | None = None
    tables: dict[str, TableSpec] = field(default_factory=dict)
    fields: dict[str, dict[str, FieldSpec]] = field(default_factory=dict)
    descriptors: dict[str, ModelDescriptor] = field(default_factory=dict)
    models_by_name: dict[str, TableModel] = field(default_factory=dict)

    def load_specs(self, tables, fields, spark: SparkSession | None = None) -> None:
        self.tables, self.fields = read_table_specs(tables, spark), read_field_specs(fields, spark)

    def register(self, *models: TableModel) -> None:
        for model in models:
            self.descriptors[model.name.lower()] = ModelDescriptor.of(model)
            self.models_by_name[model.name.lower()] = model

    def discover(self, package: str) -> None:
        self.register(*find_models(package))

    def get(self, name: str) -> TableModel | None:
        return model_by_name(name, self.models_by_name.values())

    def models(self) -> dict[str, ModelDescriptor]:
        return self.descriptors

    def known_tables(self) -> set[str]:
        return set(self.tables)

    def registered_tables(self) -> set[str]:
        return set(self.descriptors)

    def missing_required_tables(self) -> set[str]:
        return {n for n, s in self.tables.items() if s.required} - self.registered_tables()

    def spec_frame(self, spark: SparkSession) -> DataFrame:
        """Specified fields as rows."""
        rows = [(f.table, f.name, f.required, f.primary_key, f.foreign_key, f.fk_table, f.fk_field) for fields in self.fields.values() for f in fields.values()]
        return spark.createDataFrame(rows, "table string, field string, required boolean, is_pk boolean, is_fk boolean, fk_table string, fk_field string")

    def model_frame(self, spark: SparkSession) -> DataFrame:
        """Columns of registered models as rows."""
        rows = [(d.table, c, d.nullable[c], c in d.primary_key, *(d.foreign_keys.get(c) or (None, None))) for d in self.descriptors.values() for c in d.columns]
        return spark.createDataFrame(rows, "table string, field string, nullable boolean, is_pk boolean, fk_table string, fk_field string")


def descriptors(models: Iterable[TableModel]) -> list[ModelDescriptor]:
    return [ModelDescriptor.of(m) for m in models]
