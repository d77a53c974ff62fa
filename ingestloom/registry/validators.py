"""Rules that compare a model with its specification.

Each rule exists twice: over one descriptor, for reports, and as a join of the
catalog frames, for queries over many tables at once.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ingestloom.registry.report import Issue, Level, ValidationReport
from ingestloom.registry.specs import FieldSpec, ModelCatalog, ModelDescriptor


class Validator(Protocol):
    def check(self, model: ModelDescriptor, spec: Mapping[str, FieldSpec]) -> Iterator[Issue]: ...


class ColumnPresence:
    """Every specified field is a column."""

    def check(self, model: ModelDescriptor, spec: Mapping[str, FieldSpec]) -> Iterator[Issue]:
        for name in spec:
            if name not in model.columns:
                yield Issue(model.table, Level.ERROR, "COLUMN_MISSING", "a specified column is missing", name, "present", "absent", "add the column to the model")


class ColumnNullability:
    """A required field is not nullable."""

    def check(self, model: ModelDescriptor, spec: Mapping[str, FieldSpec]) -> Iterator[Issue]:
        for name, field in spec.items():
            if field.required and model.nullable.get(name):
                yield Issue(model.table, Level.ERROR, "REQUIRED_COLUMN_NULLABLE", "a required column is nullable", name, "NOT NULL", "NULL", "declare the column as not nullable")


class PrimaryKey:
    """The key exists, is not nullable, and is the specified one."""

    def check(self, model: ModelDescriptor, spec: Mapping[str, FieldSpec]) -> Iterator[Issue]:
        if not model.primary_key:
            yield Issue(model.table, Level.ERROR, "TABLE_HAS_NO_PRIMARY_KEY", "the table has no primary key", hint="declare a primary key")
            return
        wanted = {n for n, f in spec.items() if f.primary_key}
        for name in sorted(model.primary_key):
            if model.nullable[name]:
                yield Issue(model.table, Level.ERROR, "PRIMARY_KEY_COLUMN_NULLABLE", "a key column is nullable", name, "NOT NULL", "NULL")
        for name in sorted(wanted - model.primary_key):
            yield Issue(model.table, Level.ERROR, "PRIMARY_KEY_MISSING_FROM_MODEL", "a specified key column is not in the model's key", name, "key", "no key")
        for name in sorted(model.primary_key - wanted):
            yield Issue(model.table, Level.WARN, "PRIMARY_KEY_NOT_DECLARED_IN_SPEC", "the specification does not name this key column", name, "no key", "key")
        if len(model.primary_key) > 1:
            yield Issue(model.table, Level.INFO, "COMPOSITE_PRIMARY_KEY", "the key has several columns", actual=", ".join(sorted(model.primary_key)))


class ForeignKeyShape:
    """A reference is complete, and the specification has it."""

    def check(self, model: ModelDescriptor, spec: Mapping[str, FieldSpec]) -> Iterator[Issue]:
        for name, (table, field) in model.foreign_keys.items():
            if not table or not field:
                yield Issue(model.table, Level.ERROR, "FOREIGN_KEY_INCOMPLETE", "a reference lacks its table or field", name)
                continue
            said = spec.get(name)
            if said is None or not said.foreign_key:
                yield Issue(model.table, Level.WARN, "FOREIGN_KEY_NOT_IN_SPEC", "the specification has no such reference", name, None, f"{table}.{field}")


class ForeignKeyTarget:
    """Opt-in: a reference goes where the specification says, letter case aside."""

    def check(self, model: ModelDescriptor, spec: Mapping[str, FieldSpec]) -> Iterator[Issue]:
        for name, (table, field) in model.foreign_keys.items():
            said = spec.get(name)
            if said and said.fk_table and (said.fk_table.lower(), (said.fk_field or field).lower()) != (table.lower(), field.lower()):
                yield Issue(model.table, Level.WARN, "FOREIGN_KEY_TARGET_DIFFERS", "the reference goes elsewhere", name, f"{said.fk_table}.{said.fk_field}", f"{table}.{field}")


def standard_validators() -> list[Validator]:
    """The rules that always run, in order."""
    return [ColumnPresence(), ColumnNullability(), PrimaryKey(), ForeignKeyShape()]


STANDARD_VALIDATORS = tuple(standard_validators())


def run_validators(catalog: ModelCatalog, validators: Sequence[Validator] | None = None, fail_fast: bool = False, required_tables: bool = False) -> ValidationReport:
    """Each model by each rule; ``fail_fast`` ends at the first error. ``required_tables`` also reports absent ones."""
    report = ValidationReport(catalog.name)
    if required_tables:
        report.add(*[Issue(t, Level.ERROR, "REQUIRED_TABLE_MISSING", "a required table has no model") for t in sorted(catalog.missing_required_tables())])
    for table, model in catalog.models().items():
        for rule in validators if validators is not None else STANDARD_VALIDATORS:
            for issue in rule.check(model, catalog.fields.get(table, {})):
                report.add(issue)
                if fail_fast and issue.level is Level.ERROR:
                    return report
    return report


def missing_columns(spec: DataFrame, model: DataFrame) -> DataFrame:
    """table and field of specified fields that the model's table lacks."""
    known = spec.join(model.select("table").distinct(), "table", "left_semi")
    return known.join(model, ["table", "field"], "left_anti").select("table", "field")


def nullable_required(spec: DataFrame, model: DataFrame) -> DataFrame:
    return spec.where("required").join(model.where("nullable"), ["table", "field"], "left_semi").select("table", "field")


def key_mismatches(spec: DataFrame, model: DataFrame) -> DataFrame:
    """table, field and code of key columns that only one side has, and tables without a key."""
    ours, theirs = model.where("is_pk").select("table", "field"), spec.where("is_pk").select("table", "field")
    keyed = ours.select("table").distinct()
    missing = theirs.join(keyed, "table", "left_semi").join(ours, ["table", "field"], "left_anti").withColumn("code", F.lit("PRIMARY_KEY_MISSING_FROM_MODEL"))
    extra = ours.join(theirs, ["table", "field"], "left_anti").withColumn("code", F.lit("PRIMARY_KEY_NOT_DECLARED_IN_SPEC"))
    without = model.select("table").distinct().join(keyed, "table", "left_anti").select("table", F.lit(None).cast("string").alias("field"), F.lit("TABLE_HAS_NO_PRIMARY_KEY").alias("code"))
    composite = ours.groupBy("table").count().where("count > 1").select("table", F.lit(None).cast("string").alias("field"), F.lit("COMPOSITE_PRIMARY_KEY").alias("code"))
    return missing.unionByName(extra).unionByName(without).unionByName(composite)


def unspecified_references(spec: DataFrame, model: DataFrame) -> DataFrame:
    return model.where("fk_table is not null").join(spec.where("is_fk"), ["table", "field"], "left_anti").select("table", "field")
