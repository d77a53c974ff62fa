"""Table models checked against external specifications."""

from ingestloom.registry.report import Issue, Level, ValidationReport
from ingestloom.registry.specs import FieldSpec, ModelCatalog, ModelDescriptor, TableSpec, read_field_specs, read_table_specs
from ingestloom.registry.validators import STANDARD_VALIDATORS, Validator, run_validators, standard_validators

__all__ = ["STANDARD_VALIDATORS", "FieldSpec", "Issue", "Level", "ModelCatalog", "ModelDescriptor", "TableSpec", "ValidationReport", "Validator", "read_field_specs", "read_table_specs", "run_validators", "standard_validators"]
