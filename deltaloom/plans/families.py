"""The catalogue of change families, as data.

Names are the contract of a report's facts; categories and whether a family can be modified are
assigned here by rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Properties of each component.
COMPONENTS = {
    "common.object": ["presence", "editionable"],
    "common.source": ["text", "format", "occurrence_order", "path"],
    "table.column": ["definition", "data_type", "length", "length_semantics", "precision", "scale", "nullable", "default", "default_on_null", "identity", "virtual_expression", "visibility", "position", "collation"],
    "table.constraint": ["definition", "kind", "columns", "reference", "condition", "delete_rule", "enabled", "validation", "deferrable", "initially", "rely", "index_association"],
    "table.table_property": ["organization", "temporary", "on_commit", "tablespace", "storage", "logging", "compression", "parallel", "partitioning", "lob_storage", "external"],
    "table.partition": ["definition"],
    "table.comment": ["text"],
    "index.index_property": ["target", "unique", "kind", "keys", "direction", "visibility", "partitioning", "tablespace", "storage", "compression", "logging", "parallel", "domain_parameters"],
    "sequence.sequence_property": ["start_with", "increment_by", "min_value", "max_value", "cache", "cycle", "order", "scale", "extend", "shard", "session", "keep"],
    "view.output_column": ["definition"],
    "view.query_property": ["output_order", "projection", "source_references", "join", "where", "group_by", "having", "set_operators", "distinct", "with_clause", "analytic", "ordering", "row_limit", "check_option", "read_only", "force", "editioning"],
    "package_spec.routine": ["definition", "signature", "return_type"],
    "package_spec.parameter": ["definition", "name", "position", "mode", "data_type", "default", "nocopy"],
    "package_spec.type_declaration": ["definition"],
    "package_spec.constant": ["definition"],
    "package_spec.variable": ["definition"],
    "package_spec.cursor": ["definition"],
    "package_spec.exception_declaration": ["definition"],
    "package_spec.pragma": ["definition"],
    "package_spec.package_property": ["authid"],
    "package_body.routine": ["definition", "signature", "return_type"],
    "package_body.parameter": ["definition", "name", "position", "mode", "data_type", "default", "nocopy"],
    "package_body.type_declaration": ["definition"],
    "package_body.constant": ["definition"],
    "package_body.variable": ["definition"],
    "package_body.cursor": ["definition"],
    "package_body.exception_declaration": ["definition"],
    "package_body.pragma": ["definition"],
    "package_body.body_property": ["routine_body", "sql_statement", "condition", "assignment", "control_flow", "transaction_statement", "exception_handler", "raise", "call_reference", "dynamic_sql", "dynamic_sql_profile", "initialization"],
    "package_body.source": ["wrapped"],
    "procedure.procedure_property": ["signature", "transaction_statement", "exception_handler", "has_exception", "has_commit", "has_rollback"],
    "function.function_property": ["signature", "transaction_statement", "exception_handler", "has_exception", "has_commit", "has_rollback"],
    "trigger.trigger_property": ["target", "enabled_state"],
    "type.type_property": ["raw_definition"],
    "type_body.type_property": ["raw_definition"],
}
#: Raw definitions of components, which say nothing while the component survives.
ADD_OR_REMOVE = ["table.column.definition", "package_spec.routine.definition", "package_body.routine.definition"]
_PHYSICAL = {"tablespace", "storage", "logging", "compression", "parallel", "partitioning", "lob_storage", "external", "organization", "cache"}
_CONTRACT = {"data_type", "length", "precision", "scale", "nullable", "signature", "return_type", "mode", "position", "name"}
_LOGIC = {"routine_body", "sql_statement", "condition", "assignment", "control_flow", "call_reference", "dynamic_sql", "dynamic_sql_profile", "where", "join", "having", "projection"}


def category(family: str) -> str:
    last = family.rpartition(".")[2]
    if family.startswith("common."):
        return {"presence": "presence", "text": "source_text", "format": "presentation", "occurrence_order": "presentation", "path": "relocation"}.get(last, "configuration")
    if last == "start_with":
        return "observed_value"
    if last == "transaction_statement":
        return "transaction"
    if last in ("exception_handler", "raise"):
        return "exception"
    if family.startswith("table.comment"):
        return "documentation"
    for names, value in ((_PHYSICAL, "physical_configuration"), (_CONTRACT, "contract"), (_LOGIC, "logic")):
        if last in names:
            return value
    return "structural"


def names() -> list[str]:
    return [f"{c}.{p}" for c, properties in COMPONENTS.items() for p in properties]


def table(spark: SparkSession) -> DataFrame:
    """(family, category, may_modify): all can be modified; see ``ADD_OR_REMOVE`` for raw definitions."""
    return spark.createDataFrame([(f, category(f), True) for f in names()], "family string, category string, may_modify boolean")
