"""Schemas of the fact tables, as DDL, and the encodings of their keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPAN = "start_line INT, start_column INT, end_line INT, end_column INT"

SOURCE_FILE = "path STRING, language STRING, content STRING, content_hash STRING, n_lines INT, end_col INT, is_test BOOLEAN"
CAPTURE = f"file_path STRING, ord BIGINT, category STRING, entity STRING, name STRING, text STRING, {_SPAN}"
SCOPE = f"scope_id STRING, file_path STRING, parent_id STRING, name STRING, type STRING, ord BIGINT, {_SPAN}"
DEFINITION = (
    "symbol_id STRING, kind STRING, name STRING, file_path STRING, ord BIGINT, defining_scope_id STRING, body_scope_id STRING, owner_id STRING, "
    f"{_SPAN}, is_exported BOOLEAN, type_name STRING, return_type STRING, extends ARRAY<STRING>, generics ARRAY<STRING>, "
    "parameters ARRAY<STRUCT<symbol_id: STRING, name: STRING, type: STRING, default_value: STRING, optional: BOOLEAN>>, decorators ARRAY<STRING>, docstring STRING, "
    "static BOOLEAN, abstract BOOLEAN, async BOOLEAN, initial_value STRING, collection_source STRING, initialized_from_call STRING, "
    "callback STRUCT<is_callback: BOOLEAN, receiver_line: INT, receiver_column: INT>"
)
FUNCTION_COLLECTION = "collection_id STRING, file_path STRING, scope_id STRING, collection_type STRING, member_ord INT, member_key STRING, stored_function_id STRING, stored_reference STRING"
IMPORT_DEF = (
    f"symbol_id STRING, name STRING, file_path STRING, ord BIGINT, defining_scope_id STRING, import_path STRING, import_kind STRING, original_name STRING, is_reexport BOOLEAN, {_SPAN}"
)
REFERENCE = (
    f"file_path STRING, ord BIGINT, kind STRING, name STRING, scope_id STRING, {_SPAN}, keyword STRING, property_chain ARRAY<STRING>, access_type STRING, target_symbol_id STRING"
)
SESSION = "session_id STRING, started_at STRING, project_path STRING, client_name STRING, client_version STRING"
TOOL_CALL = "session_id STRING, tool_name STRING, called_at STRING, duration_ms BIGINT, success BOOLEAN, error_message STRING, arguments STRING, request_id STRING, tool_use_id STRING"
CHANGE_EVENT = "path STRING, op STRING, event_seq BIGINT, event_time TIMESTAMP, content STRING"

FACT_TABLES = {"scope": SCOPE, "definition": DEFINITION, "reference": REFERENCE, "import_def": IMPORT_DEF, "function_collection": FUNCTION_COLLECTION}

#: Names of what has none, and the kinds that can be called, exported or hold members. Fixed values.
ANONYMOUS, MODULE = "<anonymous>", "<module>"
CALLABLE_KINDS = "function", "method", "constructor"
EXPORTABLE_KINDS = "function", "class", "variable", "constant", "interface", "enum", "type", "type_alias", "namespace", "import"
LANGUAGES = "javascript", "typescript", "python", "rust"


def _span(p: str = "") -> list[str]:
    return [f"{p}start_line", f"{p}start_column", f"{p}end_line", f"{p}end_column"]


def symbol_id(kind: Column | str = "kind", file: str = "file_path", name: str = "name", prefix: str = "") -> Column:
    return F.concat_ws(":", kind, file, *_span(prefix), name)


def scope_id(kind: Column | str = "type", file: str = "file_path", prefix: str = "") -> Column:
    return F.concat_ws(":", kind, file, *_span(prefix))


def location_key(file: str = "file_path", prefix: str = "") -> Column:
    return F.concat_ws(":", file, *_span(prefix))


def reference_id(file: str = "file_path", name: str = "name") -> Column:
    return F.concat_ws(":", F.lit("ref"), file, "start_line", "start_column", name)


def symbol_ref(file: Column, line: Column, name: Column) -> Column:
    """What tools show: path:line#name."""
    return F.concat(file, F.lit(":"), line.cast("string"), F.lit("#"), name)


def type_id(category: str, parts: Column, *, ordered: bool) -> Column:
    """Composite type ids; members of unions and intersections are sorted."""
    return F.concat(F.lit(f"type:{category}:"), F.array_join(parts if ordered else F.array_sort(parts), "," if ordered else "|"))


def type_id_parts(id_: Column) -> Column:
    """Category and members of a composite type id."""
    body = F.regexp_extract(id_, "^type:[^:]*:(.*)$", 1)
    return F.struct(F.regexp_extract(id_, "^type:([^:]*):", 1).alias("category"), F.split(body, "[|,]").alias("members"))
