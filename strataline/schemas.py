"""Schemas of the code-intelligence tables, and the values their enumerations take."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VERSION = 18

TABLES = {
    "files": "id long, path string, content_hash string, language string, indexed_at long, size_bytes long, is_test boolean, subsystem_id string, repo_module_id string",
    "symbols": "id long, stable_id string, file_id long, name string, qualified_name string, kind string, visibility string, is_exported boolean, line_start int, line_end int, "
    "col_start int, col_end int, byte_start long, byte_end long, parent_id string, signature string, doc_comment string, metadata string",
    "edges": "id long, source_id string, target_id string, kind string, file_id long, line int, col int, confidence string, metadata string",
    "imports": "id long, source_file_id long, target_file_id long, import_path string, is_type_only boolean, line int",
    "commits": "hash string, author_name string, author_email string, authored_at long, subject string",
    "file_changes": "id long, commit_hash string, file_path string, status string, rename_from string",
    "test_links": "test_file_id long, source_symbol_stable_id string, confidence string",
    "channel_hits": "id long, symbol_stable_id string, file_id long, kind string, value string, line int, metadata string",
    "api_endpoints": "id long, file_path string, path_pattern string, http_method string, symbol_stable_id string, role string, framework string, line int",
    "cross_project_edges": "id long, source_project string, source_stable_id string, target_project string, target_stable_id string, kind string, confidence string, metadata string",
    "embedding_meta": "symbol_stable_id string, symbol_id long, embed_text string, embed_hash string",
    "symbol_embeddings": "symbol_id long, embedding array<float>",
    "flows": "id long, name string, description string, root_stable_id string, symbol_ids array<string>, model string, generated_at long",
    "duplicates": "id long, symbol_a_id long, symbol_b_id long, similarity double, confirmed boolean, description string",
    "subsystems": "id string, name string, description string, member_file_ids array<long>, conductance double, generated_at long, generated_for_commit string",
    "repo_modules": "id string, name string, kind string, manifest_path string, root_dir string, module_path string",
    "symbol_summaries": "symbol_stable_id string, summary string, model string, generated_at long, source_hash string",
    "pull_requests": "number long, title string, state string, author string, body string, base_ref string, head_ref string, created_at long, updated_at long, merged_at long, url string, files_complete boolean",
    "pr_files": "pr_number long, file_path string, additions long, deletions long",
    "issues": "number long, title string, state string, author string, body string, labels array<string>, created_at long, updated_at long, closed_at long, url string",
    "meta": "key string, value string",
}

# Enumerations of the data model
SYMBOL_KINDS = ("function", "class", "method", "interface", "type", "variable", "module", "enum", "property")
EDGE_KINDS = ("calls", "contains", "extends", "type_ref", "passed_as", "dispatches_to", "instantiates", "field_access")
LIVENESS_KINDS = ("calls", "extends", "type_ref", "passed_as", "dispatches_to", "instantiates", "field_access")
FAST_TRACE_KINDS = ("calls", "passed_as", "dispatches_to", "instantiates")
CONFIDENCE = ("resolved", "heuristic", "unresolved")
CHANGE_STATUS = ("A", "M", "D", "R")
CHANNEL_KINDS = ("sql_table", "queue_topic", "env_var", "graphql_type", "openapi_type")
CALLABLE_KINDS = ("function", "method")
DEAD_KINDS = ("function", "class", "method", "interface", "type", "enum")
EXPORTED_KINDS = ("function", "class", "interface", "type", "enum")

_ENUMS = {
    "symbols": {"kind": SYMBOL_KINDS}, "edges": {"kind": EDGE_KINDS, "confidence": CONFIDENCE}, "file_changes": {"status": CHANGE_STATUS},
    "test_links": {"confidence": ("imported", "called")}, "api_endpoints": {"role": ("client", "server")},
}


def violations(df: DataFrame, name: str) -> DataFrame:
    """Rows of a table whose enumerated columns hold another value (nulls are no violation)."""
    bad = F.lit(False)
    for col, values in _ENUMS.get(name, {}).items():
        bad = bad | (F.col(col).isNotNull() & ~F.col(col).isin(*values))
    return df.where(bad)
