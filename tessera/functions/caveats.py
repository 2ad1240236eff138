"""What caveat codes mean for a consumer of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The next action of each caveat code.
NEXT_ACTION = {
    "precise_scip_index_unavailable": "install_or_configure_scip_provider_then_run_index_build",
    "parser_fact": "verify_with_read_before_editing",
    "inferred_candidate": "verify_with_read_before_editing",
    "semantic_provider_missing": "install_provider_or_use_parser_fallback",
    "semantic_provider_not_started": "install_provider_or_use_parser_fallback",
    "semantic_provider_partial": "accept_partial_or_retry",
    "semantic_provider_unsupported_language": "use_parser_or_text_fallback_for_this_language",
    "semantic_generation_stale": "wait_or_fallback_to_text",
    "semantic_refresh_in_progress": "wait_or_fallback_to_text",
    "semantic_index_stale": "wait_or_fallback_to_text",
    "live_overlay_used": "accept_may_be_stale_or_wait_for_reconcile",
    "watcher_lag_detected": "accept_may_be_stale_or_wait_for_reconcile",
    "config_fact_truncated": "reduce_scope_or_paginate",
    "config_parse_failure": "inspect_raw_source_for_config_errors",
    "config_edge_unresolved": "conservatively_treat_affected_roots_as_stale",
    "secret_masked": "do_not_use_masked_values_in_prompts_or_logs",
    "large_file_truncated": "reduce_scope_or_paginate",
    "diff_proof_truncated": "reduce_scope_or_paginate",
    "diff_proof_partial": "accept_may_be_stale_or_wait_for_reconcile",
    "provider_resource_limited": "accept_partial_or_retry",
    "provider_timeout": "accept_partial_or_retry",
    "candidate_budget_exceeded": "narrow_scope_or_language",
    "broad_query_guard": "narrow_query_or_increase_limit",
    "truncated_output": "reduce_scope_or_paginate",
    "binary_file_not_displayed": "use_external_tool_for_binary_inspection",
    "path_escapes_workspace_root": "reject_request_and_report",
    "read_failed": "verify_file_exists_and_is_readable",
    "invalid_line_range": "correct_line_range_and_retry",
    "no_match": "refine_query_or_accept_absence_is_not_proof",
    "cli_usage_error": "fix_request_and_retry",
    "unknown_tool": "fix_request_and_retry",
    "invalid_mcp_argument": "fix_request_and_retry",
    "unsupported_mcp_scope": "fix_request_and_retry",
    "generated_source_unverified": "treat_as_source_fact_not_precise",
    "partial_parse_syntax_errors": "inspect_files_for_syntax_errors",
    "ambiguous_results": "narrow_by_path_language_or_kind",
    "unsupported_search_mode": "use_alternative_search_mode",
    "workspace_path_resolve_failed": "verify_path_and_workspace_root",
    "failed_to_parse_native_scip_index": "install_or_configure_scip_provider_then_run_index_build",
    "saved_query_snapshot_mismatch": "replay_query_against_current_snapshot",
    "source_fact_fallback": "accept_fallback_reliability",
}
# Codes about what is available, and codes that are errors; all others are risks.
CAPABILITY = ["precise_scip_index_unavailable", "parser_fact", "inferred_candidate", "semantic_provider_missing", "semantic_provider_not_started", "semantic_provider_partial", "semantic_provider_unsupported_language"]
ERRORS = ["path_escapes_workspace_root", "read_failed", "invalid_line_range", "cli_usage_error", "unknown_tool", "invalid_mcp_argument", "unsupported_mcp_scope"]


def caveat_table(spark: SparkSession) -> DataFrame:
    """(code, severity, category, next_action); join it to rows that carry codes."""
    kind = {c: ("info", "capability") for c in CAPABILITY} | {c: ("error", "error") for c in ERRORS}
    rows = [(code, *kind.get(code, ("warning", "risk")), action) for code, action in NEXT_ACTION.items()]
    return spark.createDataFrame(rows, "code string, severity string, category string, next_action string")


# Warnings that begin like this, or are this, have a code of their own.
BEGINNINGS = {
    "failed to read ": "read_failed",
    "invalid line range: ": "invalid_line_range",
    "path escapes workspace root: ": "path_escapes_workspace_root",
    "precise_scip_index_unavailable": "precise_scip_index_unavailable",
    "failed to parse native SCIP index ": "failed_to_parse_native_scip_index",
    "failed to resolve path ": "workspace_path_resolve_failed",
    "partial parse with syntax errors: ": "partial_parse_syntax_errors",
}


def slug(text: Column) -> Column:
    """ASCII letters and digits in lower case, all else one underscore between
    them; "warning" if nothing is left."""
    joined = F.regexp_replace(F.regexp_replace(text, "[^A-Za-z0-9]+", "_"), "^_|_$", "")
    return F.when(joined == "", "warning").otherwise(F.translate(joined, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def warning_code(message: Column) -> Column:
    """Stable code of a warning: that of its beginning, else the slug of what
    stands before its first colon."""
    code = slug(F.split_part(message, F.lit(":"), F.lit(1)))
    for beginning, own in reversed(BEGINNINGS.items()):
        code = F.when(F.startswith(message, F.lit(beginning)), own).otherwise(code)
    return code
