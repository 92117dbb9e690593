"""The named queries, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: The modules with queries, and their names; the SQL of a query is the module's constant NAME_SQL, if it has one.
QUERIES = {
    "ravelin.operators.sessions": ("chat_history_pairs", "asof_prev_user", "last_messages", "transcript_export", "session_sort_pinned", "session_merge", "session_mutations"),
    "ravelin.operators.library": ("library_items", "library_search_sort", "library_totals", "readiness", "doc_harvest", "attach_lookup"),
    "ravelin.operators.texts": ("speech_clean", "copy_clean", "sanitize_stream", "slug_title", "suggestion_rank", "html_escape", "provider_detect", "url_validate", "date_labels", "html_text", "size_labels", "word_wrap"),
    "ravelin.operators.citations": ("page_extract", "citation_normalize", "marker_join", "citation_dedup"),
    "ravelin.operators.retrieval": ("vector_topk", "bm25_topk", "rrf_fusion", "khop_1", "khop_2", "khop_3", "chunk_docs"),
    "ravelin.operators.verification": ("claim_verify", "quality_gate", "feedback_stats"),
    "ravelin.operators.streams": ("stream_fold", "ingestion_progress"),
    "ravelin.operators.chunks": ("stream_lines", "chunk_fold", "ingestion_stream", "selected_node", "list_steps", "term_suggestions"),
    "ravelin.operators.answers": ("rag_clean", "markdown_blocks"),
    "ravelin.operators.reports": ("markdown_report", "developer_export", "html_report", "pdf_report"),
    "ravelin.operators.workspace": ("voice_pick", "resource_footprint", "version_pointers", "source_toggle"),
    "ravelin.operators.ordered": ("line_ranks", "ship_frames"),
    "ravelin.operators.timing": ("tumbling_windows", "sliding_windows", "session_windows", "events_in_sessions", "orders_open"),
    "ravelin.operators.rollups": ("sales_rollup", "sales_sketches"),
    "ravelin.operators.objects": ("merged_settings", "text_splices"),
    "ravelin.operators.inline": ("inline_parts",),
    "ravelin.operators.scans": ("scanned_documents",),
    "ravelin.operators.logs": ("saved_configs",),
    "ravelin.operators.records": ("document_links", "metadata_cards", "listed_models", "session_ids", "table_list"),
    "ravelin.operators.service": ("reply_synthesis", "citation_fallback", "citation_tokens", "query_requests", "query_problems", "error_kinds", "upload_reports", "session_list", "stored_items", "saved_settings", "model_list", "pull_progress", "abort_ids", "drawer_actions", "archive_moves", "snapshot_kept", "latest_status", "persistence", "link_purge", "delete_guard", "name_matches", "suggestion_lists", "display_labels", "device_labels"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: getattr(importlib.import_module(m), n) for m, names in QUERIES.items() for n in names}


def oracle_sql() -> dict[str, str]:
    sql = {n: getattr(importlib.import_module(m), f"{n.upper()}_SQL", None) for m, names in QUERIES.items() for n in names}
    return {n: s for n, s in sql.items() if s}
