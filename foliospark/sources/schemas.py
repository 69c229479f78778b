"""Schemas of the engine's tables; readers never infer."""

from __future__ import annotations

from pyspark.sql import types as T

_CHUNK = "struct<text:string,heading_path:string,code_lang:string>"
DDL = {
    "source": "id string, name string, kind string, base_url string, owner string, trust_score decimal(3,2), "
    "poll_interval_minutes int, status string, created_at timestamp, updated_at timestamp",
    "document": "id string, source_id string, canonical_url string, title string, version_tag string, language string, "
    "first_seen_at timestamp, last_seen_at timestamp, last_changed_at timestamp, content_hash string, content string, "
    "fetch_etag string, fetch_last_modified string, fetch_last_status int, fetch_last_checked_at timestamp",
    "chunk": "id string, document_id string, chunk_index int, text string, token_count long, heading_path string, "
    "code_lang string, valid_from timestamp, valid_to timestamp",
    "chunk_embedding": "chunk_id string, model string, vector array<double>",
    "snapshot": "id string, source_id string, fetched_at timestamp, raw_blob_ref string, parser_version string, "
    "status string, error string",
    "change_event": "id string, source_id string, document_id string, canonical_url string, title string, "
    "event_type string, severity string, summary string, details struct<detector:string,keyword_family:string,"
    "changed_sections:array<string>,changed_section_count:int>, detected_at timestamp",
    "source_sync_request": "id string, source_id string, status string, requested_at timestamp, "
    "processed_at timestamp, error string",
    "telemetry_event": "id string, tenant_id string, endpoint string, auth_subject string, latency_ms int, "
    "http_status int, decision_status string, metadata map<string,string>, created_at timestamp",
    "fetched_page": "source_id string, url string, status int, html string, etag string, last_modified string",
    "ingested_document": f"source_id string, canonical_url string, title string, language string, version_tag string, "
    f"content string, chunks array<{_CHUNK}>",
}


def schema(table: str) -> T.StructType:
    return T.StructType.fromDDL(DDL[table])
