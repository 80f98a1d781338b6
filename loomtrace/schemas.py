"""The tables of a lake (D1): columns, keys, and how repeated keys are settled."""

from __future__ import annotations

import re
from dataclasses import dataclass


@dataclass(frozen=True)
class Table:
    ddl: str
    key: tuple[str, ...]
    #: "first": rows with a known key are ignored; "last": the newest row of a key counts.
    rule: str = "first"
    #: Rows are also looked up by this column, and kept in its order when commits are put together.
    by: str | None = None

    @property
    def columns(self) -> list[str]:
        return [c.split()[0] for c in re.split(r", (?![^<]*>)", self.ddl)]


TABLES: dict[str, Table] = {
    "sessions": Table("session_id string, summary string, first_prompt string, message_count int, created timestamp_ntz, modified timestamp_ntz, git_branch string, project_path string", ("session_id",), "last"),
    "records": Table("uuid string, session_id string, type string, timestamp timestamp_ntz, parent_uuid string, raw string", ("uuid",), by="session_id"),
    "history": Table("timestamp long, display string, session_id string, project string", ("timestamp", "session_id")),
    "file_mtimes": Table("file_path string, mtime_ns long, size_bytes long", ("file_path",), "last"),
    "summaries": Table("summary_id string, session_id string, kind string, condensation_order int, content string, token_count int, parent_ids array<string>, message_uuids array<string>, file_ids array<string>, created_at long", ("summary_id",), by="session_id"),
    "blob_meta": Table("file_id string, session_id string, token_count int, original_size int, created_at long", ("file_id",), by="session_id"),
    "malformed_lines": Table("file_path string, byte_offset long, line_text string, ingested_at long", ("file_path", "byte_offset")),
    "schema_meta": Table("key string, value string", ("key",), "last"),
    "record_embeddings": Table("uuid string, embedding array<float>, embedded_at long", ("uuid",)),
    "summary_embeddings": Table("summary_id string, embedding array<float>, embedded_at long", ("summary_id",)),
    "record_fts": Table("uuid string, text string", ("uuid",), "snapshot"),
    "supersessions": Table("superseding_id string, superseded_id string, source string, created_at long", ("superseding_id", "superseded_id")),
    "sweeps": Table("pass string, began_ms long, status string, embedded int, fts int, error string", ("pass",)),
    "blobs": Table("file_id string, content string", ("file_id",)),
}
