"""Table schemas and versions. Schemas are fixed in code and never inferred."""

from __future__ import annotations

SCHEMA = 1
TABLE_VERSION = 1

NOTE_FILES = "key string, file string, abs string, size bigint, mtime_ms bigint"
LEFT_OUT = "key string, reason string, size bigint, mtime_ms bigint, abs string"
NOTE_BYTES = "key string, content binary, folder_in_prefix boolean"
PASSAGES = "key string, n int, title string, trail array<string>, heads array<string>, head_repeats boolean, line int, text string, embed_text string, recovered boolean, flags array<string>"
VECTORS = "key string, n int, vector array<float>"
MANIFEST_NOTES = "key string, sha256 string, size bigint, mtime_ms bigint, racy boolean, passages int, folder_in_prefix boolean, flagged int, file string"
MANIFEST_META = "schema int, stamp bigint, chunker_version int, settings_hash string, model string, dimensions int, notes bigint, passages bigint"
LEFT_OUT_KEPT = "note_hash string, reason string, size bigint, mtime_ms bigint, racy boolean"
POSTINGS = "key string, n int, term string, tf int"
DOC_STATS = "key string, n int, doc_len int"
CHECKS = "name string, ok boolean, detail string"
