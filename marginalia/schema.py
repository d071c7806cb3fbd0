"""Row types of the document and note model."""

from __future__ import annotations

# Fixed values of the model's enumerations.
NOTE_STATUS = ("PENDING", "ACCEPTED", "REJECTED")
DERIVATION_TYPES = ("EXPLAIN", "SIMPLIFY", "SALIENCE", "EXTRACT", "SUMMARIZE", "SYNTHESIS")
BLOCK_TYPES = ("HEADING", "PARAGRAPH", "LIST", "TABLE", "FIGURE", "EQUATION", "CODE", "SEPARATOR")
COLORS = ("clay", "sage", "gold", "plum")
STYLES = ("bold", "italic", "underline")
EDIT_KINDS = ("TEXT_EDIT", "BLOCK_INSERT", "BLOCK_REMOVE", "BLOCK_RESTORE", "FORMAT", "LINK_ADD", "LINK_REMOVE")
SUMMARY_DEPTHS = ("insights", "layman", "professional")
ANNOTATIONS_TITLE = "Annotations"
PARSER_VERSION = 5
CONTEXT = 32

ANCHOR = "block_id string, start int, end int, quoted string, prefix string, suffix string"
SPAN = "struct<start:int,end:int>"
CITATION = "struct<start:int,end:int,ref_id:string,quoted:string>"
REFERENCE = "struct<id:string,label:string,text:string,url:string>"


# Tables, as DDL.
PROFILE = "background string, purpose string, application string"
NOTEBOOK = "id string, title string, profile struct<background:string,purpose:string,application:string>, created_at timestamp_ntz, updated_at timestamp_ntz"
SECTION = "id string, notebook_id string, title string, ord int, hidden boolean, parent_id string"
NOTE = "id string, section_id string, content string, status string, derivation_type string, color string, ord int, embedding array<float>, created_at timestamp_ntz, updated_at timestamp_ntz"
SOURCE = f"id string, note_id string, document_id string, {ANCHOR}, orphaned boolean"
DOCUMENT = f"id string, title string, font string, parser_version int, source_url string, file_hash string, file_data binary, glossary array<struct<term:string,definition:string,block_ids:array<string>>>, references array<{REFERENCE}>, created_at timestamp_ntz"
BLOCK = f"id string, document_id string, ord int, type string, text string, original_text string, html string, styles array<struct<start:int,end:int,style:string,quoted:string>>, citations array<{CITATION}>"
NOTEBOOK_DOCUMENT = "notebook_id string, document_id string, salience array<struct<block_id:string,start:int,end:int,quoted:string,prefix:string,suffix:string>>, summaries map<string,string>"
BLOCK_EDIT = "id string, document_id string, block_id string, kind string, before string, after string, meta map<string,string>, created_at timestamp_ntz"
DOC_LINK = "id string, from_document_id string, from_block_id string, from_start int, from_end int, from_quoted string, from_prefix string, from_suffix string, from_orphaned boolean, to_document_id string, to_block_id string, to_start int, to_end int, to_quoted string, to_prefix string, to_suffix string, to_orphaned boolean"
UPLOAD_CHUNK = "upload_id string, idx int, data binary, created_at timestamp_ntz"
FEEDBACK = "id string, category string, message string, page string, user_agent string, status string, created_at timestamp_ntz"
READER_PROFILE = "user_id string, background string, purpose string, application string"
