"""Declared schemas of the engine's tables, as DDL."""

from __future__ import annotations

FULL_DOCS = "id string, content string"
TEXT_CHUNKS = "id string, tokens int, content string, full_doc_id string, chunk_order_index int"
DOC_STATUS = "id string, status string, content_summary string, content_length int, chunks_count int, created_at timestamp, updated_at timestamp, error string"
NODES = "id string, entity_type string, description string, source_ids array<string>"
EDGES = "lo string, hi string, weight double, description string, keywords string, source_ids array<string>"
VECTORS = "id string, created_at double, vector array<float>"
CACHE = "mode string, args_hash string, answer string, q array<int>, low double, high double, original_prompt string, cache_type string"
GRAPHML_NODE = "_id string, data array<struct<_key:string,_VALUE:string>>"
GRAPHML_EDGE = "_source string, _target string, data array<struct<_key:string,_VALUE:string>>"
CUSTOM_GRAPH = (
    "entities array<struct<entity_name:string,entity_type:string,description:string,source_id:string>>, "
    "relationships array<struct<src_id:string,tgt_id:string,description:string,keywords:string,weight:double,source_id:string>>, "
    "chunks array<struct<content:string,source_id:string>>"
)


def names(ddl: str) -> list[str]:
    """Columns of a flat schema."""
    return [part.split()[0] for part in ddl.split(", ")]
