"""Schemas of the catalog, ledger, index and evaluation tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T


SCHEMAS: dict[str, str] = {
    "papers": (
        "id string, title string, abstract string, year int, venue_id string, venue_year int, paper_type string, volume string, "
        "issue string, pages string, publication_date date, status string, doi string, arxiv_id string, fingerprint string, "
        "parser_backend string, created_at timestamp, updated_at timestamp, deleted_at timestamp"
    ),
    "authors": "id string, name string, normalized_name string",
    "venues": "id string, name string, normalized_name string, kind string",
    "venue_editions": "id string, venue_id string, year int, title string",
    "paper_authors": "paper_id string, author_id string, author_order int",
    "tags": "id string, name string, normalized_name string",
    "paper_tags": "paper_id string, tag_id string, kind string",
    "paper_files": (
        "id string, paper_id string, kind string, object_key string, filename string, sha256 string, size bigint, is_primary boolean, "
        "created_at timestamp, deleted_at timestamp"
    ),
    "paper_chunks": (
        "id string, paper_id string, chunk_index int, text string, section string, section_title string, page_start int, page_end int, "
        "token_count int, char_count int, embedding_model string"
    ),
    "chunk_index": (
        "chunk_id string, paper_id string, chunk_index int, title string, text string, section string, section_title string, "
        "page_start int, page_end int, authors array<string>, venue string, venue_year int, year int, paper_type string, doi string, "
        "arxiv_id string, tags array<string>, ieee_terms array<string>, author_terms array<string>, dynamic_index_terms array<string>, "
        "source_tags array<string>, identifiers array<string>, publication_date string, embedding array<float>, embedding_model string, "
        "parser_backend string"
    ),
    "ingestion_jobs": (
        "id string, paper_id string, stage string, status string, progress int, error_code string, payload string, "
        "created_at timestamp, updated_at timestamp, finished_at timestamp"
    ),
    "paper_sources": (
        "id string, paper_id string, source_type string, source_ref string, match_status string, match_method string, "
        "match_confidence double, imported_at timestamp, raw string"
    ),
    "paper_identifiers": "id string, paper_id string, scheme string, value string, normalized_value string, is_primary boolean",
    "paper_field_provenance": (
        "id string, paper_id string, source_id string, field string, value string, confidence double, is_current boolean, "
        "decided_by string, decided_at timestamp, decision_at timestamp, decision string"
    ),
    "paper_degradations": 
        "paper_id string, stage string, code string, detail string, occurrences bigint, first_seen timestamp, last_seen timestamp, resolved_at timestamp"
    ,
    "search_queries": (
        "id string, query string, mode string, top_k int, latency_ms double, created_at timestamp, "
        "results array<struct<paper_id: string, rank: int, score: double>>"
    ),
    "metadata_index_updates": "paper_id string, revision bigint, attempts int, enqueued_at timestamp",
    "graded_labels": "query_id string, paper_id string, grade int",
    "rankings": "query_id string, paper_id string, rank int",
}


class SchemaMismatch(ValueError):
    """A table has columns that its schema does not declare, lacks some, or has other types."""


def schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(SCHEMAS[name])


def strict(df: DataFrame, name: str) -> DataFrame:
    """df in the column order of SCHEMAS[name]; undeclared, missing or differently typed columns raise."""
    wanted = {f.name: f.dataType for f in schema(name).fields}
    have = {f.name: f.dataType for f in df.schema.fields}
    wrong = [c for c in have if c not in wanted] + [c for c in wanted if c not in have]
    wrong += [c for c in wanted if c in have and wanted[c].simpleString() != have[c].simpleString()]
    if wrong:
        raise SchemaMismatch(f"{name}: {sorted(set(wrong))}")
    return df.select(*wanted)
