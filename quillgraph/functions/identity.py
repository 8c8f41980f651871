"""Identifiers: SHA-256 over parts that each end in NUL, shortened and prefixed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import normalise_newlines


def digest(*parts: Column, length: int = 64) -> Column:
    joined = F.concat(*[x for p in parts for x in (p.cast("string"), F.lit("\0"))])
    return F.substring(F.sha2(joined.cast("binary"), 256), 1, length)


def node_id(adapter: Column, key: Column) -> Column:
    return F.concat(F.lit("graph-node:"), digest(adapter, key, length=24))


def content_hash(content: Column) -> Column:
    return digest(normalise_newlines(content))


def revision_id(node: Column, hashed: Column, indexer: Column) -> Column:
    return F.concat(F.lit("graph-revision:"), digest(node, hashed, indexer, length=24))


def edge_id(source: Column, target: Column, kind: Column, revision: Column, derivation: Column) -> Column:
    """Follows the source's revision, so new content gives its edges new ids."""
    return F.concat(F.lit("graph-edge:"), digest(source, target, kind, revision, derivation, length=24))


def unit_id(session: Column, start: Column, line: Column, goal: Column) -> Column:
    return F.concat(F.lit("session-unit:"), digest(session, F.coalesce(start, F.lit("")), line, goal, length=20))


def document_id(source_set: Column, uri: Column, text: Column) -> Column:
    return F.concat(F.lit("source-doc:"), digest(source_set, uri, text, length=16))


def project_key(path: Column) -> Column:
    """The last folder as a slug, and ten hex digits of the whole path."""
    name = F.regexp_extract(path, r"([^/]*)/*$", 1)
    slug = F.regexp_replace(F.lower(F.regexp_replace(name, r"[^A-Za-z0-9]+", "-")), "^-+|-+$", "")
    return F.concat(F.when(slug == "", "project").otherwise(slug), F.lit("-"), F.substring(F.sha2(path.cast("binary"), 256), 1, 10))
