"""Content identity: hashes of bytes, texts, sets of files, and cache keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_hash(content: Column) -> Column:
    """Lower-case hex SHA-256 of a text's UTF-8 bytes, or of a binary."""
    return F.sha2(content.cast("binary"), 256)


def set_hash(hashes: Column) -> Column:
    """Hash of a group of hashes that ignores their order and keeps duplicates (an aggregate)."""
    return content_hash(F.array_join(F.array_sort(F.collect_list(hashes)), ","))


def context_key(model: Column, context: Column, content: Column) -> Column:
    return F.concat_ws("|", model, context.cast("string"), content)


def last_document_key(model: Column, context: Column) -> Column:
    return F.concat_ws("|", F.lit("lastdoc"), model, context.cast("string"))


def profile_key(model: Column, context: Column) -> Column:
    return F.concat_ws("|", F.lit("profile"), model, context.cast("string"))
