"""Deterministic identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def point_id(repo: Column, path: Column, place: Column) -> Column:
    """SHA-1 of repo, path and place, null-separated, written as a UUID."""
    h = F.sha1(F.concat_ws("\u0000", repo, path, place.cast("string")))
    return F.concat_ws("-", h.substr(1, 8), h.substr(9, 4), h.substr(13, 4), h.substr(17, 4), h.substr(21, 12))


def signature_hash(signature: Column) -> Column:
    return F.left(F.sha1(signature), F.lit(12))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def span_id(*parts: Column, length: int = 16) -> Column:
    """The first hexadecimal digits of a SHA-256 over the parts, unit-separated."""
    return F.left(F.sha2(F.concat_ws("\u001f", *parts), 256), F.lit(length))
