"""Vectors and payloads as JSON text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def vector_text(vector: Column) -> Column:
    """A vector as JSON; null for null."""
    return F.to_json(vector)


def vector_of(text: Column) -> Column:
    """The vector in a JSON text; empty for blank, null or unreadable text."""
    return F.coalesce(F.from_json(text, "array<float>"), F.array().cast("array<float>"))


def payload(text: Column, schema: str) -> Column:
    """A JSON object as a struct; one of nulls for blank, null or unreadable text."""
    return F.from_json(F.coalesce(text, F.lit("{}")), schema)
