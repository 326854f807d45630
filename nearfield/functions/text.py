"""Text keys of the embedding cache."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalized(text: Column) -> Column:
    """Lower case, white space runs as one blank, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def cache_key(text: Column, model: Column | str, version: Column | str) -> Column:
    """SHA-256 of normalised text, model and version."""
    parts = [normalized(text), *[F.lit(x) if isinstance(x, str) else x for x in (model, version)]]
    return F.sha2(F.concat_ws("|", *parts).cast("binary"), 256)
