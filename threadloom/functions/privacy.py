"""Pseudonyms by hashing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def short_hash(name: Column, salt: str = "") -> Column:
    """The first 16 hex digits of SHA-256; '' and null stay."""
    return F.when(name != "", F.substring(F.sha2(F.concat(F.lit(salt), name), 256), 1, 16)).otherwise(name)


def always_short_hash(name: Column) -> Column:
    """The same, but a missing name is hashed as an empty one."""
    return F.substring(F.sha2(F.coalesce(name, F.lit("")), 256), 1, 16)


def full_hash(name: Column) -> Column:
    """64 hex digits pass in lower case; all else is hashed."""
    return F.when(name.rlike("^[0-9a-fA-F]{64}$"), F.lower(name)).otherwise(F.sha2(name, 256))
