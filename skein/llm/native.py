"""Column expressions that the native operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The six ASCII white-space characters: \x20 and \x09 to \x0D.
WHITE = " \t\n\x0b\x0c\r"


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else; pure ASCII takes the byte-wise path of ``lower``."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def lines_of(text: Column) -> Column:
    """The text split at \\n; null and empty texts have one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def text_key(text: Column) -> Column:
    """Tells apart rows that share an id but not a text."""
    return F.xxhash64(F.coalesce(text, F.lit("")), text.isNull())


def row_key(key: Column, text: Column) -> Column:
    """Tells apart rows that differ in id or text."""
    return F.xxhash64(key, text_key(text))


def sha256_hex(text: Column) -> Column:
    return F.sha2(text, 256)
