"""Scalar expressions shared by the operators; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clean_digest(c: Column | str) -> Column:
    """Digests are compared lower-case and trimmed of any white space; null stays null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.lower(F.trim(c, F.lit(" \t\r\n\f\v")))


def once(df: DataFrame, id_col: str) -> DataFrame:
    """Rows delivered twice share an id and are one record."""
    return df.dropDuplicates([id_col])


def strip_version(c: Column) -> Column:
    """Label without the part from its first '.' up to its first ':'.

    Unchanged if either is missing. If the '.' comes after the ':' a part of the label is repeated, as in the
    inventory's rule (prefix up to the dot, then everything from the colon)."""
    dot, colon = F.instr(c, "."), F.instr(c, ":")
    return F.when((dot > 0) & (colon > 0), F.concat(F.substring_index(c, ".", 1), F.substr(c, colon))).otherwise(c)


def package_prefix(c: Column) -> Column:
    """Up to the first '-', else up to the first '.'; null where the label has neither."""
    return (
        F.when(F.instr(c, "-") > 0, F.substring_index(c, "-", 1))
        .when(F.instr(c, ".") > 0, F.substring_index(c, ".", 1))
    )


def append_suffix(c: Column, suffix: str) -> Column:
    """Null stays null."""
    return F.concat(c, F.lit(suffix))


def capitalise(c: Column) -> Column:
    """First letter upper-case, the rest as it is."""
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 1 << 30))


def safe_item(array: Column, at: int) -> Column:
    """The element at a place from 0; null outside."""
    return F.get(array, at)


def contains_literal(c: Column, needle: str) -> Column:
    """A literal search, nothing in the needle is special (X11)."""
    return F.contains(c, F.lit(needle))


def escape_digest(raw: Column) -> Column:
    """Raw digests as lower-case hex, which sorts as the bytes do."""
    return F.lower(F.hex(raw))


def seeded_bits(*key: Column, seed: int = 42) -> Column:
    """Reproducible pseudo-random bits per row."""
    return F.xxhash64(F.lit(seed), *key)
