"""Identifiers: any spelling of a UUID to one form, and a compact binary key for shuffles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What may stand around the 32 hex digits.
_AROUND = r"(?U)^[\s{(\[]*(?:urn:uuid:)?[\s{(\[]*|[\s})\]]*$"


def hex_digits(c: Column) -> Column:
    """The 32 lowercase hex digits of a UUID in any spelling; null where the value is no UUID."""
    usual = F.replace(F.lower(c), F.lit("-"), F.lit(""))  # most values need no pattern to be cleaned
    other = F.replace(F.regexp_replace(F.lower(c), _AROUND, ""), F.lit("-"), F.lit(""))
    bare = lambda h: h.rlike(r"^[0-9a-f]{32}\z")
    return F.when(bare(usual), usual).when(bare(other), other)


def dashed(h: Column) -> Column:
    """32 hex digits in the 8-4-4-4-12 form."""
    return F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")  # names h once: it is evaluated once


def canonical_id(c: Column) -> Column:
    """Canonical form of an id. A value that is no UUID stays as it is, null stays null."""
    return F.coalesce(dashed(hex_digits(c)), c)


def pack_id(c: Column) -> Column:
    """Binary key: the 16 bytes of a UUID, else 17 zero bytes and the value's own bytes (so the two never meet)."""
    return F.coalesce(F.unhex(hex_digits(c)), F.concat(F.unhex(F.lit("00" * 17)), F.encode(c, "UTF-8")))


def unpack_id(b: Column) -> Column:
    """The canonical id behind ``pack_id``."""
    h = F.lower(F.hex(b))
    return F.when(F.octet_length(b) == 16, dashed(h)).otherwise(F.decode(F.substring(b, 18, 2**30), "UTF-8"))
