"""Canonical form of 64-bit keys written in hexadecimal."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLANK = r"^\s+|\s+$"
_FORM = r"^(?:0[xX])?0*([0-9a-fA-F]{0,16})$"
_ANY = r"^(?:0[xX])?[0-9a-fA-F]+$"


def canonical_key(col: Column) -> Column:
    """16 lower-case hex digits, or null where the text is no 64-bit hexadecimal number.

    Blanks around, a 0x prefix, letter case and leading zeros do not matter: "0X0A", " a " and "000a" are one key.
    Null, empty text, a bare prefix, other characters and numbers over 64 bits give null.
    """
    t = F.regexp_replace(col, _BLANK, "")
    digits = F.lower(F.regexp_extract(t, _FORM, 1))
    ok = t.rlike(_ANY) & t.rlike(_FORM)
    return F.when(ok, F.lpad(digits, 16, "0"))


def key_as_long(key: Column) -> Column:
    """The canonical key's 64 bits as a signed long, for hashing and compact shuffles (its order is not the key's order)."""
    hi = F.conv(F.substring(key, 1, 8), 16, 10).cast("long")
    lo = F.conv(F.substring(key, 9, 8), 16, 10).cast("long")
    return F.shiftleft(hi, 32).bitwiseOR(lo)


def long_as_key(value: Column) -> Column:
    """Inverse of key_as_long."""
    return F.lpad(F.lower(F.hex(value)), 16, "0")


CANONICAL_KEY_SQL = (
    "CASE WHEN regexp_matches({t}, '^(0[xX])?[0-9a-fA-F]+$') AND regexp_matches({t}, '^(0[xX])?0*[0-9a-fA-F]{{0,16}}$') "
    "THEN lower(lpad(regexp_extract({t}, '^(?:0[xX])?0*([0-9a-fA-F]{{0,16}})$', 1), 16, '0')) END"
)


def canonical_key_sql(col: str) -> str:
    """The same expression for DuckDB, used by the SQL counterparts."""
    return CANONICAL_KEY_SQL.format(t=f"regexp_replace({col}, '^\\s+|\\s+$', '', 'g')")
