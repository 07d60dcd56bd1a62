"""Log positions: 64-bit numbers written as two hexadecimal halves, HIGH/LOW."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PATTERN = "^[0-9A-Fa-f]{1,8}/[0-9A-Fa-f]{1,8}$"


def lsn_parse(text: Column) -> Column:
    """DECIMAL(20,0), which holds all 64 unsigned bits; null for text that is no position."""
    half = lambda k: F.conv(F.split_part(text, F.lit("/"), F.lit(k)), 16, 10).cast("decimal(20,0)")
    value = half(1) * F.lit(4294967296).cast("decimal(20,0)") + half(2)
    return F.when(text.rlike(PATTERN), value.cast("decimal(20,0)"))


def lsn_parse_strict(text: Column) -> Column:
    """As lsn_parse, but text that is no position stops the query."""
    return F.coalesce(lsn_parse(text), F.raise_error(F.concat(F.lit("not a log position: "), text)).cast("decimal(20,0)"))


def lsn_format(value: Column) -> Column:
    """Upper-case halves without leading zeros; value is a BIGINT position."""
    return F.concat(F.hex(F.shiftrightunsigned(value, 32)), F.lit("/"), F.hex(value.bitwiseAND(F.lit(4294967295))))


def lsn_diff(newer: Column, older: Column) -> Column:
    return newer - older
