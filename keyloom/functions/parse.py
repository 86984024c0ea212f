"""Strict number parsing and index clamping, as columns and as Python functions of the same meaning."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

INT = r"^[+-]?[0-9]+$"
FLOAT = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$|^[+-]?0[xX]([0-9a-fA-F]+(\.[0-9a-fA-F]*)?|\.[0-9a-fA-F]+)[pP][+-]?[0-9]+$|^[+-]?(?i:inf|infinity)$|^(?i:nan)$"
_HEX = re.compile(r"[+-]?0[xX](?:[0-9a-fA-F]+(?:\.[0-9a-fA-F]*)?|\.[0-9a-fA-F]+)[pP][+-]?[0-9]+", re.ASCII)
MAX, MIN = 2**63 - 1, -(2**63)


def int_column(text: Column) -> Column:
    """BIGINT of plain decimal text, else null (blanks, suffixes and overflow too)."""
    return F.when(text.rlike(INT), text.try_cast("bigint"))


def float_column(text: Column) -> Column:
    """DOUBLE of decimal or hexadecimal text (this with an exponent), infinities and NaN, else null; finite text that overflows is null."""
    low = F.lower(text)
    named = F.when(low.rlike(r"^\+?inf"), F.lit(math.inf)).when(low.rlike("^-inf"), F.lit(-math.inf)).when(low == "nan", F.lit(math.nan))
    number = text.try_cast("double")
    finite = F.when(F.abs(number) != math.inf, number)
    return F.when(text.rlike(FLOAT), F.coalesce(named, finite))


def parse_int(text: str) -> int | None:
    if not re.fullmatch(r"[+-]?[0-9]+", text, re.ASCII):
        return None
    n = int(text)
    return n if MIN <= n <= MAX else None


def parse_float(text: str) -> float | None:
    if _HEX.fullmatch(text):
        try:
            return float.fromhex(text)
        except OverflowError:
            return None
    if not re.fullmatch(r"[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|[+-]?(?:inf|infinity)|nan", text, re.ASCII | re.IGNORECASE):
        return None
    x = float(text)
    return None if math.isinf(x) and "n" not in text.lower() else x


def wrap(n: int) -> int:
    """Signed 64-bit wrap-around."""
    return (n - MIN) % 2**64 + MIN


def incremented(value: Column) -> Column:
    """value + 1 with wrap-around; a plain sum raises at the maximum."""
    return F.when(value == MAX, F.lit(MIN)).otherwise(value + 1)


def clamp_columns(start: Column, stop: Column, n: Column) -> tuple[Column, Column]:
    """Inclusive index bounds of a range over n items; empty when the first exceeds the second."""
    lo = F.greatest(F.when(start < 0, start + n).otherwise(start), F.lit(0))
    hi = F.least(F.when(stop < 0, stop + n).otherwise(stop), n - 1)
    return lo, hi


def clamp(start: int, stop: int, n: int) -> tuple[int, int]:
    return max(start + n if start < 0 else start, 0), min(stop + n if stop < 0 else stop, n - 1)


def alive(expires_at_us: Column, now_us: Column) -> Column:
    return expires_at_us.isNull() | (now_us < expires_at_us)


def ttl_column(key_alive: Column, expires_at_us: Column, now_us: Column) -> Column:
    """-2 without key, -1 without deadline, else whole seconds left."""
    left = F.floor((expires_at_us - now_us) / 1_000_000).cast("bigint")
    return F.when(~key_alive, F.lit(-2).cast("bigint")).when(expires_at_us.isNull(), F.lit(-1).cast("bigint")).otherwise(left)
