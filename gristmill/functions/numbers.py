"""Reading numbers from text fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Multipliers written after a number.
SUFFIXES = {"k": 1e3, "m": 1e6, "lakh": 1e5}


def has_digit(text: Column) -> Column:
    """True where a digit stands in the text; null and digit-free texts give False."""
    return F.coalesce(text.rlike(r"\d"), F.lit(False))


def read_count(text: Column) -> Column:
    """The first number as a count: commas and inner blanks group digits, `k`, `m` and `lakh` multiply.

    `6,28,789` -> 628789, `216+` -> 216, `19 reviews` -> 19, `1.2k` -> 1200; null where no digit stands.
    """
    t = F.lower(text)
    number = F.regexp_extract(t, r"(\d+(?:[,\s]\d+)*(?:\.\d+)?)", 1)
    value = F.regexp_replace(number, r"[,\s]", "").try_cast("double")
    unit = F.regexp_extract(t, r"\d\s*(k|m|lakh)\b", 1)
    factor = F.lit(1.0)
    for name, by in SUFFIXES.items():
        factor = F.when(unit == name, F.lit(by)).otherwise(factor)
    return value * factor


def read_count_sql(column: str) -> str:
    """`read_count` in the SQL of DuckDB."""
    number = f"nullif(regexp_extract(lower({column}), '([0-9]+([,\\s][0-9]+)*([.][0-9]+)?)', 1), '')"
    factors = " ".join(f"WHEN '{unit}' THEN {by:.0f}" for unit, by in SUFFIXES.items())
    return f"(try_cast(regexp_replace({number}, '[,\\s]', '', 'g') AS DOUBLE) * CASE regexp_extract(lower({column}), '[0-9]\\s*(k|m|lakh)\\b', 1) {factors} ELSE 1 END)"


def read_rating(text: Column) -> Column:
    """The first number as a rating; a single comma before at most two digits is a decimal comma.

    `4,0` -> 4.0, `3.7 *` -> 3.7, `4.2 out of 5` -> 4.2; null where no digit stands.
    """
    number = F.regexp_extract(text, r"(\d+(?:[.,]\d{1,2})?)", 1)
    return F.regexp_replace(number, ",", ".").try_cast("double")


def read_money(text: Column) -> Column:
    """The first number of a currency text with digit groups set off by commas; null where none stands."""
    number = F.regexp_extract(text, r"(\d[\d,]*(?:\.\d+)?)", 1)
    return F.regexp_replace(number, ",", "").try_cast("double")


def hash_below(rows: float, total: int) -> int:
    """The signed 64-bit number at or below which lie the hashes of about `rows` of `total` rows, at any size."""
    share = min(1.0, rows / max(total, 1))
    return min(-(2**63) + max(int(share * 2**64), 1 if rows > 0 else 0), 2**63 - 1)


def strict_number(text: Column) -> Column:
    """The text as a number; a text that is none fails the query, whatever the session says of ANSI. Null stays null."""
    wrong = F.concat(F.lit("not a number: "), text)
    return F.when(text.isNotNull(), F.coalesce(text.try_cast("double"), F.raise_error(wrong).cast("double")))


def interpolated(value: Column, low: Column, high: Column, to_low: float, to_high: float) -> Column:
    """The value's place between `low` and `high` carried over to [to_low, to_high]; `to_low` where both are equal."""
    return F.when(high == low, F.lit(to_low)).otherwise(F.lit(to_low) + (value - low) / F.nullif(high - low, F.lit(0.0)) * (to_high - to_low))
