"""Number and message formatting.

`format_number` rounds the binary value half to even, exactly as Python's fixed-point formats do, while
`format_string` and `round` work on the shortest decimal text.
"""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskflow.functions.times import col


def money(amount, digits=2) -> Column:
    """1234.5 -> 1,234.50"""
    return F.format_number(col(amount).cast("double"), digits)


def plain(amount, digits=2) -> Column:
    """1234.5 -> 1234.50"""
    return F.replace(money(amount, digits), F.lit(","), F.lit(""))


def rounded(number, digits) -> Column:
    """Rounding of the binary value, half to even; what is no finite number stays as it is."""
    value = col(number).cast("double")
    return F.coalesce(plain(value, digits).try_cast("double"), value)


def template(pattern: str, *values: Column) -> Column:
    """Fill {0}, {1}, ... of a message format; a null value makes the message null."""
    parts = []
    for piece in re.split(r"(\{\d+\})", pattern):
        slot = re.fullmatch(r"\{(\d+)\}", piece)
        if slot:
            parts.append(values[int(slot.group(1))].cast("string"))
        elif piece:
            parts.append(F.lit(piece))
    return F.concat(*parts)


def number_text(raw: Column) -> Column:
    """Text of a JSON number as it would be printed: integers as written, others as a double."""
    return F.when(raw.rlike(r"^-?\d+$"), raw).otherwise(raw.try_cast("double").cast("string"))


def bullets(items: Column, prefix: str, empty: str) -> Column:
    """One line per list element, or a fixed line for an empty list."""
    lines = F.array_join(F.transform(items, lambda x: F.concat(F.lit(prefix), x)), "\n")
    return F.when(F.size(items) > 0, lines).otherwise(F.lit(empty))
