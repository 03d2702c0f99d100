"""Column helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.strip() takes for white space.
WHITE = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0        "
    "        　"
)


def strip(c: Column | str) -> Column:
    """Trim every kind of white space at both ends; stays in the JVM."""
    c = F.col(c) if isinstance(c, str) else c
    return F.btrim(c, F.lit(WHITE))


def strip_or_empty(c: Column | str) -> Column:
    """Like strip, with null taken as the empty text."""
    return F.coalesce(strip(c), F.lit(""))


def fold_case(c: Column | str) -> Column:
    """Case folding close to Python's casefold: lower case, sharp s as ss."""
    c = F.col(c) if isinstance(c, str) else c
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def instant_us(c: Column | str) -> Column:
    """ISO text with an offset as microseconds since 1970; null where it does not parse."""
    return F.unix_micros(strip(c).try_cast("timestamp"))
