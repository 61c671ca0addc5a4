"""Column builders that bring keys, statuses and numbers into one comparable form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The code points that count as white space at the ends of a key (those of str.strip in Python).
WHITE_SPACE = "".join(
    map(
        chr,
        [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000],
    )
)


def strip(c: Column | str) -> Column:
    """The text without white space at either end; Spark's own trim takes blanks only."""
    return F.btrim(F.col(c) if isinstance(c, str) else c, F.lit(WHITE_SPACE))


def norm_key(c: Column | str) -> Column:
    """Keys compare trimmed and in lower case; a blank string is no value and becomes null."""
    s = F.lower(strip(c))
    return F.when(s != "", s)


def norm_upper(c: Column | str) -> Column:
    """As norm_key, in upper case (statuses)."""
    s = F.upper(strip(c))
    return F.when(s != "", s)


def norm_keys(c: Column | str) -> Column:
    """The distinct values of an array of keys, trimmed and in lower case, without nulls and blanks; a null array stays null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.array_distinct(F.filter(F.transform(c, norm_key), lambda x: x.isNotNull()))


def hundredths(c: Column | str) -> Column:
    """A confidence at two decimals as an integer of hundredths, halves up; null and NaN become null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c), F.floor(c * 100 + 0.5).cast("int"))
