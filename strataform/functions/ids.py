"""Stable ids and hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def model_id(source_pass: str, kind: str, key: Column) -> Column:
    """kind, underscore and 16 hex digits of SHA-256 over pass, kind and key, joined by NUL."""
    return F.concat(F.lit(f"{kind}_"), F.substring(F.sha2(F.concat_ws(chr(0), F.lit(source_pass), F.lit(kind), key), 256), 1, 16))


def hash31(text: Column) -> Column:
    """The 32-bit polynomial hash h * 31 + code unit as eight hex digits; supplementary code points count as their two surrogates."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    units = F.flatten(
        F.transform(
            codes,
            lambda c: F.when(
                c >= 0x10000,
                F.array(F.lit(0xD800) + F.shiftright(c - 0x10000, 10), F.lit(0xDC00) + (c - 0x10000).bitwiseAND(0x3FF)),
            ).otherwise(F.array(c)),
        )
    )
    h = F.aggregate(units, F.lit(0).cast("long"), lambda acc, c: F.pmod(acc * 31 + c, F.lit(4294967296)))
    return F.lpad(F.lower(F.hex(h)), 8, "0")


def claim_id(subject: Column, predicate: Column, value: Column) -> Column:
    return F.concat(F.lit("claim_"), hash31(F.concat_ws(chr(0), subject, predicate, value)))


def contradiction_id(subject: Column, predicate: Column, values: Column) -> Column:
    """Values in binary order, joined by a pipe."""
    return F.concat(F.lit("contra_"), hash31(F.concat_ws(chr(0), subject, predicate, F.array_join(F.sort_array(values), "|"))))


def content_hash(*parts: Column) -> Column:
    """32 hex digits of SHA-256 over the canonical text of the parts."""
    return F.substring(F.sha2(F.concat_ws(chr(0), *parts), 256), 1, 32)
