"""Column expressions shared by the operators that use Spark expressions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)``, with ``value`` computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """The maximal runs of characters that are no ASCII white space; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda word: word != "")


CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lower_ascii(text: Column) -> Column:
    """The text with A-Z lower-cased and no other character changed."""
    # A text of ASCII characters only has no other capitals, and lower() is the faster way.
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, CAPITALS, CAPITALS.lower()))
