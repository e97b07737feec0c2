"""Column functions on strings. All of them stay in the JVM."""

from __future__ import annotations

import json
from collections.abc import Callable
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptorium.constants import SPACE, SPACE_CHARACTERS


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times in ``body``.

    A projected alias may be inlined into a lambda and then be computed again for every array element;
    a lambda variable is not.
    """
    return F.transform(F.array(value), body).getItem(0)


def strip(text: Column) -> Column:
    """Remove leading and trailing Unicode whitespace."""
    return F.btrim(text, F.lit(SPACE_CHARACTERS))


def words(text: Column) -> Column:
    """Split at runs of Unicode whitespace, without empty words."""
    return F.filter(F.split(text, f"{SPACE}+"), lambda word: word != "")


#: All named character references of HTML, as the standard library lists them.
_NAMED = json.dumps({name[:-1]: text for name, text in html5.items() if name.endswith(";")})
_REFERENCE = "^(#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]*);"


def decode_entities(text: Column) -> Column:
    """Named and numeric character references as characters, each decoded once; unknown ones stay."""

    def character(name: Column) -> Column:
        digits = F.when(name.rlike("^#[0-9]"), F.conv(F.substring(name, F.lit(2), F.length(name)), 10, 16))
        digits = digits.when(name.startswith("#"), F.substring(name, F.lit(3), F.length(name)))
        numeric = F.decode(F.unhex(F.lpad(digits, 8, "0")), "UTF-32")
        return F.when(name.startswith("#"), numeric).otherwise(F.element_at(F.from_json(F.lit(_NAMED), "map<string,string>"), name))

    def piece(each: Column, i: Column) -> Column:
        def decoded(name: Column) -> Column:
            return F.when(name != "", F.concat(character(name), F.substring(each, F.length(name) + 2, F.length(each))))

        found = let(F.regexp_extract(each, _REFERENCE, 1), decoded)
        return F.when(i == 0, each).otherwise(F.coalesce(found, F.concat(F.lit("&"), each)))

    return F.when(text.contains("&"), F.array_join(F.transform(F.split(text, "&"), piece), "")).otherwise(text)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def positions(first: Column | int, last: Column) -> Column:
    """``[first, ..., last]``, empty when ``last < first``."""
    first = first if isinstance(first, Column) else F.lit(first)
    return F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
