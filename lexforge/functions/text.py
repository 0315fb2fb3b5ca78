"""Column functions for text whose edge cases differ from Spark's own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as text processing means it: ASCII, separators and the Unicode spaces.
SPACES = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
LINE_ENDS = "\r\n|[\n\x0b\x0c\r\x1c\x1d\x1e\x85\u2028\u2029]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, evaluated once however often it is named."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    """Both ends without any white space, not only blanks."""
    return F.btrim(text, F.lit(SPACES))


def blank(text: Column) -> Column:
    return F.coalesce(strip(text) == "", F.lit(True))


def lines(text: Column) -> Column:
    """Lines of a text; a line end at the very end opens no further line."""
    cut = F.split(text, LINE_ENDS)
    return F.when(text == "", F.slice(cut, 1, 0)).when(F.element_at(cut, -1) == "", F.slice(cut, F.lit(1), F.size(cut) - 1)).otherwise(cut)


def first_filled(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def to_number(text: Column) -> Column:
    """``bare_number`` of a text with white space around it."""
    return bare_number(strip(text))


def bare_number(text: Column) -> Column:
    """A double where a plain decimal, exponent, infinity or nan stands; null for what only some parsers take (1d, 0x1p3)."""
    form = r"(?i)^[+-]?(?:[0-9]+(?:_[0-9]+)*\.?(?:[0-9]+(?:_[0-9]+)*)?(?:e[+-]?[0-9]+)?|\.[0-9]+(?:_[0-9]+)*(?:e[+-]?[0-9]+)?|inf|infinity|nan)$"
    return F.when(text.rlike(form), F.replace(text, F.lit("_"), F.lit("")).try_cast("double"))


# Characters whose capital is written with several letters, and the one letter each keeps: itself, its title form, ẞ for ß.
_LONG = [c for c in map(chr, range(0x10000)) if len(c.upper()) > 1]
_SHORT = ["\u1e9e" if c == "\xdf" else c.title() if len(c.title()) == 1 else c for c in _LONG]


def capitals(text: Column) -> Column:
    """Capitals letter for letter, as DuckDB's ``upper`` writes them; Spark's own makes SS of ß."""
    whole = F.upper(text)
    single = F.transform(F.split(text, ""), lambda c: F.when(F.length(F.upper(c)) > 1, F.translate(c, "".join(_LONG), "".join(_SHORT))).otherwise(F.upper(c)))
    return F.when(F.length(whole) == F.length(text), whole).otherwise(F.array_join(single, ""))


def fill_zeros(text: Column, width: Column) -> Column:
    """Leading zeros up to a width, after a sign; never cuts."""
    sign = F.regexp_extract(text, r"^[+-]", 0)
    digits = F.substr(text, F.length(sign) + 1)
    room = F.greatest(F.length(digits), width - F.length(sign))
    return F.concat(sign, F.lpad(digits, room, F.lit("0")))


def map_lookup(column: Column, table: dict[str, str]) -> Column:
    """The table's value for a key; null for keys that it lacks."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), column)
