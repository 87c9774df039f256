"""Column functions on strings that several jobs share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the characters that count as white space, as the inside of a regular expression's class.
BLANK = r"\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
NBSP = "\u00a0"


def strip_blank(c: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(c, f"^[{BLANK}]+|[{BLANK}]+$", "")


def utf16_length(c: Column) -> Column:
    """Length in UTF-16 units: characters beyond the basic plane count twice."""
    return (F.length(c) + F.length(F.regexp_replace(c, r"[^\x{10000}-\x{10FFFF}]", ""))).cast("int")


def escape_html(c: Column) -> Column:
    """Escapes &, < and >; quotes stay."""
    out = c
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(plain), F.lit(entity))
    return out


def padded(number: Column, width: int) -> Column:
    """The number with zeros in front up to a width; longer numbers stay whole."""
    text = number.cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def counted(number: Column, one: str, many: str) -> Column:
    """'1 aasta', '2 aastat': a number and its unit, joined by a no-break space."""
    return F.concat(number.cast("string"), F.lit(NBSP), F.when(number == 1, one).otherwise(many))
