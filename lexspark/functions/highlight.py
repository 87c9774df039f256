"""Marked-up text: search hits and annotated documents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexspark.functions.amounts import CLOSE, OPEN, SUBSTITUTE, segments
from lexspark.functions.text import escape_html

#: Fixed value: the characters that a query escapes to stand for themselves.
SPECIAL = r"([.*+?^${}()|\[\]\\])"


def query_pattern(q: Column) -> Column:
    """A case-insensitive pattern that matches the query literally."""
    return F.concat(F.lit("(?iu)"), F.regexp_replace(q, SPECIAL, r"\\$1"))


def highlight(text: Column, q: Column) -> Column:
    """The text, escaped, with every hit of q in <mark>; an empty q only escapes. Hits are found in the raw text."""
    clean = F.translate(text, OPEN + CLOSE, SUBSTITUTE * 2)
    marked = F.regexp_replace(clean, F.when(q == "", F.lit("(?!)")).otherwise(query_pattern(q)), F.lit(f"{OPEN}$0{CLOSE}"))
    escaped = escape_html(marked)
    return F.replace(F.replace(escaped, F.lit(OPEN), F.lit("<mark>")), F.lit(CLOSE), F.lit("</mark>"))


def annotate(text: Column, excluded_ords: Column, mode: str) -> Column:
    """The text with each amount marked by its number, excluded ones by a class as well.

    Without amounts the text is only escaped; otherwise a last line break gets a space after it, and an empty span ends
    the text.
    """
    parts = segments(text, mode)

    def mark(part: Column, place: Column) -> Column:
        ord_ = F.floor(place / 2).cast("int")
        kind = F.when(F.array_contains(excluded_ords, ord_), F.lit(' class="excluded"')).otherwise(F.lit(""))
        marked = F.concat(F.lit("<mark"), kind, F.lit(' data-idx="'), ord_.cast("string"), F.lit('">'), escape_html(part), F.lit("</mark>"))
        return F.when(place % 2 == 1, marked).otherwise(escape_html(part))

    body = F.array_join(F.transform(parts, mark), "")
    tail = F.when(text.endswith("\n"), F.lit(" ")).otherwise(F.lit(""))
    return F.when(F.size(parts) > 1, F.concat(body, tail, F.lit("<span></span>"))).otherwise(escape_html(text))
