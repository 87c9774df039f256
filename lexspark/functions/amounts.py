"""Amounts in free text: euros, grams, and plain numbers, in Estonian notation.

Modes are "eur", "g" and "n"; any other mode behaves as "n". Everything is a column expression: a document's amounts are
one array of structs, in text order, and no row leaves its task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspark.functions.text import BLANK, NBSP, utf16_length

#: What a number, a sign and a unit look like.
NUMBER = r"(?>[-\x{2212}]?[0-9](?:[0-9 .,\x{00A0}]*[0-9])?)"  # atomic: a shorter number is followed by a digit, never by a unit
NO_WORD_BEFORE = r"(?<![\p{L}\p{N}])"
EUROS = "eurot|euro|eur"
GRAMS = "grammides|grammi|gramm|gram"
#: An edge of a word of ASCII letters, digits and underscores.
EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
GAP = f"[{BLANK}]*"
DATES_TIMES_CASES = (
    r"(?<![.\-/:])(?!-?[0-9]{1,2}[.\-/][0-9]{1,2}[.\-/][0-9]{2,4})(?!-?[0-9]{4}[.\-/][0-9]{1,2}[.\-/][0-9]{1,2})"
    r"(?![0-9]{1,2}:[0-9]{2})(?![0-9]+-[0-9]+/[0-9]+)"
)
#: Marks put around matches while a text is split, and what stands for them in the text itself.
OPEN, CLOSE, SUBSTITUTE = "\ue000", "\ue001", "\ufffd"

MATCH = "struct<ord:int,raw:string,amount:double,decimals:int>"


def mode_of(mode: str) -> str:
    return mode if mode in ("eur", "g") else "n"


def amount_pattern(mode: str) -> str:
    """The regular expression of one amount with its unit."""
    kind = mode_of(mode)
    if kind == "eur":
        forms = [f"€{GAP}{NUMBER}", f"{NUMBER}{GAP}€", f"{NUMBER}{GAP}(?:{EUROS}){EDGE}", f"(?:{EUROS}){GAP}{NUMBER}"]
    elif kind == "g":
        # the dotted form first; a unit may stand before its number only if written out
        forms = [f"{NUMBER}{GAP}(?:g\\.?|{GRAMS}){EDGE}", f"(?:{GRAMS}){EDGE}{GAP}{NUMBER}"]
    else:
        return f"(?iu){NO_WORD_BEFORE}{DATES_TIMES_CASES}{NUMBER}"
    return f"(?iu){NO_WORD_BEFORE}(?:{'|'.join(forms)})"


def may_hold(text: Column, mode: str) -> Column:
    """A cheap test that rules out most texts without an amount."""
    kind = mode_of(mode)
    if kind == "eur":
        return (text.contains("€") | text.rlike("(?i)eur")) & text.rlike("[0-9]")
    return text.rlike("[gG]") & text.rlike("[0-9]") if kind == "g" else text.rlike("[0-9]")


def number_part(raw: Column) -> Column:
    """The number inside a match; units hold no digits."""
    return F.regexp_extract(raw, NUMBER, 0)


#: Fixed value: the white space that a number is written without when it is read; U+2212 is a minus.
SPACES = "\t\n\x0b\x0c\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def let(value: Column, body) -> Column:
    """body of the value, which is worked out once however often body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def _closed_up(number: Column) -> Column:
    return F.translate(number, "\u2212" + SPACES, "-")


def _value(s: Column) -> Column:
    """Of a number without white space."""
    comma_last = F.length(F.substring_index(s, ",", -1)) < F.length(F.substring_index(s, ".", -1))
    # the first comma becomes a dot
    pointed = lambda x: F.when(x.contains(","), F.concat(F.substring_index(x, ",", 1), F.lit("."), F.substr(x, F.instr(x, ",") + 1))).otherwise(x)
    dotted = (
        F.when(s.contains(".") & s.contains(","), F.when(comma_last, pointed(F.replace(s, F.lit("."), F.lit("")))).otherwise(F.replace(s, F.lit(","), F.lit(""))))
        .otherwise(pointed(s))
    )
    return F.regexp_extract(dotted, r"^-?[0-9]+([.][0-9]*)?", 0).try_cast("double")


def _decimals(s: Column) -> Column:
    """Of a number without white space."""
    return F.when(s.contains(".") | s.contains(","), F.length(F.substring_index(F.substring_index(s, ",", -1), ".", -1))).otherwise(0)


def parse_amount(number: Column) -> Column:
    """The value of a number: of dot and comma the later one is the decimal mark; a lone comma is one; the longest
    leading part that reads as a number counts. Null if there is none."""
    return let(_closed_up(number), _value)


def count_decimals(number: Column) -> Column:
    """Characters after the last dot or comma, white space aside; 0 without one."""
    return let(_closed_up(number), _decimals)


def extract_amounts(text: Column, mode: str) -> Column:
    """array<struct<ord, raw, amount, decimals>> in text order; ord counts from 0 over amounts that parse.

    In stages: each array holds what the next one's lambda names more than once.
    """
    raws = F.when(may_hold(text, mode), F.regexp_extract_all(text, F.lit(amount_pattern(mode)), F.lit(0)))
    numbers = F.transform(raws, lambda raw: F.struct(raw.alias("raw"), _closed_up(number_part(raw)).alias("s")))
    parsed = F.transform(numbers, lambda m: F.struct(m["raw"].alias("raw"), _value(m["s"]).alias("amount"), _decimals(m["s"]).alias("decimals")))
    kept = F.filter(parsed, lambda m: m["amount"].isNotNull())
    numbered = F.transform(kept, lambda m, i: F.struct(i.cast("int").alias("ord"), m["raw"].alias("raw"), m["amount"].alias("amount"), m["decimals"].alias("decimals")))
    return F.coalesce(numbered, F.array().cast(f"array<{MATCH}>"))


def segments(text: Column, mode: str) -> Column:
    """The text cut around its matches: even places hold what lies between them, odd places the matches."""
    clean = F.translate(text, OPEN + CLOSE, SUBSTITUTE * 2)
    return F.split(F.regexp_replace(clean, amount_pattern(mode), f"{OPEN}$0{OPEN}"), OPEN, -1)


#: Prefix sums are taken over chunks of so many parts, and inside a chunk.
CHUNK = 64


def with_places(df: DataFrame, mode: str, text: str = "text") -> DataFrame:
    """df with places, array<struct<ord, raw, index, match_len>>: the matches in text order, in UTF-16 units.

    All inside the row: the text is cut around its matches, and a part's start is the sum of the chunks before its own
    and of the parts before it there.
    """
    add = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)
    cut = df.withColumn("_parts", F.when(may_hold(F.col(text), mode), segments(F.col(text), mode)))
    sized = cut.withColumn("_sizes", F.transform("_parts", utf16_length))
    chunks = F.sequence(F.lit(0), F.floor((F.size("_sizes") - 1) / CHUNK).cast("int"))
    summed = sized.withColumn("_sums", F.when(F.size("_sizes") > 0, F.transform(chunks, lambda c: add(F.slice("_sizes", c * CHUNK + 1, F.lit(CHUNK))))))
    begun = summed.withColumn("_starts", F.transform("_sums", lambda _, c: add(F.slice("_sums", F.lit(1), c))))
    own = lambda i: F.floor(i / CHUNK).cast("int")
    start = lambda i: F.get("_starts", own(i)) + add(F.slice("_sizes", own(i) * CHUNK + 1, i % CHUNK))
    place = lambda i: F.struct(F.floor(i / 2).cast("int").alias("ord"), F.get("_parts", i).alias("raw"), start(i).alias("index"), F.get("_sizes", i).alias("match_len"))
    # _starts is named outside the lambda too: a column named once would be put in its place, and made for every match
    found = F.when((F.size("_parts") > 1) & F.col("_starts").isNotNull(), F.transform(F.sequence(F.lit(1), F.size("_parts") - 1, F.lit(2)), place))
    none = F.array().cast("array<struct<ord:int,raw:string,index:int,match_len:int>>")
    return begun.withColumn("places", F.coalesce(found, none)).drop("_parts", "_sizes", "_sums", "_starts")


# formatting


def _grouped(digits: Column) -> Column:
    """Whole digits with no-break spaces between groups of three, from five digits on."""
    return F.when(F.length(digits) < 5, digits).otherwise(F.regexp_replace(digits, r"(?<=[0-9])(?=(?:[0-9]{3})+$)", NBSP))


#: From here on doubles are whole and have no more digits than their exponent asks for.
LARGE = 1e16


def _large_digits(value: Column) -> Column:
    """All digits of a large double: those that tell it apart, and zeros."""
    size = F.abs(value)
    # the fewest digits that read back as the same double; a cast to string may give more
    written = [F.format_string(f"%.{n}e", size) for n in (14, 15, 16)]
    text = F.coalesce(*[F.when(w.try_cast("double") == size, w) for w in written[:2]], written[2])  # 1.25000000000000e+20
    digits = F.replace(F.substring_index(text, "e", 1), F.lit("."), F.lit(""))
    return F.rpad(digits, F.substring_index(text, "e", -1).try_cast("int") + 1, F.lit("0"))


def format_numeric(value: Column, decimals: Column | int | None, mode: str) -> Column:
    """The number in Estonian notation: decimal comma, no-break spaces between groups, U+2212 as minus.

    Euros have two decimals; other modes up to `decimals` (10 at most, and 10 if not given), without trailing zeros.
    """
    places = F.lit(10) if decimals is None else (F.lit(decimals) if isinstance(decimals, int) else F.least(decimals, F.lit(10)))
    exact = F.when(F.abs(value) < LARGE, value).try_cast("decimal(38,12)")
    if mode_of(mode) == "eur":
        rounded, digits, tail = F.round(exact, 2).cast("decimal(38,2)"), 2, ",00"
    else:
        rounded = let(exact, lambda x: F.coalesce(*[F.when(places == n, F.round(x, n).cast("decimal(38,10)")) for n in range(11)]))
        digits, tail = 10, ""

    def written(r: Column) -> Column:
        text = F.format_number(F.abs(r), digits)  # 12,345.60
        body = F.when(F.abs(r) < 10_000, F.translate(text, ".,", ",")).otherwise(F.translate(text, ".,", "," + NBSP))
        body = body if digits == 2 else F.rtrim(F.rtrim(body, F.lit("0")), F.lit(","))
        return F.concat(F.when((value < 0) & (r != 0), F.lit("\u2212")).otherwise(F.lit("")), body)

    minus = F.when(value < 0, F.lit("\u2212")).otherwise(F.lit(""))
    large = F.when(F.isnan(value), F.lit("NaN")).when(F.abs(value) == float("inf"), F.concat(minus, F.lit("\u221e"))).otherwise(F.concat(minus, _grouped(_large_digits(value)), F.lit(tail)))
    return F.when(F.abs(value) < LARGE, let(rounded, written)).when(value.isNotNull(), large)


def unit_short(mode: str) -> str:
    return {"eur": "€", "g": "g"}.get(mode, "")


def format_value(value: Column, decimals: Column | int | None, mode: str) -> Column:
    """format_numeric with its unit after a no-break space; no unit in mode n."""
    unit = unit_short(mode)
    text = format_numeric(value, decimals, mode)
    return F.concat(text, F.lit(NBSP + unit)) if unit else text


# in-row aggregates over a match array


def total_amount(matches: Column) -> Column:
    """The sum, left to right."""
    return F.aggregate(matches, F.lit(0.0), lambda a, m: a + m["amount"])


def max_decimals(matches: Column) -> Column:
    return F.aggregate(matches, F.lit(0), lambda a, m: F.greatest(a, m["decimals"]))


def count_label(active: Column, total: Column) -> Column:
    """'2', or '1 / 2' when some matches are excluded."""
    return F.when(active == total, active.cast("string")).otherwise(F.concat(active.cast("string"), F.lit(" / "), total.cast("string")))


def copy_list(matches: Column, mode: str) -> Column:
    """The amounts, formatted without unit, one a line."""
    return F.array_join(F.transform(matches, lambda m: format_numeric(m["amount"], m["decimals"], mode)), "\n")
