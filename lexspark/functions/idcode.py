"""Personal ID codes of eleven digits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The weights of the two checksum rounds, and the messages.
WEIGHTS = ((1, 2, 3, 4, 5, 6, 7, 8, 9, 1), (3, 4, 5, 6, 7, 8, 9, 1, 2, 3))
WRONG_LENGTH = "Isikukood peab olema 11 numbrit"
WRONG_CENTURY = "Esimene number peab olema 1–6"
WRONG_DATE = "Isikukoodi kuupäev on vigane"
CHECKED, UNCHECKED = "Kontrollnumber korrektne", "Kontrollnumber vale"


def normalise_code(c: Column) -> Column:
    """The first eleven digits typed, all else left out."""
    return F.substring(F.regexp_replace(c, "[^0-9]", ""), 1, 11)


def _weighted(code: Column, weights: tuple[int, ...]) -> Column:
    total = F.lit(0)
    for place, weight in enumerate(weights, 1):
        total = total + F.substring(code, place, 1).try_cast("int") * weight
    return total % 11


def checksum_ok(code: Column) -> Column:
    """Whether the last digit is right: the first round's remainder, else the second's, else 0."""
    first, second = (_weighted(code, w) for w in WEIGHTS)
    expected = F.when(first < 10, first).when(second < 10, second).otherwise(F.lit(0))
    return expected == F.substring(code, 11, 1).try_cast("int")


def parse_id_code(code: Column) -> Column:
    """struct<valid, error, checksum_ok, born>: length, then century, then date; a wrong checksum leaves a code valid."""
    right_length = code.rlike("^[0-9]{11}$")
    century_digit = F.substring(code, 1, 1).try_cast("int")
    century = 1800 + 100 * F.floor((century_digit - 1) / 2)
    written = F.concat_ws("-", (century + F.substring(code, 2, 2).try_cast("int")).cast("string"), F.substring(code, 4, 2), F.substring(code, 6, 2))
    born = written.try_cast("date")
    error = (
        F.when(code.isNull() | ~right_length, WRONG_LENGTH)
        .when(~century_digit.between(1, 6), WRONG_CENTURY)
        .when(born.isNull(), WRONG_DATE)
    )
    ok = error.isNull()
    return F.struct(ok.alias("valid"), error.alias("error"), F.when(ok, checksum_ok(code)).alias("checksum_ok"), F.when(ok, born).alias("born"))


def with_id_code(df: DataFrame, code: str = "code") -> DataFrame:
    """df with digits, parsed (as parse_id_code) and status: what to tell whoever typed this, digits missing, an error,
    or whether the checksum is right. Each is a column of its own before the next looks at it."""
    parsed = df.withColumn("digits", normalise_code(F.col(code))).withColumn("parsed", parse_id_code(F.col("digits")))
    return parsed.withColumn("status", _status(F.col("digits"), F.col("parsed")))


def _status(code: Column, parsed: Column) -> Column:
    missing = F.concat((11 - F.length(code)).cast("string"), F.lit(" numbrit puudu"))
    return F.when(F.length(code) < 11, missing).when(~parsed["valid"], parsed["error"]).when(parsed["checksum_ok"], CHECKED).otherwise(UNCHECKED)


def id_code_status(typed: Column) -> Column:
    """The status alone; with_id_code reads many codes faster."""
    code = normalise_code(typed)
    return _status(code, parse_id_code(code))
