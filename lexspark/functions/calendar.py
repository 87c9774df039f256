"""Calendar dates, ages and durations on DATE columns; no time zone takes part."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexspark.functions.text import counted, strip_blank

TOO_EARLY = "// arvutuskuupäev on enne sünnikuupäeva"
MINIMUM_MONTHS = 4


def parse_dmy(c: Column) -> Column:
    """The date written D.M.YYYY, blanks at the ends aside; null if there is none such, or before the year 100."""
    s = strip_blank(c)
    found = F.try_to_date(s, "d.M.yyyy")
    return F.when(s.rlike(r"^[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}$") & (F.year(found) >= 100), found)


def fmt_dmy(d: Column) -> Column:
    return F.date_format(d, "dd.MM.yyyy")


def add_months_clamped(d: Column, months: Column | int) -> Column:
    """months later; a day the month lacks becomes its last."""
    return F.add_months(d, months)


def days_between(a: Column, b: Column) -> Column:
    return F.datediff(b, a)


def age(born: Column, ref: Column) -> Column:
    """struct<years, months, days> at ref: full months since birth, and the days since the last of them."""
    apart = 12 * (F.year(ref) - F.year(born)) + F.month(ref) - F.month(born)
    months = apart - F.when(F.add_months(born, apart) > ref, 1).otherwise(0)
    years = F.floor(months / 12).cast("int")
    return F.struct(years.alias("years"), (months - 12 * years).cast("int").alias("months"), F.datediff(ref, F.add_months(born, months)).alias("days"))


def age_status(born: Column, ref: Column) -> Column:
    """'ok', an error text where ref lies before birth, null where either date is missing."""
    return F.when(F.datediff(ref, born) < 0, TOO_EARLY).when(born.isNotNull() & ref.isNotNull(), "ok")


def age_label(a: Column) -> Column:
    parts = [counted(a["years"], "aasta", "aastat"), counted(a["months"], "kuu", "kuud"), counted(a["days"], "päev", "päeva")]
    return F.concat(parts[0], F.lit("  "), parts[1], F.lit("  "), parts[2])


def _overflowing(year: Column, month: Column, day: Column) -> Column:
    """The day of the month counted from its first, running over into the next month: 29.02 of a common year is 1.03."""
    return F.date_add(F.make_date(year, month, F.lit(1)), day - 1)


def birthday_note(born: Column, ref: Column) -> Column:
    """struct<is_birthday, next_label, days_until>.

    Days run to the overflowing date, while the label keeps the day and month of birth: 29.02. of any year.
    """
    month, day, year = F.month(born), F.dayofmonth(born), F.year(ref)
    today = (F.month(ref) == month) & (F.dayofmonth(ref) == day)
    next_year = year + F.when(today | (_overflowing(year, month, day) <= ref), 1).otherwise(0)
    label = F.concat(F.date_format(born, "dd.MM."), next_year.cast("string"))
    return F.struct(today.alias("is_birthday"), label.alias("next_label"), F.datediff(_overflowing(next_year, month, day), ref).alias("days_until"))


def add_calendar_duration(start: Column, years: Column, months: Column, days: Column) -> Column:
    """Years and months first, with the day clamped, then the days."""
    return F.date_add(F.add_months(start, 12 * years + months), days)


def release_date(start: Column, years: Column, months: Column, days: Column, num: Column, den: Column) -> Column:
    """struct<total_days, fraction_days, min_days, release_date, min_applied> after num/den of the sentence, four months at least."""
    total = F.datediff(add_calendar_duration(start, years, months, days), start)
    part = F.floor((total.cast("long") * num) / den).cast("int")
    least = F.datediff(F.add_months(start, MINIMUM_MONTHS), start)
    return F.struct(total.alias("total_days"), part.alias("fraction_days"), least.alias("min_days"), F.date_add(start, F.greatest(part, least)).alias("release_date"), (least > part).alias("min_applied"))


def has_release_input(start: Column, years: Column, months: Column, days: Column) -> Column:
    return start.isNotNull() & ((years > 0) | (months > 0) | (days > 0))


def non_negative_int(c: Column) -> Column:
    """The whole number a text begins with; 0 if there is none, if it's negative, or beyond an int."""
    lead = F.regexp_extract(strip_blank(c.cast("string")), "^([-+]?[0-9]+)", 1)
    return F.greatest(F.lit(0), F.coalesce(lead.try_cast("int"), F.lit(0)))


def sentence_label(years: Column, months: Column, days: Column) -> Column:
    """'2 aastat 10 kuud': the parts above zero; a dash if there is none."""
    part = lambda n, one, many: F.when(n > 0, counted(n, one, many))
    text = F.concat_ws(" ", part(years, "aasta", "aastat"), part(months, "kuu", "kuud"), part(days, "päev", "päeva"))
    return F.when(text == "", "—").otherwise(text)
