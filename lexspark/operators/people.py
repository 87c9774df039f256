"""Persons' ages, added sentences, and early-release dates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.functions import calendar as C
from lexspark.functions import idcode as I

#: The fractions of a sentence, and the legal grounds of each.
RULES = ((1, 3, "1/3 üks kolmandik"), (1, 2, "1/2 pool"), (2, 3, "2/3 kaks kolmandikku"))
#: (numerator, denominator, juvenile, intent, degree, consent to monitoring or None where not stated, provision)
GROUNDS = (
    (1, 3, False, "intentional", "II", True, "§76 lg1 p1"),
    (1, 3, False, "negligent", "I", True, "§76 lg1 p1"),
    (1, 3, True, "intentional", "II", None, "§76¹ lg1 p1"),
    (1, 3, True, "negligent", "I", None, "§76¹ lg1 p1"),
    (1, 2, False, "intentional", "II", False, "§76 lg1 p2"),
    (1, 2, False, "negligent", "I", False, "§76 lg1 p2"),
    (1, 2, False, "intentional", "I", True, "§76 lg2 p1"),
    (1, 2, True, "intentional", "I", None, "§76¹ lg1 p2"),
    (2, 3, False, "intentional", "I", False, "§76 lg2 p2"),
)


def person_age(people: DataFrame) -> DataFrame:
    """people (code, dob as D.M.YYYY, ref_date) with born, status, age, label and the birthday's note.

    The code counts where it is valid, else the written date.
    """
    digits = people.withColumn("_digits", I.normalise_code(F.col("code")))  # a column of its own, so that it is made once
    parsed = digits.withColumns({"_code": I.parse_id_code(F.col("_digits")), "_written": C.parse_dmy(F.col("dob"))})
    born = F.coalesce(F.col("_code.born"), F.col("_written"))
    dated = parsed.withColumn("born", born).drop("_code", "_digits", "_written").withColumn("status", C.age_status(F.col("born"), F.col("ref_date")))
    fine = F.col("status") == "ok"
    aged = dated.withColumns({
        "age": F.when(fine, C.age(F.col("born"), F.col("ref_date"))),
        "birthday": F.when(fine, C.birthday_note(F.col("born"), F.col("ref_date"))),
    })
    return aged.withColumn("age_label", C.age_label(F.col("age")))


def merge_sentences(sentences: DataFrame, key: str) -> DataFrame:
    """The sum of each person's sentences (years, months, days as typed): 30 days carry to a month, 12 months to a year.

    Sums are taken once and carried once; that equals adding the sentences one by one.
    """
    part = lambda c: F.sum(C.non_negative_int(F.col(c)).cast("long"))
    sums = sentences.groupBy(key).agg(part("years").alias("y"), part("months").alias("m"), part("days").alias("d"))
    months = F.col("m") + F.floor(F.col("d") / 30)
    carried = sums.select(key, (F.col("y") + F.floor(months / 12)).alias("years"), (months % 12).alias("months"), (F.col("d") % 30).alias("days"))
    return carried.withColumn("label", C.sentence_label(F.col("years"), F.col("months"), F.col("days")))


def release_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(RULES), "num int, den int, glyph string")


def release_grounds(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(GROUNDS), "num int, den int, juvenile boolean, intent string, degree string, monitoring boolean, provision string")


GIVEN = {"_years": "years", "_months": "months", "_days": "days"}


def _coerced(sentences: DataFrame) -> DataFrame:
    """sentences with the typed numbers read, once for all that follows."""
    return sentences.withColumns({k: C.non_negative_int(F.col(c)) for k, c in GIVEN.items()})


def _released(coerced: DataFrame) -> DataFrame:
    given = [F.col(c) for c in GIVEN]
    there = C.has_release_input(F.col("start_date"), *given) & F.col("num").isNotNull()
    shown = F.when(there, C.release_date(F.col("start_date"), *given, F.col("num"), F.col("den")))
    fields = ("total_days", "fraction_days", "min_days", "release_date", "min_applied")
    return coerced.withColumn("_r", shown).select("*", *[f"_r.{f}" for f in fields]).drop("_r", *GIVEN)


def cross_release_rules(sentences: DataFrame) -> DataFrame:
    """Every sentence (start_date, years, months, days) under each of the three fractions; nulls without input.

    The rules are an array exploded in place, so that rows meet them without a join.
    """
    rules = F.array(*[F.struct(F.lit(n).alias("num"), F.lit(d).alias("den"), F.lit(g).alias("glyph")) for n, d, g in RULES])
    return _released(_coerced(sentences).withColumn("_rule", F.explode(rules)).select("*", "_rule.*").drop("_rule"))


def applicable_release(cases: DataFrame) -> DataFrame:
    """cases (juvenile, intent, degree, monitoring and a sentence) with the fraction and provision of the ground that
    fits; without one these and the dates are null. Consent counts only where the ground states it."""
    g = F.broadcast(release_grounds(cases.sparkSession)).select("num", "den", "provision", *[F.col(c).alias(f"_{c}") for c in ("juvenile", "intent", "degree", "monitoring")])
    fits = (F.col("juvenile") == F.col("_juvenile")) & (F.col("intent") == F.col("_intent")) & (F.col("degree") == F.col("_degree"))
    consent = F.col("_monitoring").isNull() | (F.coalesce(F.col("monitoring"), F.lit(False)) == F.col("_monitoring"))
    return _released(_coerced(cases).join(g, fits & consent, "left")).drop("_juvenile", "_intent", "_degree", "_monitoring")
