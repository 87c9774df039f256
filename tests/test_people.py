import datetime as dt

import pytest
from pyspark.sql import functions as F

from lexspark.functions import calendar as C
from lexspark.functions import idcode as I
from lexspark.operators import people as P

N = " "
D = dt.date


def test_id_codes(spark):
    rows = [("49001012115",), ("37605030000",), ("07605030000",), ("123",), ("10001010000",), ("39002300000",), (None,)]
    got = [r["p"] for r in spark.createDataFrame(rows, "c string").select(I.parse_id_code(F.col("c")).alias("p")).collect()]
    assert (got[0]["valid"], got[0]["checksum_ok"], got[0]["born"]) == (True, True, D(1990, 1, 1))
    assert (got[1]["valid"], got[1]["checksum_ok"]) == (True, False)
    assert got[2]["error"] == I.WRONG_CENTURY and got[3]["error"] == I.WRONG_LENGTH
    assert got[4]["born"].year == 1800 and got[5]["error"] == I.WRONG_DATE and not got[6]["valid"]


def test_checksum_matches_plain_arithmetic(spark):
    import random

    rnd = random.Random(1)
    codes = ["".join(rnd.choice("0123456789") for _ in range(11)) for _ in range(500)]

    def right(code):
        digits = [int(x) for x in code]
        for weights in ([1, 2, 3, 4, 5, 6, 7, 8, 9, 1], [3, 4, 5, 6, 7, 8, 9, 1, 2, 3]):
            rest = sum(a * b for a, b in zip(digits, weights)) % 11
            if rest < 10:
                return rest == digits[10]
        return digits[10] == 0

    got = spark.createDataFrame([(c,) for c in codes], "c string").select("c", I.checksum_ok(F.col("c")).alias("ok")).collect()
    assert all(r["ok"] == right(r["c"]) for r in got)


def test_status(spark):
    rows = [("4900101-2115 9",), ("37605030000",), ("1-2",), ("90001010000",)]
    got = [r[0] for r in spark.createDataFrame(rows, "c string").select(I.id_code_status(F.col("c"))).collect()]
    assert got == [I.CHECKED, I.UNCHECKED, "9 numbrit puudu", I.WRONG_CENTURY]


def test_age(spark):
    rows = [(D(2020, 1, 31), D(2020, 3, 1), (0, 1, 1)), (D(2020, 2, 29), D(2021, 2, 28), (1, 0, 0)), (D(2000, 5, 10), D(2026, 9, 26), (26, 4, 16))]
    df = spark.createDataFrame([r[:2] for r in rows], "b date, r date").select(C.age(F.col("b"), F.col("r")).alias("a"))
    assert [tuple(r["a"]) for r in df.collect()] == [r[2] for r in rows]


def test_age_is_never_negative(spark):
    births = spark.sql("select explode(sequence(date'1990-01-01', date'2001-12-31')) b").repartition(8)
    days = births.select("b", F.explode(F.expr("sequence(make_date(year(b) + 30, 1, 1), make_date(year(b) + 30, 12, 31))")).alias("r"))
    bad = days.select(C.age(F.col("b"), F.col("r")).alias("a")).where("a.years < 0 or a.months < 0 or a.days < 0")
    assert bad.isEmpty()


def test_parse_dmy(spark):
    rows = [("31.02.2020",), ("01.13.2020",), ("29.02.2020",), (" 1.2.2020 ",), ("1.2.0050",), ("x",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "s string").select(C.parse_dmy(F.col("s"))).collect()]
    assert got == [None, None, D(2020, 2, 29), D(2020, 2, 1), None, None, None]


@pytest.mark.parametrize("zone", ["UTC", "Europe/Tallinn"])
def test_birthdays(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        rows = [(D(1980, 3, 30), D(2026, 3, 26)), (D(2000, 2, 29), D(2026, 2, 28)), (D(2000, 2, 29), D(2028, 2, 29)), (D(1990, 1, 1), D(1980, 1, 1))]
        people = spark.createDataFrame([(None, f"{b.day}.{b.month}.{b.year}", r) for b, r in rows], "code string, dob string, ref_date date")
        got = P.person_age(people).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert (got[0]["birthday"]["days_until"], got[0]["birthday"]["next_label"]) == (4, "30.03.2026")
    assert (got[1]["birthday"]["days_until"], got[1]["birthday"]["next_label"], got[1]["birthday"]["is_birthday"]) == (1, "29.02.2026", False)
    assert got[2]["birthday"]["is_birthday"] and got[2]["birthday"]["next_label"] == "29.02.2029"
    assert got[3]["status"] == C.TOO_EARLY and got[3]["age"] is None
    assert got[0]["age_label"] == f"45{N}aastat  11{N}kuud  26{N}päeva"


def test_coercion(spark):
    rows = [("3.7", 3), (" 12abc", 12), ("", 0), ("-4", 0), ("+5", 5), (None, 0), ("99999999999", 0)]
    got = [r[0] for r in spark.createDataFrame(rows, "s string, n int").select(C.non_negative_int(F.col("s"))).collect()]
    assert got == [n for _, n in rows]


def test_merged_sentences(spark):
    rows = [(1, "1", "11", "0"), (1, "0", "11", "20"), (2, "", "", "25"), (2, "x", "-1", "0"), (3, "0", "0", "0")]
    got = {r["p"]: r["label"] for r in P.merge_sentences(spark.createDataFrame(rows, "p int, years string, months string, days string"), "p").collect()}
    assert got == {1: f"2{N}aastat 10{N}kuud 20{N}päeva", 2: f"25{N}päeva", 3: "—"}


def test_releases(spark):
    rows = [(1, D(2021, 1, 1), "0", "3", "0"), (2, D(2021, 1, 1), "0", "0", ""), (3, None, "1", "0", "0")]
    got = P.cross_release_rules(spark.createDataFrame(rows, "id int, start_date date, years string, months string, days string")).collect()
    half = {r["id"]: (r["release_date"], r["min_applied"]) for r in got if r["den"] == 2}
    assert half == {1: (D(2021, 5, 1), True), 2: (None, None), 3: (None, None)} and len(got) == 9


def test_durations(spark):
    rows = [(D(2021, 1, 31), 0, 1, 0, D(2021, 2, 28)), (D(2020, 1, 31), 0, 1, 0, D(2020, 2, 29)), (D(2020, 2, 29), 1, 0, 0, D(2021, 2, 28)), (D(2020, 1, 31), 0, 1, 2, D(2020, 3, 2))]
    df = spark.createDataFrame(rows, "s date, y int, m int, d int, want date")
    assert df.where(C.add_calendar_duration(*[F.col(c) for c in "symd"]) != F.col("want")).isEmpty()


def test_grounds(spark):
    rows = [(1, False, "intentional", "II", True), (2, False, "intentional", "II", None), (3, True, "negligent", "I", None), (4, False, "negligent", "II", True)]
    cases = spark.createDataFrame(rows, "id int, juvenile boolean, intent string, degree string, monitoring boolean")
    cases = cases.withColumns({"start_date": F.lit("2024-01-01").cast("date"), "years": F.lit("3"), "months": F.lit("0"), "days": F.lit("0")})
    got = {r["id"]: (r["num"], r["den"], r["provision"]) for r in P.applicable_release(cases).collect()}
    assert got == {1: (1, 3, "§76 lg1 p1"), 2: (1, 2, "§76 lg1 p2"), 3: (1, 3, "§76¹ lg1 p1"), 4: (None, None, None)}
