import re

import pytest
from pyspark.sql import functions as F

from lexspark.functions import amounts as A
from lexspark.functions.highlight import annotate, highlight
from lexspark.functions.text import escape_html
from lexspark.operators import amounts as O

N = " "

TOTALS = [
    ("eur", "1 234,56 € ning 89.50 €", f"1324,06{N}€", "2"),
    ("g", "0,5g heroiini ja 1.2g", f"1,7{N}g", "2"),
    ("eur", "100 € ja -40 €", f"60,00{N}€", "2"),
    ("eur", "100 € ja -100 €", f"0,00{N}€", "2"),
    ("eur", "x10 € ja 20 €", f"20,00{N}€", "1"),
    ("eur", "pole raha", f"0,00{N}€", "0"),
    ("eur", "", "0", "0"),
    ("eur", "  \n", "0", "0"),
    ("eur", None, "0", "0"),
    ("eur", "1234567 €", f"1{N}234{N}567,00{N}€", "1"),
    ("eur", "-50 € ja −50 €", f"−100,00{N}€", "2"),
    ("eur", "–50 €", f"50,00{N}€", "1"),
    ("eur", "1.234 €", f"1,23{N}€", "1"),
    ("eur", "1.234,56 €", f"1234,56{N}€", "1"),
    ("eur", "100. 200 EUR", f"100,20{N}€", "1"),
    ("eur", "COVID-19 EUR", f"19,00{N}€", "1"),
    ("eur", "1,2,3 eurot", f"1,20{N}€", "1"),
    ("eur", "12 europeans", f"0,00{N}€", "0"),
    ("g", "g 1.5 ja 10g5g", f"0{N}g", "0"),
    ("g", "gramm 1.5", f"1,5{N}g", "1"),
    ("n", "12.03.2024 kell 12:30, asi 1-23/45, kokku 7", "7", "1"),
    ("n", "2024-03-12 ja 5", "5", "1"),
]


@pytest.mark.parametrize("mode", ["eur", "g", "n"])
def test_totals(spark, mode):
    cases = [(i, text) for i, (m, text, _, _) in enumerate(TOTALS) if m == mode]
    got = O.document_totals(spark.createDataFrame(cases, "doc_id long, text string"), mode=mode).collect()
    assert {r["doc_id"]: (r["sum_label"], r["count_label"]) for r in got} == {i: TOTALS[i][2:] for i, _ in cases}


def test_raws_and_true_word_edges(spark):
    rows = [(0, "kokku 5 g."), (1, "kokku 5 g.x"), (2, "10 grammi ja 3 GRAMMIDES")]
    df = O.matches(spark.createDataFrame(rows, "doc_id long, text string"), "g")
    got = sorted((r["doc_id"], r["raw"]) for r in df.collect())
    assert got == [(0, "5 g"), (1, "5 g."), (2, "10 grammi"), (2, "3 GRAMMIDES")]


def test_exclusions(spark):
    docs = spark.createDataFrame([(1, "10 € ja 20 €"), (2, "10 €"), (3, "5 €")], "doc_id long, text string")
    out = spark.createDataFrame([(1, 0), (2, 0), (9, 0)], "doc_id long, ord int")
    got = {r["doc_id"]: (r["sum_label"], r["count_label"]) for r in O.document_totals(docs, out).collect()}
    assert got == {1: (f"20,00{N}€", "1 / 2"), 2: (f"0,00{N}€", "0 / 1"), 3: (f"5,00{N}€", "1")}


@pytest.mark.parametrize(("prefix", "kept"), [(" " * 10, [0]), (" " * 12 + "y ", [])])
def test_carried_exclusions(spark, prefix, kept):
    before = O.with_offsets(spark.createDataFrame([(1, "10 € ja 20 €")], "doc_id long, text string")).where("ord = 0")
    after = O.with_offsets(spark.createDataFrame([(1, prefix + "10 € ja 20 €")], "doc_id long, text string"))
    assert [r["ord"] for r in O.carry_exclusions(before, after).collect()] == kept


def test_carried_exclusions_match_brute_force(spark):
    import random

    rnd = random.Random(3)
    prev = [(d, rnd.choice(["1 €", "2 €"]), rnd.randrange(200)) for d in range(5) for _ in range(15)]
    new = [(d, o, rnd.choice(["1 €", "2 €"]), rnd.randrange(200)) for d in range(5) for o in range(20)]
    got = O.carry_exclusions(spark.createDataFrame(prev, "doc_id long, raw string, index int"), spark.createDataFrame(new, "doc_id long, ord int, raw string, index int"))
    want = {(d, o) for d, o, r, i in new if any(d == e and r == s and abs(i - j) <= 10 for e, s, j in prev)}
    assert {tuple(r) for r in got.collect()} == want


CORPUS = [
    "Kahju 1 234,56 € ja 12 eurot, lisaks EUR 5. 😀 7 €", "0,5 g ja 10grammi. gramm 3", "a 1.2.3 b 2-3/4 c 12:30 d 1,5 e 2024-01-02", "€5€6 7€", "x1 y2 3z 4",
    "12 € 3 €",
]


@pytest.mark.parametrize("mode", ["eur", "g", "n"])
def test_invariants(spark, mode):
    rows = O.with_offsets(spark.createDataFrame(list(enumerate(CORPUS)), "doc_id long, text string"), mode).collect()
    listed = O.matches(spark.createDataFrame(list(enumerate(CORPUS)), "doc_id long, text string"), mode).collect()
    assert len(rows) == len(listed)
    for doc, text in enumerate(CORPUS):
        units, last = text.encode("utf-16-le"), 0
        for r in sorted((r for r in rows if r["doc_id"] == doc), key=lambda r: r["ord"]):
            assert units[2 * r["index"] : 2 * (r["index"] + r["match_len"])].decode("utf-16-le") == r["raw"]
            assert r["index"] >= last
            last = r["index"] + r["match_len"]
            assert r["amount"] == r["amount"]
            assert mode == "n" or re.search("€|eur|g", r["raw"], re.I)


def test_long_number_runs_end(spark):
    text = "1 " * 8000
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert O.document_totals(df.withColumn("text", F.concat("text", F.lit("€ eur")))).first()["n_total"] <= 1


def test_highlight(spark):
    cases = [
        ("Amphetamine & co", "amp", "<mark>Amp</mark>hetamine &amp; co"), ("a & b", "&", "a <mark>&amp;</mark> b"), ("a < b", "<", "a <mark>&lt;</mark> b"),
        ("hello", "zzz", "hello"), ("a.b", ".", "a<mark>.</mark>b"), ("a <b", "", "a &lt;b"), ("ÕUN", "õ", "<mark>Õ</mark>UN"),
    ]
    df = spark.createDataFrame(cases, "t string, q string, want string").select("want", highlight(F.col("t"), F.col("q")).alias("got"))
    assert all(r["want"] == r["got"] for r in df.collect())


def test_escape(spark):
    cases = [("a & b < c > d", "a &amp; b &lt; c &gt; d"), ("&amp;", "&amp;amp;"), ("say \"hi\" it's", "say \"hi\" it's")]
    df = spark.createDataFrame(cases, "t string, want string").select("want", escape_html(F.col("t")).alias("got"))
    assert all(r["want"] == r["got"] for r in df.collect())


def test_annotate(spark):
    cases = [
        ("kokku 100 € ja 200 €", [], 'kokku <mark data-idx="0">100 €</mark> ja <mark data-idx="1">200 €</mark><span></span>'),
        ("a<b 100 €", [], 'a&lt;b <mark data-idx="0">100 €</mark><span></span>'), ("100 €\n", [], '<mark data-idx="0">100 €</mark>\n <span></span>'),
        ("100 & 200", [], "100 &amp; 200"), ("1 € 2 €", [1], '<mark data-idx="0">1 €</mark> <mark class="excluded" data-idx="1">2 €</mark><span></span>'),
    ]
    df = spark.createDataFrame(cases, "t string, e array<int>, want string").select("want", annotate(F.col("t"), F.col("e"), "eur").alias("got"))
    for r in df.collect():
        assert r["want"] == r["got"]


def test_format_numeric(spark):
    cases = [(1234.5, 2, "1234,5"), (12345.678, 1, "12 345,7"), (-3.0, 0, "−3"), (2.0, 2, "2"), (0.1234, 10, "0,1234")]
    df = spark.createDataFrame(cases, "v double, d int, want string").select("want", A.format_numeric(F.col("v"), F.col("d"), "n").alias("got"))
    assert [r["got"] for r in df.collect()] == [c[2] for c in cases]


def test_numbered_does_not_cut(spark):
    df = O.numbered(spark.range(1200).withColumn("k", F.lit(1)), 3, ["k"], ["id"])
    got = {r["id"]: r["row_no"] for r in df.collect()}
    assert got[0] == "001" and got[1199] == "1200"


def test_offsets_of_repeated_ids_and_of_many_matches(spark):
    many = " ja ".join(f"{k} €" for k in range(1, 400))
    rows = [(1, "x 10 € ja 20 €"), (1, "x 10 € ja 20 €"), (1, "\U0001f600 5 €"), (None, "1 €"), (2, many), (3, None), (4, "")]
    got = O.with_offsets(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["ord"], r["index"], r["match_len"]) for r in got if r["doc_id"] == 1) == [(0, 2, 4), (0, 2, 4), (0, 3, 3), (1, 10, 4), (1, 10, 4)]
    assert [(r["raw"], r["index"]) for r in sorted((r for r in got if r["doc_id"] == 2), key=lambda r: r["ord"])] == [(f"{k} €", many.index(f" {k} €") + 1 if k > 1 else 0) for k in range(1, 400)]
    assert len(got) == 5 + 1 + 399


def test_large_amounts(spark):
    rows = [(1, "12345678901234567890123456789 €"), (2, "-" + "9" * 400 + " €"), (3, "1" + "0" * 22 + ",5 €"), (4, "9007199254740993 €"), (5, "99999999999999,995 €")]
    got = {r["doc_id"]: r["sum_label"].replace("\u00a0", " ") for r in O.document_totals(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "12 345 678 901 234 568 000 000 000 000,00 €", 2: "\u2212\u221e €", 3: "10 000 000 000 000 000 000 000,00 €", 4: "9 007 199 254 740 992,00 €", 5: "100 000 000 000 000,00 €"}
    run = " ".join(str(n) for n in range(10, 30))
    plain = O.document_totals(spark.createDataFrame([(1, run)], "doc_id long, text string"), mode="n").first()
    assert float(plain["sum_label"].replace("\u00a0", "")) == float(run.replace(" ", "")) and plain["amount_list"] == plain["sum_label"]


def test_plain_numbers_against_a_scanner_in_sql(spark):
    """Short texts full of what may stand in and around a number; the SQL looks at neighbours in place of lookarounds."""
    import random

    import duckdb

    from lexspark.jobs.queries import ORACLE_SQL
    from lexspark.operators.amounts import document_totals

    rnd = random.Random(12)
    pieces = ["1", "23", "456", "2024", "12.03.2024", "1-2/3", "7:05", "0", " ", " ", ".", ",", "-", "\u2212", "/", ":", "\u00a0", "a", "\u00f5", "\u20ac", "\n", "\u0663"]
    rows = [(i, "".join(rnd.choice(pieces) for _ in range(rnd.choice([1, 3, 6, 10])))) for i in range(1500)] + [(-1, None), (-2, ""), (-3, " \n"), (-4, "9" * 15 + " x -9"), (-5, "1" + "0" * 20)]
    con = duckdb.connect()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    con.register("documents", docs.toArrow())
    result = con.execute(ORACLE_SQL["number_totals"])
    names = [d[0] for d in result.description]
    want = {r[0]: dict(zip(names, r)) for r in result.fetchall()}
    for r in document_totals(docs, mode="n").collect():
        got, known = r.asDict(), want[r["doc_id"]]
        assert got == known | {"total": pytest.approx(known["total"], rel=1e-12)}, (rows[r["doc_id"]], got, known)
