"""Legal-records inputs derived from the star-schema tables, so that their answers can be read off the same tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

JOINED = " & "


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, ord, cents, tenths, line, part, flag): the lines of each order, in order."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"),
        (F.round(F.col("l_quantity") * 10).cast("long") + F.col("l_linenumber")).alias("tenths"),
        F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), F.col("l_returnflag").alias("flag"),
    )
    order = Window.partitionBy("doc_id").orderBy("line", "cents", "part", "supp")
    return rows.withColumn("ord", (F.row_number().over(order) - 1).cast("int")).drop("supp")


LINES_SQL = """
lines AS (
  SELECT l_orderkey AS doc_id, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents,
    CAST(round(l_quantity * 10) AS BIGINT) + l_linenumber AS tenths,
    l_linenumber AS line, l_partkey AS part, l_suppkey AS supp, l_returnflag AS flag,
    CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, CAST(round(l_extendedprice * 100) AS BIGINT), l_partkey, l_suppkey) - 1 AS INTEGER) AS ord
  FROM lineitem
)"""


def plain_number(cents: Column, mark: str = ",") -> Column:
    return F.concat(F.floor(cents / 100).cast("long").cast("string"), F.lit(mark), F.lpad((cents % 100).cast("string"), 2, "0"))


def _spread_number(cents: Column, gap: str) -> Column:
    whole = F.floor(cents / 100).cast("long").cast("string")
    return F.concat(F.regexp_replace(whole, "(?<=[0-9])(?=(?:[0-9]{3})+$)", gap), F.lit(","), F.lpad((cents % 100).cast("string"), 2, "0"))


def written_amount(cents: Column, part: Column, flag: Column) -> Column:
    """An amount in one of the notations in use, by part; returned lines are negative, with either sign."""
    sign = F.when(flag != "R", F.lit("")).when(part % 2 == 0, F.lit("-")).otherwise(F.lit("\u2212"))
    return (
        F.when(part % 4 == 0, F.concat(sign, plain_number(cents), F.lit(" €")))
        .when(part % 4 == 1, F.concat(sign, _spread_number(cents, " "), F.lit(" eurot")))
        .when(part % 4 == 2, F.concat(sign, _spread_number(cents, "."), F.lit("EUR")))
        .otherwise(F.concat(F.lit("€ "), sign, plain_number(cents, ".")))
    )


def _texts(lines: DataFrame, piece: Column, head: str, between: str) -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct("ord", piece.alias("piece"))))
    whole = lines.groupBy("doc_id").agg(parts.alias("parts"))
    return whole.select("doc_id", F.concat(F.lit(head), F.col("doc_id").cast("string"), F.lit(": "), F.array_join(F.col("parts.piece"), between)).alias("text"))


def invoice_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): each order's lines as amounts in mixed notation."""
    return _texts(order_lines(spark, sf_dir), written_amount(F.col("cents"), F.col("part"), F.col("flag")), "Arve ", " ja ")


def plain_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): each order's lines in one notation, whose places can be reckoned."""
    return _texts(order_lines(spark, sf_dir), F.concat(plain_number(F.col("cents")), F.lit(" €")), "Arve ", JOINED)


PLAIN_SQL = f"""
placed AS (
  SELECT *, (cents // 100) || ',' || lpad(CAST(cents % 100 AS VARCHAR), 2, '0') || ' €' AS raw FROM lines
), offsets AS (
  SELECT *, CAST(length('Arve ' || doc_id || ': ') + coalesce(sum(length(raw) + {len(JOINED)}) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS pos
  FROM placed
)"""


def gram_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): each order's quantities in grams."""
    number = F.concat(F.floor(F.col("tenths") / 10).cast("long").cast("string"), F.lit(","), (F.col("tenths") % 10).cast("string"))
    unit = F.when(F.col("part") % 3 == 0, " g").when(F.col("part") % 3 == 1, "g").otherwise(" grammi")
    return _texts(order_lines(spark, sf_dir), F.concat(number, unit), "Akt ", " ja ")


def record_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): each order's quantities as plain numbers, among dates, times and case numbers."""
    lines = order_lines(spark, sf_dir)
    number = F.concat(F.floor(F.col("tenths") / 10).cast("long").cast("string"), F.when(F.col("tenths") % 10 > 0, F.concat(F.lit(","), (F.col("tenths") % 10).cast("string"))).otherwise(F.lit(",0")))
    date = F.concat((F.col("part") % 28 + 1).cast("string"), F.lit("."), F.lpad((F.col("part") % 12 + 1).cast("string"), 2, "0"), F.lit(".2024"))
    other = (
        F.when(F.col("part") % 3 == 0, date)
        .when(F.col("part") % 3 == 1, F.concat((F.col("part") % 24).cast("string"), F.lit(":05")))
        .otherwise(F.concat(F.lit("3-"), F.col("part").cast("string"), F.lit("/22")))
    )
    texts = _texts(lines, F.concat(other, F.lit(" kogus "), number, F.lit(" tk")), "Asi 1-", " ja ")
    return texts.withColumn("text", F.regexp_replace("text", "^(Asi 1-[0-9]+):", "$1/7:"))


def large_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, number): numbers of many digits; every third is negative."""
    key = F.col("o_orderkey")
    digits = F.concat((key % 100_000).cast("string"), F.lit("5"), F.repeat(F.lit("0"), (16 + key % 25).cast("int")))
    number = F.concat(F.when(key % 3 == 0, F.lit("-")).otherwise(F.lit("")), digits)
    return table(spark, sf_dir, "orders").select(key.alias("doc_id"), number.alias("number"))


def id_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(person_id, code, dob, ref_date): codes from order dates, some wrong in checksum, month, length or century."""
    key, born = F.col("o_orderkey"), F.to_date("o_orderdate")
    century = F.when(F.year(born) < 2000, 3).otherwise(5) + key % 2
    first = F.when(key % 17 == 0, F.lit("9")).otherwise(century.cast("string"))
    month = F.when(key % 11 == 0, F.lit("13")).otherwise(F.date_format(born, "MM"))
    ten = F.concat(first, F.date_format(born, "yy"), month, F.date_format(born, "dd"), F.lpad((key % 1000).cast("string"), 3, "0"))
    rounds = []
    for weights in ((1, 2, 3, 4, 5, 6, 7, 8, 9, 1), (3, 4, 5, 6, 7, 8, 9, 1, 2, 3)):
        total = F.lit(0)
        for place, weight in enumerate(weights, 1):
            total = total + F.substring("ten", place, 1).cast("int") * weight
        rounds.append(total % 11)
    check = F.when(rounds[0] < 10, rounds[0]).when(rounds[1] < 10, rounds[1]).otherwise(0)
    wrong = F.when(key % 7 == 0, (check + 1) % 10).otherwise(check)
    typed = F.concat(F.substring("ten", 1, 7), F.when(key % 5 == 0, F.lit(" - ")).otherwise(F.lit("")), F.substring("ten", 8, 3), wrong.cast("string"))
    rows = table(spark, sf_dir, "orders").withColumn("ten", ten)
    ref = F.when(key % 19 == 0, F.lit("1990-01-01").cast("date")).otherwise(F.date_add(F.lit("2027-02-27").cast("date"), (key % 4).cast("int")))
    return rows.select(
        key.alias("person_id"), F.when(key % 13 == 0, F.substring(typed, 1, 8)).otherwise(typed).alias("code"),
        F.when(key % 3 == 0, F.lit("31.02.2001")).otherwise(F.date_format(born, "d.M.yyyy")).alias("dob"), ref.alias("ref_date"),
    )


IDS_SQL = """
digits AS (
  SELECT o_orderkey AS person_id, CAST(o_orderdate AS DATE) AS d,
    (CASE WHEN o_orderkey % 17 = 0 THEN '9' ELSE CAST((CASE WHEN year(o_orderdate) < 2000 THEN 3 ELSE 5 END) + o_orderkey % 2 AS VARCHAR) END)
      || strftime(o_orderdate, '%y') || (CASE WHEN o_orderkey % 11 = 0 THEN '13' ELSE strftime(o_orderdate, '%m') END) || strftime(o_orderdate, '%d')
      || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') AS ten
  FROM orders
), said AS (
  SELECT *,
    CASE WHEN person_id % 13 = 0 THEN 'length' WHEN person_id % 17 = 0 THEN 'century' WHEN person_id % 11 = 0 THEN 'date' ELSE 'fine' END AS kind,
    CASE WHEN person_id % 19 = 0 THEN DATE '1990-01-01' ELSE DATE '2027-02-27' + CAST(person_id % 4 AS INTEGER) END AS ref
  FROM digits
)"""


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(person_id, case_id, years, months, days, start_date), the numbers as typed."""
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("person_id"), key.alias("case_id"),
        F.when(key % 8 == 0, F.lit("-3")).otherwise((key % 4).cast("string")).alias("years"),
        F.concat(F.lit(" "), (key % 12).cast("string"), F.lit("kuud")).alias("months"),
        F.when(key % 9 == 0, F.lit("")).otherwise((key % 30).cast("string")).alias("days"),
        F.to_date("o_orderdate").alias("start_date"),
    )


SENTENCES_SQL = """
sentences AS (
  SELECT o_custkey AS person_id, o_orderkey AS case_id, CAST(CASE WHEN o_orderkey % 8 = 0 THEN 0 ELSE o_orderkey % 4 END AS INTEGER) AS y,
    CAST(o_orderkey % 12 AS INTEGER) AS m, CAST(CASE WHEN o_orderkey % 9 = 0 THEN 0 ELSE o_orderkey % 30 END AS INTEGER) AS d, CAST(o_orderdate AS DATE) AS start_date
  FROM orders
)"""

#: Parts are cut into editions of so many, so that editions grow with the table and each stays small.
EDITION, PAGE = 100, 40


def annex_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table rows of annex editions, from parts: entries, continuations, boilerplate, doubles and a wrong name."""
    p = F.col("p_partkey")
    step = p % EDITION
    k = step % 10
    name = F.concat(F.initcap("p_name"), F.lit("-\n"), (p % 97).cast("string"))
    cells = (
        F.when(step % 83 == 82, F.array(F.lit("Dilämmastikoksiid  (N2O)"), F.lit("dilämmastikoksiid\n(N2O)")))
        .when(k == 6, F.array(F.lit(None).cast("string"), F.col("p_type")))
        .when((k == 7) | ((step < 60) & (step % 20 == 0)), F.array(F.col("p_brand"), F.lit("")))
        .when(k == 8, F.array(F.lit("Eestikeelne nimetus"), F.lit("Ingliskeelne nimetus")))
        .when(k == 9, F.array(name, F.lit("ab")))
        .otherwise(F.array(name, F.concat("p_brand", F.lit("\n"), "p_type")))
    )
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("act"), F.floor(p / EDITION).cast("string")).alias("doc_id"), F.floor(step / PAGE).cast("int").alias("page"), F.lit(0).alias("table_idx"),
        (step % PAGE).cast("int").alias("row_idx"), F.lit(10.0).alias("tbl_top"), cells.alias("cells"),
    )


def annex_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings as words: before every tenth row, and other words on lines of their own. Tops end in a half or a little more."""
    p = F.col("p_partkey")
    step = p % EDITION
    numeral = F.element_at(F.array(*[F.lit(x) for x in ("I", "II", "iii", "IV", "V", "VI")]), (F.floor(step / 10) % 6 + 1).cast("int"))
    heading = F.when(step % 10 == 0, F.array(numeral, F.lit("nimekiri"))).otherwise(F.array(F.col("p_brand"), F.col("p_type")))
    rows = table(spark, sf_dir, "part").where(step % 10 < 2).select(
        F.concat(F.lit("act"), F.floor(p / EDITION).cast("string")).alias("doc_id"), F.floor(step / PAGE).cast("int").alias("page"),
        (10.0 + step % PAGE + F.when(step % 20 == 0, 0.5).otherwise(0.2)).alias("top"), F.posexplode(heading).alias("word_idx", "text"),
    )
    return rows.select("doc_id", "page", "word_idx", "text", "top")


ANNEX_SQL = f"""
steps AS (
  SELECT 'act' || (p_partkey // {EDITION}) AS doc_id, p_partkey % {EDITION} AS step, p_partkey % 97 AS tail, p_name, p_brand, p_type FROM part
), cells AS (
  SELECT doc_id, step,
    CAST(CASE WHEN step >= 10 * (step // 10) THEN (step // 10) % 6 + 1 END AS INTEGER) AS list_id,
    CASE WHEN step % 83 = 82 THEN 'new' WHEN step % 10 = 6 THEN 'more_en' WHEN step % 10 = 7 OR (step < 60 AND step % 20 = 0) THEN 'more_et' WHEN step % 10 = 8 THEN NULL ELSE 'new' END AS kind,
    CASE WHEN step % 83 = 82 THEN 'Dilämmastikoksiid (N2O)' WHEN step % 10 = 6 THEN '' WHEN step % 10 = 7 OR (step < 60 AND step % 20 = 0) THEN p_brand
      ELSE array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') || '-' || tail END AS et,
    CASE WHEN step % 83 = 82 THEN 'dilämmastikoksiid (N2O)' WHEN step % 10 = 6 THEN p_type WHEN step % 10 = 7 OR (step < 60 AND step % 20 = 0) THEN '' WHEN step % 10 = 9 THEN '' ELSE p_brand || ' ' || p_type END AS en
  FROM steps
), told AS (
  SELECT *, sum(CASE WHEN kind = 'new' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, list_id ORDER BY step ROWS UNBOUNDED PRECEDING) AS entry
  FROM cells WHERE kind IS NOT NULL
), entries AS (
  SELECT doc_id, list_id, min(step) AS step, string_agg(et, ' ' ORDER BY step) FILTER (et <> '') AS et,
    coalesce(string_agg(en, ' ' ORDER BY step) FILTER (en <> ''), '') AS en
  FROM told WHERE entry > 0 GROUP BY doc_id, list_id, entry
), firsts AS (
  SELECT * FROM entries QUALIFY row_number() OVER (PARTITION BY doc_id, list_id, lower(et) ORDER BY step) = 1
), substances AS (
  SELECT doc_id, list_id, CAST(row_number() OVER (PARTITION BY doc_id, list_id ORDER BY lower(et), step) AS INTEGER) AS ord, et,
    CASE WHEN lower(et) = 'dilämmastikoksiid (n2o)' AND lower(en) = lower(et) THEN 'Nitrous oxide (N2O)' ELSE en END AS en
  FROM firsts
)"""


def part_substances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(list_id, ord, et, en): parts as the rows of a large register."""
    p = F.col("p_partkey")
    return table(spark, sf_dir, "part").select((p % 6 + 1).cast("int").alias("list_id"), p.alias("ord"), F.concat("p_name", F.lit(" <"), p.cast("string"), F.lit(">")).alias("et"), F.concat("p_type", F.lit(" & "), "p_brand").alias("en"))


def search_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, q): types and brands as queries, one that finds nothing, and an empty one."""
    part = table(spark, sf_dir, "part")
    terms = part.select(F.concat(F.lit(" "), F.lower("p_type")).alias("q")).union(part.select(F.concat(F.upper("p_brand"), F.lit("\u00a0")).alias("q"))).distinct()
    fixed = part.sparkSession.createDataFrame([("zzz",), ("  ",)], "q string")
    return terms.union(fixed).select(F.crc32("q").alias("query_id"), "q")


def act_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(act_id, body, xml): what the register of acts answers for each order, with some revisions missing, some documents
    broken, and dates and names in several forms."""
    k, d = F.col("o_orderkey"), F.to_date("o_orderdate")
    key = k.cast("string")
    body = F.when(k % 10 == 0, F.lit('{"kehtivRedaktsioon": 0}')).otherwise(F.concat(F.lit('{"kehtivRedaktsioon": '), key, F.lit("}")))
    date = F.when(k % 4 == 1, F.concat(F.lit("alates "), F.date_format(d, "dd.MM.yyyy"))).otherwise(F.date_format(d, "yyyy-MM-dd"))
    prefix = F.when(k % 4 == 2, F.lit("a:")).otherwise(F.lit(""))
    space = F.when(k % 4 == 2, F.lit(' xmlns:a="urn:akt"')).otherwise(F.lit(""))
    named = F.when(k % 5 == 0, F.lit("Lisa 2")).otherwise(F.lit("vt Lisa 1"))
    xml = F.concat(
        F.lit("<"), prefix, F.lit("akt"), space, F.lit("><"), prefix, F.lit("kehtivuseAlgus> "), date, F.lit(" </"), prefix, F.lit("kehtivuseAlgus><"), prefix, F.lit("tavatekst>"), named,
        F.lit("</"), prefix, F.lit("tavatekst><"), prefix, F.lit('fail failNimi="muu.pdf"/><'), prefix, F.lit('fail failNimi="'), key, F.lit('_LISA_1.pdf"/></'), prefix, F.lit("akt"),
        F.when(k % 4 == 3, F.lit("")).otherwise(F.lit(">")),
    )
    return table(spark, sf_dir, "orders").select(k.alias("act_id"), body.alias("body"), xml.alias("xml"))
