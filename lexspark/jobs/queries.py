"""The registered queries of the legal-records jobs, each over whole tables, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexspark.functions import calendar as C
from lexspark.functions import idcode as I
from lexspark.jobs import inputs as N
from lexspark.jobs.publish import publish_plan, read_published
from lexspark.operators import amounts as A
from lexspark.operators import people as P
from lexspark.operators import register as R
from lexspark.sources import acts
from lexspark.sources.bundles import ActBundles
from lexspark.sources.documents import read_documents, read_drifting_register, read_register, write_documents
from lexspark.sources.folders import shared_dir
from lexspark.streaming import amounts as S

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _sql_grouped(whole: str) -> str:
    return f"CASE WHEN {whole} < 10000 THEN CAST({whole} AS VARCHAR) ELSE replace(format('{{:,}}', {whole}), ',', chr(160)) END"


def _sql_cents(cents: str) -> str:
    whole = f"CAST(abs({cents}) // 100 AS BIGINT)"
    return f"(CASE WHEN {cents} < 0 THEN chr(8722) ELSE '' END) || ({_sql_grouped(whole)}) || ',' || lpad(CAST(abs({cents}) % 100 AS VARCHAR), 2, '0')"


# amounts


_SIGNED = "signed AS (SELECT *, CASE WHEN flag = 'R' THEN -cents ELSE cents END AS amount FROM lines)"


@query(f"""WITH {N.LINES_SQL}, {_SIGNED}, sums AS (
  SELECT doc_id, CAST(sum(amount) AS BIGINT) AS total, count(*) AS n, string_agg({_sql_cents('amount')}, chr(10) ORDER BY ord) AS amount_list FROM signed GROUP BY doc_id
) SELECT doc_id, round(total / 100.0::DOUBLE, 10) AS total, 2 AS max_decimals, CAST(n AS INTEGER) AS n_active, CAST(n AS INTEGER) AS n_total,
  {_sql_cents('total')} || chr(160) || '€' AS sum_label, CAST(n AS VARCHAR) AS count_label, amount_list FROM sums""")
def amount_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.document_totals(N.invoice_texts(spark, sf_dir))


@query(f"""WITH {N.LINES_SQL}, {_SIGNED} SELECT doc_id, ord, amount / 100.0::DOUBLE AS amount, 2 AS decimals FROM signed""")
def amount_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.matches(N.invoice_texts(spark, sf_dir)).drop("raw")


@query(f"""WITH {N.LINES_SQL}, {_SIGNED}, sums AS (
  SELECT doc_id, CAST(coalesce(sum(amount) FILTER (line % 3 <> 0), 0) AS BIGINT) AS total, count(*) FILTER (line % 3 <> 0) AS a, count(*) AS n,
    coalesce(string_agg({_sql_cents('amount')}, chr(10) ORDER BY ord) FILTER (line % 3 <> 0), '') AS amount_list FROM signed GROUP BY doc_id
) SELECT doc_id, round(total / 100.0::DOUBLE, 10) AS total, CASE WHEN a > 0 THEN 2 ELSE 0 END AS max_decimals, CAST(a AS INTEGER) AS n_active, CAST(n AS INTEGER) AS n_total,
  {_sql_cents('total')} || chr(160) || '€' AS sum_label, CASE WHEN a = n THEN CAST(n AS VARCHAR) ELSE a || ' / ' || n END AS count_label, amount_list FROM sums""")
def amount_totals_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    exclusions = N.order_lines(spark, sf_dir).where(F.col("line") % 3 == 0).select("doc_id", "ord")
    return A.document_totals(N.invoice_texts(spark, sf_dir), exclusions)


@query(f"""WITH {N.LINES_SQL}, {_SIGNED} SELECT doc_id, ord, amount / 100.0::DOUBLE AS amount FROM signed WHERE line % 3 <> 0""")
def active_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    exclusions = N.order_lines(spark, sf_dir).where(F.col("line") % 3 == 0)
    return A.active_matches(A.matches(N.invoice_texts(spark, sf_dir)), exclusions).select("doc_id", "ord", "amount")


@query(f"""WITH {N.LINES_SQL}, sums AS (SELECT doc_id, CAST(sum(tenths) AS BIGINT) AS t, count(*) AS n FROM lines GROUP BY doc_id)
SELECT doc_id, round(t / 10.0::DOUBLE, 10) AS total, 1 AS max_decimals, CAST(n AS INTEGER) AS n_active,
  ({_sql_grouped('CAST(t // 10 AS BIGINT)')}) || (CASE WHEN t % 10 > 0 THEN ',' || (t % 10) ELSE '' END) || chr(160) || 'g' AS sum_label FROM sums""")
def gram_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.document_totals(N.gram_texts(spark, sf_dir), mode="g").select("doc_id", "total", "max_decimals", "n_active", "sum_label")


_LARGE_SQL = "rtrim(reverse(regexp_replace(reverse(digits), '([0-9]{3})', '\\1' || chr(160), 'g')), chr(160))"


#: A scanner without looking around. The text is cut into stretches of digits, blanks, dots and commas (even places) and what
#: lies between them (odd places). A stretch holds one number at most: from its first digit, or the sign before it, that may
#: begin one, to its last digit. What may not stand before or follow is seen in the places beside it.
_SCANNED_SQL = f"""
numbered_texts AS (SELECT row_number() OVER () AS doc, doc_id, coalesce(text, '') AS text FROM documents),
parted AS (SELECT doc, string_split(regexp_replace(text, '([0-9 .,\\x{{A0}}]*[0-9][0-9 .,\\x{{A0}}]*)', chr(57344) || '\\1' || chr(57344), 'g'), chr(57344)) AS parts FROM numbered_texts),
stretches AS (
  SELECT doc, i, parts[i] AS z, right((CASE WHEN i > 2 THEN parts[i - 2] ELSE '' END) || parts[i - 1], 2) AS before,
    concat(parts[i + 1], parts[i + 2], parts[i + 3], parts[i + 4]) AS ahead
  FROM (SELECT doc, parts, unnest(range(2, len(parts), 2)) AS i FROM parted)
), starts AS (
  SELECT doc, i, k, z,
    CASE WHEN k = 0 THEN right(before, 1) ELSE '' END AS sign,
    CASE WHEN k = 0 THEN CASE WHEN length(before) = 2 THEN left(before, 1) ELSE '' END WHEN k = 1 THEN right(before, 1) ELSE z[k - 1] END AS prior,
    (CASE WHEN k = 0 THEN right(before, 1) ELSE '' END) || z[greatest(k, 1):] || ahead AS following
  FROM (SELECT *, unnest(range(0, length(z) + 1)) AS k FROM stretches)
  WHERE CASE WHEN k = 0 THEN right(before, 1) IN ('-', chr(8722)) AND regexp_matches(z, '^[0-9]') ELSE regexp_matches(z[k], '[0-9]') END
), firsts AS (
  SELECT doc, i, arg_min(sign || regexp_replace(z[greatest(k, 1):], '[^0-9]+$', ''), k) AS raw FROM starts
  WHERE NOT regexp_matches(prior, '[\\pL\\pN.\\-/:]') AND NOT regexp_matches(following, '^-?[0-9]{{1,2}}[.\\-/][0-9]{{1,2}}[.\\-/][0-9]{{2,4}}')
    AND NOT regexp_matches(following, '^-?[0-9]{{4}}[.\\-/][0-9]{{1,2}}[.\\-/][0-9]{{1,2}}') AND NOT regexp_matches(following, '^[0-9]{{1,2}}:[0-9]{{2}}') AND NOT regexp_matches(following, '^[0-9]+-[0-9]+/[0-9]+')
  GROUP BY doc, i
), closed AS (
  SELECT doc, i, replace(replace(replace(raw, chr(8722), '-'), ' ', ''), chr(160), '') AS s FROM firsts
), valued AS (
  SELECT doc, i, CASE WHEN regexp_matches(s, '[.,]') THEN length(regexp_extract(s, '[.,]([^.,]*)$', 1)) ELSE 0 END AS d,
    CAST(regexp_extract(CASE WHEN contains(s, '.') AND contains(s, ',') AND instr(reverse(s), '.') < instr(reverse(s), ',') THEN replace(s, ',', '')
      WHEN contains(s, '.') AND contains(s, ',') THEN regexp_replace(replace(s, '.', ''), ',', '.') ELSE regexp_replace(s, ',', '.') END, '^-?[0-9]+([.][0-9]*)?') AS DOUBLE) AS v
  FROM closed
), summed AS (
  SELECT doc, list_reduce(list(v ORDER BY i), lambda a, b: a + b) AS total, max(d) AS most, count(*) AS n FROM valued GROUP BY doc
), asked AS (
  SELECT doc, i, v, d FROM valued UNION ALL SELECT doc, NULL, total, most FROM summed
), exact AS (
  SELECT *, CASE WHEN abs(v) < 1e16 THEN abs(CAST(CAST(v AS VARCHAR) AS DECIMAL(38, 12))) END AS x FROM asked
), cut AS (
  SELECT *, CAST(CASE least(d, 10) {" ".join(f"WHEN {n} THEN CAST(round(x, {n}) AS DECIMAL(38, 12))" for n in range(11))} END AS VARCHAR) AS t,
    rpad(replace(split_part(CAST(abs(v) AS VARCHAR), 'e', 1), '.', ''), CAST(CASE WHEN abs(v) >= 1e16 THEN split_part(CAST(abs(v) AS VARCHAR), 'e+', 2) ELSE '0' END AS INTEGER) + 1, '0') AS digits FROM exact
), said AS (
  SELECT doc, i, (CASE WHEN v < 0 AND (x IS NULL OR regexp_matches(t, '[1-9]')) THEN chr(8722) ELSE '' END) || CASE WHEN x IS NULL THEN ltrim({_LARGE_SQL}, chr(160))
    ELSE rtrim(({_sql_grouped("CAST(split_part(t, '.', 1) AS BIGINT)")}) || ',' || rtrim(split_part(t, '.', 2), '0'), ',') END AS label FROM cut
), listed AS (
  SELECT doc, string_agg(label, chr(10) ORDER BY i) FILTER (i IS NOT NULL) AS amount_list, max(label) FILTER (i IS NULL) AS sum_label FROM said GROUP BY doc
)"""


@query(f"""WITH {_SCANNED_SQL}
SELECT doc_id, coalesce(CASE WHEN abs(total) < 1e16 THEN CAST(round(CAST(CAST(total AS VARCHAR) AS DECIMAL(38, 12)), 10) AS DOUBLE) ELSE total END, 0) AS total, coalesce(CAST(most AS INTEGER), 0) AS max_decimals, coalesce(CAST(n AS INTEGER), 0) AS n_active, coalesce(CAST(n AS INTEGER), 0) AS n_total,
  coalesce(sum_label, '0') AS sum_label, coalesce(CAST(n AS VARCHAR), '0') AS count_label, coalesce(amount_list, '') AS amount_list
FROM numbered_texts LEFT JOIN summed USING (doc) LEFT JOIN listed USING (doc)""")
def number_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.document_totals(N.table(spark, sf_dir, "documents"), mode="n")


@query(f"""WITH {N.LINES_SQL}, sums AS (SELECT doc_id, CAST(sum(tenths) AS BIGINT) AS t, count(*) AS n, string_agg(({_sql_grouped('CAST(tenths // 10 AS BIGINT)')}) || (CASE WHEN tenths % 10 > 0 THEN ',' || (tenths % 10) ELSE '' END), chr(10) ORDER BY ord) AS amount_list FROM lines GROUP BY doc_id)
SELECT doc_id, round(t / 10.0::DOUBLE, 10) AS total, 1 AS max_decimals, CAST(n AS INTEGER) AS n_active, CAST(n AS INTEGER) AS n_total,
  ({_sql_grouped('CAST(t // 10 AS BIGINT)')}) || (CASE WHEN t % 10 > 0 THEN ',' || (t % 10) ELSE '' END) AS sum_label, CAST(n AS VARCHAR) AS count_label, amount_list FROM sums""")
def record_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain numbers among dates, times and case numbers, which are none."""
    return A.document_totals(N.record_texts(spark, sf_dir), mode="n")


@query(f"""WITH large AS (SELECT o_orderkey AS doc_id, ltrim((o_orderkey % 100000) || '5', '0') || repeat('0', CAST(16 + o_orderkey % 25 AS INTEGER)) AS digits FROM orders),
shown AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN chr(8722) ELSE '' END || ltrim({_LARGE_SQL}, chr(160)) AS label FROM large)
SELECT doc_id, label || ',00' || chr(160) || '€' AS euros, label || chr(160) || 'g' AS grams, label AS plain FROM shown""")
def large_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts beyond what doubles count singly, in all three modes."""
    numbers = N.large_numbers(spark, sf_dir)
    said = lambda mode, unit, name: A.document_totals(numbers.select("doc_id", F.concat("number", F.lit(unit)).alias("text")), mode=mode).select("doc_id", F.col("sum_label").alias(name))
    return said("eur", " €", "euros").join(said("g", " g", "grams"), "doc_id").join(said("n", "", "plain"), "doc_id")


@query(f"""WITH {N.LINES_SQL}, {_SIGNED} SELECT doc_id, ord, amount / 100.0::DOUBLE AS amount, CAST(ord + 1 AS INTEGER) AS place FROM signed""")
def ordered_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each amount's place within its document in the order of the whole result."""
    found = A.order_matches(A.matches(N.invoice_texts(spark, sf_dir))).withColumn("_at", F.monotonically_increasing_id())
    return found.select("doc_id", "ord", "amount", F.row_number().over(Window.partitionBy("doc_id").orderBy("_at")).alias("place"))


@query(f"""WITH {N.LINES_SQL}, {_SIGNED}, sums AS (SELECT doc_id, CAST(sum(amount) AS BIGINT) AS total, count(*) AS n FROM signed GROUP BY doc_id)
SELECT doc_id, round(total / 100.0::DOUBLE, 10) AS total, CAST(n AS INTEGER) AS n_total FROM sums""")
def stored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of documents written as Parquet and read again."""
    folder = f"{shared_dir(spark)}/documents-{uuid.uuid4()}"
    N.invoice_texts(spark, sf_dir).write.parquet(folder)
    return A.document_totals(read_documents(spark, folder)).select("doc_id", "total", "n_total")


@query("""WITH own AS (SELECT n_nationkey AS k, s_suppkey AS s FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT s AS file_id, CAST(2 * s + 0.5 AS DOUBLE) AS total, 2 AS n_total FROM own""")
def stored_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of text files, one document a file, whose path is its id."""
    folder = f"{shared_dir(spark)}/texts-{uuid.uuid4()}"
    key = F.col("s_suppkey")
    text = F.concat(F.lit("Leping\n"), key.cast("string"), F.lit(",50 € ja\n"), key.cast("string"), F.lit(" eurot\n"))
    suppliers = N.table(spark, sf_dir, "supplier")
    write_documents(suppliers.select(key.alias("doc_id"), text.alias("text")), folder, "supplier=", suppliers.count() // 1000 + 1)
    found = A.document_totals(read_documents(spark, f"{folder}/*", "text"))
    return found.select(F.regexp_extract("doc_id", "supplier=([0-9]+)", 1).cast("long").alias("file_id"), "total", "n_total")


@query(f"""WITH {N.LINES_SQL}, {N.PLAIN_SQL}
SELECT doc_id, ord, raw, cents / 100.0::DOUBLE AS amount, 2 AS decimals, pos AS index, CAST(length(raw) AS INTEGER) AS match_len FROM offsets""")
def amount_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.with_offsets(N.plain_texts(spark, sf_dir))


_REVISED = "' ' || repeat(' ', CAST(9 + doc_id % 4 AS INTEGER))"


@query(f"""WITH {N.LINES_SQL}, {N.PLAIN_SQL}, revised AS (SELECT *, pos + CAST(9 + doc_id % 4 AS INTEGER) AS now FROM offsets)
SELECT doc_id, ord FROM revised r WHERE EXISTS (SELECT 1 FROM offsets o WHERE o.doc_id = r.doc_id AND o.line % 3 = 0 AND o.raw = r.raw AND abs(o.pos - r.now) <= 10)""")
def carried_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = N.plain_texts(spark, sf_dir)
    after = before.withColumn("text", F.concat(F.repeat(F.lit(" "), (9 + F.col("doc_id") % 4).cast("int")), F.col("text")))
    asked = N.order_lines(spark, sf_dir).where(F.col("line") % 3 == 0).select("doc_id", "ord")
    excluded = A.with_offsets(before).join(asked, ["doc_id", "ord"], "left_semi")
    return A.carry_exclusions(excluded, A.with_offsets(after))


@query(f"""WITH {N.LINES_SQL}, {N.PLAIN_SQL} SELECT doc_id, 'Arve ' || doc_id || ': ' || string_agg('<mark' || (CASE WHEN line % 3 = 0 THEN ' class="excluded"' ELSE '' END)
  || ' data-idx="' || ord || '">' || raw || '</mark>', ' &amp; ' ORDER BY ord) || '<span></span>' AS html FROM placed GROUP BY doc_id""")
def annotated_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexspark.functions.highlight import annotate

    asked = N.order_lines(spark, sf_dir).where(F.col("line") % 3 == 0).groupBy("doc_id").agg(F.collect_set("ord").alias("ords"))
    joined = N.plain_texts(spark, sf_dir).join(asked, "doc_id", "left")
    ords = F.coalesce(F.col("ords"), F.array().cast("array<int>"))
    return joined.select("doc_id", annotate(F.col("text"), ords, "eur").alias("html"))


@query(f"""WITH {N.LINES_SQL}, {_SIGNED} SELECT doc_id, ord, lpad(CAST(ord + 1 AS VARCHAR), 2, '0') AS row_no FROM signed""")
def numbered_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = A.matches(N.invoice_texts(spark, sf_dir)).select("doc_id", "ord")
    return A.numbered(found, 2, ["doc_id"], ["ord"])


# people


@query(f"""WITH {N.IDS_SQL}, weighed AS (
  SELECT *, list_sum(list_transform(range(1, 11), lambda i: CAST(ten[i] AS INTEGER) * ([1,2,3,4,5,6,7,8,9,1])[i])) % 11 AS r1,
    list_sum(list_transform(range(1, 11), lambda i: CAST(ten[i] AS INTEGER) * ([3,4,5,6,7,8,9,1,2,3])[i])) % 11 AS r2 FROM said
) SELECT person_id, kind = 'fine' AS valid,
  CASE kind WHEN 'length' THEN 'Isikukood peab olema 11 numbrit' WHEN 'century' THEN 'Esimene number peab olema 1–6' WHEN 'date' THEN 'Isikukoodi kuupäev on vigane' END AS error,
  CASE WHEN kind = 'fine' THEN person_id % 7 <> 0 END AS checksum_ok, CASE WHEN kind = 'fine' THEN d END AS born,
  CASE kind WHEN 'length' THEN CASE WHEN person_id % 5 = 0 THEN '4 numbrit puudu' ELSE '3 numbrit puudu' END WHEN 'century' THEN 'Esimene number peab olema 1–6' WHEN 'date' THEN 'Isikukoodi kuupäev on vigane'
    ELSE CASE WHEN person_id % 7 <> 0 THEN 'Kontrollnumber korrektne' ELSE 'Kontrollnumber vale' END END AS status FROM weighed""")
def id_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.with_id_code(N.id_codes(spark, sf_dir)).select("person_id", "parsed.valid", "parsed.error", "parsed.checksum_ok", "parsed.born", "status")


@query(f"""WITH {N.IDS_SQL}, born AS (
  SELECT person_id, ref, CASE WHEN kind = 'fine' THEN d WHEN person_id % 3 <> 0 THEN d END AS b FROM said
), months AS (
  SELECT *, (year(ref) - year(b)) * 12 + month(ref) - month(b) AS apart FROM born
), full_months AS (
  SELECT *, apart - CASE WHEN CAST(b + to_months(CAST(apart AS INTEGER)) AS DATE) > ref THEN 1 ELSE 0 END AS mm FROM months
), noted AS (
  SELECT *, ref >= b AS fine, month(b) = month(ref) AND day(b) = day(ref) AS today,
    make_date(year(ref), month(b), 1) + CAST(day(b) - 1 AS INTEGER) AS this_year FROM full_months
), nexts AS (SELECT *, year(ref) + CASE WHEN today OR this_year <= ref THEN 1 ELSE 0 END AS ny FROM noted)
SELECT person_id, b AS born, CASE WHEN ref < b THEN '// arvutuskuupäev on enne sünnikuupäeva' WHEN b IS NOT NULL THEN 'ok' END AS status,
  CASE WHEN fine THEN (mm // 12) || chr(160) || (CASE WHEN mm // 12 = 1 THEN 'aasta' ELSE 'aastat' END) || '  ' || (mm % 12) || chr(160) || (CASE WHEN mm % 12 = 1 THEN 'kuu' ELSE 'kuud' END)
    || '  ' || date_diff('day', CAST(b + to_months(CAST(mm AS INTEGER)) AS DATE), ref) || chr(160) || (CASE WHEN date_diff('day', CAST(b + to_months(CAST(mm AS INTEGER)) AS DATE), ref) = 1 THEN 'päev' ELSE 'päeva' END) END AS age_label,
  CASE WHEN fine THEN today END AS is_birthday, CASE WHEN fine THEN strftime(b, '%d.%m.') || ny END AS next_label,
  CASE WHEN fine THEN CAST(date_diff('day', ref, make_date(ny, month(b), 1) + CAST(day(b) - 1 AS INTEGER)) AS INTEGER) END AS days_until FROM nexts""")
def person_ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = P.person_age(N.id_codes(spark, sf_dir))
    return found.select("person_id", "born", "status", "age_label", "birthday.is_birthday", "birthday.next_label", "birthday.days_until")


@query("""WITH t AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS d FROM orders)
SELECT k AS case_id, strftime(d, '%d.%m.%Y') AS written, CAST(d + to_months(CAST(k % 50 AS INTEGER)) AS DATE) AS later,
  CAST(date_diff('day', d, CAST(d + to_months(CAST(k % 50 AS INTEGER)) AS DATE)) AS INTEGER) AS apart FROM t""")
def shifted_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    dates = N.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_id"), F.to_date("o_orderdate").alias("d"))
    later = dates.withColumn("later", C.add_months_clamped(F.col("d"), (F.col("case_id") % 50).cast("int")))
    return later.select("case_id", C.fmt_dmy(F.col("d")).alias("written"), "later", C.days_between(F.col("d"), F.col("later")).alias("apart"))


@query(f"""WITH {N.SENTENCES_SQL}, sums AS (SELECT person_id, sum(y) AS y, sum(m) AS m, sum(d) AS d FROM sentences GROUP BY person_id),
carried AS (SELECT person_id, CAST(y + (m + d // 30) // 12 AS BIGINT) AS years, CAST((m + d // 30) % 12 AS BIGINT) AS months, CAST(d % 30 AS BIGINT) AS days FROM sums)
SELECT *, CASE WHEN years + months + days = 0 THEN '—' ELSE concat_ws(' ',
  CASE WHEN years > 0 THEN years || chr(160) || (CASE WHEN years = 1 THEN 'aasta' ELSE 'aastat' END) END,
  CASE WHEN months > 0 THEN months || chr(160) || (CASE WHEN months = 1 THEN 'kuu' ELSE 'kuud' END) END,
  CASE WHEN days > 0 THEN days || chr(160) || (CASE WHEN days = 1 THEN 'päev' ELSE 'päeva' END) END) END AS label FROM carried""")
def merged_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.merge_sentences(N.sentences(spark, sf_dir), "person_id")


def _sql_release(num: str, den: str) -> str:
    end = "CAST(start_date + to_months(CAST(12 * y + m AS INTEGER)) AS DATE) + d"
    least = "date_diff('day', start_date, CAST(start_date + INTERVAL 4 MONTH AS DATE))"
    part = f"(date_diff('day', start_date, {end}) * {num}) // {den}"
    there = f"y + m + d > 0 AND {num} IS NOT NULL"
    return f"""CASE WHEN {there} THEN CAST(date_diff('day', start_date, {end}) AS INTEGER) END AS total_days,
  CASE WHEN {there} THEN start_date + CAST(greatest({part}, {least}) AS INTEGER) END AS release_date, CASE WHEN {there} THEN {least} > {part} END AS min_applied"""


@query(f"""WITH {N.SENTENCES_SQL}, rules AS (SELECT * FROM (VALUES (1, 3), (1, 2), (2, 3)) r(num, den))
SELECT case_id, num, den, {_sql_release('num', 'den')} FROM sentences, rules""")
def release_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.cross_release_rules(N.sentences(spark, sf_dir)).select("case_id", "num", "den", "total_days", "release_date", "min_applied")


#: The grounds in words of the SQL's own, so that a wrong one in the library shows.
_GROUNDS_SQL = """(1, 3, false, 'intentional', 'II', true, '§76 lg1 p1'), (1, 3, false, 'negligent', 'I', true, '§76 lg1 p1'),
  (1, 3, true, 'intentional', 'II', NULL, '§76¹ lg1 p1'), (1, 3, true, 'negligent', 'I', NULL, '§76¹ lg1 p1'),
  (1, 2, false, 'intentional', 'II', false, '§76 lg1 p2'), (1, 2, false, 'negligent', 'I', false, '§76 lg1 p2'),
  (1, 2, false, 'intentional', 'I', true, '§76 lg2 p1'), (1, 2, true, 'intentional', 'I', NULL, '§76¹ lg1 p2'),
  (2, 3, false, 'intentional', 'I', false, '§76 lg2 p2')"""


@query(f"""WITH {N.SENTENCES_SQL}, cases AS (
  SELECT *, case_id % 3 = 0 AS juvenile, CASE WHEN case_id % 2 = 0 THEN 'intentional' ELSE 'negligent' END AS intent,
    CASE WHEN (case_id // 2) % 2 = 0 THEN 'I' ELSE 'II' END AS degree, CASE (case_id // 4) % 3 WHEN 0 THEN true WHEN 1 THEN false END AS monitoring FROM sentences
), grounds AS (SELECT * FROM (VALUES {_GROUNDS_SQL}) g(num, den, j, i, g, mon, provision))
SELECT case_id, num, den, provision, {_sql_release('num', 'den')} FROM cases LEFT JOIN grounds ON juvenile = j AND intent = i AND degree = g AND (mon IS NULL OR coalesce(monitoring, false) = mon)""")
def applicable_releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("case_id")
    cases = N.sentences(spark, sf_dir).withColumns({
        "juvenile": key % 3 == 0,
        "intent": F.when(key % 2 == 0, "intentional").otherwise("negligent"),
        "degree": F.when(F.floor(key / 2) % 2 == 0, "I").otherwise("II"),
        "monitoring": F.when(F.floor(key / 4) % 3 == 0, True).when(F.floor(key / 4) % 3 == 1, False),
    })
    return P.applicable_release(cases).select("case_id", "num", "den", "provision", "total_days", "release_date", "min_applied")


# registers


@query(f"WITH {N.ANNEX_SQL} SELECT *, lpad(CAST(ord AS VARCHAR), 3, '0') AS row_no FROM substances")
def register_substances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.numbered_substances(R.substances(N.annex_words(spark, sf_dir), N.annex_rows(spark, sf_dir)))


@query(f"""WITH {N.ANNEX_SQL} SELECT doc_id, list_id, count(*) AS n_warnings FROM told WHERE entry = 0 GROUP BY doc_id, list_id""")
def register_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.classified_rows(R.page_events(N.annex_words(spark, sf_dir), N.annex_rows(spark, sf_dir)))
    return R.merge_continuations(rows)[1].groupBy("doc_id", "list_id").agg(F.count(F.lit(1)).alias("n_warnings"))


@query(f"""WITH {N.ANNEX_SQL}, full_lists AS (
  SELECT e.doc_id, l.list_id, count(s.ord) AS n FROM (SELECT DISTINCT doc_id FROM steps) e CROSS JOIN (SELECT CAST(range AS INTEGER) AS list_id FROM range(1, 7)) l
  LEFT JOIN substances s ON s.doc_id = e.doc_id AND s.list_id = l.list_id GROUP BY e.doc_id, l.list_id
), rolled AS (SELECT doc_id, list_id, CAST(sum(n) AS BIGINT) AS n FROM full_lists GROUP BY GROUPING SETS ((doc_id, list_id), (doc_id)))
SELECT *, n || (CASE WHEN list_id = 6 THEN ' rühma' ELSE ' ainet' END) AS label FROM rolled""")
def register_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = N.annex_rows(spark, sf_dir)
    return R.list_counts(R.substances(N.annex_words(spark, sf_dir), rows), rows.select("doc_id"))


@query(f"""WITH {N.ANNEX_SQL}, kept AS (SELECT * FROM substances WHERE NOT (doc_id = 'act1' AND list_id IN (2, 5)))
SELECT e.doc_id, list_sort(list(l.list_id)) AS empty_lists FROM (SELECT DISTINCT doc_id FROM steps) e CROSS JOIN (SELECT CAST(range AS INTEGER) AS list_id FROM range(1, 7)) l
WHERE NOT EXISTS (SELECT 1 FROM kept s WHERE s.doc_id = e.doc_id AND s.list_id = l.list_id) GROUP BY e.doc_id""")
def register_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = N.annex_rows(spark, sf_dir)
    subs = R.substances(N.annex_words(spark, sf_dir), rows).where(~((F.col("doc_id") == "act1") & F.col("list_id").isin(2, 5)))
    return R.validate_register(R.list_counts(subs, rows.select("doc_id")))


@query("""WITH steps AS (SELECT 'act' || (p_partkey // 100) AS doc_id, p_partkey % 100 AS step FROM part),
events AS (SELECT doc_id, step, 1 AS rank FROM steps UNION ALL SELECT doc_id, step, 0 FROM steps WHERE step % 10 = 0)
SELECT doc_id, CAST(step // 40 AS INTEGER) AS page, rank, CASE WHEN rank = 1 THEN CAST(step % 40 AS INTEGER) END AS row_idx,
  CAST(row_number() OVER (PARTITION BY doc_id ORDER BY step, rank) AS INTEGER) AS place FROM events""")
def ordered_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's place within its edition in the order of the whole result."""
    events = R.order_events(R.page_events(N.annex_words(spark, sf_dir), N.annex_rows(spark, sf_dir))).withColumn("_at", F.monotonically_increasing_id())
    return events.select("doc_id", "page", "rank", "row_idx", F.row_number().over(Window.partitionBy("doc_id").orderBy("_at")).alias("place"))


@query(f"""WITH {N.ANNEX_SQL} SELECT 'akt/' || doc_id AS act, '23.02.2026' AS effective_date, list_id, list_id = 6 AS is_groups, ord, et, en,
  ['I', 'II', 'III', 'IV', 'V', 'VI'][list_id] || ' nimekiri' AS title FROM substances""")
def stored_registers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registers written as JSON, one document a line, and read again row by row."""
    rows = N.annex_rows(spark, sf_dir)
    folder = f"{shared_dir(spark)}/registers-{uuid.uuid4()}"
    R.build_register(R.substances(N.annex_words(spark, sf_dir), rows), _meta(rows, "now")).select("meta", "lists").write.json(folder)
    return read_register(spark, folder, lines=True).select("meta.act", "effective_date", "list_id", "is_groups", "ord", "et", "en", "title")


def _drifting(spark: SparkSession, sf_dir: str) -> str:
    """A folder of registers whose shape changes with the edition: fields added, ids as text, English names missing; and for
    each edition a line that breaks off, a document of another kind, and a register with a wrong list and a wrong substance."""
    rows = N.annex_rows(spark, sf_dir)
    folder = f"{shared_dir(spark)}/drifting-{uuid.uuid4()}"
    built = R.build_register(R.substances(N.annex_words(spark, sf_dir), rows), _meta(rows, "now"))
    kind = F.substring("doc_id", 4, 18).cast("long") % 4
    text = F.to_json(F.struct("meta", "lists"))
    changed = (
        F.when(kind == 0, F.replace(F.replace(text, F.lit('"isGroups":'), F.lit('"colour":"red","isGroups":')), F.lit('"et":'), F.lit('"formula":{"n":1},"et":')))
        .when(kind == 1, F.regexp_replace(text, '"id":([0-9])', '"id":"$1"'))
        .when(kind == 2, F.regexp_replace(text, ',"en":"[^"]*"', ""))
        .otherwise(text)
    )
    wrong = '{"meta": {}, "lists": [{"id": "seven", "substances": []}, {"id": 2, "substances": [{"en": "x"}]}]}'
    built.select(F.explode(F.array(changed, F.substring(text, 1, 40), F.lit("[1, 2]"), F.lit(wrong))).alias("value")).write.text(folder)
    return folder


@query(f"""WITH {N.ANNEX_SQL}, kinds AS (SELECT *, CAST(substr(doc_id, 4) AS BIGINT) % 4 AS kind FROM substances)
SELECT 'akt/' || doc_id AS act, '23.02.2026' AS effective_date, list_id, list_id = 6 AS is_groups, ord, et, CASE WHEN kind = 2 THEN '' ELSE en END AS en,
  CASE WHEN kind = 0 THEN 'colour,formula' ELSE '' END AS unknown FROM kinds""")
def drifting_registers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registers of several shapes, read as variants."""
    rows, _ = read_drifting_register(spark, _drifting(spark, sf_dir))
    return rows.select("meta.act", "effective_date", "list_id", "is_groups", "ord", "et", "en", F.array_join("unknown", ",").alias("unknown"))


@query(f"""WITH {N.ANNEX_SQL}, editions AS (SELECT count(DISTINCT doc_id) AS n FROM steps)
SELECT reason, n FROM editions, (VALUES ('no JSON'), ('no register'), ('no list'), ('no name')) r(reason)""")
def quarantined_registers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of these registers can't be read, by reason."""
    _, bad = read_drifting_register(spark, _drifting(spark, sf_dir))
    return bad.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def _meta(rows: DataFrame, generated: str) -> DataFrame:
    return rows.select("doc_id").distinct().select("doc_id", F.lit("annex").alias("source"), F.concat(F.lit("akt/"), "doc_id").alias("act"), F.lit("23.02.2026").alias("effective_date"), F.lit(generated).alias("generated"))


@query(f"""WITH {N.ANNEX_SQL} SELECT e.doc_id, l.list_id AS id, l.list_id = 6 AS "isGroups", count(s.ord) AS n, coalesce(string_agg(s.et || '=' || s.en, ';' ORDER BY s.ord), '') AS listed
FROM (SELECT DISTINCT doc_id FROM steps) e CROSS JOIN (SELECT CAST(range AS INTEGER) AS list_id FROM range(1, 7)) l
LEFT JOIN substances s ON s.doc_id = e.doc_id AND s.list_id = l.list_id GROUP BY e.doc_id, l.list_id""")
def nested_registers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = N.annex_rows(spark, sf_dir)
    nested = R.build_register(R.substances(N.annex_words(spark, sf_dir), rows), _meta(rows, "now")).select("doc_id", F.explode("lists").alias("l"))
    listed = F.array_join(F.transform("l.substances", lambda s: F.concat(s["et"], F.lit("="), s["en"])), ";")
    return nested.select("doc_id", "l.id", "l.isGroups", F.size("l.substances").cast("long").alias("n"), listed.alias("listed"))


@query("""SELECT DISTINCT 'act' || (p_partkey // 100) AS doc_id, (p_partkey // 100) % 2 = 0 AS changed FROM part""")
def changed_registers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = N.annex_rows(spark, sf_dir)
    subs = R.substances(N.annex_words(spark, sf_dir), rows)
    edited = F.substring("doc_id", 4, 18).cast("long") % 2 == 0
    later = subs.withColumn("en", F.when(edited & (F.col("ord") == 1), F.concat("en", F.lit("!"))).otherwise(F.col("en")))
    return publish_plan(R.build_register(later, _meta(rows, "later")), R.build_register(subs, _meta(rows, "before")))


_TERMS_SQL = """
terms AS (SELECT DISTINCT ' ' || lower(p_type) AS q FROM part UNION SELECT DISTINCT upper(p_brand) || chr(160) FROM part UNION ALL SELECT 'zzz' UNION ALL SELECT '  '),
asked AS (SELECT q, trim(lower(q), ' ' || chr(160)) AS wanted FROM terms),
register AS (SELECT CAST(p_partkey % 6 + 1 AS INTEGER) AS list_id, p_partkey AS ord, p_name || ' <' || p_partkey || '>' AS et, p_type || ' & ' || p_brand AS en FROM part)"""
_ESCAPED = "replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_MARKED = "CASE WHEN wanted = '' THEN " + _ESCAPED + " ELSE regexp_replace(" + _ESCAPED + ", '(?i)(' || wanted || ')', '<mark>\\1</mark>', 'g') END"


@query(f"""WITH {_TERMS_SQL} SELECT q, list_id, ord, {_MARKED.format('et', 'et')} AS et_html, {_MARKED.format('en', 'en')} AS en_html
FROM asked, register WHERE wanted = '' OR contains(lower(et), wanted) OR contains(lower(en), wanted)""")
def register_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = N.search_terms(spark, sf_dir)
    hits = R.search_register(N.part_substances(spark, sf_dir), terms)
    return hits.join(terms, "query_id").select("q", "list_id", "ord", "et_html", "en_html")


@query(f"""WITH {_TERMS_SQL}, grid AS (SELECT q, wanted, CAST(range AS INTEGER) AS list_id FROM asked, range(1, 7)),
seen AS (SELECT g.q, g.wanted, g.list_id, count(r.ord) AS total, count(r.ord) FILTER (wanted = '' OR contains(lower(et), wanted) OR contains(lower(en), wanted)) AS visible
  FROM grid g LEFT JOIN register r ON r.list_id = g.list_id GROUP BY g.q, g.wanted, g.list_id)
SELECT q, list_id, visible, total, CASE WHEN wanted <> '' THEN visible || '/' || total ELSE total || (CASE WHEN list_id = 6 THEN ' rühma' ELSE ' ainet' END) END AS badge,
  wanted <> '' AND visible = 0 AS hidden, CASE WHEN wanted <> '' THEN CAST(sum(visible) OVER (PARTITION BY q) AS BIGINT) || ' tulemust' ELSE '' END AS result_label FROM seen""")
def search_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = N.search_terms(spark, sf_dir)
    found = R.search_counts(N.part_substances(spark, sf_dir), terms)
    return found.join(terms, "query_id").select("q", "list_id", "visible", "total", "badge", "hidden", "result_label")


@query("""WITH t AS (SELECT p_partkey AS k, p_name, p_type FROM part)
SELECT k AS row_id, CASE WHEN k % 6 = 0 THEN CAST((k // 6) % 6 + 1 AS INTEGER) END AS header, k % 6 = 1 OR k % 6 = 0 AS boilerplate,
  CASE k % 6 WHEN 0 THEN 'more_et' WHEN 1 THEN 'more_et' WHEN 2 THEN 'new' WHEN 3 THEN 'more_en' WHEN 4 THEN 'new' END AS kind,
  CASE WHEN k % 6 = 2 THEN p_name || '-' || p_type END AS et FROM t""")
def cell_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    numeral = F.element_at(F.array(*[F.lit(x) for x in ("I", "II", "III", "IV", "V", "VI")]), (F.floor(k / 6) % 6 + 1).cast("int"))
    cells = (
        F.when(k % 6 == 0, F.array(F.concat(numeral, F.lit("  Nimekiri "))))
        .when(k % 6 == 1, F.array(F.lit("3 / 12"), F.lit(None).cast("string")))
        .when(k % 6 == 2, F.array(F.concat(F.lit(" "), "p_name", F.lit("-\n"), "p_type"), F.concat("p_type", F.lit("\n\nx"))))
        .when(k % 6 == 3, F.array(F.lit(""), F.col("p_type")))
        .when(k % 6 == 4, F.array(F.col("p_name"), F.lit("ab")))
        .otherwise(F.array(F.lit("ab"), F.lit("cde")))
    )
    rows = N.table(spark, sf_dir, "part").select(k.alias("row_id"), cells.alias("cells")).where(R.non_empty_row(F.col("cells")))
    joined = R.joined_cells(F.col("cells"))
    said = R.classify_row(F.col("cells"))
    return rows.select("row_id", R.list_header(joined).alias("header"), R.is_boilerplate(joined).alias("boilerplate"), said["kind"].alias("kind"), F.when(F.col("row_id") % 6 == 2, said["et"]).alias("et"))


_ACTS_SQL = """WITH t AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS d FROM orders)
SELECT k AS act_id, CASE WHEN k % 10 <> 0 THEN 'https://www.riigiteataja.ee/public-api/api/v1/akt/' || k || '/blob-xml' END AS blob_url, CASE WHEN k % 10 = 0 THEN 'kehtivRedaktsioon puudub' END AS error,
  CASE WHEN k % 4 <> 3 AND k % 5 <> 0 THEN 'https://www.riigiteataja.ee/aktilisa/1110/8202/6010/' || k || '_LISA_1.pdf' END AS annex_url,
  CASE WHEN k % 4 = 3 THEN 'XML parsimine ebaõnnestus' WHEN k % 5 = 0 THEN 'Lisa 1 linki ei leitud' END AS annex_error,
  CASE k % 4 WHEN 0 THEN strftime(d, '%d.%m.%Y') WHEN 1 THEN 'alates ' || strftime(d, '%d.%m.%Y') WHEN 2 THEN strftime(d, '%d.%m.%Y') END AS effective_date FROM t"""


@query(_ACTS_SQL)
def act_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = acts.act_facts(acts.resolve_revision(N.act_bodies(spark, sf_dir)))
    return found.select("act_id", "blob_url", "error", "annex_url", "annex_error", "effective_date")


def _bundled(spark: SparkSession, sf_dir: str) -> str:
    """A folder of the acts' responses in bundles."""
    spark.dataSource.register(ActBundles)
    folder = f"{shared_dir(spark)}/acts-{uuid.uuid4()}"
    said = F.explode(F.map_from_arrays(F.array(F.lit("revision"), F.lit("xml")), F.array("body", "xml"))).alias("kind", "body")
    N.act_bodies(spark, sf_dir).select("act_id", said).write.format("act_bundles").mode("append").save(folder)
    return folder


@query(_ACTS_SQL)
def archived_acts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Acts whose responses were written to bundles and are read from there by ranges of files."""
    read = spark.read.format("act_bundles").option("range_bytes", 1 << 20).load(_bundled(spark, sf_dir))
    of = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("body"))).alias({"revision": "body"}.get(kind, kind))
    found = acts.act_facts(acts.resolve_revision(read.groupBy("act_id").agg(of("revision"), of("xml"))))
    return found.select("act_id", "blob_url", "error", "annex_url", "annex_error", "effective_date")


# streams


def _streamed(df: DataFrame) -> DataFrame:
    """df as a stream: written to the shared folder, and read from there file by file."""
    folder = f"{shared_dir(df.sparkSession)}/arrived-{uuid.uuid4()}"
    df.write.parquet(folder)
    return df.sparkSession.readStream.schema(df.schema).parquet(folder)


def _drained(stream: DataFrame) -> DataFrame:
    """What a stream yields for all that has arrived."""
    spark = stream.sparkSession
    folder = f"{shared_dir(spark)}/drained-{uuid.uuid4()}"
    running = stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", f"{folder}-log").trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(folder)


@query(f"""WITH {N.LINES_SQL}, {_SIGNED} SELECT doc_id, ord, amount / 100.0::DOUBLE AS amount, 2 AS decimals FROM signed""")
def streamed_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drained(S.stream_amounts(_streamed(N.invoice_texts(spark, sf_dir)))).drop("raw")


@query(f"SELECT act_id, annex_url, annex_error, effective_date FROM ({_ACTS_SQL})")
def streamed_acts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What act documents say as their bundles arrive."""
    stream = spark.readStream.format("act_bundles").load(_bundled(spark, sf_dir)).where("kind = 'xml'").withColumnRenamed("body", "xml")
    return _drained(acts.act_facts(stream).select("act_id", "annex_url", "annex_error", "effective_date"))


@query(f"""WITH {N.LINES_SQL}, {N.PLAIN_SQL}, revised AS (SELECT *, pos + CAST(9 + doc_id % 4 AS INTEGER) AS now FROM offsets)
SELECT doc_id, 0 AS revision, ord, raw, pos AS index FROM offsets WHERE line % 3 = 0 UNION ALL
SELECT doc_id, 1 AS revision, ord, raw, now AS index FROM revised r WHERE EXISTS (SELECT 1 FROM offsets o WHERE o.doc_id = r.doc_id AND o.line % 3 = 0 AND o.raw = r.raw AND abs(o.pos - r.now) <= 10)""")
def streamed_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = N.order_lines(spark, sf_dir).where(F.col("line") % 3 == 0).groupBy("doc_id").agg(F.collect_set("ord").alias("excluded"))
    before = N.plain_texts(spark, sf_dir).join(asked, "doc_id", "left")
    shifted = F.concat(F.repeat(F.lit(" "), (9 + F.col("doc_id") % 4).cast("int")), F.col("text"))
    revision = lambda number, text, excluded: F.struct(F.lit(number).alias("revision"), text.alias("text"), excluded.alias("excluded"))
    both = F.array(revision(0, F.col("text"), F.col("excluded")), revision(1, shifted, F.lit(None).cast("array<int>")))
    arrived = before.select("doc_id", F.explode(both).alias("r")).select("doc_id", "r.*")
    groups = max(N.table(spark, sf_dir, "orders").count() // 256, 64)
    return _drained(S.stream_carry_exclusions(_streamed(arrived), idle_ms=None, groups=groups))


@query("""SELECT DISTINCT 'act' || (p_partkey // 100) AS doc_id, (p_partkey // 100) % 2 = 0 AS replaced FROM part""")
def streamed_registers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches, of which the second holds two revisions of each edition, the older one with content that must not stay."""
    rows = N.annex_rows(spark, sf_dir)
    subs = R.substances(N.annex_words(spark, sf_dir), rows)
    edited = F.substring("doc_id", 4, 18).cast("long") % 2 == 0
    first = F.col("ord") == 1
    between = subs.withColumn("en", F.when(first, F.concat("en", F.lit("?"))).otherwise(F.col("en")))
    later = subs.withColumn("en", F.when(edited & first, F.concat("en", F.lit("!"))).otherwise(F.col("en")))
    path = f"{shared_dir(spark)}/registers-{uuid.uuid4()}"
    built = lambda entries, made: R.build_register(entries, _meta(rows, made))
    for step, arrived in enumerate((built(subs, "1"), built(later, "3").unionByName(built(between, "2")))):
        S.stream_publish(_streamed(arrived), path, f"{path}-log{step}").awaitTermination()
    out = read_published(spark, path)
    wrong = F.exists("lists", lambda x: F.exists(x["substances"], lambda s: s["en"].endswith("?")))
    return out.select("doc_id", F.when(~wrong, F.col("meta.generated") == "3").alias("replaced"))
