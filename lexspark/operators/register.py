"""A legal annex's cells and words made into registers of controlled substances.

Inputs: annex_words (doc_id, page, word_idx, text, top) and annex_rows (doc_id, page, table_idx, row_idx, tbl_top,
cells). One edition (doc_id) is read in order; editions are independent, so everything is keyed by doc_id or finer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexspark.functions.highlight import highlight
from lexspark.functions.text import BLANK, padded, strip_blank

#: The lists' headings, titles and descriptions, the boilerplate rows, and the known wrong names.
HEADERS = {"I NIMEKIRI": 1, "II NIMEKIRI": 2, "III NIMEKIRI": 3, "IV NIMEKIRI": 4, "V NIMEKIRI": 5, "VI NIMEKIRI": 6}
LISTS = (
    (1, "I nimekiri", "Koige rangemalt piiritletud ained, meditsiiniline kasutus puudub", False),
    (2, "II nimekiri", "Opioidid ja korge riskiga narkootikumid", False),
    (3, "III nimekiri", "Kontrollitud ained piiratud meditsiinilise kasutusega", False),
    (4, "IV nimekiri", "Psyhhotroopsed ained meditsiinilise kasutusega", False),
    (5, "V nimekiri", "Lahteained ja muud kontrollitud ained", False),
    (6, "VI nimekiri", "Kontrollitud ainegruhmad (mitte yksikained)", True),
)
BOILERPLATE = (
    r"^eestikeelne", r"^ingliskeelne", r"^nimetus", r"^aineryhma", r"narkootiliste.*ainete", r"^[ivx]+\s+nimekiri\s*$",
    r"^\d+\s*/\s*\d+$",
)
CORRECTIONS = (("dilämmastikoksiid (n2o)", "Nitrous oxide (N2O)"),)

NO_CELLS = "array<string>"


def clean_cell(c: Column) -> Column:
    """Line breaks gone (after a hyphen without a space), spaces collapsed, ends stripped; null is empty."""
    joined = F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("-\n"), F.lit("-")), F.lit("\n"), F.lit(" "))
    return strip_blank(F.regexp_replace(joined, " {2,}", " "))


def list_header(c: Column) -> Column:
    """The list a heading names; null for any other text."""
    cleaned = F.regexp_replace(strip_blank(F.upper(c)), f"[{BLANK}]+", " ")
    found = None
    for heading, number in HEADERS.items():
        found = F.when(cleaned == heading, number) if found is None else found.when(cleaned == heading, number)
    return found


def non_empty_row(cells: Column) -> Column:
    return F.coalesce(F.exists(cells, lambda c: c.isNotNull() & (c != "")), F.lit(False))


def joined_cells(cells: Column) -> Column:
    """The row's text: its cells that hold something, cleaned."""
    return F.array_join(F.transform(F.filter(cells, lambda c: c.isNotNull() & (c != "")), clean_cell), " ")


def is_boilerplate(joined: Column) -> Column:
    return F.lower(joined).rlike("|".join(f"(?:{p})" for p in BOILERPLATE))


def classify_row(cells: Column) -> Column:
    """struct<kind, et, en> of the first two cells; kind is 'new', 'more_et', 'more_en', or null for rows to drop."""
    et, en = clean_cell(F.get(cells, 0)), clean_cell(F.get(cells, 1))
    kind = (
        F.when((et == "") & (en != ""), "more_en")
        .when((en == "") & (et != ""), "more_et")
        .when(F.length(et) > 2, "new")
    )
    return F.struct(kind.alias("kind"), et.alias("et"), F.when((kind != "new") | (F.length(en) > 2), en).otherwise("").alias("en"))


def assemble_lines(words: DataFrame) -> DataFrame:
    """(doc_id, page, pos, line): a page's words of the same rounded top, in word order. Halves round to even."""
    parts = F.array_sort(F.collect_list(F.struct("word_idx", "text")))
    lines = words.groupBy("doc_id", "page", F.bround("top").alias("pos")).agg(parts.alias("parts"))
    return lines.select("doc_id", "page", "pos", F.array_join(F.col("parts.text"), " ").alias("line"))


def page_events(words: DataFrame, rows: DataFrame) -> DataFrame:
    """Headings among the lines, and the non-empty table rows, with the columns that order them; headings go first."""
    headings = assemble_lines(words).withColumn("header", list_header(F.col("line"))).where(F.col("header").isNotNull())
    heads = headings.select("doc_id", "page", F.col("pos").cast("double").alias("pos"), F.lit(0).alias("rank"), "header")
    table = rows.where(non_empty_row(F.col("cells"))).select(
        "doc_id", "page", (F.col("tbl_top") + F.col("row_idx")).alias("pos"), F.lit(1).alias("rank"), "table_idx", "row_idx", "cells",
        joined_cells(F.col("cells")).alias("joined"),
    ).withColumn("header", list_header(F.col("joined")))
    return heads.unionByName(table, allowMissingColumns=True)


#: The order in which an edition is read.
READING = ["page", "pos", "rank", "table_idx", "row_idx"]


def order_events(events: DataFrame) -> DataFrame:
    return events.orderBy("doc_id", *READING)


def carry_list(events: DataFrame) -> DataFrame:
    """events with list_id, the last heading so far in the edition, across pages; and seq, the place in reading order."""
    so_far = Window.partitionBy("doc_id").orderBy(*READING)
    current = F.last("header", ignorenulls=True).over(so_far.rowsBetween(Window.unboundedPreceding, 0))
    return events.withColumns({"list_id": current, "seq": F.row_number().over(so_far)})


def drop_before_first_list(events: DataFrame) -> DataFrame:
    return events.where(F.col("list_id").isNotNull())


def classified_rows(events: DataFrame) -> DataFrame:
    """(doc_id, list_id, seq, kind, et, en) of the rows that say something about a substance."""
    rows = drop_before_first_list(carry_list(events)).where(F.col("cells").isNotNull() & F.col("header").isNull() & ~is_boilerplate(F.col("joined")))
    said = rows.select("doc_id", "list_id", "seq", classify_row(F.col("cells")).alias("c"))
    return said.where(F.col("c.kind").isNotNull()).select("doc_id", "list_id", "seq", "c.kind", "c.et", "c.en")


def merge_continuations(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries (doc_id, list_id, seq, et, en), and warnings: continuations of a list that has no entry yet.

    A continuation belongs to the last entry of its own list, even if another list came between.
    """
    so_far = Window.partitionBy("doc_id", "list_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    entry = F.sum(F.when(F.col("kind") == "new", 1).otherwise(0)).over(so_far)
    marked = rows.withColumn("entry", entry)
    parts = F.array_sort(F.collect_list(F.struct("seq", "et", "en")))
    merged = marked.where(F.col("entry") > 0).groupBy("doc_id", "list_id", "entry").agg(F.min("seq").alias("seq"), parts.alias("parts"))
    said = lambda k: F.array_join(F.filter(F.col(f"parts.{k}"), lambda x: x != ""), " ")
    entries = merged.select("doc_id", "list_id", "seq", said("et").alias("et"), said("en").alias("en"))
    return entries, marked.where(F.col("entry") == 0).select("doc_id", "list_id", "seq", "kind", "et", "en")


def _key(c: Column) -> Column:
    return strip_blank(F.lower(c))


def dedupe_substances(entries: DataFrame) -> DataFrame:
    """The first entry of each name in a list, case aside; blank names go."""
    first = Window.partitionBy("doc_id", "list_id", "key").orderBy("seq")
    keyed = entries.withColumn("key", _key(F.col("et"))).where(F.col("key") != "")
    return keyed.withColumn("n", F.row_number().over(first)).where(F.col("n") == 1).drop("n", "key")


def apply_corrections(entries: DataFrame, corrections=CORRECTIONS) -> DataFrame:
    """English names that repeat the Estonian one, replaced where the table of corrections (name, English) has them."""
    table = entries.sparkSession.createDataFrame(list(corrections), "correct_key string, correct_en string")
    joined = entries.join(F.broadcast(table), _key(F.col("et")) == F.col("correct_key"), "left")
    wrong = F.col("correct_en").isNotNull() & (_key(F.col("en")) == F.col("correct_key"))
    return joined.withColumn("en", F.when(wrong, F.col("correct_en")).otherwise(F.col("en"))).drop("correct_key", "correct_en")


def order_substances(entries: DataFrame) -> DataFrame:
    """entries with ord, from 1 within a list: by lower-cased name, equal names in reading order."""
    return entries.withColumn("ord", F.row_number().over(Window.partitionBy("doc_id", "list_id").orderBy(F.lower("et"), "seq")))


def substances(words: DataFrame, rows: DataFrame) -> DataFrame:
    """(doc_id, list_id, ord, et, en): the clean register of every edition."""
    entries, _ = merge_continuations(classified_rows(page_events(words, rows)))
    return order_substances(apply_corrections(dedupe_substances(entries))).select("doc_id", "list_id", "ord", "et", "en")


def list_dim(spark: SparkSession) -> DataFrame:
    """The six lists."""
    return spark.createDataFrame(list(LISTS), "list_id int, title string, description string, is_groups boolean")


def with_list_meta(df: DataFrame) -> DataFrame:
    """The lists left-joined with df, so that empty lists stay."""
    return F.broadcast(list_dim(df.sparkSession)).join(df, "list_id", "left")


def _grid(df: DataFrame, keys: list[str]) -> DataFrame:
    """Every list for each of the keys' rows."""
    return df.select(*keys).distinct().withColumn("list_id", F.explode(F.sequence(F.lit(1), F.lit(6))))


def list_counts(subs: DataFrame, editions: DataFrame | None = None) -> DataFrame:
    """(doc_id, list_id, n, label) for all six lists of each edition, and a total with list_id null: one rollup, in which
    every list of an edition stands with nothing to count, so that empty lists stay."""
    grid = _grid(editions if editions is not None else subs, ["doc_id"]).select("doc_id", "list_id", F.lit(0).alias("one"))
    rolled = subs.select("doc_id", "list_id", F.lit(1).alias("one")).unionByName(grid).rollup("doc_id", "list_id")
    counted = rolled.agg(F.sum("one").alias("n"), F.grouping_id().alias("level")).where("level < 2").drop("level")
    unit = F.when(F.col("list_id") == 6, " rühma").otherwise(" ainet")
    return counted.withColumn("label", F.concat(F.col("n").cast("string"), unit))


def validate_register(counts: DataFrame) -> DataFrame:
    """(doc_id, empty_lists) of the editions that must not be published: some list is empty."""
    empty = counts.where(F.col("list_id").isNotNull() & (F.col("n") == 0))
    return empty.groupBy("doc_id").agg(F.array_sort(F.collect_list("list_id")).alias("empty_lists"))


# search


def substance_matches(et: Column, en: Column, q: Column) -> Column:
    """Whether the query, trimmed and case aside, is empty or part of either name."""
    return _holds(F.lower(et), F.lower(en), strip_blank(F.lower(q)))


def _holds(low_et: Column, low_en: Column, wanted: Column) -> Column:
    return F.coalesce(low_et, F.lit("")).contains(wanted) | F.coalesce(low_en, F.lit("")).contains(wanted)


#: Names are indexed by stretches of so many characters; shorter queries by stretches of their own length.
GRAM = 3
#: What is broadcast has at most so many rows and characters; beyond, the join is left to Spark.
MOST_KEYS, MOST_CHARS = 200_000, 16 << 20


def grams(lowered: Column, n: int) -> Column:
    """The different stretches of n characters of a text, of 0 the empty one."""
    if not n:
        return F.array(F.lit(""))
    return F.array_distinct(F.regexp_extract_all(lowered, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)))


def _lowered(subs: DataFrame) -> DataFrame:
    return subs.withColumns({"low_et": F.lower("et"), "low_en": F.lower(F.coalesce("en", F.lit("")))})


def _row_grams(lengths: list[int]) -> Column:
    """A row's postings: the different stretches of either name, of all lengths asked for."""
    made = [g for n in lengths for g in (grams(F.coalesce(F.col("low_et"), F.lit("")), n), grams(F.col("low_en"), n))]
    return F.explode(F.array_distinct(F.concat(*made)))


def _hinted(keys: DataFrame, text: str) -> DataFrame:
    """keys, marked for broadcast only if they are few and short."""
    rows, chars = keys.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length(text)), F.lit(0))).first()
    return F.broadcast(keys) if rows <= MOST_KEYS and chars <= MOST_CHARS else keys


def rarest_grams(subs: DataFrame, wanted: DataFrame) -> tuple[DataFrame, list[int]]:
    """(gram, wanted): for each different query the one of its stretches that the fewest rows hold; and the lengths.

    Only stretches that some query holds are counted, by a map-side aggregate over the rows' postings.
    """
    distinct = wanted.select("wanted").distinct()
    lengths = sorted(r[0] for r in distinct.select(F.least(F.length("wanted"), F.lit(GRAM))).distinct().collect())
    own = [F.when(F.least(F.length("wanted"), F.lit(GRAM)) == n, grams(F.col("wanted"), n)) for n in lengths]
    asked = distinct.select("wanted", F.explode(F.coalesce(*own) if own else F.array(F.lit(""))).alias("gram"))
    if not lengths:
        return asked, [0]
    keys = _hinted(asked.select("gram").distinct(), "gram")
    held = _lowered(subs).select(_row_grams(lengths).alias("gram")).join(keys, "gram", "left_semi").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rare = asked.join(held, "gram", "left").groupBy("wanted").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("gram"))
    return rare.select("gram", "wanted"), lengths


def matching(subs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of subs beside each different query (wanted: trimmed and lower-cased) that either name holds.

    An inverted index by stretches of characters: a row's postings meet the queries by equality, each query under its
    rarest stretch alone, so that a row and a query meet once at most; what meets is then verified. The plan is the same
    for any number of queries; few of them are broadcast, and then no row is moved. A query of one or two characters is
    a stretch itself, and an empty one is the stretch that all rows hold.
    """
    rare, lengths = rarest_grams(subs, wanted)
    posted = _lowered(subs).withColumn("gram", _row_grams(lengths))
    return posted.join(_hinted(rare, "wanted"), "gram").where(_holds(F.col("low_et"), F.col("low_en"), F.col("wanted"))).drop("gram", "low_et", "low_en")


def _wanted(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", strip_blank(F.lower(F.coalesce("q", F.lit("")))).alias("wanted"))


def search_register(subs: DataFrame, queries: DataFrame) -> DataFrame:
    """Every (query_id, q) against every row: the hits, with both names highlighted. Equal queries are searched once."""
    wanted = _wanted(queries)
    hits = matching(subs, wanted)
    shown = hits.withColumns({"et_html": highlight(F.col("et"), F.col("wanted")), "en_html": highlight(F.coalesce("en", F.lit("")), F.col("wanted"))})
    return shown.join(wanted, "wanted")


def search_counts(subs: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, list_id, visible, total, badge, hidden, result_label) for every query and list.

    Hits are counted by different query; one rollup gives the counts by list and by query.
    """
    totals = with_list_meta(subs.groupBy("list_id").agg(F.count(F.lit(1)).alias("k"))).select("list_id", F.coalesce("k", F.lit(0)).alias("total"))
    wanted = _wanted(queries)
    counted = matching(subs, wanted).rollup("wanted", "list_id").agg(F.count(F.lit(1)).alias("v"), F.grouping_id().alias("level")).where("level < 2")
    lists = F.filter(F.collect_list(F.struct("level", "list_id", "v")), lambda x: x["level"] == 0)
    seen = counted.groupBy("wanted").agg(lists.alias("lists"), F.max(F.when(F.col("level") == 1, F.col("v"))).alias("all_hits"))
    joined = wanted.join(seen, "wanted", "left").withColumn("list_id", F.explode(F.sequence(F.lit(1), F.lit(6))))
    own = F.get(F.filter("lists", lambda x: x["list_id"] == F.col("list_id")), 0)["v"]
    full = joined.withColumn("visible", F.coalesce(own, F.lit(0).cast("long"))).join(F.broadcast(totals), "list_id")
    asked = F.col("wanted") != ""
    unit = F.when(F.col("list_id") == 6, " rühma").otherwise(" ainet")
    badge = F.when(asked, F.concat(F.col("visible").cast("string"), F.lit("/"), F.col("total").cast("string"))).otherwise(F.concat(F.col("total").cast("string"), unit))
    label = F.when(asked, F.concat(F.coalesce("all_hits", F.lit(0)).cast("string"), F.lit(" tulemust"))).otherwise("")
    return full.select("query_id", "list_id", "visible", "total", badge.alias("badge"), (asked & (F.col("visible") == 0)).alias("hidden"), label.alias("result_label"))


def numbered_substances(subs: DataFrame) -> DataFrame:
    """subs with row_no, the place in the list padded to three digits."""
    return subs.withColumn("row_no", padded(F.col("ord"), 3))


# publishing


def build_register(subs: DataFrame, meta: DataFrame) -> DataFrame:
    """(doc_id, meta, lists): one nested document an edition, with all six lists in order, empty ones included.

    meta: doc_id, source, act, effective_date, generated.
    """
    entry = F.struct("ord", F.struct("et", "en").alias("s"))
    own = subs.groupBy("doc_id", "list_id").agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    grid = meta.select("doc_id").withColumn("list_id", F.explode(F.sequence(F.lit(1), F.lit(6))))
    full = grid.join(F.broadcast(list_dim(subs.sparkSession)), "list_id").join(own, ["doc_id", "list_id"], "left")
    none = F.array().cast("array<struct<et:string,en:string>>")
    listed = F.struct(F.col("list_id").alias("id"), "title", "description", F.col("is_groups").alias("isGroups"), F.coalesce(F.col("entries.s"), none).alias("substances"))
    lists = full.groupBy("doc_id").agg(F.array_sort(F.collect_list(listed)).alias("lists"))
    head = meta.select("doc_id", F.struct("source", "act", "effective_date", "generated").alias("meta"))
    return head.join(lists, "doc_id").select("doc_id", "meta", "lists")


def content_hash() -> Column:
    """A digest of a register's content, the time of its making aside."""
    return F.sha2(F.to_json(F.struct(F.struct("meta.source", "meta.act", "meta.effective_date").alias("meta"), "lists")), 256)


def changed_registers(new: DataFrame, old: DataFrame | None) -> DataFrame:
    """new with changed: whether an edition is new or differs from old in more than meta.generated."""
    fresh = new.withColumn("_hash", content_hash())
    if old is None:
        return fresh.withColumn("changed", F.lit(True)).drop("_hash")
    known = old.select("doc_id", content_hash().alias("_old"))
    return fresh.join(known, "doc_id", "left").withColumn("changed", ~F.col("_hash").eqNullSafe(F.col("_old"))).drop("_hash", "_old")
