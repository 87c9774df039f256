"""Amounts of documents: totals, positions, and exclusions that follow an amount through revisions of its text.

Documents are (doc_id, text), matches (doc_id, ord, raw, amount, decimals[, index, match_len]), exclusions (doc_id, ord).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexspark.functions import amounts as A
from lexspark.functions.text import BLANK, padded


def with_amounts(docs: DataFrame, mode: str = "eur") -> DataFrame:
    """docs with the array of their amounts as column matches."""
    return docs.withColumn("matches", A.extract_amounts(F.col("text"), mode))


def matches(docs: DataFrame, mode: str = "eur") -> DataFrame:
    """One row per amount, in text order by ord."""
    found = with_amounts(docs.select("doc_id", "text"), mode)
    exploded = found.select("doc_id", F.explode_outer("matches").alias("m")).where(F.col("m").isNotNull())
    return exploded.select("doc_id", "m.ord", "m.raw", "m.amount", "m.decimals")


def with_offsets(docs: DataFrame, mode: str = "eur") -> DataFrame:
    """matches, with index and match_len in UTF-16 units; each row of docs has its own, whatever its doc_id."""
    # an inner explode would test the array first, below the columns that make it, and so make it twice
    placed = A.with_places(docs.select("doc_id", "text"), mode).select("doc_id", F.explode_outer("places").alias("p"))
    numbers = placed.where(F.col("p").isNotNull()).select("doc_id", "p.*", A.number_part(F.col("p.raw")).alias("_number"))
    return numbers.select(
        "doc_id", "ord", "raw", A.parse_amount(F.col("_number")).alias("amount"), A.count_decimals(F.col("_number")).alias("decimals"), "index", "match_len"
    )


def order_matches(found: DataFrame) -> DataFrame:
    return found.orderBy("doc_id", "ord")


def active_matches(found: DataFrame, exclusions: DataFrame) -> DataFrame:
    """The matches that aren't excluded."""
    return found.join(exclusions.select("doc_id", "ord"), ["doc_id", "ord"], "left_anti")


def carry_exclusions(previous: DataFrame, found: DataFrame, tolerance: int = 10) -> DataFrame:
    """(doc_id, ord) of the new matches that stay excluded: an excluded match of the previous revision has the same text
    and begins at most `tolerance` units away.

    Positions are cut into cells of tolerance + 1, and each excluded match is offered to its own cell and the two
    beside it, so that a text repeated often in one document is compared with near neighbours only.
    """
    width = tolerance + 1
    cell = F.floor(F.col("index") / width)
    near = previous.select("doc_id", "raw", F.col("index").alias("was"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell"))
    new = found.withColumn("cell", cell)
    same = (new["doc_id"] == near["doc_id"]) & (new["raw"] == near["raw"]) & (new["cell"] == near["cell"])
    return new.join(near, same & (F.abs(near["was"] - new["index"]) <= tolerance), "left_semi").select("doc_id", "ord")


def document_totals(docs: DataFrame, exclusions: DataFrame | None = None, mode: str = "eur") -> DataFrame:
    """doc_id, total, max_decimals, n_active, n_total, sum_label, count_label, amount_list for every document.

    Amounts are added inside their row, left to right. A document's exclusions come to it as one array, so that only
    they are grouped, and the documents meet them in one join. A blank text reads "0", "0".
    """
    blank = F.coalesce(F.col("text"), F.lit("")).rlike(f"^[{BLANK}]*$")
    # the text goes before the join: only amounts are moved
    rows = docs.select("doc_id", A.extract_amounts(F.col("text"), mode).alias("matches"), blank.alias("blank"))
    if exclusions is None:
        rows = rows.withColumn("active", F.col("matches"))
    else:
        own = exclusions.groupBy("doc_id").agg(F.collect_set("ord").alias("ords"))
        joined = rows.join(own, "doc_id", "left")
        kept = F.filter("matches", lambda m: ~F.array_contains(F.coalesce(F.col("ords"), F.array().cast("array<int>")), m["ord"]))
        rows = joined.withColumn("active", kept)
    n_active, n_total = F.size("active"), F.size("matches")
    total, decimals = A.total_amount(F.col("active")), A.max_decimals(F.col("active"))
    figured = rows.select("doc_id", "active", "blank", total.alias("total"), decimals.alias("max_decimals"), n_active.alias("n_active"), n_total.alias("n_total"))
    shown = A.format_value(F.col("total"), F.col("max_decimals"), mode)
    return figured.select(
        "doc_id", F.round("total", 10).alias("total"), "max_decimals", "n_active", "n_total",
        F.when(F.col("blank"), "0").otherwise(shown).alias("sum_label"),
        F.when(F.col("blank"), "0").otherwise(A.count_label(F.col("n_active"), F.col("n_total"))).alias("count_label"),
        A.copy_list(F.col("active"), mode).alias("amount_list"),
    )


def numbered(df: DataFrame, width: int, partition: list[str], order: list) -> DataFrame:
    """df with row_no, counted from 1 within a partition and padded to a width."""
    number = F.row_number().over(Window.partitionBy(*partition).orderBy(*order))
    return df.withColumn("row_no", padded(number, width))
