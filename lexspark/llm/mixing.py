"""Mixing sources to target weights by systematic sampling.

Each document of a source has the same expected number of copies, target / source size. The prefix sums of these
expectations run over a source's documents in an order by size level, so that the words taken come near the target;
one random offset is added, and a document is emitted once for each integer boundary its step crosses.

A source's documents are ordered by (size level, a hash of the doc_id, size, doc_id). Sizes are counted once and kept
with the ids, and all ranks come from these rows: counts by (source, level, leading bits of the hash) are running-summed
to give each such bucket its first rank, and ranks inside a bucket come from a window over that bucket alone. There are
so many buckets that each holds about `BUCKET_ROWS` rows, whatever the size of the input; the order doesn't depend on
their number. `mix` then finds its rows again by a key of their own, so that texts are moved once and no bucket holds them.

Defined cases: null and empty texts have size 0 and are never counted in words; very long texts count whole and come up
to max_repeat times like any other; rows of one source equal in size and doc_id are ordered by nothing else, and together take the same; null sources form one source, ordered
last; a source without words has target 0; repeated rows are separate documents; an empty table gives no rows; other
columns, of whatever names, are carried along by `mix` and ignored by `plan`.
"""

from __future__ import annotations

import math
import random
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexspark.llm.common import ROW_KEY, WORD, bounded, carried, checkpointed, row_key

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_REPEAT = 2
SEED = 20_231
BUCKET_ROWS = 20_000
HASH_BITS = 24


def offset_of(seed: int) -> float:
    """The one random offset of a run, the same on every rerun with this seed."""
    return round(random.Random(seed).random(), 9)


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _sized(docs: DataFrame, told: dict[str, Column]) -> DataFrame:
    """doc_id, source, _size, the columns that order a source's documents, and the columns told; kept."""
    bits = F.bin("_size")
    hashed = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, HASH_BITS // 4), 16, 10).cast("int")
    sized = docs.select("doc_id", F.col("source").alias("_source"), size_of(F.col("text")).alias("_size"), *[c.alias(k) for k, c in told.items()])
    return checkpointed(sized.withColumns({"_level": F.length(bits), "_sublevel": F.substring(bits, 1, 4), "_hash": hashed}))


def source_targets(
    source_sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, max_repeat: float = MAX_REPEAT
) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources by code point, null last, take the weights in turn. share x all words are divided by weight; a target stops
    at max_repeat x its source's size and the excess is shared anew. The fixed point has a closed form: in ascending
    order of limit / weight, with all sources before one at their limits, what is left for it and those after it reaches
    a level. Levels rise as long as sources stop at their limits and fall from the first that doesn't, so that the
    highest is the last one, and a source gets that level times its weight or its limit. Should the share be more than
    all limits together, all sources are at their limits. One row per source, so its windows are over a small summary.
    """
    by_code = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_code) - 1) % len(weights) + 1).cast("int"))
    ranked = source_sizes.withColumns({"_w": turn, "_limit": F.col("source_size") * F.lit(float(max_repeat))})
    up = Window.orderBy(F.col("_limit") / F.col("_w"), F.col("source").asc_nulls_last())
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.lit(float(share)) * F.sum("source_size").over(everything) - F.coalesce(F.sum("_limit").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))) / F.sum("_w").over(up.rowsBetween(0, Window.unboundedFollowing))
    target = F.least("_limit", F.max("_reach").over(everything) * F.col("_w"))
    return ranked.withColumn("_reach", level).select("source", "source_size", target.alias("target"))


def plan(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    max_repeat: float = MAX_REPEAT,
    seed: int = SEED,
    bucket_rows: int = BUCKET_ROWS,
    told: dict[str, Column] | None = None,
) -> DataFrame:
    """doc_id, _size, _source_size, _target and _copies (how often the mix takes each document), and the columns told."""
    sized = _sized(docs, told or {})
    # the most numerous stratum decides how finely the hash is cut
    strata = sized.groupBy("_source", "_level", "_sublevel").agg(F.count(F.lit(1)).alias("_n"), F.sum("_size").alias("_words"))
    most = strata.agg(F.max("_n")).first()[0] or 0
    cut = min(HASH_BITS, max(0, math.ceil(math.log2(max(1, most / bucket_rows)))))
    sized = sized.withColumn("_bucket", F.struct("_source", "_level", "_sublevel", F.shiftright("_hash", HASH_BITS - cut).alias("_part")))
    counts = checkpointed(sized.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"), F.sum("_size").alias("_words")))
    within_stratum = Window.partitionBy("_bucket._source").orderBy("_bucket._level", "_bucket._sublevel", "_bucket._part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select(F.col("_bucket").alias("_bucket_key"), F.coalesce(F.sum("_n").over(within_stratum), F.lit(0)).alias("_first"))
    targets = source_targets(counts.groupBy(F.col("_bucket._source").alias("source")).agg(F.sum("_words").alias("source_size")), weights, share, max_repeat)
    targets = targets.select(F.col("source").alias("_target_source"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"))
    figures = firsts.join(targets, F.col("_bucket_key._source").eqNullSafe(F.col("_target_source"))).drop("_target_source")
    within = Window.partitionBy("_bucket").orderBy("_hash", "_size", "doc_id")
    ranked = sized.withColumn("_rank", F.row_number().over(within))
    joined = ranked.join(bounded(figures, counts.count()), F.col("_bucket") == F.col("_bucket_key"))
    step = F.when(F.col("_source_size") > 0, F.col("_target") / F.col("_source_size")).otherwise(F.lit(0.0))
    last = F.col("_first") + F.col("_rank")
    crossed = F.floor(last * step + F.lit(offset_of(seed))) - F.floor((last - 1) * step + F.lit(offset_of(seed)))
    copies = F.least(crossed, F.lit(int(-(-max_repeat // 1))).cast("long"))
    return joined.select("doc_id", *(told or {}), "_size", "_source_size", "_target", copies.alias("_copies"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: each row of docs as often as the mix takes it, with the columns of docs.

    Equal rows share what the mix takes of them all.
    """
    planned = plan(docs, told=row_key(docs), **options)
    shares = planned.groupBy(*ROW_KEY).agg(F.sum("_copies").alias("_copies"), F.count(F.lit(1)).alias("_equal")).where(F.col("_copies") > 0)
    rows = carried(docs, **row_key(docs)).join(shares, ROW_KEY)
    place = F.row_number().over(Window.partitionBy(*ROW_KEY).orderBy("_copies"))
    own = F.floor(F.col("_copies") / F.col("_equal")) + F.when(place <= F.col("_copies") % F.col("_equal"), 1).otherwise(0)
    taken = rows.withColumn("_own", own.cast("int")).where(F.col("_own") > 0)
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_own")))).select("_row.*")


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, size, source_size, target and the words taken, repeats counted."""
    planned = plan(docs.select("doc_id", "text", "source"), **options)
    return planned.select(
        "doc_id",
        F.col("_size").alias("size"),
        F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"),
        (F.col("_copies") * F.col("_size")).cast("long").alias("taken"),
    )


#: Shares by rounds: whoever lies above its limit is fixed there, the others share what is left, until none is above.
ORACLE_SQL = """
WITH RECURSIVE sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size
  FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    CASE (row_number() OVER (ORDER BY source NULLS LAST)) % 3 WHEN 1 THEN 3 WHEN 2 THEN 1 ELSE 2 END AS w
  FROM sized GROUP BY source
), rounds AS (
  SELECT 0 AS round, source, source_size, w, false AS fixed, true AS changed,
    1.5::DOUBLE * sum(source_size) OVER () / sum(w) OVER () AS level
  FROM sources
  UNION ALL
  SELECT round + 1, source, source_size, w, now_fixed, bool_or(now_fixed AND NOT fixed) OVER (),
    (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2.0::DOUBLE * source_size) FILTER (now_fixed) OVER (), 0))
      / nullif(sum(w) FILTER (NOT now_fixed) OVER (), 0)
  FROM (SELECT *, fixed OR level * w > 2.0::DOUBLE * source_size AS now_fixed FROM rounds WHERE changed)
), targets AS (
  SELECT source, source_size, CASE WHEN fixed THEN 2.0::DOUBLE * source_size ELSE level * w END AS target
  FROM rounds WHERE NOT changed
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY length(bin(size)), substr(bin(size), 1, 4),
      substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 6), size, doc_id NULLS FIRST) AS k
  FROM sized
), joined AS (
  SELECT r.doc_id, r.size, t.source_size, t.target, r.k,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS step
  FROM ranked r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  CAST(size * least(floor(k * step + 0.841861358::DOUBLE) - floor((k - 1) * step + 0.841861358::DOUBLE), 2) AS BIGINT) AS taken
FROM joined
"""
