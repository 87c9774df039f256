"""How far the sources of a language diverge, by smoothed term frequencies over one dictionary of the language.

Terms are numbered by sorted dictionaries. A task numbers the words of a block of texts by the block's own sorted terms
and counts each group's numbers with bincount; counts meet by (language, term). What enough documents hold is kept and
dealt out by ranges of (language, term), so that each stretch of the dictionary is a sorted array in one task: searchsorted
gives a term's number, in the order of UTF-8, and every source has a dense vector of counts over the stretch. Frequencies,
divergences of all pairs of sources and the terms that stand out are then array arithmetic on such chunks; the sums of
pairs and the few best terms of a chunk are what is shuffled. All arithmetic is exact, in whole numbers of 64 bits, for up
to 2.9e14 words.

A chunk holds at most `CHUNK_TERMS` terms, and fewer where a language has more than `CHUNK_CELLS` / `CHUNK_TERMS` sources,
so that its dense form is bounded; no dictionary is ever whole in one place.

Defined cases: a null text, lang or source counts as ''; very long texts are counted whole; a source without kept terms is
a group with counts of zero; a language that keeps no term has divergences of 0 between its sources and no term that stands
out; ties go to the item first by UTF-8; repeated rows are documents of their own; an empty table gives no rows; other
columns, of whatever names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexspark.llm.common import bounded, checkpointed

LEAST_DOCUMENTS, TOP_TERMS = 10, 10
SCALE = 1_000_000_000
BLOCK_BYTES = 8 << 20
CHUNK_TERMS, CHUNK_CELLS = 4096, 1 << 20

_INSIDE = [b for b in range(256) if 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80]
#: a term's bytes, A-Z lower-cased; all others become a space
_TERM_BYTES = bytes(ord(chr(b).lower()) if b < 0x80 else b for b in range(256)).translate(bytes(b if b in _INSIDE else 0x20 for b in range(256)))

COUNTED = "lang string, source string, term binary, count long, docs long"


def _block_counts(groups: list[tuple[str, str]], texts: list[pa.Array]) -> Iterator[pa.RecordBatch]:
    """Per group of a block and term: how often it occurs there, and in how many documents."""
    words = pa.concat_arrays(texts).dictionary_encode()
    order = np.asarray(pc.sort_indices(words.dictionary))
    terms = words.dictionary.take(pa.array(order))
    numbers = np.empty(len(order), np.int32)
    numbers[order] = np.arange(len(order), dtype=np.int32)
    ends = np.cumsum([len(own) for own in texts])
    own_ids: dict[tuple[str, str], list[np.ndarray]] = {}
    for group, ids in zip(groups, np.split(numbers[np.asarray(words.indices)], ends[:-1]), strict=True):
        own_ids.setdefault(group, []).append(ids)
    for (lang, source), ids in own_ids.items():
        counts = np.bincount(np.concatenate(ids), minlength=len(terms))
        docs = np.bincount(np.concatenate([np.unique(own) for own in ids]), minlength=len(terms))
        there = np.nonzero(counts)[0]
        if len(there):
            columns = [pa.array([lang]).take(pa.array(np.zeros(len(there), np.int64))), pa.array([source]).take(pa.array(np.zeros(len(there), np.int64)))]
            columns += [terms.take(pa.array(there)), pa.array(counts[there]), pa.array(docs[there])]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "count", "docs"])


def _count_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    groups, texts, size = [], [], 0
    for batch in batches:
        langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lang, source, text in zip(langs, sources, batch.column(2), strict=True):
            raw = text.as_py()
            groups.append((lang, source))
            texts.append(pa.array(raw.translate(_TERM_BYTES).split(), pa.binary()))
            size += len(raw)
            if size >= BLOCK_BYTES:
                yield from _block_counts(groups, texts)
                groups, texts, size = [], [], 0
    if texts:
        yield from _block_counts(groups, texts)


def _named(docs: DataFrame) -> DataFrame:
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return docs.select(empty("lang").alias("lang"), empty("source").alias("source"), empty("text").cast("binary").alias("text"))


def kept_counts(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """lang, term, source, count, of the terms that enough documents of a language hold; first marks one row a term."""
    counted = _named(docs).mapInArrow(_count_blocks, COUNTED)
    by_term = Window.partitionBy("lang", "term")
    summed = counted.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
    kept = summed.withColumns({"_docs": F.sum("docs").over(by_term), "_place": F.row_number().over(by_term.orderBy("source"))})
    return kept.where(F.col("_docs") >= least_documents).select("lang", "term", "source", "count", (F.col("_place") == 1).alias("first"))


CHUNKS = "lang string, terms array<binary>, sources array<string>, counts array<array<bigint>>"


def _chunk(lang: str, terms: pa.Array, sources: pa.Array, counts: np.ndarray) -> pa.RecordBatch:
    """One stretch of the dictionary: its sorted terms, and a dense vector of counts for each source that occurs."""
    rows = np.array(terms.to_pylist(), object)
    fresh = np.append(True, rows[1:] != rows[:-1])
    kept = rows[fresh]
    ids = np.searchsorted(kept, rows)
    coded = sources.dictionary_encode()
    dense = np.zeros((len(coded.dictionary), len(kept)), np.int64)
    dense[np.asarray(coded.indices), ids] = counts
    wrap = lambda values, kind: pa.array([values], pa.list_(kind))
    columns = [pa.array([lang]), wrap(kept.tolist(), pa.binary()), wrap(coded.dictionary.to_pylist(), pa.string()), wrap(dense.tolist(), pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays(columns, ["lang", "terms", "sources", "counts"])


def chunks(kept: DataFrame, most_sources: int) -> DataFrame:
    """The dictionaries in chunks, from kept_counts; a language has at most so many sources."""
    most_terms = max(1, min(CHUNK_TERMS, CHUNK_CELLS // max(1, most_sources)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        begun, terms = None, 0  # the (lang, term) of the last row held, and how many terms are held

        def emptied() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            return _chunk(table["lang"][0].as_py(), table["term"].combine_chunks(), table["source"].combine_chunks(), np.asarray(table["count"]))

        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            start = 0
            for i, key in enumerate(keys):
                if key == begun:
                    continue
                if begun and (key[0] != begun[0] or terms == most_terms):
                    if i > start:
                        held.append(batch.slice(start, i - start))
                    yield emptied()
                    start, terms = i, 0
                begun, terms = key, terms + 1
            if start < len(keys):
                held.append(batch.slice(start))
        if held:
            yield emptied()

    ordered = kept.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term", "source")
    return ordered.select("lang", "term", "source", "count").mapInArrow(run, CHUNKS)


def frequencies(counts: np.ndarray, total: np.ndarray | int, terms: int) -> np.ndarray:
    """1 + floor(SCALE x (count + 2) / (total + 2 x terms)), exactly: SCALE is taken in two factors."""
    first, second = 32_000, SCALE // 32_000
    divisor = total + 2 * terms
    whole, rest = np.divmod((counts + 2) * first, divisor)
    return 1 + whole * second + rest * second // divisor


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    difference = p - q
    return difference * difference // (p + q)


FIGURES = "lang string, source string, part string, item string, value long"


def _figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each chunk, the divergences of all pairs of sources (first < second), and the best terms of each source."""
    for batch in batches:
        for row in batch.to_pylist():
            names, totals, n = row["all_sources"], np.array(row["totals"], np.int64)[:, None], len(row["terms"])
            place = {s: k for k, s in enumerate(names)}
            counts = np.zeros((len(names), n), np.int64)
            counts[[place[s] for s in row["sources"]]] = np.array(row["counts"], np.int64)
            p = frequencies(counts, totals, row["kept"])
            q = frequencies(counts.sum(axis=0), int(totals.sum()), row["kept"])
            for k, name in enumerate(names):
                sums = divergence(p[k], p[k + 1 :]).sum(axis=1)
                out = [(name, "pair", other, v) for other, v in zip(names[k + 1 :], sums.tolist(), strict=True)]
                ahead = np.nonzero((counts[k] > 0) & (p[k] > q))[0]
                values = divergence(p[k, ahead], q[ahead])
                best = np.argsort(-values, kind="stable")[:TOP_TERMS]  # numbers are in the order of UTF-8
                out += [(name, "term", row["terms"][ahead[b]].decode("utf-8", "replace"), int(values[b])) for b in best.tolist()]
                if out:
                    columns = [pa.array([row["lang"]] * len(out)), *[pa.array(x) for x in zip(*out, strict=True)]]
                    yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "part", "item", "value"])


def divergences(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, top_terms: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: each source's other sources (part pair) and own terms (part term)."""
    if top_terms > TOP_TERMS:
        raise ValueError(f"a chunk gives its {TOP_TERMS} best terms")
    kept = checkpointed(kept_counts(docs, least_documents))
    totals = kept.groupBy("lang", "source").agg(F.sum("count").alias("_total"))
    vocabulary = kept.where("first").groupBy("lang").agg(F.count(F.lit(1)).alias("kept"))
    groups = _named(docs).select("lang", "source").distinct()
    named = groups.join(totals, ["lang", "source"], "left").groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", F.coalesce("_total", F.lit(0)).alias("total")))).alias("_g"))
    languages = named.join(vocabulary, "lang", "left").select("lang", F.col("_g.source").alias("all_sources"), F.col("_g.total").alias("totals"), F.coalesce("kept", F.lit(0)).alias("kept"))
    languages = checkpointed(languages)
    many, most = languages.agg(F.coalesce(F.sum(F.size("all_sources")), F.lit(0)), F.coalesce(F.max(F.size("all_sources")), F.lit(0))).first()
    figures = checkpointed(chunks(kept, most).join(bounded(languages, many), "lang").mapInArrow(_figures, FIGURES))
    first = languages.select("lang", F.explode("all_sources").alias("source"), "all_sources")
    nothing = first.select("lang", "source", F.explode(F.filter("all_sources", lambda s: s > F.col("source"))).alias("item"), F.lit(0).cast("long").alias("value"))
    once = figures.where("part = 'pair'").drop("part").unionByName(nothing).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    sides = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))
    pairs = once.select("lang", sides.alias("_s"), "value").select("lang", "_s.source", F.lit("pair").alias("part"), "_s.item", "value")
    by_value = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(by_value))
    terms = ranked(figures.where("part = 'term'")).where(F.col("rank") <= top_terms)
    return ranked(pairs).unionByName(terms).select("lang", "source", "part", "item", "value", "rank")


ORACLE_SQL = """
WITH named AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS words
  FROM documents
), occurring AS (
  SELECT doc, lang, source, unnest(words) AS term FROM named
), vocabulary AS (
  SELECT lang, term, count(*) AS language_count FROM occurring GROUP BY lang, term HAVING count(DISTINCT doc) >= 10
), counted AS (
  SELECT lang, source, term, count(*) AS n FROM occurring SEMI JOIN vocabulary USING (lang, term) GROUP BY lang, source, term
), languages AS (
  SELECT lang, count(*) AS v, sum(language_count) AS language_total FROM vocabulary GROUP BY lang
), groups AS (
  SELECT g.lang, g.source, coalesce(v, 0) AS v, coalesce(language_total, 0) AS language_total,
    coalesce((SELECT sum(n) FROM counted c WHERE c.lang = g.lang AND c.source = g.source), 0) AS total
  FROM (SELECT DISTINCT lang, source FROM named) g LEFT JOIN languages USING (lang)
), frequent AS (
  SELECT g.lang, g.source, t.term, coalesce(c.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (g.total + 2 * g.v) AS p,
    1 + (1000000000::HUGEINT * (t.language_count + 2)) // (g.language_total + 2 * g.v) AS q
  FROM groups g JOIN vocabulary t USING (lang) LEFT JOIN counted c ON c.lang = g.lang AND c.source = g.source AND c.term = t.term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item,
    coalesce((SELECT sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) FROM frequent x JOIN frequent y USING (lang, term)
      WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
), both_parts AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM frequent WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM both_parts
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM ranked WHERE part = 'pair' OR rank <= 10
"""
