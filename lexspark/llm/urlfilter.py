"""Judging urls by host and path rules and by a weighted vocabulary.

A url's terms are counted in one Aho-Corasick pass over its lower-cased text; a hit counts only between boundaries,
where the characters beside it are not letters or digits. Every term has a weight, and a url that no rule decides is
rejected if the weights of its distinct terms reach the limit: a strict term weighs that much by itself, soft terms do so
together. `load_vocabulary` reads the terms from a table; the built-in ones are a small sample.

Defined cases: a null url, or one without "://", has an empty host and path, and no rule fits it; a null url holds no
term and is allowed; urls of any length are read whole; of rules of one length the first given counts; repeated rows are
judged alike; an empty table gives no rows; of the other columns only the key is kept.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import lru_cache
from types import MappingProxyType

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (verdict, host, path)
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
STRICT_TERMS = (
    "adult", "casino", "cheap-pills", "escort", "hentai", "malware", "phishing", "porn", "porno", "sex", "spam",
    "viagra", "warez", "xxx",
)
SOFT_TERMS = (
    "ads", "affiliate", "bet", "bets", "bonus", "cheap", "click", "coupon", "crack", "dating", "farm", "free", "hot",
    "jackpot", "keygen", "loan", "nude", "pills", "poker", "popup", "promo", "slots", "torrent", "track", "win",
)
SOFT_LIMIT = 2
#: What the weights of a rejected url's terms add up to. Built-in soft terms weigh 1.
LIMIT = float(SOFT_LIMIT)
VOCABULARY = {t: 1.0 for t in SOFT_TERMS} | {t: LIMIT for t in STRICT_TERMS}
MAX_TERMS = 1_000_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HOST = r"(?s)^.*?://([^/?#]*)"
PATH = r"(?s)^.*?://[^/?#]*([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), PATH, 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits; null if none does. A few hundred rules at most."""

    def fits(rule_host: str, rule_path: str) -> Column:
        return ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)

    longest_first = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    chosen = [F.when(fits(h, p), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for v, h, p in longest_first]
    return F.coalesce(*chosen) if chosen else F.lit(None).cast("struct<rule:string,verdict:string>")


def load_vocabulary(table: DataFrame, max_terms: int = MAX_TERMS) -> dict[str, float]:
    """Weights by term of a table (term, weight): terms lower-cased, the largest weight of a repeated one.

    Null or empty terms and weights that are null or not above zero are left out. The vocabulary goes to every worker as
    one automaton, so that more than max_terms terms are an error.
    """
    usable = table.where((F.coalesce(F.col("term"), F.lit("")) != "") & (F.col("weight") > 0))
    terms = usable.groupBy(F.lower("term").alias("term")).agg(F.max("weight").cast("double").alias("weight"))
    rows = terms.limit(max_terms + 1).collect()
    if len(rows) > max_terms:
        raise ValueError(f"a vocabulary of more than {max_terms} terms")
    return {r["term"]: r["weight"] for r in rows}


@lru_cache(maxsize=4)
def _automaton(terms: frozenset[tuple[str, float]]):
    """One for each vocabulary in a worker process, whatever the number of its tasks."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for term, _ in terms:
        automaton.add_word(term, term)
    automaton.make_automaton()
    return automaton


def term_hits(spark: SparkSession, vocabulary: Mapping[str, float], limit: float = LIMIT):
    """A column function: struct(strict, soft, weight), of the distinct terms found between boundaries: how many reach
    the limit alone, how many don't, and the weight of all. The vocabulary is sent to each executor once."""
    sent = spark.sparkContext.broadcast(frozenset(vocabulary.items()))

    @F.pandas_udf("strict int, soft int, weight double")
    def hits(urls: pd.Series) -> pd.DataFrame:
        weight_of = dict(sent.value)
        automaton = _automaton(sent.value) if weight_of else None
        counts = []
        for url in urls:
            found = set()
            if url and automaton:
                lowered = url.lower()
                for end, term in automaton.iter(lowered):
                    begin = end - len(term) + 1
                    if (begin == 0 or not lowered[begin - 1].isalnum()) and not lowered[end + 1 : end + 2].isalnum():
                        found.add(term)
            weights = [weight_of[t] for t in sorted(found)]
            strict = sum(w >= limit for w in weights)
            counts.append((strict, len(weights) - strict, math.fsum(weights)))
        return pd.DataFrame(counts, columns=["strict", "soft", "weight"]).astype({"strict": "int32", "soft": "int32", "weight": "float64"})

    return hits


def judge(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]] = RULES,
    vocabulary: Mapping[str, float] = MappingProxyType(VOCABULARY),
    limit: float = LIMIT,
) -> DataFrame:
    """page_id, host, path, rule, verdict, and the numbers of strict and soft terms found."""
    parts = pages.select("page_id", F.col("url").alias("_url"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    ruled = parts.withColumns({"_rule": rule_of(F.col("host"), F.col("path"), rules), "_hits": term_hits(pages.sparkSession, vocabulary, limit)(F.col("_url"))})
    verdict = F.coalesce(F.col("_rule.verdict"), F.when(F.col("_hits.weight") >= limit, F.lit("block")).otherwise(F.lit("allow")))
    return ruled.select(
        "page_id", "host", "path", F.col("_rule.rule").alias("rule"), verdict.alias("verdict"),
        F.col("_hits.strict").cast("long").alias("strict_terms"), F.col("_hits.soft").cast("long").alias("soft_terms"),
    )


#: The rules and terms in words of the SQL's own, so that a wrong one in the library shows.
ORACLE_SQL = """
WITH parts AS (
  SELECT page_id, lower(coalesce(url, '')) AS low,
    CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*') ELSE '' END AS raw_host,
    CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages
), hosted AS (
  SELECT *, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host FROM parts
), rules(rule_host, rule_path, said) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), fitting AS (
  SELECT page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(said, length(rule_host || rule_path)) AS said
  FROM (SELECT DISTINCT page_id, host, path FROM hosted) h JOIN rules ON ('.' || host) LIKE ('%.' || rule_host) AND starts_with(path, rule_path) GROUP BY page_id
), terms AS (
  SELECT unnest(string_split('adult casino cheap-pills escort hentai malware phishing porn porno sex spam viagra warez xxx', ' ')) AS term, true AS strict
  UNION ALL
  SELECT unnest(string_split('ads affiliate bet bets bonus cheap click coupon crack dating farm free hot jackpot keygen loan nude pills poker popup promo slots torrent track win', ' ')), false
), counted AS (
  SELECT low, count(*) FILTER (strict) AS strict_terms, count(*) FILTER (NOT strict) AS soft_terms
  FROM (SELECT DISTINCT low FROM parts) p JOIN terms ON regexp_matches(low, '(^|[^\\pL\\pN])' || term || '($|[^\\pL\\pN])') GROUP BY low
)
SELECT page_id, host, path, rule,
  coalesce(said, CASE WHEN coalesce(strict_terms, 0) >= 1 OR coalesce(soft_terms, 0) >= 2 THEN 'block' ELSE 'allow' END) AS verdict,
  coalesce(strict_terms, 0) AS strict_terms, coalesce(soft_terms, 0) AS soft_terms
FROM hosted LEFT JOIN fitting USING (page_id) LEFT JOIN counted USING (low)
"""
