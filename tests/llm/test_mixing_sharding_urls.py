import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from lexspark.llm import mixing, sharding, urlfilter

DOCS = "doc_id long, text string, lang string, source string, n_chars long, target double, size string"


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(2)
    out = [(i, " ".join(["w"] * rnd.choice([0, 1, 5, 40, 300])), "en", rnd.choice(["b", "a", "é", None, "c", "c", "c"]), 0, 1.0, "x") for i in range(600)]
    return out + [(600, None, None, "z", 0, 1.0, "x"), (601, "w w", "en", "b", 0, 1.0, "x"), (601, "w w", "en", "b", 0, 1.0, "x"), (None, "w", "en", None, 0, 1.0, "x")]


def targets(sizes):
    """By rounds: what lies above a limit is fixed, and the rest is shared anew."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    fixed, left = {}, 1.5 * sum(sizes.values())
    while True:
        open_ = [s for s in order if s not in fixed]
        total = sum(weight[s] for s in open_)
        shares = {s: (left - sum(fixed.values())) * weight[s] / total for s in open_}
        above = [s for s in open_ if shares[s] >= 2 * sizes[s]]
        if not above:
            return fixed | shares
        fixed |= {s: 2.0 * sizes[s] for s in above}
        if len(fixed) == len(order):
            return fixed


def test_mix(spark, rows):
    docs = spark.createDataFrame(rows, DOCS)
    got = mixing.mix_report(docs).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len((r[1] or "").split())
    want = targets(sizes)
    source = {(r[0], len((r[1] or "").split())): r[3] for r in rows}
    taken = Counter()
    for r in got:
        s = source[r["doc_id"], r["size"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s]) and r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 700 for s in sizes)
    copies = Counter(r["doc_id"] for r in mixing.mix(docs).collect())
    again = {r["doc_id"]: r["taken"] for r in mixing.mix_report(docs).collect()}
    assert all(copies[r["doc_id"]] * r["size"] == again[r["doc_id"]] for r in got if r["doc_id"] not in (None, 601))


def many_sources():
    """Forty sources of very different sizes, most of which stay below their limits."""
    rnd = random.Random(8)
    return [(i, " ".join(["w"] * rnd.choice([1, 3, 9, 30])), "en", f"s{int(40 * rnd.random() ** 2):02}", 0, 1.0, "x") for i in range(3000)]


def held_to_targets(got, rows):
    """The words taken of each source lie near its target, and all targets together are one and a half times all words."""
    sizes, taken = Counter(), Counter()
    for r in rows:
        sizes[r[3]] += len((r[1] or "").split())
    want, source = targets(sizes), {r[0]: r[3] for r in rows}
    for r in got:
        assert r["target"] == pytest.approx(want[source[r["doc_id"]]]) and 0 <= r["taken"] <= 2 * r["size"]
        taken[source[r["doc_id"]]] += r["taken"]
    assert sum(want.values()) == pytest.approx(1.5 * sum(sizes.values())) and min(want.values()) > 0
    assert sum(w < 2 * sizes[s] for s, w in want.items()) > 5
    assert all(abs(taken[s] - w) <= 60 for s, w in want.items())


def test_mix_of_many_sources(spark):
    rows = many_sources()
    docs = spark.createDataFrame(rows, DOCS)
    held_to_targets(mixing.mix_report(docs).collect(), rows)
    copies = Counter(r["doc_id"] for r in mixing.mix(docs).collect())
    got = [{"doc_id": r[0], "target": 0, "size": len(r[1].split()), "taken": copies[r[0]] * len(r[1].split())} for r in rows]
    planned = {r["doc_id"]: r for r in mixing.mix_report(docs).collect()}
    held_to_targets([g | {"target": planned[g["doc_id"]]["target"]} for g in got], rows)
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text", "source").toArrow())
    names = ["doc_id", "size", "source_size", "target", "taken"]
    held_to_targets([dict(zip(names, r)) for r in con.execute(mixing.ORACLE_SQL).fetchall()], rows)


@pytest.mark.parametrize("seed", range(8))
def test_targets_by_rounds(spark, seed):
    rnd = random.Random(seed)
    sizes = {f"s{i}": rnd.choice([0, 1, 10, 1000, 10**9]) * rnd.randrange(1, 9) for i in range(rnd.choice([1, 2, 7, 40]))} | {None: 5}
    got = mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    want = targets(sizes)
    assert {r["source"]: r["target"] for r in got} == {s: pytest.approx(w) for s, w in want.items()}
    assert all(0 <= r["target"] <= 2 * r["source_size"] for r in got)
    assert sum(r["target"] for r in got) == pytest.approx(1.5 * sum(sizes.values()))


def test_mix_of_nothing(spark):
    assert mixing.mix_report(spark.createDataFrame([], DOCS)).count() == 0
    assert {r["target"] for r in mixing.mix_report(spark.createDataFrame([(1, "", "en", "a", 0, 1.0, "x"), (2, None, "en", None, 0, 1.0, "x")], DOCS)).collect()} == {0.0}


def test_mix_of_columns_with_clashing_names(spark, rows):
    docs = spark.createDataFrame([(*r[:4], i, {"k": 1}, "y") for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, _level long, `a.b` map<string,int>, _copies string")
    got = mixing.mix(docs)
    assert got.columns == docs.columns
    known = {tuple(map(str, r)) for r in docs.collect()}
    assert {tuple(map(str, r)) for r in got.collect()} <= known


def test_equal_rows_share_their_copies(spark):
    docs = spark.createDataFrame([(1, "w w", "en", "a", 0, 1.0, "x")] * 40 + [(2, "w w", "en", "b", 0, 1.0, "x")] * 40, DOCS)
    taken = sum(r["taken"] for r in mixing.mix_report(docs).collect())
    assert mixing.mix(docs).count() * 2 == taken == 240


@pytest.mark.parametrize("bucket_rows", [3, 20_000])
def test_mix_sql(spark, rows, bucket_rows):
    docs = spark.createDataFrame(rows, DOCS)
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text", "source").toArrow())
    want = con.execute(mixing.ORACLE_SQL).fetchall()
    got = [tuple(r) for r in mixing.mix_report(docs, bucket_rows=bucket_rows).collect()]
    key = lambda r: tuple((x is None, round(x, 6) if x is not None else 0) for x in r)
    assert sorted(map(key, got)) == sorted(map(key, want))


def jump(key, shards):
    """The published algorithm, key by key."""
    b, j, key = -1, 0, key % 2**64
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash():
    keys = [0, 1, -1, 2**62, -(2**63), *range(5, 900)]
    for shards in (1, 2, 8, 9, 100):
        assert sharding.jump_hash(np.array(keys, np.int64), shards).tolist() == [jump(k, shards) for k in keys]


def test_shards(spark, rows):
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    got = sharding.assign(docs).collect()
    assert len(got) == len(rows)
    text = {(r[0], zlib.crc32((r[1] or "").encode())): r[1] or "" for r in rows}
    for r in got:
        assert r["shard"] == jump(r["doc_id"] or 0, 8) and r["grown_shard"] in (r["shard"], 8) and r["law"] == "key"
        assert r["size"] == len(text[r["doc_id"], r["text_crc32"]].encode()) + 1
    for shard in range(8):
        assert sorted(r["slot"] for r in got if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in got)))
    assert sharding.assign(spark.createDataFrame([], DOCS)).count() == 0


def test_written_shards(spark, rows, tmp_path):
    sharding.write_shards(spark.createDataFrame(rows, DOCS), str(tmp_path / "s"), 4)
    read = spark.read.parquet(str(tmp_path / "s"))
    assert read.count() == len(rows) and {r["shard"] for r in read.select("shard").distinct().collect()} <= {0, 1, 2, 3}


URLS = [
    "http://WWW.Example.com/en/1", "http://example.com/en/", "https://a.example.com/en", "http://x.net/es/?q", "http://x.net/fr/#a", "http://notnet/es/", "http://x.net",
    "http://a.b.com?x=/en/", "x", None, "", "http://casino-win.example.org/", "http://cas.example.org/casinos", "ftp://a.org/free/bets", "http://a.org/free", "http://a.org/FREE-free",
    "http://x.org/y?u=http://porn.net/", "http://example.net/en/adults", "://h/p", "http://com/", "http://a.org/cheap-pills",
]


def test_urls_against_rules_and_sql(spark):
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    got = {r["page_id"]: r for r in urlfilter.judge(pages).collect()}
    con = duckdb.connect()
    con.register("pages", pages.toPandas())
    names = ["page_id", "host", "path", "rule", "verdict", "strict_terms", "soft_terms"]
    for row in con.execute(urlfilter.ORACLE_SQL).fetchall():
        assert tuple(got[row[0]][n] for n in names) == row
    said = lambda i: (got[i]["rule"], got[i]["verdict"])
    assert said(0) == ("www.example.com/en/", "allow") and said(1) == ("example.com/en/", "block") and said(2) == ("com/", "allow")
    assert said(3) == ("net/es/", "block") and said(5) == (None, "allow") and said(7) == (None, "allow") and said(8) == (None, "allow")
    assert said(11) == (None, "block") and said(12) == (None, "allow") and said(13) == (None, "block") and said(14)[1] == said(15)[1] == "allow"
    assert got[0]["host"] == "www.example.com" and got[9]["host"] == got[9]["path"] == ""


def test_rules_of_one_length_and_very_long_urls(spark):
    long = "http://a.org/" + "x" * 300_000
    pages = spark.createDataFrame([(1, long + "/porn"), (2, long), (3, "http://b.a.org/xx"), (3, "http://b.a.org/xx")], "page_id long, url string")
    rules = [("allow", "b.a.org", "/x"), ("block", "a.org", "/xxx"), ("block", "a.org", "/xx/"), ("block", "a.org", "/x")]
    got = [(r["page_id"], r["rule"], r["verdict"]) for r in urlfilter.judge(pages, [("block", "org", "/y"), *rules]).orderBy("page_id").collect()]
    assert got == [(1, "a.org/xxx", "block"), (2, "a.org/xxx", "block"), (3, "b.a.org/x", "allow"), (3, "b.a.org/x", "allow")]
    tie = urlfilter.judge(pages.where("page_id = 3"), [("allow", "b.a.org", "/x"), ("block", "a.org", "/xx"), ("block", "b.a.org", "/x")]).first()
    assert tie["verdict"] == "allow"
    assert len(urlfilter.judge(pages).where("page_id = 1").first()["path"]) == 300_006


def test_vocabulary_of_a_table(spark):
    table = spark.createDataFrame([("Grape", 0.8), ("fig", 0.4), ("fig", 0.7), ("plum", 2.0), (None, 5.0), ("", 5.0), ("zero", 0.0), ("none", None)], "term string, weight double")
    terms = urlfilter.load_vocabulary(table)
    assert terms == {"grape": 0.8, "fig": 0.7, "plum": 2.0}
    with pytest.raises(ValueError):
        urlfilter.load_vocabulary(table, max_terms=2)
    urls = ["http://a.org/fig", "http://a.org/FIG-grape", "http://a.org/fig/fig/fig", "http://a.org/plum", "http://a.org/plums"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    got = {r["page_id"]: (r["verdict"], r["strict_terms"], r["soft_terms"]) for r in urlfilter.judge(pages, (), terms, limit=1.5).collect()}
    assert got == {0: ("allow", 0, 1), 1: ("block", 0, 2), 2: ("allow", 0, 1), 3: ("block", 1, 0), 4: ("allow", 0, 0)}
