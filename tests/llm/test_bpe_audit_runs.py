import base64
import codecs
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from lexspark.llm import audit, bpe, runs

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def public():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return encoding, bpe.codec(RANKS, public_tokenizers.PATTERN)


def ids_of(own, text):
    return np.frombuffer(own.encode(text), "<u4").tolist()


def odd_texts(count):
    rnd = random.Random(4)
    pools = ["abcdeé", " \n\t\r\x0b\x0c\x1c\x85  　", "a b", "日本語한국", "0１²५", "'s'll !?<|>", "​﻿\U0001f600́", "ÀÈß"]
    return ["".join(rnd.choice(rnd.choice(pools)) for _ in range(rnd.choice([1, 4, 12, 60, 300]))) for _ in range(count)]


def test_encoding_is_that_of_the_library(public):
    encoding, own = public
    texts = ["", " ", "  a", "<|endoftext|>", "a<|endoftext|> b", " " * 999, "\n" * 500 + " x", "ab" * 20_000, "é" * 5_000, *odd_texts(4000)]
    for text in texts:
        ids = ids_of(own, text)
        assert ids == encoding.encode_ordinary(text), text[:50]
        assert own.decode(own.encode(text)) == text


def test_every_code_point_block(public):
    encoding, own = public
    for point in [*range(0x3100), *range(0x3100, 0x110000, 41)]:
        if not 0xD800 <= point < 0xE000:
            c = chr(point)
            text = f"a{c} {c}{c}1 {c}\n{c}b"
            assert ids_of(own, text) == encoding.encode_ordinary(text), hex(point)


def test_texts_in_parts_and_tables_that_are_emptied(public, monkeypatch):
    encoding, own = public
    monkeypatch.setattr(bpe, "PART_CHARS", 7)
    monkeypatch.setattr(bpe, "MAX_WORDS", 5)
    monkeypatch.setattr(own.transducer, "max_states", 40)
    for text in odd_texts(1500):
        assert ids_of(own, text) == encoding.encode_ordinary(text)


@given(st.lists(st.sampled_from([b"a", b"b", b"c", b"ab", b"ba", b"aa", b"bc", b"abc", b"aab", b"bab", b"abab", b"cab", b"aaa", b"bca", b"abca"]), unique=True), st.lists(st.text("abc", max_size=14), max_size=12), st.randoms())
@settings(max_examples=150, deadline=None)
def test_any_ranks(tokens, words, rnd):
    """Any tokens in any order of rank, also ones that no merges make."""
    order = [t for t in tokens if len(t) > 1]
    rnd.shuffle(order)
    ranks = {t: r for r, t in enumerate([b"a", b"b", b"c", *order])}
    encoding = tiktoken.Encoding("any", pat_str=r"\w+", mergeable_ranks=ranks, special_tokens={})
    own = bpe.Transducer(ranks)
    for word in words:
        assert own.encode(word.encode()) == encoding.encode_ordinary(word)


def test_decoding_bytes_as_they_come():
    rnd = random.Random(3)
    bytes_of = {b: bytes([b]) for b in range(256)} | {256: b"\xe2\x82", 257: b"\xac\xf0\x9f", 258: b"ab"}
    for _ in range(3000):
        ids = [rnd.choice([rnd.randrange(258), rnd.choice([0xC3, 0xA9, 0xE0, 0xA0, 0xED, 0x9F, 0xF0, 0x90, 0xF4, 0x8F, 256, 257])]) for _ in range(rnd.randrange(9))]
        decoder, incremental = bpe.Decoder(bytes_of), codecs.getincrementaldecoder("utf-8")("replace")
        ours = theirs = ""
        for i in ids:  # whatever is complete comes at once, no later than from the library's decoder
            ours, theirs = ours + decoder.feed([i]), theirs + incremental.decode(bytes_of[i])
            assert ours.startswith(theirs)
        assert ours + decoder.finish() == theirs + incremental.decode(b"", True)
        assert decoder.feed(ids) + decoder.finish() == b"".join(bytes_of[i] for i in ids).decode("utf-8", "replace")


DOCS = "doc_id long, text string, lang string, source string, ids string, value long, `a.b` map<string,int>"


def rows_of(texts):
    rnd = random.Random(6)
    rows = [(i, t, rnd.choice(["en", "fr", None, ""]), rnd.choice(["a", "b", "ß", None, "z"]), "x", 1, {"k": 1}) for i, t in enumerate(texts)]
    return [*rows, (None, "a a a a a a", None, None, None, None, None), (7, None, "en", "only", None, None, None), rows[0], rows[0]]


def test_round_trip(spark, public):
    encoding, _ = public
    rows = rows_of(["", "a b", "word " * 40_000, *odd_texts(60)])
    docs = spark.createDataFrame(rows, DOCS)
    want = []
    for r in rows:
        ids = np.array(encoding.encode_ordinary(r[1] or ""), "<u4")
        want.append((r[0], len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()))
    assert Counter(map(tuple, bpe.round_trip(docs).collect())) == Counter(want)
    encoded = bpe.encode(docs)
    assert Counter(map(tuple, bpe.decode(encoded).collect())) == Counter((r[0], r[1] or "") for r in rows)
    assert bpe.round_trip(docs.limit(0)).count() == bpe.encode(docs.limit(0)).count() == 0


def plain_divergences(rows, least=10):
    """The definition, term by term."""
    words = defaultdict(lambda: defaultdict(Counter))
    holders = defaultdict(Counter)
    for _, text, lang, source, *_ in rows:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c if c > "\x7f" or "a" <= c <= "z" else " " for c in text or "")
        own = [w for w in lower.split(" ") if w]
        words[lang or ""][source or ""].update(own)
        holders[lang or ""].update(set(own))
    out = []
    for lang, sources in words.items():
        kept = [t for t, k in holders[lang].items() if k >= least]
        both = sum(sources.values(), Counter())
        p = {}
        for name, counts in [*sources.items(), (None, both)]:
            n = sum(counts[t] for t in kept)
            p[name] = {t: 1 + 10**9 * (counts[t] + 2) // (n + 2 * len(kept)) for t in kept}
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for name in sources:
            pairs = [(o, sum(f(p[name][t], p[o][t]) for t in kept)) for o in sources if o != name]
            own = [(t, f(p[name][t], p[None][t])) for t in kept if sources[name][t] and p[name][t] > p[None][t]]
            for part, items in (("pair", pairs), ("term", own)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, name, part, item, v, k) for k, (item, v) in enumerate(ranked, 1) if part == "pair" or k <= 10]
    return Counter(out)


@pytest.mark.parametrize("cells, block", [(1 << 20, 1 << 24), (12, 40)])
def test_divergences(spark, monkeypatch, cells, block):
    rnd = random.Random(9)
    vocabulary = ["the", "The", "é", "É", "日本", "\u0085x", "ab-cd", "x1y", "\U0001f600", "zz"] + ["".join(rnd.choice("abé") for _ in range(rnd.choice([1, 2, 3]))) for _ in range(40)]
    texts = [" ".join(rnd.choices(vocabulary, [1 / (k + 1) for k in range(50)], k=rnd.choice([0, 3, 20, 60]))) for _ in range(250)]
    rows = rows_of(["rare " * 30_000, *texts])
    rows += [(9000 + k, "12 34", "xx", s, None, None, None) for k, s in enumerate("abc")] + [(9100, "lone", "yy", "a", None, None, None)]
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    monkeypatch.setattr(audit, "CHUNK_CELLS", cells)
    monkeypatch.setattr(audit, "BLOCK_BYTES", block)
    want = plain_divergences(rows)
    got = Counter(map(tuple, audit.divergences(docs).collect()))
    assert got == want and any(r[2] == "term" for r in want) and any(r[4] == 0 for r in want)
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text", "lang", "source").toArrow())
    assert Counter(con.execute(audit.ORACLE_SQL).fetchall()) == want
    assert audit.divergences(docs.limit(0)).count() == 0


def test_frequencies_are_exact():
    rnd = random.Random(1)
    for _ in range(3000):
        terms, total = rnd.choice([1, 50, 10**9]), rnd.choice([0, 7, 10**6, 2 * 10**14])
        count = rnd.choice([0, total, rnd.randrange(total + 1)])
        assert audit.frequencies(np.array([count]), total, terms)[0] == 1 + 10**9 * (count + 2) // (total + 2 * terms)


def plain_runs(words):
    """Every period, and every stretch it holds for; the smallest period alone counts."""
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i + q - start
            stretch = words[start : start + length]
            if length >= max(6, 4 * q) and not any(stretch[p:] == stretch[: length - p] for p in range(1, q)):
                out.append((start, length, q))
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def repetitive(rnd):
    words = [rnd.randrange(rnd.choice([1, 2, 3, 6])) for _ in range(rnd.randrange(50))]
    for _ in range(rnd.choice([0, 1, 3])):
        at = rnd.randrange(len(words) + 1)
        words[at:at] = words[at : at + rnd.randrange(1, 9)] * rnd.randrange(2, 8)
    return words


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def test_runs_against_all_periods():
    rnd = random.Random(2)
    fixed = [[], [1] * 5, [1] * 6, [1, 2] * 4, [1, 2, 1, 2, 1, 2, 1], fibonacci(900), fibonacci(13) * 9, [i.bit_count() & 1 for i in range(700)] * 4, [1] * 300 + [2] + [1] * 299]
    for words in [*fixed, *(repetitive(rnd) for _ in range(2500))]:
        assert runs.runs_of(words) == plain_runs(words)


def test_hashes_decide_nothing(monkeypatch):
    """With hashes that agree on everything, and so mislead every search, the verified results are the same."""
    monkeypatch.setattr(runs.Sequence, "_alike", lambda self, i, j, length: True)
    rnd = random.Random(5)
    for words in [repetitive(rnd) for _ in range(500)] + [[1] * 80 + [2] + [1] * 79, fibonacci(300)]:
        assert runs.runs_of(words) == plain_runs(words)


@pytest.mark.parametrize("words", [[3] * 150_000, [0, 1, 2, 0, 1, 1, 3] * 30_000, fibonacci(150_000)])
def test_very_long_texts_take_linear_time(words):
    assert len(runs.runs_of(words)) == (0 if words[1] != words[0] and len(words) == 150_000 else 1)


def test_report_and_collapse(spark):
    rnd = random.Random(3)
    texts = [" \t\n".join(f"w{w}" for w in repetitive(rnd)) + rnd.choice(["", " ", " x"]) for _ in range(300)]
    rows = rows_of(["x y " * 30_000, "", *texts])
    docs = spark.createDataFrame(rows, DOCS)
    want, planted = [], 0
    for r in rows:
        words = [w for w in (r[1] or "").translate({c: " " for c in b"\t\n\x0b\x0c\r"}).split(" ") if w]
        h, n = zlib.crc32(str(r[0]).encode()), len(words)
        if r[0] is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
            planted += 1
        found = plain_runs(words) if len(words) < 9000 else runs.runs_of([words.index(w) for w in words])
        best = sorted(found, key=lambda x: (-x[1], x[0], x[2]))[0] if found else (None,) * 3
        dropped = {i for s, m, q in found for i in range(s + q, s + m)}
        digests = ["".join(f"{s},{m},{q}\n" for s, m, q in found), " ".join(w for i, w in enumerate(words) if i not in dropped)]
        want.append((r[0], len(found), *best, 1000 * best[1] // best[2] if found else None, *[hashlib.sha256(d.encode()).hexdigest() for d in digests]))
    got = Counter(map(tuple, runs.report(docs).collect()))
    assert got == Counter(want) and planted > 10
    listed = {r["doc_id"]: [tuple(x) for x in r["runs"]] for r in runs.find_runs(docs).collect() if r["doc_id"] not in (None, 0, 7)}
    assert all(found == runs.runs_of(runs.numbered((rows[i][1] or "").encode().split())) for i, found in listed.items())
    shorter = runs.collapse(docs)
    assert shorter.columns == docs.columns
    by_id = {r["doc_id"]: r["text"] for r in shorter.collect()}
    assert by_id[0] == "x y" and by_id[1] == "" and by_id[None] == "a"
    assert runs.report(docs.limit(0)).count() == runs.collapse(docs.limit(0)).count() == 0
