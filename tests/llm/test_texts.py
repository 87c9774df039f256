"""Fingerprints, near-duplicates, languages, quality and outliers, against brute force and held-out labels."""

import hashlib
import itertools
import math
import random
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexspark.llm import fingerprints, langid, outliers, quality, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, fingerprint string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, source, 0, "x", "y") for i, t, lang, source in rows], DOCS)


def sentence(rnd, words, n):
    return " ".join(rnd.choice(words) for _ in range(n))


def vocabulary(seed, syllables):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(syllables) for _ in range(rnd.choice([1, 2, 2, 3]))) for _ in range(300)]


VOCABULARIES = {"aa": vocabulary(1, ["ka", "lo", "mi", "tere", "us"]), "bb": vocabulary(2, ["the", "ing", "ion", "er", "sh"]), "cc": vocabulary(3, ["é", "eau", "qu", "ment", "oi"])}


# fingerprints


def canonical(text):
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(folded.split())


TEXTS = ["Hello  World", "hello world ", "ﬁn Straße", "FIN STRASSE", "été", "éTÉ", "", None, " \n", "ab", "abc", "x" * 50_000, "日本語テキスト", "the end", "a b", "A B"]


def test_fingerprints_are_equal_just_for_equal_canonical_forms(spark):
    got = {r["doc_id"]: r["fingerprint"] for r in fingerprints.fingerprints(table(spark, [(i, t, "en", "s") for i, t in enumerate(TEXTS)])).collect()}
    for i, a in enumerate(TEXTS):
        for j, b in enumerate(TEXTS):
            assert (got[i] == got[j]) == (canonical(a or "") == canonical(b or "")), (a, b)


@pytest.mark.parametrize("bucket_rows", [1, 3, 1000])
def test_edited_texts(spark, bucket_rows):
    rows = [(i * 7 % 101, t, "en", "s") for i, t in enumerate(TEXTS)] + [(None, "no id", "en", "s"), (200, "twice", "en", "s"), (200, "twice", "en", "s")]
    got = fingerprints.compare_edited(table(spark, rows), bucket_rows).collect()
    order = sorted(((-(2**63) if i is None else i, t or "") for i, t, _, _ in rows), key=lambda x: (-x[0], x[1]))
    want = []
    for k, (i, t) in enumerate(order):
        following, third = order[(k + 1) % len(order)][1], len(t) // 3
        edited = t[: len(t) - third] + following[:third]
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), float(canonical(t) == canonical(edited)), float(canonical(t) == canonical(following))))
    found = [(-(2**63) if r["doc_id"] is None else r["doc_id"], r["n_chars"], r["edited_sha256"], r["near_edited"], r["near_next"]) for r in got]
    assert sorted(found) == sorted(want)


def test_shared_digests_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "digest", lambda form: F.substring(F.md5(form), 1, 1))
    rows = table(spark, [(i, f"text {i % 40}", "en", "s") for i in range(80)])
    got = {r["doc_id"]: r["fingerprint"] for r in fingerprints.fingerprints(rows).collect()}
    assert len(set(got.values())) == 40 and all(got[i] == got[i + 40] for i in range(40))
    # edited forms are told apart from each other's and from other texts, too
    rows = [(i, f"text {i % 13} of them" if i % 3 else f"Text  {i % 13} OF them", "en", "s") for i in range(60)] + [(70, "ab", "en", "s"), (71, "ab", "en", "s")]
    order = sorted(((i, t) for i, t, _, _ in rows), reverse=True)
    forms = {}
    for k, (i, t) in enumerate(order):
        third = len(t) // 3
        forms[i] = (canonical(t), canonical(t[: len(t) - third] + order[(k + 1) % len(order)][1][:third]))
    seen = {}
    for r in fingerprints.compare_edited(table(spark, rows)).collect():
        for form, name in zip(forms[r["doc_id"]], (r["fingerprint"], r["edited_fingerprint"]), strict=True):
            assert seen.setdefault(form, name) == name
    assert len(set(seen.values())) == len(seen) > 20


def test_no_documents(spark):
    none = table(spark, [])
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert fingerprints.compare_edited(none).count() == 0 and simhash.near_duplicates(none).count() == 0 and langid.report(none).count() == 0
    assert outliers.judge(none).count() == 0 and quality.score(none, quality.fit(none, labels)).count() == 0


# near-duplicates


def simhash_plainly(text):
    import xxhash

    words = [w for w in (text or "").translate({c: 32 for c in (9, 10, 11, 12, 13)}).split(" ") if w]
    words = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in words]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_plainly(nodes, near):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a in nodes:
        for b in nodes:
            if a < b and near(a, b):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {n: root(n) for n in nodes}


def near_texts():
    rnd = random.Random(4)
    base = [sentence(rnd, VOCABULARIES["bb"], 60) for _ in range(30)]
    texts = [None, "", " \t", "One", "one", "one two three", "Ünï é É", "\x1c a\x85b  c", "x " * 30_000] + base
    for b in base[:12]:
        for _ in range(8):
            words = b.split()
            words[rnd.randrange(60)] = "changed"
            texts.append(" ".join(words))
    return texts + base[:5] * 6


def test_near_duplicates(spark):
    texts = near_texts()
    rows = [(1000 - i, t, "en", "s") for i, t in enumerate(texts)]
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(table(spark, rows)).collect()}
    fps = {i: simhash_plainly(t) for i, t, _, _ in rows}
    assert {i: f for i, (f, _) in got.items()} == {i: f"{f:016x}" for i, f in fps.items()}
    assert {i: c for i, (_, c) in got.items()} == components_plainly(list(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 4)


@pytest.mark.parametrize("bits", [2, 4, 5])
def test_links_are_all_pairs_within_the_distance_once(spark, bits):
    rnd = random.Random(bits)
    fps = {rnd.getrandbits(64) for _ in range(60)}
    for f in list(fps):
        for _ in range(5):
            for b in rnd.sample(range(64), rnd.choice([1, 2, 4, 5, 6])):
                f ^= 1 << b
            fps.add(f)
    signed = [f - 2**64 if f >> 63 else f for f in fps] + [-1]
    got = sorted(tuple(r) for r in simhash.links(spark.createDataFrame([(f,) for f in set(signed)], "fp long"), bits).collect())
    known = sorted(set(signed))
    assert got == [(a, b) for i, a in enumerate(known) for b in known[i + 1 :] if ((a ^ b) % 2**64).bit_count() <= bits]


def test_long_chains(spark):
    edges = [(i, i + 1) for i in range(150)] + [(1000, 2000), (3000, 2000)]
    got = dict(tuple(r) for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert all(got[i] == 0 for i in range(151)) and got[3000] == got[2000] == 1000


def test_one_of_each_stays(spark):
    rows = [(i, t, "en", "s") for i, t in enumerate(near_texts())]
    docs = table(spark, rows + rows[:20])
    kept = simhash.keep_one(docs)
    names = {r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(names)


@pytest.mark.parametrize("min_similarity", [None, 0.8])
def test_one_of_each_stays_without_ids_of_their_own(spark, min_similarity):
    rnd = random.Random(13)
    texts = [sentence(rnd, VOCABULARIES["bb"], 60) for _ in range(12)]
    rows = [(None, t, "en", "s") for t in texts[:4]] + [(7, t, "en", "s") for t in texts[4:8]] + [(20 + i, t, "en", "s") for i, t in enumerate(texts[8:])]
    copies = [(None, texts[8], "en", "s"), (None, texts[0], "en", "s"), (30, texts[3], "en", "s"), (7, texts[9], "en", "s"), (40, None, "x", "s"), (None, None, "s", "x")]
    kept = simhash.keep_one(table(spark, rows + copies), min_similarity=min_similarity)
    want = dict(zip(texts, [None] * 3 + [30] + [7] * 4 + [20, 7, 22, 23], strict=True)) | {None: 40}
    assert sorted(((r["text"] or "", r["doc_id"]) for r in kept.collect()), key=str) == sorted(((t or "", i) for t, i in want.items()), key=str)


# languages


def language_rows():
    rnd = random.Random(6)
    rows = [(i, sentence(rnd, VOCABULARIES[lang], rnd.choice([8, 60, 900])).capitalize() + "!", lang, "s") for i, lang in enumerate(rnd.choices(list(VOCABULARIES), k=240))]
    return rows + [(900, None, "aa", "s"), (901, "12 !!", "bb", "s"), (902, "", None, "s"), (903, "ж" * 50, None, "s"), (904, "x" * 100_000, None, "s")]


def test_languages_by_held_out_rows(spark):
    rows = language_rows()
    truth = {i: lang for i, _, lang, _ in rows if i < 900}
    got = {r["doc_id"]: r for r in langid.report(table(spark, rows)).collect()}
    held = [i for i in truth if got[i]["held_out"]]
    assert len(held) > 20 and np.mean([got[i]["lang_pred"] == truth[i] for i in held]) > 0.97
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (900, 901, 902)) and got[903]["lang_pred"] in VOCABULARIES
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert {r["doc_id"] for r in langid.keep_identified(table(spark, rows)).collect()} == set(truth) | {903, 904}


def phrases_plainly(text, sample):
    count = at = 0
    while at < len(text):
        n = 1
        while at + n < len(text) and text[at : at + n + 1] in sample:
            n += 1
        at += n
        count += 1
    return count


def clean(text):
    return "".join(map(chr, langid.normalise(text).tolist()))


@pytest.mark.parametrize(("block", "extra"), [(1, 1), (7, 1), (16, 5), (512, 48)])
def test_phrases_are_the_longest_matches_whatever_the_blocks(block, extra):
    rnd = random.Random(block)
    for alphabet in ("ab", "abc ", "abcdжя "):
        samples = {x: "".join(rnd.choice(alphabet) for _ in range(n)) for x, n in (("p", 300), ("q", 40))}
        texts = ["".join(rnd.choice(alphabet + "zщ") for _ in range(rnd.choice([0, 1, 7, 100, 700]))) for _ in range(15)]
        texts += [x * 300 for x in ("ab", "a", "abc ")] + [samples["p"] * 3 + samples["q"]]  # parses that never meet, and phrases longer than blocks
        parser = langid.CrossParser(samples)
        got = parser.phrases([parser.encode(langid.normalise(t)) for t in texts], block, extra)
        assert got.tolist() == [[phrases_plainly(clean(t), clean(samples[x])) for x in parser.languages] for t in texts]


def test_every_letter_of_the_samples_counts():
    scripts = {"cyrl": range(0x410, 0x450), "grek": range(0x3B1, 0x3CA), "hani": range(0x4E00, 0x5200), "latn": range(0x61, 0x7B)}
    rnd = random.Random(3)
    said = lambda letters: " ".join("".join(chr(rnd.choice(letters)) for _ in range(4)) for _ in range(500))
    samples = {k: said(v) for k, v in scripts.items()}
    names, scores = langid.predictions(pa.array([samples[k][200:400] for k in scripts] + [None, "1"]), samples)
    assert names == [*scripts, "und", "und"] and min(scores[:4]) > 0.5


def test_parsers_are_told_apart_by_content_alone(spark):
    class SameId(dict):
        pass

    first, second = SameId(aa="abc abd"), SameId(zz="xyz xyy")
    assert langid.parser_of(first).languages == ["aa"] and langid.parser_of(second).languages == ["zz"]
    first.clear()
    first["bb"] = "kkk"  # the same object with other content
    assert langid.parser_of(first).languages == ["bb"]
    docs = table(spark, [(i, "abc xyz kkk", None, "s") for i in range(40)]).repartition(4)
    for k in range(12):  # corpora with languages of their own, other Python jobs between
        if k % 3 == 0:
            docs.select(F.pandas_udf(lambda t: t.str.len(), "long")("text")).collect()
        assert {r["lang_pred"] for r in langid.identify(docs, {f"l{k}": "abc", f"m{k}": "zzz"}).collect()} == {f"l{k}"}


def test_passages_are_drawn_from_whole_documents(spark):
    rows = [(i, " ".join(f"w{i}q{k}" for k in range(2_000)), "aa", "s") for i in range(40)] + [(None, "x " * 500, "bb", "s")] * 3
    got = langid.learn_samples(table(spark, rows), sample_passages=60, passage_chars=100)
    assert 30 * 100 < len(got["aa"]) <= 60 * 101 and set(got) <= {"aa", "bb"}


def test_languages_with_columns_of_clashing_names(spark):
    rows = [(i, "the ing ion" if i % 2 else "1", "bb", i, 6) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, _language int, `a.b` int")
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns and sorted(tuple(r) for r in kept.collect()) == [r for r in rows if r[0] % 2]


# quality


def quality_rows(n=500):
    rnd = random.Random(8)
    rows, labels = [], []
    for i in range(n):
        good = rnd.random() < 0.6
        text = sentence(rnd, VOCABULARIES["bb"], 80)
        if not good:
            text = rnd.choice([lambda t: t.upper().replace(" ", "!! "), lambda t: t.replace(" ", "### "), lambda t: t.replace(" ", " | ")])(text)
        rows.append((i, text, "en", "s"))
        labels.append((i, int(good), 0))
    return rows, labels


def test_quality_by_held_out_rows(spark):
    rows, labels = quality_rows()
    rows += [(9000, None, "en", "s"), (9001, "", "en", "s"), (9001, "", "en", "s"), (9002, "y " * 50_000, None, None)]
    labelled = spark.createDataFrame(labels + [(3, None, 0), (4, 0, 0)], "doc_id long, quality int, toxic int")
    docs = table(spark, rows)
    model = quality.fit(docs, labelled)
    got = {r["doc_id"]: r for r in quality.score(docs, model).collect()}
    held = [(i, q) for i, q, _ in labels if got[i]["held_out"] and i != 4]
    assert model.rules and np.mean([got[i]["predicted"] == q for i, q in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[9000]["score"] == got[9001]["score"]
    kept = quality.keep_good(docs, labelled)
    assert kept.columns == docs.columns and kept.where("doc_id < 9000").count() == sum(r["predicted"] for i, r in got.items() if i < 9000)


def quality_statistics_plainly(text):
    text = text or ""
    words = [w for w in text.translate({c: 32 for c in (9, 10, 11, 12, 13)}).split(" ") if w]
    lines = [x for x in text.split("\n") if x.strip(" ")]
    w, c, n = max(1, len(words)), max(1, len(text)), max(1, len(lines))
    kind = lambda *k: sum(unicodedata.category(x) in k for x in text)
    among = lambda chars: sum(x in chars for x in text)
    return {
        "log_chars": math.log1p(len(text)), "mean_word": len(text) / w, "long_word": sum(len(x) > 15 for x in words) / w, "short_words": sum(len(x) <= 3 for x in words) / w,
        "distinct_words": len(set(words)) / w, "symbols": among("#*$%&<>") / c, "upper": kind("Lu") / c, "digits": kind("Nd") / c, "marks": among("!?;:") / w, "pipes": among("|{}[]") / w,
        "stops": among(".,") / w, "repeated_lines": max(0.0, 1 - len(set(lines)) / n), "line_words": math.log1p(len(words) / n),
    }


def test_scores_are_the_brute_force_s(spark):
    rows, labels = quality_rows(200)
    rows += [(9000 + i, t, "en", "s") for i, t in enumerate([None, "", " \n", "A1 b2|{} É日本\nA1\nA1", "z" * 40_000, "a\tb\x0bc\u00a0d"])]
    docs = table(spark, rows)
    model = quality.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {r["doc_id"]: r for r in quality.score(docs, model).collect()}
    assert model.rules
    for i, text, _, _ in rows:
        stats = quality_statistics_plainly(text)
        fits = lambda rule: all(stats[s] <= t if most else stats[s] > t for s, most, t in rule.conditions)  # noqa: B023, E731
        want = 1 / (1 + math.exp(-model.intercept - sum(r.weight for r in model.rules if fits(r))))
        assert got[i]["score"] == pytest.approx(want) and got[i]["predicted"] == (want >= 0.3), text
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)


def test_quality_keeps_columns_of_clashing_names(spark):
    rows, labels = quality_rows(60)
    docs = spark.createDataFrame([(i, t, "q", 1) for i, t, _, _ in rows], "doc_id long, text string, _q_text string, `a.b` int")
    kept = quality.keep_good(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert kept.columns == docs.columns and {r["_q_text"] for r in kept.collect()} == {"q"}


def test_near_duplicates_keep_columns_of_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b", "n", 1), (2, "a b", "n", 1), (3, "c d e f g", "n", 1)], "doc_id long, text string, _name string, `fps.x` int")
    kept = simhash.keep_one(docs, shingle=1, min_similarity=0.8, distinct=True, count=2)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 3]


def test_quality_without_labels_of_both_kinds(spark):
    docs = table(spark, [(i, "a b", "en", "s") for i in range(9)])
    for labels in ([], [(i, 1) for i in range(9)]):
        scores = {r["score"] for r in quality.score(docs, quality.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"))).collect()}
        assert len(scores) == 1 and 0 < scores.pop() < 1


# outliers


def statistics_plainly(text):
    words = [w for w in (text or "").translate({c: 32 for c in (9, 10, 11, 12, 13)}).split(" ") if w]
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = {}
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def outlier_rows():
    rnd = random.Random(10)
    rows = [(i, "\n".join(sentence(rnd, VOCABULARIES["bb"], 12) for _ in range(6)), rnd.choice(["en", "de"]), rnd.choice(["a", "a", "b", None])) for i in range(400)]
    rows += [(1000 + i, sentence(rnd, VOCABULARIES["bb"], 60).replace(" ", "### "), "en", "a") for i in range(10)]
    rows += [(2000 + i, ("one two three four five six\n" * 4) + sentence(rnd, VOCABULARIES["aa"], 50), "de", "b") for i in range(10)]
    rows += [(3000, None, None, None), (3001, "", "en", "a"), (3002, "few words here", "en", "a"), (3003, "a\x1cb c\x85d " + "é ü 日本 x| " * 5, "xx", "q")]
    return rows + [(4000 + i, "same text of " + "more than ten words in a row of them all", "en", "hot") for i in range(150)]


def test_outliers(spark):
    rows = outlier_rows()
    got = {r["doc_id"]: r for r in outliers.judge(table(spark, rows)).collect()}
    for i, text, _, _ in rows:
        r, want = got[i], statistics_plainly(text)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, text
        assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and not (r["base_failed"] and r["kept"])
    assert not any(got[i]["kept"] for i in range(1000, 1010)) and not any(got[i]["kept"] for i in range(2000, 2010))
    assert all(got[i]["kept"] for i in range(400)) and all(got[4000 + i]["kept"] for i in range(150))


def test_a_third_of_a_group_as_copies(spark):
    rnd = random.Random(12)
    clean = lambda: "\n".join(sentence(rnd, VOCABULARIES["bb"], 12) for _ in range(6))
    junk, good = " ".join(sentence(rnd, "abcdefgh", 5).replace(" ", "") + "###" for _ in range(60)), clean()
    rows = [(i, clean(), "en", "junk") for i in range(200)] + [(1000 + i, junk, "en", "junk") for i in range(100)]
    rows += [(2000 + i, clean(), "en", "good") for i in range(200)] + [(3000 + i, good, "en", "good") for i in range(100)]
    got = {r["doc_id"]: r["kept"] for r in outliers.judge(table(spark, rows)).collect()}
    assert sum(not kept for i, kept in got.items() if 1000 <= i < 2000) == 100
    assert all(kept for i, kept in got.items() if not 1000 <= i < 2000)


def regularised(points):
    return outliers.consistency(outliers.SUPPORT) * np.cov(points.T, bias=True) + np.diag(np.square(outliers.FLOORS))


def test_least_determinants_are_the_brute_force_s(spark):
    """Against every subset of half the points, of groups with a third of junk, near and far, tight and wide."""
    rnd = np.random.default_rng(2)
    groups = {}
    for k in range(16):
        clean = rnd.normal(size=(9, 4)) * [1, 0.5, 2, 1]
        junk = rnd.normal(size=(5, 4)) * (0.1 if k % 2 else 5) + (0, 8, 15, -20)[k % 4]
        groups[f"g{k}"] = np.vstack([clean, junk])
    rows = spark.createDataFrame([(g, *map(float, p)) for g, points in groups.items() for p in points], "_group string, x0 double, x1 double, x2 double, x3 double")
    sizes = rows.groupBy("_group").agg(F.count(F.lit(1)).alias("n"))
    got = {r["_group"]: r["log_det"] for r in outliers.least_determinants(rows, sizes, 16).collect()}
    subsets = [list(c) for c in itertools.combinations(range(14), 7)]
    above = [got[g] - min(np.linalg.slogdet(regularised(points[c]))[1] for c in subsets) for g, points in groups.items()]
    assert min(above) > -1e-6  # all are subsets' determinants
    assert sum(x < 1e-6 for x in above) >= 8 and max(above) < 2.5, above  # mostly the least of all 3,432, else near it


def test_estimates_reweight_from_all_near_points(spark):
    rnd = np.random.default_rng(3)
    points = np.vstack([rnd.normal(size=(300, 4)) * [1, 2, 0.5, 1] + [0, 1, 2, 3], rnd.normal(size=(140, 4)) * 0.2 + 25])
    rows = spark.createDataFrame([("g", *map(float, p)) for p in points], "_group string, x0 double, x1 double, x2 double, x3 double")
    got = outliers.estimates(rows)[0].first()
    assert got["n"] == 440 and np.allclose([got[f"m{i}"] for i in range(4)], points[:300].mean(axis=0), atol=0.2)
    want = np.cov(points[:300].T, bias=True) + np.diag(np.square(outliers.FLOORS))
    assert np.allclose([got[f"c{i}_{j}"] for i, j in outliers.PAIRS], [want[i, j] for i, j in outliers.PAIRS], atol=0.5)


def test_small_groups_lean_on_their_language(spark):
    rnd = random.Random(14)
    plain = lambda words: "\n".join(sentence(rnd, words, 12) for _ in range(6))
    rows = [(i, plain(VOCABULARIES["bb"]), "en", "a") for i in range(200)]
    rows += [(1000, plain(VOCABULARIES["bb"]), "en", "tiny"), (1001, plain(VOCABULARIES["bb"]).replace(" ", "#### "), "en", "tiny"), (1002, plain(VOCABULARIES["bb"]), None, None)]
    got = {r["doc_id"]: r for r in outliers.judge(table(spark, rows)).collect()}
    assert got[1000]["kept"] and not got[1001]["kept"] and got[1002]["kept"] and all(got[i]["kept"] for i in range(200))


def test_chi2():
    assert outliers.chi2_quantile(0.95, 4) == pytest.approx(9.4877, abs=1e-3) and outliers.chi2_quantile(0.975, 6) == pytest.approx(14.4494, abs=1e-3)
