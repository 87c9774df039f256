import random

import corpus_pipeline
from lexspark.llm import langid, quality, simhash
from test_mixing_sharding_urls import targets

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def write(spark, folder, rows, labels):
    spark.createDataFrame(rows, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def corpus():
    rnd = random.Random(1)
    words = ["the", "ing", "shore", "leaf", "wind", "stone", "over", "river", "quiet", "long", "tree", "cloud", "of", "and"]
    rows, labels = [], []
    for i in range(150):
        text = " ".join(rnd.choice(words) for _ in range(rnd.choice([40, 90, 1500])))
        if i % 5 == 4:
            text = text.upper().replace(" ", "!! ")
        rows.append((i, text, "en", rnd.choice("abcdef"), len(text)))
        labels.append((i, int(i % 5 != 4), 0))
    copies = [(200 + k, rows[k % 3][1], "en", "a", 0) for k in range(60)]
    near = [(400 + k, rows[k][1].replace("the", "another", 1), "en", "b", 0) for k in range(40) if k % 5 != 4]
    return rows + copies + near + [(300, None, None, None, None), (301, "", "en", "a", 0), (302, "12345 67890 " * 9, "en", "a", 0)], labels


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def survivors(rows, near=None):
    """The least id of each component over all pairs of different texts with a fingerprint near by and a similarity of
    0.8 or more; or by similarity alone."""
    texts = {}
    for r in rows:
        texts[r["text"]] = min(r["doc_id"], texts.get(r["text"], r["doc_id"]))
    known = [(t, i, simhash.fingerprints_of(t, 1, True, 3), shingles(t)) for t, i in texts.items()]
    least = {i: i for _, i, _, _ in known}

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    for n, (_, i, fps, own) in enumerate(known):
        for _, j, others, theirs in known[:n]:
            alike = len(own & theirs) >= 0.8 * len(own | theirs)
            if alike and (near is None and any(((f ^ g) % 2**64).bit_count() <= 5 for f, g in zip(fps, others)) or near == "similar"):
                a, b = root(i), root(j)
                least[max(a, b)] = min(a, b)
    return sorted(i for i in least if root(i) == i)


def near_corpus():
    """Texts with copies that change, drop or add words here and there, near the similarity of 0.8 on either side."""
    rnd = random.Random(5)
    words = ["".join(rnd.choice("aeioukltrsn") for _ in range(rnd.choice([2, 3, 5, 7]))) for _ in range(900)]
    weights = [1 / (k + 2) for k in range(900)]
    rows = []
    for base in range(60):
        text = rnd.choices(words, weights, k=rnd.choice([50, 120, 400]))
        rows.append((base, " ".join(text)))
        for copy in range(rnd.choice([1, 2, 12])):
            other = list(text)
            for _ in range(max(1, int(len(text) * rnd.choice([0.005, 0.01, 0.018, 0.03])))):
                at = rnd.randrange(len(other))
                other[at : at + 1] = rnd.choice([[], [rnd.choice(words)], [other[at], rnd.choice(words)]])
            rows.append((1000 * (base + 1) + copy, " ".join(other)))
    return rows


def test_near_copies_are_found(spark):
    rows = near_corpus()
    # a large group of near copies of one text, each different from the others
    rows += [(500_000 + k, rows[2][1] + f" tail{k}") for k in range(150)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    got = sorted(r["doc_id"] for r in corpus_pipeline.without_near_duplicates(spark, docs, "").collect())
    known = [{"doc_id": i, "text": t} for i, t in rows]
    assert got == survivors(known)
    wanted = survivors(known, "similar")
    gone, found = len(rows) - len(wanted), len(rows) - len(got)
    assert gone > 200 and found >= 0.95 * gone


def test_stages_take_effect_and_agree_with_brute_force(spark, tmp_path):
    rows, labels = corpus()
    write(spark, tmp_path, rows, labels)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    known = spark.read.parquet(f"{tmp_path}/labels.parquet")
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
    given = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, given, str(tmp_path)).write.parquet(f"{tmp_path}/out{k}")
        out = spark.read.parquet(f"{tmp_path}/out{k}")
        ids, before = sorted(r["doc_id"] for r in out.select("doc_id").collect()), given.collect()
        if k < 4:
            assert out.columns == docs.columns
        if k == 0:
            scored = {r["doc_id"]: r["predicted"] for r in quality.score(given, quality.fit(given, known)).collect()}
            assert ids == sorted(i for i, p in scored.items() if p) and not any(i % 5 == 4 for i in ids if i < 150)
        if k == 1:
            told = {r["doc_id"]: r["lang_pred"] for r in langid.report(given).collect()}
            assert ids == sorted(i for i, p in told.items() if p != "und")
        if k == 2:
            assert ids == survivors(before)
        if k == 3:
            assert set(ids) <= {r["doc_id"] for r in before} and max(ids.count(i) for i in ids) <= 2
            words = lambda rows: {s: sum(len(r["text"].split()) for r in rows if r["source"] == s) for s in "abcdef"}
            wanted, taken, longest = targets(words(before)), words(out.collect()), max(len(r["text"].split()) for r in before)
            assert all(w > 0 and abs(taken[s] - w) <= 2 * longest for s, w in wanted.items())
            assert abs(sum(taken.values()) - sum(wanted.values())) <= 3 * longest
        if k == 4:
            sizes = {}
            for r in out.collect():
                sizes.setdefault(r["sequence_id"], []).append(r["length"])
            assert all(sum(s) <= 1024 for s in sizes.values()) and {r["doc_id"] for r in before} == set(ids)
        given = out
    result = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(r["doc_id"] for r in result.collect()) == ids


def test_empty_tables(spark, tmp_path):
    write(spark, tmp_path, [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_sketches_lose_no_link(spark, monkeypatch):
    rows = [t for _, t in near_corpus()][:260] + ["", "a b c", "A b C"]
    sets = [simhash.shingle_hashes(t) for t in rows]
    parity = [simhash.sketch_of(s).tolist() for s in sets]
    for s, p in zip(sets, parity):
        for t, q in zip(sets[:40], parity):
            assert sum(((x ^ y) % 2**64).bit_count() for x, y in zip(p, q)) <= len(set(s.tolist()) ^ set(t.tolist()))
    monkeypatch.setattr(simhash, "HOT_TEXTS", 1)  # every shared signature is hot, but for what chance gives
    made = [(n, simhash.fingerprints_of(t, 1, True, 3), len(s), p) for n, (t, s, p) in enumerate(zip(rows, sets, parity))]
    nodes = spark.createDataFrame(made, "node long, fps array<long>, size long, sketch array<long>")
    alone = nodes.selectExpr("node", "node AS component")
    near = {tuple(r) for r in simhash.apart(nodes, alone, 5).collect()}
    left = {tuple(r) for r in simhash.apart(nodes, alone, 5, 0.8).collect()}
    wanted = {(i, j) for j, y in enumerate(made) for i, x in enumerate(made[:j]) if any(((f ^ g) % 2**64).bit_count() <= 5 for f, g in zip(x[1], y[1]))}
    alike = {(i, j) for i, j in wanted if len(set(sets[i]) & set(sets[j])) >= 0.8 * len(set(sets[i]) | set(sets[j]))}
    assert near == wanted and alike <= left < near and len(alike) > 50
