from pyspark.sql import functions as F

from lexspark.jobs.publish import publish_if_changed, publish_valid, read_published
from lexspark.operators import register as R
from lexspark.sources import acts
from lexspark.sources.documents import flatten_register, read_documents, read_drifting_register, read_register

CELLS = [
    ["X", "Y"], ["I  nimekiri", None], ["Eestikeelne nimetus", "Ingliskeelne"], ["jätk", ""], ["Beeta-\naine", "Beta\nagent"], ["", "salt"], ["Alfa", "Al"],
    ["ab", "cde"], ["BEETA-AINE", "other"], ["Dilämmastikoksiid (N2O)", "Dilämmastikoksiid (N2O)"], ["II nimekiri"], ["3 / 12"], [None, ""],
]
ROWS = "doc_id string, page int, table_idx int, row_idx int, tbl_top double, cells array<string>"
WORDS = "doc_id string, page int, word_idx int, text string, top double"


def edition(spark, cells, words=()):
    return spark.createDataFrame(list(words), WORDS), spark.createDataFrame([("e", 0, 0, i, 10.0, c) for i, c in enumerate(cells)], ROWS)


def test_one_edition(spark):
    words, rows = edition(spark, CELLS)
    got = [(r["list_id"], r["et"], r["en"]) for r in R.substances(words, rows).orderBy("list_id", "ord").collect()]
    assert got == [(1, "Alfa", ""), (1, "Beeta-aine", "Beta agent salt"), (1, "Dilämmastikoksiid (N2O)", "Nitrous oxide (N2O)")]
    _, warned = R.merge_continuations(R.classified_rows(R.page_events(words, rows)))
    assert [(r["kind"], r["et"]) for r in warned.collect()] == [("more_et", "jätk")]
    counts = R.list_counts(R.substances(words, rows), rows.select("doc_id"))
    assert R.validate_register(counts).first()["empty_lists"] == [2, 3, 4, 5, 6]
    assert counts.where("list_id is null").first()["n"] == 3


def test_headings_from_words_and_ties(spark):
    # 12.5 rounds to 12, so the heading shares its place with the row at 10 + 2, and goes first; 13.5 rounds to 14
    words, rows = edition(
        spark, [["Enne", "Before"], ["Üks asi", "One thing"], ["Kaks asja", "Two things"], ["Kolm asja", "Three"], ["Neli asja", "Four"]],
        [("e", 0, 0, "I", 9.0), ("e", 0, 1, "nimekiri", 9.2), ("e", 0, 1, "NIMEKIRI", 12.5), ("e", 0, 0, "ii", 12.4), ("e", 0, 0, "iii", 13.5), ("e", 0, 1, "nimekiri", 13.6)],
    )
    got = [(r["list_id"], r["et"]) for r in R.substances(words, rows).orderBy("list_id", "ord").collect()]
    assert got == [(1, "Enne"), (1, "Üks asi"), (2, "Kaks asja"), (2, "Kolm asja"), (3, "Neli asja")]


def test_resumed_list(spark):
    words, rows = edition(spark, [["I nimekiri"], ["Alfa", "Alpha"], ["II nimekiri"], ["Beeta", "Beta"], ["I nimekiri"], ["", "more"]])
    got = [(r["list_id"], r["en"]) for r in R.substances(words, rows).orderBy("list_id").collect()]
    assert got == [(1, "Alpha more"), (2, "Beta")]


def _meta(spark, generated):
    return spark.createDataFrame([("e", "s", "a", "1.1.2026", generated)], "doc_id string, source string, act string, effective_date string, generated string")


def test_publish_and_read_back(spark, tmp_path):
    words, rows = edition(spark, CELLS)
    subs = R.substances(words, rows)
    path = str(tmp_path / "out")
    assert publish_if_changed(R.build_register(subs, _meta(spark, "1")), path)
    assert not publish_if_changed(R.build_register(subs, _meta(spark, "2")), path)
    assert publish_if_changed(R.build_register(subs.withColumn("en", F.lit("x")), _meta(spark, "3")), path)
    nested = read_published(spark, path)
    assert sorted(p.name for p in (tmp_path / "out" / "_log").iterdir()) == [f"{v:020}.version" for v in (1, 2)]
    row = nested.first()
    assert row["meta"]["generated"] == "3" and [x["id"] for x in row["lists"]] == [1, 2, 3, 4, 5, 6]
    assert row["lists"][5]["isGroups"] and row["lists"][1]["substances"] == []
    nested.select("meta", "lists").coalesce(1).write.json(str(tmp_path / "json"))
    flat = read_register(spark, str(tmp_path / "json")).collect()
    assert [(r["list_id"], r["ord"], r["en"]) for r in flat] == [(1, i, "x") for i in (1, 2, 3)]
    assert flatten_register(nested).count() == 3


def test_search(spark):
    subs = spark.createDataFrame([(1, 1, "Amfetamiin", "Amphetamine"), (6, 1, "Rühm", None)], "list_id int, ord int, et string, en string")
    queries = spark.createDataFrame([(1, " AMPH "), (2, ""), (3, "zz")], "query_id long, q string")
    hits = {(r["query_id"], r["et"]): r["en_html"] for r in R.search_register(subs, queries).collect()}
    assert hits == {(1, "Amfetamiin"): "<mark>Amph</mark>etamine", (2, "Amfetamiin"): "Amphetamine", (2, "Rühm"): ""}
    counts = {(r["query_id"], r["list_id"]): (r["badge"], r["hidden"], r["result_label"]) for r in R.search_counts(subs, queries).collect()}
    assert counts[1, 1] == ("1/1", False, "1 tulemust") and counts[3, 6] == ("0/1", True, "0 tulemust")
    assert counts[2, 6] == ("1 rühma", False, "") and counts[2, 2] == ("0 ainet", False, "") and len(counts) == 18


ODD = ["", "a", "aa", "Aaa", "abcabc", "ÄÖ ü", "ß İ", "\U0001f600x\U0001f600", "a\nb", "(.*)", "aab", "x" * 3000 + "Ä", None]


def test_search_against_every_pair(spark, monkeypatch):
    names = [(n % 6 + 1, n, et, en) for n, (et, en) in enumerate((a, b) for a in ODD for b in ODD)] * 2
    subs = spark.createDataFrame(names, "list_id int, ord int, et string, en string")
    asked = [*ODD, "A", "b", "bc", "cab", "aaa", " äö ", "\U0001f600", "x" * 40, "xä", "nowhere", "z", "\u00a0", "aa"]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id int, q string")
    low = lambda t: (t or "").lower()
    strip = lambda q: low(q).strip(" \u00a0\n")
    want = sorted((i, n, et, en) for i, q in enumerate(asked) for _, n, et, en in names if strip(q) in low(et) or strip(q) in low(en))
    for most in (200_000, 0):
        monkeypatch.setattr(R, "MOST_KEYS", most)
        hits = R.search_register(subs, queries)
        assert sorted((r["query_id"], r["ord"], r["et"], r["en"]) for r in hits.collect()) == want or most is None
        counts = {}
        for r in R.search_counts(subs, queries).collect():
            counts[r["query_id"]] = counts.get(r["query_id"], 0) + r["visible"]
            assert not strip(asked[r["query_id"]]) or r["result_label"] == f"{sum(w[0] == r['query_id'] for w in want)} tulemust"
        assert counts == {i: sum(w[0] == i for w in want) for i in range(len(asked))}
    flt7 = subs.crossJoin(queries).where(R.substance_matches(F.col("et"), F.col("en"), F.coalesce("q", F.lit(""))))
    assert sorted((r["query_id"], r["ord"], r["et"], r["en"]) for r in flt7.collect()) == want
    assert R.search_register(subs, queries.limit(0)).count() == R.search_register(subs.limit(0), queries).count() == 0


def test_the_plan_of_a_search(spark):
    """No nested loop, and the same plan for any number of queries."""
    subs = spark.range(100).selectExpr("CAST(id % 6 + 1 AS int) AS list_id", "id AS ord", "concat('aine ', id) AS et", "'x' AS en")
    shapes = []
    for n in (30, 30_000):
        queries = spark.range(n).selectExpr("id AS query_id", "CAST(1000 + id AS string) AS q")
        plan = R.search_register(subs, queries)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
        shapes.append(len(plan.splitlines()))
    assert shapes[0] == shapes[1]


def test_counts_are_one_aggregate(spark):
    subs = spark.createDataFrame([("e", 1), ("e", 1), ("f", 6)], "doc_id string, list_id int")
    counts = R.list_counts(subs)
    assert {(r["doc_id"], r["list_id"], r["n"]) for r in counts.collect()} == {
        *(("e", n, 2 if n == 1 else 0) for n in range(1, 7)), *(("f", n, int(n == 6)) for n in range(1, 7)), ("e", None, 2), ("f", None, 1)
    }
    assert counts._jdf.queryExecution().optimizedPlan().toString().count("Expand") == 1


def test_acts(spark):
    xml = '<a:akt xmlns:a="u"><a:kehtivuseAlgus>{}</a:kehtivuseAlgus><a:tavatekst>vt Lisa 1</a:tavatekst><a:fail failNimi="m.pdf"/><a:fail failNimi="X_LISA.pdf"/></a:akt>'
    rows = [(1, xml.format("2026-02-23")), (2, xml.format("kevad")), (3, "<akt"), (4, "<akt><tavatekst>Lisa 2</tavatekst></akt>"), (5, None)]
    got = {r["id"]: r for r in acts.effective_date(acts.annex_url(spark.createDataFrame(rows, "id int, xml string"))).collect()}
    assert got[1]["annex_url"].endswith("/X_LISA.pdf") and got[1]["effective_date"] == "23.02.2026" and got[2]["effective_date"] == "kevad"
    assert got[3]["annex_error"] == acts.BROKEN and got[3]["effective_date"] is None and got[4]["annex_error"] == acts.NO_ANNEX and got[5]["annex_error"] == acts.BROKEN
    plan = acts.act_facts(spark.createDataFrame(rows, "id int, xml string").repartition(2))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("from_xml") + plan.count("xmltostructs") <= 2 and plan.lower().count("xpath") == 1
    bodies = spark.createDataFrame([('{"kehtivRedaktsioon": 12}',), ("{}",), ("no json",), ('{"kehtivRedaktsioon": ""}',)], "body string")
    found = [(r["blob_url"], r["error"]) for r in acts.resolve_revision(bodies).collect()]
    assert found[0][0].endswith("/akt/12/blob-xml") and all(f == (None, acts.NO_REVISION) for f in found[1:])


def test_act_details(spark):
    """Against the standard library's reading of the same documents, element by element."""
    from xml.etree import ElementTree

    texts = ["", "  ", "2026-2-3", "2026-02-30", "kevad", "2026-02-23\n", "<b/>2026-01-01", "x<b/>y", "<!-- c -->"]
    files = ["LISA.pdf", "http://x/Lisa_1.pdf", "m.pdf", "ftp://lisa", "li sa", "a&amp;lisa", ""]
    rows = []
    for n, (t, f) in enumerate((t, f) for t in texts for f in files):
        p = ("a:", ' xmlns:a="u"') if n % 3 == 0 else ("", ' xmlns="u"') if n % 3 == 1 else ("", "")
        words = "vt Lisa 1" if n % 5 else "<i/>Lisa 1"
        rows.append((n, f'<{p[0]}akt{p[1]}><{p[0]}sisu><{p[0]}kehtivuseAlgus>{t}</{p[0]}kehtivuseAlgus><{p[0]}uustavatekst1>{words}</{p[0]}uustavatekst1></{p[0]}sisu>'
            f'<{p[0]}fail failNimi="x"/><{p[0]}lisafail failNimi="{f}"/><{p[0]}kehtivuseAlgus>2027-01-01</{p[0]}kehtivuseAlgus></{p[0]}akt>'))  # fmt: skip
    got = {r["id"]: (r["annex_url"], r["annex_error"], r["effective_date"]) for r in acts.act_facts(spark.createDataFrame(rows, "id int, xml string")).collect()}
    for n, xml in rows:
        root = ElementTree.fromstring(xml)
        file = next((e.get("failNimi") for e in root.iter() if "fail" in e.tag and "lisa" in (e.get("failNimi") or "").lower()), None)
        named = any("tavatekst" in e.tag and "Lisa 1" in (e.text or "") for e in root.iter())
        date = next((e.text.strip() for e in root.iter() if "kehtivuseAlgus" in e.tag and e.text), None)
        date = {"2026-2-3": "03.02.2026", "2026-02-23": "23.02.2026", "2027-01-01": "01.01.2027"}.get(date, date)
        url = acts.ANNEX + file if named and file else None
        assert got[n] == (url, None if url else acts.NO_ANNEX, date), xml
    bodies = [('{"kehtivRedaktsioon": "0"}', "0"), ('{"kehtivRedaktsioon": 0}', None), ('{"kehtivRedaktsioon": "false"}', "false"), ('{"kehtivRedaktsioon": null}', None), ("[1]", None), (None, None)]
    found = acts.resolve_revision(spark.createDataFrame(bodies, "body string, want string")).collect()
    assert all(r["blob_url"] == (r["want"] and f"{acts.ACT}{r['want']}/blob-xml") and (r["error"] is None) == bool(r["want"]) for r in found)


def test_only_whole_registers_are_published(spark, tmp_path):
    rows = [("good", n, 1, f"aine {n}", "x") for n in range(1, 7)] + [("bad", 1, 1, "aine", "x")]
    subs = spark.createDataFrame(rows, "doc_id string, list_id int, ord int, et string, en string")
    meta = spark.createDataFrame([(d, "s", "a", None, "1") for d in ("good", "bad", "none")], "doc_id string, source string, act string, effective_date string, generated string")
    done, failed = publish_valid(subs, meta, str(tmp_path / "out"))
    assert done and {r["doc_id"]: r["empty_lists"] for r in failed.collect()} == {"bad": [2, 3, 4, 5, 6], "none": [1, 2, 3, 4, 5, 6]}
    assert [r["doc_id"] for r in read_published(spark, str(tmp_path / "out")).collect()] == ["good"]


def test_reading_documents(spark, tmp_path):
    (tmp_path / "a.txt").write_text("10 €\nja 20 €", encoding="utf-8")
    docs = read_documents(spark, str(tmp_path / "*.txt"), "text")
    assert [r["text"] for r in docs.collect()] == ["10 €\nja 20 €"]
    docs.write.parquet(str(tmp_path / "p"))
    assert read_documents(spark, str(tmp_path / "p")).columns == ["doc_id", "text"]


def test_drifting_registers(spark, tmp_path):
    lines = [
        '{"meta": {"act": "a", "generated": 5, "new": [1]}, "lists": [{"id": "3", "isGroups": "true", "substances": [{"et": "Ä", "en": null}, {"en": "x"}, {"et": 7, "z": {"q": 1}}, "odd"]}]}',
        '{"lists": [{"title": "t", "substances": []}, {"id": 1, "substances": {}}, {"id": 2, "substances": []}, 5, null]}',
        '{"lists": 5}', "{}", "null", "[]", "", "{", '{"lists": []}',
    ]
    (tmp_path / "in.txt").write_text("\n".join(lines) + "\n", encoding="utf-8")
    rows, bad = read_drifting_register(spark, str(tmp_path / "in.txt"))
    got = [(r["meta"]["act"], r["meta"]["generated"], r["list_id"], r["is_groups"], r["title"], r["ord"], r["et"], r["en"], r["unknown"]) for r in rows.orderBy("ord").collect()]
    assert got == [("a", "5", 3, True, None, 1, "Ä", "", []), ("a", "5", 3, True, None, 3, "7", "", ["z"])]
    held = {}
    for r in bad.collect():
        held.setdefault(r["reason"], []).append(r["document"])
    assert {k: len(v) for k, v in held.items()} == {"no JSON": 2, "no register": 4, "no list": 4, "no name": 2}
    assert '{"en":"x"}' in held["no name"] and '"odd"' in held["no name"] and "{" in held["no JSON"]
