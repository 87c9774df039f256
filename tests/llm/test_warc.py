import gzip
import hashlib
import base64
import random

import pyarrow as pa
import pytest

from lexspark.llm import warc

SCHEMA = "page_id long, url string, html string, record_type string"


def expected(rows):
    last = {}
    for page, _, html, _ in rows:
        last[html or ""] = max(last.get(html or "", page), page)
    out = []
    for page, _, html, _ in rows:
        data = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        top = last[html or ""]
        out.append((page, len(data), digest, "response" if page == top else "revisit", None if page == top else top))
    return sorted(out, key=str)


def test_round_trip(spark):
    rnd = random.Random(5)
    long = "".join(rnd.choice("abcdefghij <>&é") for _ in range(900_000))
    rows = [(i, f"http://x/{i}\r\nX: y", rnd.choice(["", None, "a", "b" * 500, long, f"own {i}"]), "clash") for i in range(120)]
    rows += [(500, None, "a", "clash"), (500, None, "a", "clash")]  # repeated rows with the largest id are both responses
    got = warc.round_trip(spark, spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == expected(rows) and all(r["intact"] for r in got)


@pytest.mark.parametrize("size", [1, 7, 50, 333, 5_000])
def test_every_split_owns_each_record_once(size):
    members = [warc.gzip_member(warc.record(i, "u", bytes(random.Random(i).randbytes(i * 40)), "D", None)) for i in range(30)]
    data = b"".join(members)
    starts = [sum(map(len, members[:i])) for i in range(30)]
    file = pa.BufferReader(data)
    found = [s for b in range(0, len(data), size) for s, _ in warc.records_in(file, len(data), b, min(b + size, len(data)))]
    assert found == starts


def test_magic_inside_payloads_is_no_record():
    payload = b"\x1f\x8b\x08\x00 not a member " * 50
    data = warc.gzip_member(warc.record(1, "u", payload, "D", None), level=0) * 2
    file = pa.BufferReader(data)
    starts = [s for b in range(0, len(data), 100) for s, _ in warc.records_in(file, len(data), b, min(b + 100, len(data)))]
    assert starts == [0, len(data) // 2]


def test_files_are_plain_gzip(spark, tmp_path):
    manifest = warc.write_archives(spark.createDataFrame([(1, "u", "x", ""), (2, "v", "x", "")], SCHEMA), f"file://{tmp_path}/w").collect()
    text = b"".join(gzip.open(r["path"].removeprefix("file://")).read() for r in manifest)
    assert text.count(b"WARC/1.1\r\n") == 2 and b"WARC-Type: revisit" in text
    read = warc.read_archives(spark.createDataFrame(manifest)).collect()
    assert {r["page_id"]: bytes(r["payload"]) for r in read} == {1: b"", 2: b"x"}


def test_minimum_and_empty_table(spark):
    pages = spark.createDataFrame([(1, "u", "x", ""), (2, "v", "x", "")], SCHEMA)
    assert {r["record_type"] for r in warc.round_trip(spark, pages, min_revisit_bytes=2).collect()} == {"response"}
    assert warc.round_trip(spark, spark.createDataFrame([], SCHEMA)).count() == 0


def test_ranges_are_read_in_tasks_of_their_own(spark, tmp_path):
    rows = [(i, "u", bytes(random.Random(i).randbytes(900)).hex(), "") for i in range(200)]
    manifest = warc.write_archives(spark.createDataFrame(rows, SCHEMA).coalesce(1), f"file://{tmp_path}/w")
    size = manifest.first()["bytes"]
    read = warc.read_archives(manifest, range_bytes=8 << 10)
    filled = [n for n in read.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect() if n]
    assert len(filled) == -(-size // (8 << 10)) > 10 and sum(filled) == 200


def test_damaged_payloads_are_found(spark, tmp_path):
    good = warc.record(1, "u", b"payload", warc.digest_of(b"payload"), None)
    for name, data in (("a", good), ("b", good.replace(b"payload\r\n", b"pAyload\r\n"))):
        (tmp_path / name).write_bytes(warc.gzip_member(data))
    files = spark.createDataFrame([(f"file://{tmp_path}/{n}", (tmp_path / n).stat().st_size) for n in "ab"], "path string, bytes long")
    assert {r["path"][-1]: r["intact"] for r in warc.read_archives(files).collect()} == {"a": True, "b": False}


def test_payloads_stay_where_they_are(spark):
    plan = warc.with_revisits(spark.createDataFrame([(1, "u", "x", ""), (2, "v", "x", "")], SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_ranges_follow_the_total():
    assert warc.range_size(0) == warc.range_size(10**9) == warc.RANGE_BYTES
    for total in (10**13, 10**14 + 7):
        assert -(-total // warc.range_size(total)) <= warc.MOST_RANGES
