import random

import pytest

from lexspark.sources import bundles as B


def rows():
    rnd = random.Random(3)
    bodies = ["", None, "<akt>ä\n</akt>", "\x1e{\"act_id\": 5}", "\x1f\x1fS\x1eE", "x" * 70_000, "\n\n", "õ\U0001f600"]
    return [(i, rnd.choice(["revision", "xml"]), rnd.choice(bodies)) for i in range(400)] + [(None, None, "no id")]


@pytest.fixture
def register(spark):
    spark.dataSource.register(B.ActBundles)


@pytest.mark.parametrize("range_bytes", [17, 5_000, 1 << 25])
def test_round_trip_by_ranges(spark, tmp_path, register, range_bytes):
    folder, given = str(tmp_path / "acts"), rows()
    given = given if range_bytes > 17 else [r for r in given if len(r[2] or "") < 1000][:60]
    frame = spark.createDataFrame(given, "act_id long, kind string, body string").repartition(3)
    frame.write.format("act_bundles").mode("append").save(folder)
    frame.limit(0).write.format("act_bundles").mode("append").save(folder)  # leaves no file
    read = spark.read.format("act_bundles").option("range_bytes", range_bytes).load(folder)
    got = read.collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(((r["act_id"], r["kind"], r["body"]) for r in got), key=key) == sorted(given, key=key)
    assert len({(r["file"], r["place"]) for r in got}) == len(given) and len({r["file"] for r in got}) == 3
    size = sum(p.stat().st_size for p in (tmp_path / "acts").iterdir())
    assert read.rdd.getNumPartitions() >= size // range_bytes


def test_no_files_and_headers_that_cannot_be_read(spark, tmp_path, register):
    assert spark.read.format("act_bundles").load(str(tmp_path / "none")).count() == 0
    (tmp_path / "x.acts").write_bytes(b"what\x1e{}\nbody\n\x1e{\"act_id\": 1, \"kind\": \"xml\"}\n<a/>\n\x1enot json\n\x1e")
    got = {(r["act_id"], r["kind"], r["body"]) for r in spark.read.format("act_bundles").load(str(tmp_path)).collect()}
    assert got == {(None, None, "{}\nbody\n"), (1, "xml", "<a/>"), (None, None, "not json\n"), (None, None, "")}


def test_a_failed_job_leaves_nothing(spark, tmp_path, register):
    from pyspark.sql import functions as F

    bad = F.when(F.col("id") == 90, F.raise_error(F.lit("broken"))).otherwise(F.lit("b"))
    with pytest.raises(Exception, match="broken"):
        spark.range(100).select(F.col("id").alias("act_id"), F.lit("xml").alias("kind"), bad.alias("body")).write.format("act_bundles").mode("append").save(str(tmp_path))
    assert list(tmp_path.iterdir()) == []


def test_a_stream_takes_each_file_once(spark, tmp_path, register):
    folder, given = str(tmp_path / "acts"), [r for r in rows() if r[0] is not None and r[2] is not None]

    def drain():
        stream = spark.readStream.format("act_bundles").option("range_bytes", 4_000).load(folder)
        running = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
        running.awaitTermination()
        return sorted(r["act_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect())

    for part in (given[:200], given[200:]):
        spark.createDataFrame(part, "act_id long, kind string, body string").write.format("act_bundles").mode("append").save(folder)
        seen = drain()
    assert seen == sorted(r[0] for r in given)


def test_ranges_grow_with_many_bytes():
    files = [("a", 7 << 30), ("b", 0), ("c", 5), ("d", 6 << 30)]
    got = B.ranges(files, 1 << 20)
    assert len(got) <= B.RANGES + len(files)
    for name, size in files:
        mine = [r for r in got if r.name == name]
        assert [r.start for r in mine] == ([0] + [r.end for r in mine[:-1]] if mine else []) and sum(r.end - r.start for r in mine) == size
    assert len(B.ranges([("a", 50 << 20)], 1 << 20)) == 50


def test_records_written_by_column():
    import json

    import pyarrow as pa

    rows = [(i, k, b) for i in (None, 0, -5, 2**62) for k in (None, "xml", 'q"\\ä\n', "") for b in (None, "", "\x1e\x1f\x1fS", "ä\n\U0001f600")]
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.string()), strict=True)], ["act_id", "kind", "body"])
    for at, n in ((0, len(rows)), (5, 20), (3, 1), (0, 0)):
        want = ""
        for i, k, b in rows[at : at + n]:
            head = json.dumps({"act_id": i, "kind": k} | ({"none": True} if b is None else {}))
            want += "\x1e" + head + "\n" + (b or "").replace("\x1f", "\x1fE").replace("\x1e", "\x1fS") + "\n"
        assert B.written(batch.slice(at, n)).to_pybytes() == want.encode()
