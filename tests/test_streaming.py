import pandas as pd

from lexspark.streaming import amounts as S


def test_exclusions_follow_revisions(spark, tmp_path):
    schema = "doc_id long, revision int, text string, excluded array<int>"
    rows = [
        [(1, 0, "10 € ja 20 €", [0]), (2, 0, "5 €", None)],
        [(1, 2, " " * 22 + "10 € ja 20 €", None), (1, 1, " " * 10 + "10 € ja 20 €", None)],  # out of order within a batch
        [(1, 1, "10 € ja 20 €", [1]), (1, 3, " " * 22 + "10 € ja 20 €", None)],  # a revision seen before
    ]
    for batch in rows:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        out = S.stream_carry_exclusions(stream, idle_ms=None)
        q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
        q.awaitTermination()
    got = sorted((r["doc_id"], r["revision"], r["ord"], r["index"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(1, 0, 0, 0), (1, 1, 0, 10)]


SCHEMA = "doc_id long, revision int, text string, excluded array<int>"


def drain(spark, folder, batches, idle_ms=None, **options):
    """The rows of a stream over files that arrive one after another, each seen by a run of its own."""
    for batch in batches:
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder / "in"))
        out = S.stream_carry_exclusions(spark.readStream.schema(SCHEMA).parquet(str(folder / "in")), idle_ms=idle_ms, **options)
        writer = out.writeStream.format("parquet").option("path", str(folder / "out")).option("checkpointLocation", str(folder / "log"))
        if idle_ms is None:
            writer.trigger(availableNow=True).start().awaitTermination()
        else:  # with a time to live there is always another batch to come
            running = writer.start()
            for _ in range(200):
                if running.awaitTermination(0.3) or any(p["numInputRows"] for p in running.recentProgress):
                    break
            running.stop()
    return sorted((r["doc_id"], r["revision"], r["ord"], r["index"]) for r in spark.read.parquet(str(folder / "out")).collect())


def test_exclusions_expire(spark, tmp_path):
    batches = [[(1, 0, "10 € ja 20 €", [0])], [(1, 1, "10 € ja 20 €", None)]]
    assert drain(spark, tmp_path / "kept", batches, 3_600_000) == [(1, 0, 0, 0), (1, 1, 0, 0)]
    assert drain(spark, tmp_path / "gone", batches, 1) == [(1, 0, 0, 0)]


def test_a_stream_starts_from_a_batch(spark, tmp_path):
    held = [(1, 4, "20 €", 8), (1, 3, "10 €", 0), (2, 0, "5 €", 0), (3, 1, None, None)]
    initial = spark.createDataFrame(held, "doc_id long, revision int, raw string, index int")
    first = [(1, 4, "20 €", [0]), (1, 5, " 10 € ja 20 €", None), (2, 1, "x" * 20 + " 5 €", None), (3, 1, "7 €", [0]), (4, 0, "1 €", [0])]
    assert drain(spark, tmp_path, [first], initial=initial) == [(1, 5, 1, 9), (4, 0, 0, 0)]
    later = [(1, 6, "20 €", None), (1, 7, " " * 9 + "20 €", None), (3, 2, "7 €", [0])]
    assert drain(spark, tmp_path, [later], initial=initial) == [(1, 5, 1, 9), (1, 6, 0, 0), (1, 7, 0, 9), (3, 2, 0, 0), (4, 0, 0, 0)]


class Handle:
    """State of one group, whose calls are counted; its own time to live is left out."""

    def __init__(self):
        self.values, self.calls = [], 0

    def getListState(self, name, schema, ttl):
        return self

    def get(self):
        self.calls += 1
        return iter(self.values)

    def put(self, values):
        self.calls += 1
        self.values = values


class At:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentProcessingTimeInMs(self):
        return self.ms


def arrived(*rows):
    return iter([pd.DataFrame(rows, columns=["doc_id", "revision", "raws", "starts", "excluded"])])


def test_state_is_asked_for_once_a_group():
    handle, carry = Handle(), S.CarryExclusions(None)
    carry.init(handle)
    for revision, asked in ((0, [0]), (1, None)):
        found = list(carry.handleInputRows((0,), arrived(*[(str(d), revision, ["5 €"], [revision], asked) for d in range(500)]), None))
        assert sum(map(len, found)) == 500
    assert handle.calls == 4 and len(handle.values) == 500


def test_documents_of_a_group_expire_apart():
    handle, carry = Handle(), S.CarryExclusions(100)
    carry.init(handle)
    said = lambda doc, revision, asked=None: (doc, revision, ["5 €"], [0], asked)
    rows = [[said("1", 0, [0]), said("2", 0, [0])], [said("2", 1)], [said("1", 1), said("2", 2)]]
    got = [[(r.doc_id, r.revision) for r in pd.concat(list(carry.handleInputRows((0,), arrived(*batch), At(ms)))).itertuples()] for ms, batch in zip((0, 90, 150), rows, strict=True)]
    assert got == [[("1", 0), ("2", 0)], [("2", 1)], [("2", 2)]]


def test_groups_do_not_mix_documents(spark, tmp_path):
    big = 2**53 + 1
    ids = [None, big, big + 1, *range(40)]
    batches = [[(d, 0, "10 € ja 20 €", [i % 2]) for i, d in enumerate(ids)], [(d, 1, " 10 € ja 20 €", None) for d in ids]]
    key = lambda r: (r[0] is not None, r)
    folder, options = tmp_path, {"groups": 3, "idle_ms": None}
    for batch in batches:
        spark.createDataFrame(batch, SCHEMA).write.mode("append").parquet(str(folder / "in"))
        out = S.stream_carry_exclusions(spark.readStream.schema(SCHEMA).parquet(str(folder / "in")), **options)
        assert [f.simpleString() for f in out.schema] == ["doc_id:bigint", "revision:int", "ord:int", "raw:string", "index:int"]
        writer = out.writeStream.format("parquet").option("path", str(folder / "out")).option("checkpointLocation", str(folder / "log"))
        writer.trigger(availableNow=True).start().awaitTermination()
    got = sorted(((r["doc_id"], r["revision"], r["ord"], r["index"]) for r in spark.read.parquet(str(folder / "out")).collect()), key=key)
    assert got == sorted([(d, v, i % 2, 8 * (i % 2) + v) for i, d in enumerate(ids) for v in (0, 1)], key=key)
