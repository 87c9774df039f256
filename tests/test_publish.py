import random
import threading

import pytest

from lexspark.jobs import publish as P
from lexspark.sources.documents import REGISTER
from lexspark.streaming import amounts as S


def registers(spark, rows):
    """rows: (edition, order, content)"""
    made = [(d, ("s", "a", None, o), [(1, "t", "d", False, [(c, "x")])]) for d, o, c in rows]
    return spark.createDataFrame(made, "doc_id string, " + REGISTER).repartition(2)


def out(spark, path):
    return {r["doc_id"]: (r["meta"]["generated"], r["lists"][0]["substances"][0]["et"]) for r in P.read_published(spark, path).collect()}


def folders(path):
    return sorted(p.name.split("-")[0] for p in path.iterdir())


def test_one_revision_of_an_edition_in_a_batch(spark, tmp_path):
    for k, rows in enumerate(([("e", "2", "new"), ("e", "1", "old")], [("e", "1", "old"), ("e", "2", "new"), ("e", "2", "new")])):
        path = str(tmp_path / str(k))
        assert P.publish_if_changed(registers(spark, rows), path)
        assert out(spark, path) == {"e": ("2", "new")}
        assert not P.publish_if_changed(registers(spark, [("e", "1", "older still")]), path)  # comes late
        assert not P.publish_if_changed(registers(spark, [("e", "3", "new")]), path)
        assert P.publish_if_changed(registers(spark, [("e", "3", "newer"), ("f", None, "n")]), path)
        assert out(spark, path) == {"e": ("3", "newer"), "f": (None, "n")}
        assert P.publish_if_changed(registers(spark, [("f", "0", "m")]), path)  # no order is the least


def test_different_content_under_one_order_is_an_error(spark, tmp_path):
    path = str(tmp_path / "out")
    with pytest.raises(P.Conflict):
        P.publish_if_changed(registers(spark, [("e", "1", "a"), ("e", "1", "b"), ("f", "1", "c")]), path)
    assert P.read_published(spark, path) is None
    assert P.publish_if_changed(registers(spark, [("e", "1", "a"), ("e", "0", "x"), ("e", "0", "y")]), path)
    with pytest.raises(P.Conflict):
        P.publish_if_changed(registers(spark, [("e", "1", "b")]), path)
    assert out(spark, path) == {"e": ("1", "a")} and folders(tmp_path / "out") == ["_log", "registers"]


def test_two_writers(spark, tmp_path, monkeypatch):
    path, claim, met = str(tmp_path / "out"), P._claim, []

    def late(session, at, name, said):
        if not met:  # another publisher comes between the comparison and the claim
            met.append(name)
            assert P.publish_if_changed(registers(session, [("e", "5", "other"), ("g", "1", "g")]), path)
            assert not claim(session, at, name, said)
        return claim(session, at, name, said)

    monkeypatch.setattr(P, "_claim", late)
    assert P.publish_if_changed(registers(spark, [("e", "4", "mine"), ("f", "1", "f")]), path)
    assert out(spark, path) == {"e": ("5", "other"), "f": ("1", "f"), "g": ("1", "g")}
    assert P.published_state(spark, path).version == 2 and folders(tmp_path / "out") == ["_log", "registers", "registers"]


def test_many_writers_at_once(spark, tmp_path):
    path, failed = str(tmp_path / "out"), []

    def write(k):
        try:
            P.publish_if_changed(registers(spark, [("e", f"{k:02}", f"c{k}"), (f"own{k}", "1", "x")]), path, fold_after=2)
        except Exception as error:  # noqa: BLE001
            failed.append(error)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    got = out(spark, path)
    assert not failed and got["e"] == ("03", "c3") and len(got) == 5 and P.published_state(spark, path).version == 4


def test_snapshots_bound_what_is_read(spark, tmp_path):
    path, rnd, known = str(tmp_path / "out"), random.Random(1), {}
    for k in range(8):
        rows = [(f"e{e}", f"{k:02}", f"c{rnd.randrange(3)}") for e in rnd.sample(range(5), 3)]
        changed = {d: (o, c) for d, o, c in rows if known.get(d, ("", ""))[1] != c}
        assert P.publish_if_changed(registers(spark, rows), path, batch=("w", k), fold_after=3) == bool(changed)
        known |= changed
        state = P.published_state(spark, path)
        assert out(spark, path) == known and len(state.folders) <= 3 and state.batches["w"] <= k
    assert state.snapshot >= 3


def test_a_replayed_batch(spark, tmp_path):
    path = str(tmp_path / "out")
    first, second = registers(spark, [("e", "1", "a")]), registers(spark, [("e", "2", "b")])
    assert P.publish_if_changed(first, path, batch=("w", 0)) and P.publish_if_changed(second, path, batch=("w", 1))
    again = registers(spark, [("e", "3", "must not come: this batch is out")])
    assert not P.publish_if_changed(again, path, batch=("w", 1)) and not P.publish_if_changed(again, path, batch=("w", 0))
    P.fold(spark, path)
    assert not P.publish_if_changed(again, path, batch=("w", 1))  # the snapshot remembers
    assert out(spark, path) == {"e": ("2", "b")}
    assert P.publish_if_changed(again, path, batch=("v", 0)) and P.published_state(spark, path).batches == {"w": 1, "v": 0}


def test_a_stream_that_fails_after_publishing(spark, tmp_path, monkeypatch):
    path, log = str(tmp_path / "out"), str(tmp_path / "log")
    registers(spark, [("e", "1", "a"), ("e", "2", "b")]).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(P.read_published(spark, path).schema if P.read_published(spark, path) else registers(spark, [("e", "1", "a")]).schema).parquet(str(tmp_path / "in"))
    real = S.publish_if_changed

    def failing(*args):
        real(*args)
        raise RuntimeError("lost after its version was made")

    monkeypatch.setattr(S, "publish_if_changed", failing)
    with pytest.raises(Exception, match="lost after"):
        S.stream_publish(stream(), path, log).awaitTermination()
    assert P.published_state(spark, path).version == 1
    monkeypatch.setattr(S, "publish_if_changed", real)
    S.stream_publish(stream(), path, log).awaitTermination()  # the batch is replayed
    assert P.published_state(spark, path).version == 1 and out(spark, path) == {"e": ("2", "b")}
