"""Amounts over arriving documents, exclusions that follow revisions, and registers published as they arrive."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lexspark.functions import amounts as A
from lexspark.jobs.publish import ORDER, publish_if_changed

TOLERANCE = 10
WEEK_MS = 7 * 24 * 3600 * 1000

EXCLUDED = "doc_id string, revision int, ord int, raw string, index int"
HELD = "doc_id string, last int, written long, raws array<string>, starts array<int>"
GROUPS = 4096
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_amounts(stream: DataFrame, mode: str = "eur") -> DataFrame:
    """One row per amount of each arriving document (doc_id, text); nothing is kept between batches."""
    found = stream.select("doc_id", F.explode(A.extract_amounts(F.col("text"), mode)).alias("m"))
    return found.select("doc_id", "m.ord", "m.raw", "m.amount", "m.decimals")


def _carried(held: list[tuple[str, int]], said: Iterable[str], begun: Iterable[int], asked: Iterable[int] | None) -> list[tuple[int, str, int]]:
    """The excluded matches of a revision (ord, raw, start), from those of the revision before."""
    asked = set(asked) if asked is not None else set()
    near: dict[str, list[int]] = {}
    for raw, start in sorted(held, key=lambda m: m[1]):
        near.setdefault(raw, []).append(start)
    now = []
    for n, (raw, start) in enumerate(zip(said, map(int, begun), strict=True)):
        known = near.get(raw, [])
        at = bisect_left(known, start - TOLERANCE)
        if n in asked or (at < len(known) and known[at] <= start + TOLERANCE):
            now.append((n, raw, start))
    return now


class CarryExclusions(StatefulProcessor):
    """A group's list of documents: their last revision, and the matches excluded in it. A document goes when it wasn't
    written for idle_ms, the list when none of the group was. It is read and written once a batch, whole."""

    def __init__(self, idle_ms: int | None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.list = handle.getListState("held", HELD, self.idle_ms)

    def _now(self, timerValues) -> int:
        return 0 if self.idle_ms is None else int(timerValues.getCurrentProcessingTimeInMs())

    def _state(self, now: int) -> dict[str | None, tuple[int, int, list[tuple[str, int]]]]:
        """(last revision, when written, excluded matches) of each document that has not expired."""
        return {
            doc_id: (last, written, list(zip(raws, starts, strict=True)))
            for doc_id, last, written, raws, starts in self.list.get()
            if self.idle_ms is None or written + self.idle_ms > now
        }

    def _keep(self, documents: dict[str | None, tuple[int, int, list[tuple[str, int]]]]) -> None:
        if documents:
            self.list.put([(doc_id, last, written, [m[0] for m in held], [m[1] for m in held]) for doc_id, (last, written, held) in documents.items()])
        else:
            self.list.clear()

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        """Of the revisions given of a document the last counts."""
        now = self._now(timerValues)
        documents = self._state(now)
        for doc_id, revision, raw, start in zip(*[initialState[c] for c in ("doc_id", "revision", "raw", "index")], strict=True):
            last, _, held = documents.get(doc_id, (-1, now, []))
            if revision >= last:
                held = held if revision == last else []
                if raw is not None:
                    held.append((raw, int(start)))
                documents[doc_id] = (int(revision), now, held)
        self._keep(documents)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        """A row for each match excluded in a revision that arrived; revisions seen before are ignored."""
        now = self._now(timerValues)
        documents, found = self._state(now), []
        arrived = pd.concat(list(rows)).sort_values("revision", kind="stable")
        for doc_id, revision, said, begun, asked in zip(*[arrived[c] for c in ("doc_id", "revision", "raws", "starts", "excluded")], strict=True):
            last, _, held = documents.get(doc_id, (-1, now, []))
            if revision > last:
                last = int(revision)
                matches = _carried(held, said, begun, asked)
                found += [(doc_id, last, *m) for m in matches]
                held = [m[1:] for m in matches]
            if last >= 0:
                documents[doc_id] = (last, now, held)
        self._keep(documents)
        yield pd.DataFrame(found, columns=["doc_id", "revision", "ord", "raw", "index"])

    def close(self) -> None:
        """Nothing is open."""


def stream_carry_exclusions(
    stream: DataFrame, mode: str = "eur", idle_ms: int | None = WEEK_MS, initial: DataFrame | None = None, groups: int = GROUPS
) -> DataFrame:
    """Exclusions of each revision (doc_id, revision, text, excluded: the places excluded by hand in it).

    A match is excluded if it was asked for, or if an excluded match of the revision before has the same text and began
    at most ten units away. State holds a document's excluded matches only, and goes when no revision came for idle_ms;
    None keeps it, which a run over what is available now needs in order to end. A new stream can start from the exclusions that a batch ended with (initial: doc_id, revision, raw,
    index). State is kept by RocksDB, which the session is set to: keyed lists with a time to live need it.

    Python asks for state over a socket, a few milliseconds each time, so it is keyed by groups that documents are dealt to
    by the hash of their id, not by documents. A batch reads and writes the lists of the groups that it touches: groups
    should be the number of documents, divided by some hundreds. It is fixed for the life of a checkpoint.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    # only matches and their places go to Python, and ids as text, which stay whole beside null
    kind = stream.schema["doc_id"].dataType
    dealt = lambda df: df.withColumns({"doc_id": F.col("doc_id").cast("string"), "group": F.pmod(F.xxhash64(F.col("doc_id").cast(kind)), F.lit(groups))})
    placed = A.with_places(stream.select("doc_id", "revision", "excluded", "text"), mode)
    cut = dealt(placed.select("doc_id", "revision", "excluded", F.col("places.raw").alias("raws"), F.col("places.index").alias("starts")))
    start = None
    if initial is not None:
        start = dealt(initial.select("doc_id", F.col("revision").cast("int").alias("revision"), "raw", F.col("index").cast("int").alias("index"))).groupBy("group")
    carried = cut.groupBy("group").transformWithStateInPandas(CarryExclusions(idle_ms), EXCLUDED, "append", "ProcessingTime" if idle_ms else "None", start)
    return carried.withColumn("doc_id", F.col("doc_id").cast(kind))


def stream_publish(stream: DataFrame, path: str, checkpoint: str, order: str = ORDER):
    """A query that publishes arriving registers (doc_id, meta, lists) whenever their content differs from what is out.

    Of several revisions in a batch the last by `order` counts. Each version names its batch, under the checkpoint's name,
    so that a batch replayed after a failure is published once.
    """

    def publish(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            publish_if_changed(batch, path, order, (checkpoint, number))

    return stream.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
