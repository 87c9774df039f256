"""Publishing registers only when their content has changed, by a log of versions.

A published path holds folders of registers, and under `_log` one small file a version that names the folder which came
with it. A version exists once its file does, and the file is made only if it is absent, in one step that either gives all
of it or fails: so of two publishers one is first, and the other compares again with what is out by then. Beside each
register stand the digest of its content and the order of its revision, and only these two are read to see what changed.

After `FOLD_AFTER` versions what is out is folded into one folder, a snapshot; readers open the last snapshot and the
versions after it, so that what is listed and joined stays bounded. Folders that no version names are never read.

Of several revisions of an edition the one with the greatest order counts, within a batch and against what is out; an older
one that comes late changes nothing. The order is `meta.generated` unless the caller names another column; null is the
least. Different content under an equal order is an error, as nothing says which is right. A batch of a stream is named in
its version, so that a replayed one is recognised.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.operators.register import build_register, changed_registers, content_hash, list_counts, validate_register
from lexspark.sources.folders import remove_folder

FOLD_AFTER = 10
ATTEMPTS = 20
ORDER = "meta.generated"


class Conflict(ValueError):
    """Different content of one edition under one order."""


@dataclass
class State:
    """What is out: the last version, the folders to read by version, and each writer's last batch."""

    version: int = 0
    snapshot: int = 0
    folders: dict[int, str] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)


def _store(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def published_state(spark: SparkSession, path: str) -> State:
    log, store = _store(spark, f"{path}/_log")
    names = [s.getPath().getName() for s in store.listStatus(log)] if store.exists(log) else []
    commits = sorted(int(n[:20]) for n in names if n[0] not in "._" and n.endswith(".version"))
    snapshots = [int(n[:20]) for n in names if n[0] not in "._" and n.endswith(".snapshot")]
    state = State(max(commits, default=0), max(snapshots, default=0))
    wanted = [f"{state.snapshot:020}.snapshot"] * bool(snapshots) + [f"{v:020}.version" for v in commits if v > state.snapshot]
    if wanted:
        texts = spark.read.text([f"{path}/_log/{n}" for n in wanted], wholetext=True).collect()
        for said in sorted((json.loads(r[0]) for r in texts), key=lambda x: x["version"]):
            state.folders[said["version"]] = said["folder"]
            state.batches |= said["batches"]
    return state


def _claim(spark: SparkSession, path: str, name: str, said: dict) -> bool:
    """Makes the log file, whole and only if it is absent; False if it was there."""
    jvm = spark.sparkContext._jvm
    target, store = _store(spark, f"{path}/_log/{name}")
    written = jvm.org.apache.hadoop.fs.Path(f"{path}/_log/.{uuid.uuid4()}")
    out = store.create(written)
    out.write(bytearray(json.dumps(said).encode()))
    out.close()
    try:
        if store.getUri().getScheme() == "file":  # a local rename would replace what is there; a link doesn't
            local = lambda p: jvm.java.nio.file.Paths.get(p.toUri().getPath(), spark.sparkContext._gateway.new_array(jvm.java.lang.String, 0))
            jvm.java.nio.file.Files.createLink(local(target), local(written))
        else:
            context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(store.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
            context.rename(written, target, spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Py4JJavaError as error:
        if "FileAlreadyExists" not in error.java_exception.getClass().getName():
            raise
        return False
    finally:
        store.delete(written, False)
    return True


def _versions(spark: SparkSession, path: str, state: State, columns: list[str]) -> DataFrame:
    parts = [spark.read.parquet(f"{path}/{folder}").select(*columns, F.lit(v).alias("_version")) for v, folder in state.folders.items()]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def _out(spark: SparkSession, path: str, state: State, columns: list[str]) -> DataFrame:
    """Of each edition what came with the highest version."""
    last = F.max_by(F.struct(*columns), "_version").alias("r")
    return _versions(spark, path, state, ["doc_id", *columns]).groupBy("doc_id").agg(last).select("doc_id", "r.*")


def read_published(spark: SparkSession, path: str) -> DataFrame | None:
    """The registers (doc_id, meta, lists) that are out. None if there are none yet."""
    state = published_state(spark, path)
    return _out(spark, path, state, ["meta", "lists"]) if state.folders else None


def _conflicts(keys: DataFrame) -> None:
    found = [str(r[0]) for r in keys.select("doc_id").limit(5).collect()]
    if found:
        raise Conflict(f"different content under one order: {', '.join(found)}")


def last_revisions(incoming: DataFrame) -> DataFrame:
    """(doc_id, _order, _hash) of each edition's last revision; equal revisions count once."""
    upside_down = F.translate("_hash", "0123456789abcdef", "fedcba9876543210")
    last = incoming.groupBy("doc_id").agg(
        F.max(F.struct("_order", "_hash")).alias("most"), F.max(F.struct("_order", upside_down.alias("_turned"), "_hash")).alias("least")
    )
    _conflicts(last.where("most._hash <> least._hash"))
    return last.select("doc_id", "most._order", "most._hash")


def _changed(spark: SparkSession, incoming: DataFrame, last: DataFrame, path: str, state: State) -> DataFrame:
    """The rows of incoming to write: last revisions that are new, or later than what is out and of other content."""
    if state.folders:
        out = _out(spark, path, state, ["_hash", "_order"]).select("doc_id", F.col("_hash").alias("_old"), F.struct(F.col("_order").alias("o")).alias("_was"))
        compared = last.join(out, "doc_id", "left").withColumn("_now", F.struct(F.col("_order").alias("o")))
        other = compared.where(F.col("_old").isNull() | (F.col("_hash") != F.col("_old")))
        _conflicts(other.where(F.col("_old").isNotNull() & F.col("_now").eqNullSafe(F.col("_was"))))
        last = other.where(F.col("_old").isNull() | (F.col("_now") > F.col("_was"))).select("doc_id", "_order", "_hash")
    wanted = last.select(F.col("doc_id").alias("_id"), F.col("_order").alias("_o"), F.col("_hash").alias("_h"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("_order").eqNullSafe(F.col("_o")) & (F.col("_hash") == F.col("_h"))
    return incoming.join(wanted, same, "left_semi").dropDuplicates(["doc_id"])


def publish_if_changed(
    new: DataFrame, path: str, order: str = ORDER, batch: tuple[str, int] | None = None, fold_after: int = FOLD_AFTER
) -> bool:
    """Publishes the registers (doc_id, meta, lists) that differ from what is out at path; whether there were any.

    Only changed editions are written; others stay as they were published. batch: a writer's name and the number of its
    batch, which is published once however often it comes. order names the column of new that orders revisions.
    """
    spark = new.sparkSession
    incoming_folder = f"{path}/_incoming-{uuid.uuid4()}"
    new.select("doc_id", "meta", "lists", content_hash().alias("_hash"), F.col(order).alias("_order")).write.parquet(incoming_folder)
    try:
        incoming = spark.read.parquet(incoming_folder)
        last = last_revisions(incoming)
        for _ in range(ATTEMPTS):
            state = published_state(spark, path)
            if batch and state.batches.get(batch[0], -1) >= batch[1]:
                return False
            folder = f"registers-{uuid.uuid4()}"
            _changed(spark, incoming, last, path, state).write.parquet(f"{path}/{folder}")
            if spark.read.schema(incoming.schema).parquet(f"{path}/{folder}").isEmpty():
                remove_folder(spark, f"{path}/{folder}")
                return False
            version = state.version + 1
            if _claim(spark, path, f"{version:020}.version", {"version": version, "folder": folder, "batches": dict([batch]) if batch else {}}):
                if version - state.snapshot >= fold_after:
                    fold(spark, path)
                return True
            remove_folder(spark, f"{path}/{folder}")  # another publisher was first
        raise RuntimeError(f"other publishers were first {ATTEMPTS} times at {path}")
    finally:
        remove_folder(spark, incoming_folder)


def fold(spark: SparkSession, path: str) -> None:
    """Writes what is out as one folder, from which later reading starts; of two at once the first counts."""
    state = published_state(spark, path)
    if len(state.folders) < 2:
        return
    folder = f"snapshot-{uuid.uuid4()}"
    _out(spark, path, state, ["meta", "lists", "_hash", "_order"]).write.parquet(f"{path}/{folder}")
    if not _claim(spark, path, f"{state.version:020}.snapshot", {"version": state.version, "folder": folder, "batches": state.batches}):
        remove_folder(spark, f"{path}/{folder}")


def publish_plan(new: DataFrame, old: DataFrame) -> DataFrame:
    """(doc_id, changed) without writing."""
    return changed_registers(new, old).select("doc_id", F.col("changed"))


def publish_valid(subs: DataFrame, meta: DataFrame, path: str) -> tuple[bool, DataFrame]:
    """publish_if_changed for the editions whose six lists all hold something, and (doc_id, empty_lists) of the others."""
    failed = validate_register(list_counts(subs, meta.select("doc_id")))
    good = meta.join(failed, "doc_id", "left_anti")
    return publish_if_changed(build_register(subs.join(good.select("doc_id"), "doc_id", "left_semi"), good), path), failed
