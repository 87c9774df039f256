"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir. Where none is set, a temporary one in local mode
    (tests), and an error on a cluster, whose machines would not see each other's files."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="spark-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named.rstrip("/")


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Deletes an intermediate folder of the shared store, if it is there."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder, so that a lost executor loses none of it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def carried(docs: DataFrame, **columns: Column) -> DataFrame:
    """docs as one column _row beside the given columns, so that its own columns, of whatever names, clash with none;
    select("_row.*") brings them back."""
    return docs.select(F.struct("*").alias("_row"), *[c.alias(name) for name, c in columns.items()])


#: What tells rows apart: whether the id is null, the id, and two digests of the whole row; in the order of survival.
ROW_KEY = ["_key_null", "_key_id", "_key_1", "_key_2"]
NO_ID = -(1 << 63)


def row_key(docs: DataFrame) -> dict[str, Column]:
    """The columns ROW_KEY of docs; equal rows share them. A digest skips nulls, so that their places are digested too."""
    columns = []
    for field in docs.schema.fields:
        name = "`" + field.name.replace("`", "``") + "`"
        # maps can't be hashed
        columns.append(F.to_json(F.struct(name)) if "map<" in field.dataType.simpleString() else F.col(name))
    digests = [F.xxhash64(F.lit(k), *columns, *[c.isNull() for c in columns]) for k in (1, 2)]
    made = [F.col("doc_id").isNull(), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), *digests]
    return dict(zip(ROW_KEY, made, strict=True))


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def id_bucket(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id falls into bucket 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % n, F.lit(0))


def words_of(text: Column) -> Column:
    return F.filter(F.split(text_or_empty(text), SPACE), lambda w: w != "")


def bounded(df: DataFrame, rows: int, most_rows: int = 100_000) -> DataFrame:
    """df, which has at most so many rows, marked for broadcast if these are few enough; beyond that joins shuffle."""
    return F.broadcast(df) if rows <= most_rows else df


def small_side(df: DataFrame, most_rows: int = 100_000) -> DataFrame:
    """df, checkpointed, and marked for broadcast only if it has few enough rows; beyond that it is joined by shuffle."""
    kept = checkpointed(df)
    return bounded(kept, kept.count(), most_rows)
