"""Reading documents and registers, and writing documents."""

from __future__ import annotations

from collections.abc import Iterable
from urllib.parse import quote

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

SUBSTANCES = "array<struct<et:string,en:string>>"
REGISTER = (
    "meta struct<source:string,act:string,effective_date:string,generated:string>, "
    f"lists array<struct<id:int,title:string,description:string,isGroups:boolean,substances:{SUBSTANCES}>>"
)


def read_documents(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """(doc_id, text): of Parquet as it is; of text files one document a file, its path the id."""
    if kind == "parquet":
        return spark.read.parquet(path).select("doc_id", "text")
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("doc_id"), F.col("value").alias("text"))


def write_documents(documents: DataFrame, folder: str, prefix: str = "", folders: int = 1) -> None:
    """(doc_id, text), each as a text file of its own under its id: `{folder}/{n}/{prefix}{doc_id}.txt`, n by the hash of the
    id. A folder should hold some thousand files at most, and is written by one task; the driver sees no file. A null text
    is empty; a task that runs again writes the same files."""

    def write(rows: Iterable[Row]) -> None:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else "file://" + folder)
        made = set()
        for n, doc_id, text in rows:
            if n not in made:
                store.create_dir(f"{root}/{n}", recursive=True)
                made.add(n)
            with store.open_output_stream(f"{root}/{n}/{prefix}{quote(doc_id, safe='')}.txt") as out:
                out.write((text or "").encode())

    dealt = documents.select(F.pmod(F.xxhash64("doc_id"), F.lit(folders)).alias("n"), F.col("doc_id").cast("string"), "text")
    dealt.repartition(folders, "n").foreachPartition(write)


def flatten_register(registers: DataFrame) -> DataFrame:
    """One row per substance, with its list's description and its place in the list from 1; a missing English name is empty."""
    lists = registers.select(*[c for c in registers.columns if c not in ("meta", "lists")], "meta", F.explode("lists").alias("l"))
    rows = lists.select("*", F.posexplode("l.substances").alias("place", "s")).drop("lists")
    kept = [c for c in registers.columns if c not in ("meta", "lists")]
    return rows.select(
        *kept, "meta", F.col("meta.effective_date").alias("effective_date"), F.col("l.id").alias("list_id"), F.col("l.title").alias("title"),
        F.col("l.isGroups").alias("is_groups"), (F.col("place") + 1).alias("ord"), F.col("s.et").alias("et"), F.coalesce("s.en", F.lit("")).alias("en"),
    )


def read_register(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """flatten_register of JSON documents, one a file, or one a line."""
    return flatten_register(spark.read.schema(REGISTER).json(path, multiLine=not lines))


def read_drifting_register(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, quarantined) of registers whose shape drifts, one JSON document a line, read as variants.

    rows: as of read_register without the ids of files, with unknown, the names of fields of the list and the substance
    that registers don't have. Values are taken by what they can be read as: an id written as text is a number, a missing
    title is null, a missing English name is empty. quarantined: (reason, document) of what can't be a row: lines that
    aren't JSON, documents that aren't registers, lists without a number, and substances without an Estonian name, each
    with the smallest part that is wrong. Nothing else of such a document is lost.
    """
    lines = spark.read.text(path).select("value", F.try_parse_json("value").alias("v"))
    held = lines.withColumn("lists", F.try_variant_get("v", "$.lists", "array<variant>"))
    wrong = F.when(F.col("v").isNull(), "no JSON").when(F.col("lists").isNull(), "no register")
    marked = held.withColumn("reason", wrong)
    of = lambda part, name, kind: F.try_variant_get(part, f"$.{name}", kind)
    meta = F.struct(*[of("v", name, "string").alias(name.removeprefix("meta.")) for name in ("meta.source", "meta.act", "meta.effective_date", "meta.generated")])
    lists = marked.where("reason IS NULL").withColumn("meta", meta).select("meta", F.explode("lists").alias("l"))
    lists = lists.withColumns({"list_id": of("l", "id", "int"), "substances": of("l", "substances", "array<variant>")})
    fine = F.col("list_id").isNotNull() & F.col("substances").isNotNull()
    entries = lists.where(fine).select("meta", "list_id", "l", F.posexplode("substances").alias("place", "s")).withColumn("et", of("s", "et", "string"))
    unknown = lambda part, known: F.filter(F.map_keys(F.try_variant_get(part, "$", "map<string,variant>")), lambda k: ~k.isin(*known))
    rows = entries.where(F.col("et").isNotNull()).select(
        "meta", F.col("meta.effective_date").alias("effective_date"), "list_id", of("l", "title", "string").alias("title"), of("l", "isGroups", "boolean").alias("is_groups"),
        (F.col("place") + 1).alias("ord"), "et", F.coalesce(of("s", "en", "string"), F.lit("")).alias("en"),
        F.concat(unknown("l", ("id", "title", "description", "isGroups", "substances")), unknown("s", ("et", "en"))).alias("unknown"),
    )
    bad = marked.where("reason IS NOT NULL").select("reason", F.col("value").alias("document"))
    bad = bad.unionByName(lists.where(~fine).select(F.lit("no list").alias("reason"), F.to_json("l").alias("document")))
    return rows, bad.unionByName(entries.where(F.col("et").isNull()).select(F.lit("no name").alias("reason"), F.to_json("s").alias("document")))
