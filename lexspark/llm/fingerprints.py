"""Canonical exact digests of documents, by SQL functions only.

A text's canonical form is its compatibility composition (NFKC), case-folded, with each run of white space one space and
none at the ends. Its fingerprint is the 128-bit digest made of two differently seeded XXH64 values of that form.
Texts, edited ones included, are grouped by digest, and inside a digest's group they are compared: texts with equal
SHA-256 are the same, and of all others the canonical forms are compared byte by byte. Should two forms ever share a
digest, each gets its own number after it. Digests alone are grouped at first; forms are moved only for those digests
that several different texts have. All grouping is aggregated map-side, so a group of copies costs one row a task.

The next document in descending doc_id is found in range buckets. Their bounds are quantiles of the ids, so that each
bound is the first id of its bucket; that document is also held, as a guest, at the end of the bucket before.

Defined cases: null texts are empty; texts of any length are digested whole; equal ids are ordered by text; a null doc_id counts as the least id; repeated rows
have equal fingerprints; a table of one row follows itself; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexspark.llm.common import checkpointed, small_side, text_or_empty

#: Rows of a bucket; more where there would be more buckets than MAX_SPLITS (at 100 TB of such texts, half a GB a bucket).
BUCKET_ROWS, MAX_SPLITS = 1_000, 200_000
LEAST = -(1 << 63)


def canonical(text: str) -> Column:
    """The canonical form of the string column of this name. ICU comes with Spark; reflect calls its static methods."""
    composed = f"reflect('com.ibm.icu.text.Normalizer', 'compose', `{text}`, true)"
    folded = f"reflect('com.ibm.icu.lang.UCharacter', 'foldCase', {composed}, true)"
    again = f"reflect('com.ibm.icu.text.Normalizer', 'compose', {folded}, true)"  # folding may leave uncomposed letters
    return F.trim(F.regexp_replace(F.expr(again), r"(?U)\s+", " "))


def digest(form: Column) -> Column:
    parts = (F.xxhash64(form), F.xxhash64(F.lit(1), form))
    return F.lower(F.concat(*[F.lpad(F.hex(p), 16, "0") for p in parts]))


def _numbers(forms: DataFrame) -> DataFrame:
    """(digest, form, number) of canonical forms (digest, form) that share their digest with another; empty in practice."""
    distinct = forms.distinct()
    shared = distinct.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select(F.col("digest").alias("_shared"))
    order = Window.partitionBy("digest").orderBy("form")
    return distinct.join(shared, F.col("digest") == F.col("_shared"), "left_semi").withColumn("number", F.row_number().over(order))


def _suspects(said: DataFrame) -> DataFrame:
    """The digests that texts (digest, raw: SHA-256) of different raw digests have; as _suspect."""
    groups = said.groupBy("digest").agg(F.min("raw").alias("low"), F.max("raw").alias("high"))
    return small_side(groups.where(F.col("low") < F.col("high")).select(F.col("digest").alias("_suspect")))


def _numbered(rows: DataFrame, shared: DataFrame, form: str, name: str) -> DataFrame:
    own = shared.select(F.col("form").alias("_f"), F.col("digest").alias("_d"), F.col("number").alias("_n"))
    joined = rows.join(own, (F.col(name) == F.col("_d")) & (F.col(form) == F.col("_f")), "left")
    return joined.withColumn(name, F.concat(F.col(name), F.coalesce(F.concat(F.lit("-"), "_n"), F.lit("")))).drop("_f", "_d", "_n")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint for every row: equal if and only if the canonical forms are."""
    rows = docs.select("doc_id", text_or_empty(F.col("text")).alias("_text")).withColumn("_form", canonical("_text"))
    found = rows.select("doc_id", "_form", digest(F.col("_form")).alias("fingerprint"), F.sha2("_text", 256).alias("raw"))
    light = checkpointed(found.select("doc_id", "fingerprint", "raw"))
    suspects = _suspects(light.select(F.col("fingerprint").alias("digest"), "raw"))
    forms = found.join(suspects, F.col("fingerprint") == F.col("_suspect"), "left_semi").select(F.col("fingerprint").alias("digest"), F.col("_form").alias("form"))
    shared = checkpointed(_numbers(forms))
    if not shared.isEmpty():
        light = _numbered(found, shared, "_form", "fingerprint")
    return light.select("doc_id", "fingerprint")


def _bucket(key: Column, splits: list[int]) -> tuple[Column, Column]:
    """The bucket of a key, descending: how many splits are no less; and whether the key is the first of its bucket.

    Two levels, so that few splits are compared. The lists are text in the plan, and folded into constants.
    """
    if not splits:
        return F.lit(0), F.lit(False)
    down = sorted(splits, reverse=True)
    width = max(1, round(len(down) ** 0.5))
    longs = lambda xs: F.split(F.lit(",".join(map(str, xs))), ",").cast("array<bigint>")
    among = lambda xs: F.size(F.filter(xs, lambda s: s >= key))
    coarse = among(longs(down[width - 1 :: width])) if len(down) >= width else F.lit(0)
    bucket = coarse * width + among(F.slice(longs(down), coarse * width + 1, F.lit(width)))
    return bucket, F.coalesce(F.get(longs(down), bucket - 1) == key, F.lit(False))


def with_next(docs: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """doc_id, text and the next document's text in descending doc_id; the last is followed by the first."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST)).alias("key"), text_or_empty(F.col("text")).alias("text"))
    keys = rows.select("key")
    count, top = keys.agg(F.count(F.lit(1)), F.max("key")).first()
    wanted = count // max(bucket_rows, count // MAX_SPLITS, 1)
    splits: list[int] = []
    if wanted > 1:
        shares = [i / wanted for i in range(1, wanted)]
        splits = sorted(set(keys.select(F.percentile_approx("key", shares, max(10_000, 4 * wanted)).alias("q")).first()["q"] or []))
    bucket, first = _bucket(F.col("key"), splits)
    placed = rows.withColumn("_b", bucket).withColumn("_first", first)
    place = lambda b, guest: F.struct(b.alias("bucket"), F.lit(guest).alias("guest"))
    own, before, around = place(F.col("_b"), False), F.when(F.col("_first"), place(F.col("_b") - 1, True)), F.when(F.col("key") == F.lit(top), place(F.lit(len(splits)), True))
    placed = placed.withColumn("_c", F.explode(F.array_compact(F.array(own, before, around)))).select("doc_id", "key", "text", "_c.bucket", "_c.guest")
    order = Window.partitionBy("bucket").orderBy("guest", F.col("key").desc(), "text")
    return placed.withColumn("next_text", F.lead("text").over(order)).where(~F.col("guest")).select("doc_id", "text", "next_text")


def compare_edited(docs: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Fingerprints of every text and of its edited form, and the likeness of fingerprints: 1 if equal, else 0.

    Edited: the last third of the code points gives way to as many from the start of the next document.
    """
    rows = with_next(docs, bucket_rows).withColumn("n_chars", F.length("text").cast("long"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    kept = F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - third).cast("int"))
    edited = rows.withColumn("edited", F.concat(kept, F.substring(F.col("next_text"), F.lit(1), third)))
    forms = edited.select(
        "doc_id", "n_chars", F.sha2("text", 256).alias("raw"), F.sha2("edited", 256).alias("edited_sha256"),
        canonical("text").alias("form"), canonical("edited").alias("edited_form"), canonical("next_text").alias("next_form"),
    )
    like = lambda other: F.when(F.col("form") == F.col(other), F.lit(1.0)).otherwise(F.lit(0.0))
    found = forms.withColumns({
        "fingerprint": digest(F.col("form")), "edited_fingerprint": digest(F.col("edited_form")), "near_edited": like("edited_form"), "near_next": like("next_form"),
    })
    columns = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    light = checkpointed(found.select(*columns, "raw"))
    said = F.explode(F.array(F.struct(F.col("fingerprint").alias("digest"), "raw"), F.struct(F.col("edited_fingerprint").alias("digest"), F.col("edited_sha256").alias("raw"))))
    suspects = _suspects(light.select(said.alias("_s")).select("_s.*"))
    if suspects.isEmpty():
        return light.select(*columns)
    originals = docs.select(text_or_empty(F.col("text")).alias("_text")).select(canonical("_text").alias("form")).select(digest(F.col("form")).alias("digest"), "form")
    # an edited form that equals its own text's was compared with it in the row; only others are made again
    others = light.where(F.col("near_edited") == 0).join(suspects, F.col("edited_fingerprint") == F.col("_suspect"), "left_semi")
    if not others.isEmpty():
        originals = originals.union(found.where(F.col("near_edited") == 0).select(F.col("edited_fingerprint").alias("digest"), F.col("edited_form").alias("form")))
    shared = checkpointed(_numbers(originals.join(suspects, F.col("digest") == F.col("_suspect"), "left_semi")))
    if not shared.isEmpty():
        light = _numbered(_numbered(found, shared, "form", "fingerprint"), shared, "edited_form", "edited_fingerprint")
    return light.select(*columns)
