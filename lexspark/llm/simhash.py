"""Near-duplicates by SimHash, found through deletion-variant signatures.

A 64-bit fingerprint is cut into three segments. Two fingerprints that differ in at most four (or five) bits differ in at
most one bit of some segment, so in that segment they share a variant with the same one bit wildcarded. Distinct
fingerprints are indexed under all 64 such variants, joined by equality, and verified on the full 64 bits in the join
itself, where each pair is kept at its first shared variant only. Components come from alternating large-star and
small-star rounds over the links, each round kept in the shared folder.

Copies count once: documents are grouped by fingerprint (or by text) before anything is joined, so a group of copies of
any size is one node. The index is spread by variant, and skewed variants are split by adaptive execution.

`keep_one` with a similarity works on distinct texts. A text has several fingerprints of its distinct words, made with
hashes of their own, and two texts are candidates if one of them differs in few bits; the five-word shingles of every
candidate pair then decide. So that a large group of near copies doesn't bring all its pairs, each text is first held
against the least text in its segments (a star); what that leaves apart is then searched in full, but pairs that are
in one component already never leave the join, and neither do pairs of a hot signature whose parity sketches prove
that they are not similar enough. The components are the same as over all pairs.

Defined cases: null, empty and blank texts have fingerprint zero and link to whatever lies within the distance of zero;
texts with fewer words than a shingle are one shingle; very long texts are shingled whole, each in one task; a bit set in
just half the hashes is 0; repeated rows share everything; a null doc_id belongs to its
component but is never its name unless all its ids are null; an empty table gives no rows; other columns, of whatever
names, are ignored by `near_duplicates` and carried along by `keep_one`.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexspark.llm.common import ROW_KEY, SPACE, carried, checkpointed, row_key, small_side, text_or_empty

SHINGLE = 4
MAX_BITS = 4
SEED = 42
BITS = 64
VERIFY_WORDS = 5
#: A fingerprint with more than one row in so many is hot; so there are never more hot ones than this.
HOT_SHARE = 20_000
#: 64-bit words of a parity sketch.
SKETCH = 16
#: A signature is hot if it has more texts than this and more than eight times what chance gives it.
HOT_TEXTS = 64


def _mixed(hashes: np.ndarray) -> np.ndarray:
    """Other hashes of the same things, by a one-to-one function of the hash."""
    h = hashes ^ (hashes >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def fingerprints_of(text: str | None, shingle: int = SHINGLE, distinct: bool = False, count: int = 1) -> list[int]:
    """Fingerprints of a text, signed. A bit is set if it is set in over half the hashes of the text's word shingles,
    repeats included unless distinct: XXH64 values for the first fingerprint, mixed ones for the others."""
    import xxhash

    words = text.encode("utf-8", "replace").lower().split() if text else []  # of bytes: ASCII letters and white space only
    if not words:
        return [0] * count
    if distinct and shingle == 1:
        words = list(dict.fromkeys(words))
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = max(len(words) - shingle + 1, 1)
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[s:e], SEED) for s, e in zip(starts[:last].tolist(), ends[min(shingle, len(words)) - 1 :].tolist(), strict=True)], dtype="<u8")
    if distinct:
        hashes = np.unique(hashes)
    found = []
    for k in range(count):
        hashes = _mixed(hashes).astype("<u8") if k else hashes
        set_in = np.zeros(BITS, np.int64)
        for part in np.array_split(hashes, len(hashes) // 65_536 + 1):
            set_in += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        found.append(int(np.packbits(2 * set_in > len(hashes), bitorder="little").view("<i8")[0]))
    return found


def shingle_hashes(text: str | None, words: int = VERIFY_WORDS) -> np.ndarray:
    """The distinct 64-bit hashes of a text's lower-cased word shingles; of all its words together if they are fewer."""
    import xxhash

    split = text.lower().encode("utf-8", "replace").split() if text else []
    if not split:
        return np.zeros(1, "<u8")
    numbers: dict[bytes, int] = {}
    places = [numbers.setdefault(w, len(numbers)) for w in split]
    own = np.array([xxhash.xxh64_intdigest(w, SEED) for w in numbers], dtype="<u8")[places]
    last, found = max(len(split) - words + 1, 1), np.zeros(1, "<u8")
    for k in range(min(words, len(split))):
        found = found * np.uint64(0x9E3779B97F4A7C15) + own[k : k + last]
    return np.unique(_mixed(found))


def sketch_of(hashes: np.ndarray) -> np.ndarray:
    """A parity sketch: every hash flips one bit. Sketches of two sets differ in no more bits than the sets in elements."""
    bits = np.bincount((_mixed(hashes) >> np.uint64(54)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view("<i8")


def sketched(text: Column, shingle: int = SHINGLE, distinct: bool = False, count: int = 1) -> Column:
    """A text's fingerprints (fps), the number of its five-word shingles (size) and their parity sketch."""

    @F.pandas_udf("fps array<long>, size long, sketch array<long>")
    def of(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            hashes = shingle_hashes(t)
            rows.append((fingerprints_of(t, shingle, distinct, count), len(hashes), sketch_of(hashes)))
        return pd.DataFrame(rows, columns=["fps", "size", "sketch"])

    return of(text)


def fingerprints(text: Column, shingle: int = SHINGLE, distinct: bool = False, count: int = 1) -> Column:
    """The array of a text's fingerprints."""

    @F.pandas_udf("array<long>")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprints_of(t, shingle, distinct, count) for t in texts], dtype=object)

    return of(text)


def segments_for(max_bits: int) -> list[tuple[int, int]]:
    """(first bit, bits) of the fewest near-equal segments of which one differs in at most one bit."""
    count = max_bits // 2 + 1
    edges = [round(i * BITS / count) for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _mask(first: int, bits: int) -> int:
    mask = ((1 << bits) - 1) << first
    return mask - (1 << 64) if mask >> 63 else mask


def _variants(fp: Column, max_bits: int, tag: Column | None = None) -> Column:
    """Array of signatures: the segment without the wildcarded bit in the low half, the bit's number above it, and a
    small tag from bit 40 on."""
    made = []
    for first, bits in segments_for(max_bits):
        for bit in range(first, first + bits):
            mask = _mask(first, bits) & ~_mask(bit, 1)
            segment = F.shiftrightunsigned(fp.bitwiseAND(F.lit(mask).cast("long")), first)
            made.append(segment.bitwiseOR(F.lit(bit << 32).cast("long")))
    return F.array(*[m if tag is None else m.bitwiseOR(F.shiftleft(tag.cast("long"), 40)) for m in made])


def _first_shared(different: Column, max_bits: int) -> Column:
    """The number of the first variant that two fingerprints with this exclusive-or share."""
    arms = []
    for first, bits in segments_for(max_bits):
        own = different.bitwiseAND(F.lit(_mask(first, bits)).cast("long"))
        single = F.bit_count(own)
        at = F.bit_count(own - F.lit(1).cast("long"))  # the place of the only set bit: so many lower bits
        if first + bits == BITS:  # 2**63 - 1 is right too, but -2**63 - 1 overflows
            at = F.when(own < 0, F.lit(BITS - 1)).otherwise(F.bit_count(F.greatest(own, F.lit(1).cast("long")) - F.lit(1).cast("long")))
        arms.append(F.when(single == 0, F.lit(first)).when(single == 1, at))
    return F.coalesce(*arms)


def _meeting(index: DataFrame, apart: Column, max_bits: int, *bounds: Column) -> DataFrame:
    """The rows of index (fp, signature and others) as a and b, joined where they share a signature, at the first one
    only, their fingerprints differ in at most max_bits bits, and apart and the bounds hold."""
    different = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    variant = F.shiftright("a.signature", 32).bitwiseAND(F.lit(255).cast("long"))
    on = (F.col("a.signature") == F.col("b.signature")) & apart
    for bound in (F.bit_count(different) <= max_bits, variant == _first_shared(different, max_bits), *bounds):
        on = on & bound
    return index.alias("a").join(index.alias("b"), on)


def links(fingerprints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b), a < b: pairs of distinct values of column fp that differ in at most max_bits bits, each once."""
    index = fingerprints.withColumn("signature", F.explode(_variants(F.col("fp"), max_bits)))
    return _meeting(index, F.col("a.fp") < F.col("b.fp"), max_bits).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, component) for every node of the edges (a, b); the component is its least node.

    Star rounds (Kiveris et al., 2014): each round joins every node's neighbours to the least of them. The edges reach
    a fixed point, stars around the least nodes, in a number of rounds that grows with the logarithm of the size.
    """

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        # u's neighbours v; large: those above u go to the least one; small: those below u, and u itself
        around = pairs.select(F.col("a").alias("u"), F.col("b").alias("v"))
        if large:
            around = around.union(pairs.select(F.col("b").alias("u"), F.col("a").alias("v")))
        else:
            around = pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        joined = around.join(least, "u")
        kept = joined.where(F.col("v") > F.col("u")) if large else joined
        moved = kept.select(F.least("v", "m").alias("a"), F.greatest("v", "m").alias("b"))
        if not large:
            moved = moved.union(least.select(F.least("u", "m").alias("a"), F.greatest("u", "m").alias("b")))
        return moved.where(F.col("a") != F.col("b")).distinct()

    def state(pairs: DataFrame) -> tuple:
        return tuple(pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = checkpointed(edges.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    seen = state(edges)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        edges = checkpointed(star(star(edges, large=True), large=False))
        now = state(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    leaves = edges.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return leaves.union(leaves.select(F.col("component").alias("node"), "component").distinct())


def _shingle_set(text: Column, words: int) -> Column:
    """The distinct hashes of a text's word shingles."""

    @F.pandas_udf("array<long>")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([shingle_hashes(t, words).view("<i8") for t in texts], dtype=object)

    return of(text)


def similar(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, min_similarity: float, words: int = VERIFY_WORDS) -> DataFrame:
    """The pairs (a, b) of nodes whose texts' word shingles have a Jaccard similarity of at least min_similarity.

    A node's text is that of its first row. Only nodes in pairs are looked up; their list goes to the documents by
    broadcast while it is short, and by shuffle beyond.
    """
    linked = pairs.select(F.col("a").alias("_node")).union(pairs.select("b")).distinct()
    wanted = small_side(nodes.join(linked, F.col("node") == F.col("_node")).select(F.col("node").alias("_fp"), "first.*"))
    own = docs.select("text", *[c.alias(k) for k, c in row_key(docs).items()]).join(wanted, ROW_KEY)
    one = own.dropDuplicates(["_fp"])  # equal rows share a key
    sets = checkpointed(one.select("_fp", _shingle_set(F.col("text").cast("string"), words).alias("_set")))
    a, b = (sets.select(F.col("_fp").alias(f"_{k}"), F.col("_set").alias(f"_set_{k}")) for k in "ab")
    # a star's least node is a: the sets that differ from pair to pair come first
    both = pairs.join(b, F.col("b") == F.col("_b")).join(a, F.col("a") == F.col("_a"))
    shared = F.size(F.array_intersect("_set_a", "_set_b"))
    similarity = shared / (F.size("_set_a") + F.size("_set_b") - shared)
    return checkpointed(both.where(similarity >= min_similarity).select("a", "b"))


def stars(nodes: DataFrame, max_bits: int, count: int) -> DataFrame:
    """(a, b), a < b: every node of (node, fps) with the least node that has one of its segments in the same place, if
    one of their fingerprints differs in at most max_bits bits. No more rows than a node has segments."""
    keys = []
    for k in range(count):
        for n, (first, bits) in enumerate(segments_for(max_bits)):
            segment = F.shiftrightunsigned(F.get("fps", F.lit(k)).bitwiseAND(F.lit(_mask(first, bits)).cast("long")), first)
            keys.append(segment.bitwiseOR(F.lit((k * BITS + n) << 32).cast("long")))
    held = nodes.select("node", "fps", F.explode(F.array(*keys)).alias("key"))
    least = held.groupBy("key").agg(F.min(F.struct("node", "fps")).alias("least"))
    near = F.exists(F.zip_with("fps", "least.fps", lambda x, y: F.bit_count(x.bitwiseXOR(y)) <= max_bits), lambda t: t)
    return held.join(least, "key").where((F.col("node") > F.col("least.node")) & near).select(F.col("least.node").alias("a"), F.col("node").alias("b")).distinct()


def apart(nodes: DataFrame, found: DataFrame, max_bits: int, min_similarity: float | None = None) -> DataFrame:
    """(a, b), a < b: all pairs of nodes with a fingerprint that differs in at most max_bits bits, but for those of one
    component in found (node, component).

    With min_similarity, pairs that meet at a hot signature are left out if their sketches prove them less similar. Of
    two sets of x and y shingles that are similar enough, at most (x + y)(1 - s) / (1 + s) shingles are in one only.
    The sketches go along with hot signatures alone, as they are larger than all else in the index.
    """
    own = found.select(F.col("node").alias("_node"), "component")
    placed = nodes.join(own, F.col("node") == F.col("_node"), "left").select("node", F.coalesce("component", "node").alias("component"), F.posexplode("fps").alias("tag", "fp"))
    placed = checkpointed(placed)
    index = placed.select("node", "component", "fp", F.explode(_variants(F.col("fp"), max_bits, F.col("tag"))).alias("signature"))

    ordered = (F.col("a.node") < F.col("b.node")) & (F.col("a.component") != F.col("b.component"))

    def met(index: DataFrame, *bounds: Column) -> DataFrame:
        return _meeting(index, ordered, max_bits, *bounds).select(F.col("a.node").alias("a"), F.col("b.node").alias("b"))

    if min_similarity is None:
        return met(index).distinct()
    by_chance = nodes.count() / 2 ** (BITS // len(segments_for(max_bits)) - 1)
    hot = index.groupBy("signature").agg(F.count(F.lit(1)).alias("texts")).where(F.col("texts") > max(HOT_TEXTS, 8 * by_chance))
    hot = small_side(hot.select("signature"))
    sketches = nodes.select(F.col("node").alias("_node"), "size", "sketch")
    warm = index.join(hot, "signature", "left_semi").join(sketches, F.col("node") == F.col("_node")).drop("_node")
    differ = sum(F.bit_count(F.get("a.sketch", F.lit(k)).bitwiseXOR(F.get("b.sketch", F.lit(k)))) for k in range(SKETCH))
    most = (F.col("a.size") + F.col("b.size")) * F.lit((1 - min_similarity) / (1 + min_similarity) + 1e-9)
    return met(index.join(hot, "signature", "left_anti")).union(met(warm, differ <= most)).distinct()


def similar_components(docs: DataFrame, nodes: DataFrame, max_bits: int, count: int, min_similarity: float) -> DataFrame:
    """(node, component) of the nodes that are linked: near by a fingerprint, and similar by shingles."""
    close = similar(checkpointed(stars(nodes, max_bits, count)), docs, nodes, min_similarity)
    found = components(close)
    rest = similar(checkpointed(apart(nodes, found, max_bits, min_similarity)), docs, nodes, min_similarity)
    return components(close.union(rest))


def with_components(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fp, component_id for every row of docs."""
    fp = F.get(fingerprints(F.col("text"), shingle), F.lit(0))
    rows = checkpointed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), fp.alias("fp")))
    groups = checkpointed(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("size")))
    # components over fingerprints, then the least id among all fingerprints of a component
    linked = components(links(groups.select("fp"), max_bits)).join(groups, F.col("node") == F.col("fp")).select("fp", "component", "least")
    names = linked.groupBy("component").agg(F.min("least").alias("name"))
    named = linked.join(names, "component").select(F.col("fp").alias("_fp"), F.col("name"))
    every = checkpointed(groups.join(named, F.col("fp") == F.col("_fp"), "left").select(F.col("fp").alias("_fp"), "size", F.coalesce("name", "least").alias("component_id")))
    # rows of hot fingerprints, of which there are at most HOT_SHARE, stay where they are; the others meet by shuffle
    hot = F.col("size") > max(1, groups.agg(F.sum("size")).first()[0] or 0) / HOT_SHARE
    of_hot = F.broadcast(every.where(hot).select(F.col("_fp").alias("_hot"), F.col("component_id").alias("_hot_id")))
    met = rows.join(of_hot, F.col("fp") == F.col("_hot"), "left")
    cold = met.where(F.col("_hot").isNull()).select("doc_id", "fp").join(every.where(~hot), F.col("fp") == F.col("_fp"))
    return met.where(F.col("_hot").isNotNull()).select("doc_id", "fp", F.col("_hot_id").alias("component_id")).union(cold.select("doc_id", "fp", "component_id"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the least doc_id reachable over links)."""
    found = with_components(docs, shingle, max_bits)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, min_similarity: float | None = None, distinct: bool = False, count: int = 1) -> DataFrame:
    """One row of docs for every component: the one with the least doc_id, and of several with it that of the least digest.

    Without min_similarity, nodes are fingerprints and links are near fingerprints. With it, nodes are texts, told apart
    by a 128-bit digest, and links are texts near by one of count fingerprints whose five-word shingles are so similar.
    Rows without an id come last. The survivor is chosen within its component and found again by ROW_KEY, so that texts
    without an id, or different texts with one id, don't stand for each other.
    """
    text = text_or_empty(F.col("text").cast("string"))
    key = [c.alias(k) for k, c in row_key(docs).items()]
    if min_similarity is not None:
        rows = docs.select(sketched(text, shingle, distinct, count).alias("_made"), F.unhex(F.md5(text)).alias("digest"), *key).select("_made.*", "digest", *ROW_KEY)
        grouped = rows.groupBy("digest").agg(F.min(F.struct(*ROW_KEY)).alias("first"), *[F.first(c).alias(c) for c in ("fps", "size", "sketch")])
    else:
        grouped = docs.select(fingerprints(text, shingle, distinct, count).alias("fps"), *key).groupBy("fps").agg(F.min(F.struct(*ROW_KEY)).alias("first"))
    nodes = checkpointed(grouped.withColumn("node", F.monotonically_increasing_id()))
    if min_similarity is not None:
        found = similar_components(docs, nodes, max_bits, count, min_similarity)
    else:
        found = components(apart(nodes, nodes.select("node", F.col("node").alias("component")), max_bits))
    named = nodes.join(found.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left")
    firsts = named.groupBy(F.coalesce("component", "node").alias("_component")).agg(F.min("first").alias("first")).select("first.*")
    # one key for the join and the window, so that texts are moved once
    kept = carried(docs, **row_key(docs)).join(firsts, ROW_KEY, "left_semi")
    # equal rows share the key: a group of them leaves one row
    again = Window.partitionBy(*ROW_KEY).orderBy("_key_1")
    return kept.withColumn("_again", F.row_number().over(again)).where(F.col("_again") == 1).select("_row.*")
