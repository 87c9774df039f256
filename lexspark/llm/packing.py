"""Best-fit-decreasing packing of tokenised documents into fixed-length sequences.

Tokenising and packing happen in one narrow pass: each task cuts its documents into pieces, gathers a bounded block of
pieces, places them longest first into the tightest open window, and emits the placements. Nothing is shuffled, and a
lost task is simply run again. With thousands of pieces a block, the windows left open at its end are a small part.

Defined cases: a null or empty text is one piece holding only the end id; very long texts are encoded whole, in one task,
and cut into full windows; pieces of one length keep their order, and of equally tight windows the one that came to be so
last is taken; repeated rows are packed as often as they occur; an empty table gives no rows; a null doc_id is kept; other columns of the input are ignored.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 1024
BLOCK_PIECES = 16_384
SLICE_BYTES = 4 << 20
END_ID = 0
#: Fixed value: the vocabulary's special strings; what they cover is cut out of a text before anything else.
SPECIALS = {"<|endoftext|>": 50256}

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
PIECES_WITH_IDS = PIECES + ", ids array<int>"


class WindowTree:
    """Open windows by remaining capacity, under a segment tree that finds the smallest capacity that still fits."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.filled = [False] * (2 * self.leaves)

    def _mark(self, node: int, value: bool) -> None:
        filled = self.filled
        filled[node] = value
        while node > 1:
            node >>= 1
            now = filled[2 * node] or filled[2 * node + 1]
            if filled[node] == now:
                break
            filled[node] = now

    def put(self, window: int, remaining: int) -> None:
        if remaining <= 0:
            return
        self.open[remaining].append(window)
        if len(self.open[remaining]) == 1:
            self._mark(self.leaves + remaining, True)

    def take(self, length: int) -> tuple[int, int] | None:
        """The (window, remaining) with the least remaining capacity of at least `length`, taken out; None if none fits."""
        filled, node = self.filled, self.leaves + length
        while not filled[node]:
            while node & 1:  # a right child: its subtree's successor lies above
                node >>= 1
            if not node:
                return None
            node += 1
        while node < self.leaves:
            node = 2 * node if filled[2 * node] else 2 * node + 1
        remaining = node - self.leaves
        window = self.open[remaining].pop()
        if not self.open[remaining]:
            self._mark(node, False)
        return window, remaining


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """For each piece its window and its offset there, and the number of windows."""
    window, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree, count = WindowTree(capacity), 0
    values = lengths.tolist()
    for i in np.argsort(-lengths, kind="stable").tolist():
        length = values[i]
        found = tree.take(length)
        if found is None:
            found = (count, capacity)
            count += 1
        window[i], offset[i] = found[0], capacity - found[1]
        tree.put(found[0], found[1] - length)
    return window, offset, count


BLANK = r"\s\x85\x1c-\x1f\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


class TextEncoder:
    """Ids of texts under the byte-level vocabulary, each different word of a slice encoded once.

    A single space after a non-space always starts a new token of this vocabulary's splitting pattern, so the words of
    a text can be encoded apart. Texts in which a space follows other white space, or which hold a special string, are
    encoded whole: a special string is one id, and what lies before and after it is encoded apart.
    """

    def __init__(self, ranks_path: str, pattern: str, specials: dict[str, int]):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens=specials)
        self.encode = encoding.encode_ordinary
        self.encode_whole = lambda text: encoding.encode(text, allowed_special="all")
        self.unsafe = "|".join([f"[{BLANK}] ", *("\\Q" + x + "\\E" for x in specials)])
        self.token_bytes = np.zeros(max(ranks.values()) + 1, np.int64)
        self.token_bytes[list(ranks.values())] = [len(t) for t in ranks]

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, each after a space, one after another, and how many each has.

        The words are encoded as one text, and the tokens dealt out by their bytes. A word that is empty or ends in white
        space would run into the next one, and is encoded alone.
        """
        alone = np.asarray(pc.or_(pc.equal(words, ""), pc.not_equal(pc.utf8_rtrim_whitespace(words), words)))
        together = words.filter(pa.array(~alone))
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(together)], pa.int32()), together), " ")[0].as_py()
        ids = np.array(self.encode(" " + joined) if len(together) else [], np.uint32)
        ends = np.cumsum(np.asarray(pc.binary_length(together), np.int64) + 1)
        token_ends = np.cumsum(self.token_bytes[ids])
        last = np.searchsorted(token_ends, ends)
        if len(ends) and not np.array_equal(token_ends[last], ends):
            raise ValueError("a token runs over the end of a word")
        sizes = np.zeros(len(words), np.int64)
        sizes[~alone] = np.diff(last + 1, prepend=0)
        if not alone.any():
            return ids, sizes
        parts = np.split(ids, last[:-1] + 1) if len(together) else []
        given, own = iter(parts), []
        for i, single in enumerate(alone.tolist()):
            own.append(np.array(self.encode(" " + words[i].as_py()), np.uint32) if single else next(given))
            sizes[i] = len(own[-1])
        return np.concatenate(own), sizes

    def encode_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and each text's first position (with the end as a last entry)."""
        unsafe = np.asarray(pc.match_substring_regex(texts, self.unsafe))
        heads: list[list[int]] = [[]] * len(texts)
        for i in np.nonzero(unsafe)[0].tolist():
            heads[i] = self.encode_whole(texts[i].as_py())
        split = pc.split_pattern(pc.if_else(pa.array(unsafe), "", texts), " ")
        starts = np.asarray(split.offsets, np.int64)[:-1]
        words = split.flatten()
        for i in np.nonzero(~unsafe)[0].tolist():  # a text's first word has no space before it
            heads[i] = self.encode(words[int(starts[i])].as_py())
        is_head = np.zeros(len(words), bool)
        is_head[starts] = True
        coded = words.filter(pa.array(~is_head)).dictionary_encode()
        word_ids, word_sizes = self.words(coded.dictionary)
        codes = np.empty(len(words), np.int64)
        codes[~is_head] = np.asarray(coded.indices, np.int64)
        codes[starts] = len(word_sizes) + np.arange(len(starts))
        flat = np.concatenate([word_ids, np.array([x for ids in heads for x in ids], np.uint32)])
        sizes = np.concatenate([word_sizes, np.array([len(ids) for ids in heads], np.int64)])
        begins = np.cumsum(sizes) - sizes
        lengths = sizes[codes]
        ends = np.cumsum(lengths)
        ids = flat[np.repeat(begins[codes] - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)]
        firsts = (ends - lengths)[starts]
        return ids, np.append(firsts, len(ids))


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of at most SLICE_BYTES of text, or of one row."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(1)), 0), np.int64)
    begin, total = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > begin and total + size > SLICE_BYTES:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += size
    if begin < batch.num_rows:
        yield batch.slice(begin)


def pack(
    docs: DataFrame,
    ranks_path: str | None = None,
    capacity: int = CAPACITY,
    block_pieces: int = BLOCK_PIECES,
    with_ids: bool = False,
    specials: dict[str, int] | None = None,
) -> DataFrame:
    """One row per piece of a document, with its sequence and its place there; with_ids adds the ids themselves.

    ranks_path names the vocabulary's rank file (default: the installed public byte-level one of 50,257 ids); it must
    exist on every executor, and specials its special strings. sequence_id counts from the task's number times 2**32.
    """
    import public_tokenizers

    path, pattern = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN

    def placed(block: list[tuple], done: int) -> tuple[pa.RecordBatch, int]:
        doc_id, start, length, crc, total, ids = zip(*block, strict=True)
        lengths = np.array(length, np.int64)
        window, offset, count = best_fit_decreasing(lengths, capacity)
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        columns = [pa.array(x, pa.int64()) for x in (doc_id, start, lengths, crc, total, window + done, offset)]
        if with_ids:
            names, columns = [*names, "ids"], [*columns, pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))]
        return pa.RecordBatch.from_arrays(columns, names), done + count

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.default_memory_pool().release_unused()  # what earlier tasks of this worker have left free
        encoder = TextEncoder(path, pattern, SPECIALS if specials is None else specials)
        done = TaskContext.get().partitionId() << 32
        block: list[tuple] = []
        for batch in batches:
            for part in _slices(batch):
                ids, firsts = encoder.encode_texts(pc.fill_null(part.column(1), "").cast(pa.string()))
                for k, doc_id in enumerate(part.column(0).to_pylist()):
                    own = np.append(ids[firsts[k] : firsts[k + 1]], np.uint32(END_ID)).astype("<u4")
                    for s in range(0, len(own), capacity):
                        piece = own[s : s + capacity]
                        block.append((doc_id, s, len(piece), zlib.crc32(piece.tobytes()), len(own), piece if with_ids else None))
                    if len(block) >= block_pieces:
                        rows, done = placed(block, done)
                        block = []
                        yield rows
        if block:
            yield placed(block, done)[0]

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(run, PIECES_WITH_IDS if with_ids else PIECES)


def sequences(pieces: DataFrame, capacity: int = CAPACITY, pad_id: int = END_ID) -> DataFrame:
    """Sequences with the ids and documents in them, from pack(..., with_ids=True); padded to the capacity, but for
    those whose length is a power of two."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "length", "ids")))
    whole = pieces.groupBy("sequence_id").agg(parts.alias("parts"))
    ids = F.flatten(F.col("parts.ids"))
    missing = F.when(F.bit_count(F.size(ids)) == 1, 0).otherwise(F.greatest(F.lit(0), F.lit(capacity) - F.size(ids)))
    padded = F.concat(ids, F.array_repeat(F.lit(pad_id), missing))
    return whole.select("sequence_id", padded.alias("input_ids"), F.col("parts.doc_id").alias("doc_ids"), F.col("parts.length").alias("lengths"))
