"""Byte-level BPE: encoding by a transducer compiled from the merges, and decoding token by token.

Merging bytes by rank and merging left to right are the same in this sense: a sequence of tokens is what the merges make
of its bytes just if they make each neighbouring pair of its tokens of that pair's bytes. So every beginning of a word
has one last token, and the tokens of a word can be read off from left to right by a nondeterministic transducer over
the trie of all tokens: a reading stands at a node of the trie, after the tokens it has taken, and may take the token it
stands at if that token can follow the last one. `Transducer` makes it deterministic as words ask for it: a state is the
set of the readings that are still possible, each with the tokens that not all of them share; what all share is emitted.
Readings part for no longer than the longest token, which bounds the lookahead. A transition is made when it is asked for
the second time; a word that asks for one the first time is read by the nondeterministic transducer itself. States and
transitions are kept up to `MAX_STATES`; then the table is emptied and grows anew, so memory is bounded. Results are the
same either way.

`Decoder` takes ids as they come. Its state is the beginning of a character that the last token left open, and what a
token adds in a state is worked out once. Bytes that are no UTF-8 become U+FFFD, one for each longest valid beginning.

Texts are cut into words by the vocabulary's pattern, and words met before are looked up in a bounded cache.

Defined cases: a null or empty text has no tokens; very long texts are read in parts of about `PART_CHARS` characters,
cut where white space follows something else, which is always an edge between words; a text without such an edge is one
part; equal texts and repeated rows are encoded alike; strings of special tokens are ordinary text; an empty table gives
no rows; other columns, of whatever names, are ignored.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from struct import pack

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_STATES = 400_000
MAX_WORDS = 500_000
PART_CHARS = 1 << 20


def merged(ranks: dict[bytes, int], piece: bytes) -> list[bytes]:
    """The tokens of a short piece, by merging the neighbours of least rank again and again, the leftmost first."""
    none, parts = float("inf"), [piece[i : i + 1] for i in range(len(piece))]
    costs = [ranks.get(piece[i : i + 2], none) for i in range(len(piece) - 1)]
    while costs and (least := min(costs)) < none:
        at = costs.index(least)
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
        del costs[at]
        if at:
            costs[at - 1] = ranks.get(parts[at - 1] + parts[at], none)
        if at < len(costs):
            costs[at] = ranks.get(parts[at] + parts[at + 1], none)
    return parts


class Transducer:
    """From the bytes of a word to its ids. A reading is (node of the trie, the tokens taken that not all readings share,
    after the last one that they do share, or -1 at the beginning)."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = MAX_STATES):
        self.ranks, self.max_states = ranks, max_states
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        #: tokens that no merges make; they stand only for a word that they equal
        self.unmade = {token for token in ranks if merged(ranks, token) != [token]}
        self.children: list[dict[int, int]] = [{}]
        self.token_at = [-1]
        for token, rank in ranks.items():
            if token not in self.unmade:
                node = 0
                for byte in token:
                    below = self.children[node].get(byte)
                    if below is None:
                        below = self.children[node][byte] = len(self.children)
                        self.children.append({})
                        self.token_at.append(-1)
                    node = below
                self.token_at[node] = rank
        self._empty()

    def _empty(self) -> None:
        self.numbers: dict[bytes, int] = {}
        #: each state's readings, as packed numbers: node, how many tokens, the tokens
        self.readings: list[bytes] = []
        #: the number of what is emitted when a word ends in the state
        self.ends = array("i")
        #: state * 256 + byte: the next state, and in the lower bits the number of what is emitted on the way
        self.moves: dict[int, int] = {}
        #: those asked for once
        self.asked: set[int] = set()
        self.emitted: dict[tuple[int, ...], int] = {(): 0}
        self.emissions: list[tuple[int, ...]] = [()]
        self.pairs: dict[int, bool] = {}
        self._number([(0, (-1,))], 1)

    def _number(self, readings: list[tuple[int, tuple[int, ...]]], shared: int) -> int:
        packed = array("i")
        for node, tokens in readings:
            packed.append(node)
            packed.append(len(tokens) - shared + 1)
            packed.extend(tokens[shared - 1 :])
        key = packed.tobytes()
        number = self.numbers.setdefault(key, len(self.readings))
        if number == len(self.readings):
            self.readings.append(key)
            self.ends.append(self._emission(readings[-1][1][shared:]))  # of the reading that has just taken a token
        return number

    def _emission(self, tokens: tuple[int, ...]) -> int:
        number = self.emitted.setdefault(tokens, len(self.emissions))
        if number == len(self.emissions):
            self.emissions.append(tokens)
        return number

    def _readings(self, state: int) -> list[tuple[int, tuple[int, ...]]]:
        packed = array("i", self.readings[state])
        found, at = [], 0
        while at < len(packed):
            end = at + 2 + packed[at + 1]
            found.append((packed[at], tuple(packed[at + 2 : end])))
            at = end
        return found

    def follows(self, before: int, token: int) -> bool:
        """Whether the merges leave these two tokens apart when one follows the other."""
        key = before << 32 | token
        known = self.pairs.get(key)
        if known is None:
            a, b = self.bytes_of[before], self.bytes_of[token]
            known = self.pairs[key] = a + b not in self.ranks and merged(self.ranks, a + b) == [a, b]
        return known

    def _move(self, state: int, byte: int) -> int:
        after, taken = [], None
        for node, tokens in self._readings(state):
            below = self.children[node].get(byte)
            if below is None:
                continue
            if taken is None and (token := self.token_at[below]) >= 0 and (tokens[-1] < 0 or self.follows(tokens[-1], token)):
                taken = (0, (*tokens, token))
            if self.children[below]:
                after.append((below, tokens))
        if taken is None:
            raise ValueError(f"the vocabulary has no token for byte {byte}")
        after.append(taken)
        first = after[0][1]
        shared = len(first)
        for _, tokens in after[1:]:
            while first[:shared] != tokens[:shared]:
                shared -= 1
        move = self.moves[state << 8 | byte] = self._number(after, shared) << 32 | self._emission(first[1:shared])
        return move

    def _read(self, word: bytes) -> list[int]:
        """By the nondeterministic transducer: each beginning's last token is the longest that ends there and can follow."""
        children, token_at, known, size = self.children, self.token_at, self.pairs.get, len(word)
        last = [-1] * (size + 1)
        for begin in range(size):
            before, node, end = last[begin] << 32, 0, begin
            while end < size:
                node = children[node].get(word[end])
                if node is None:
                    break
                end += 1
                token = token_at[node]
                if token >= 0 and last[end] < 0:
                    fits = not begin or known(before | token)
                    if fits or fits is None and self.follows(before >> 32, token):
                        last[end] = token
            if last[begin + 1] < 0:
                raise ValueError(f"the vocabulary has no token for byte {word[begin]}")
        out, end = [], size
        while end:
            out.append(last[end])
            end -= len(self.bytes_of[last[end]])
        return out[::-1]

    def encode(self, word: bytes) -> list[int]:
        if word in self.unmade:
            return [self.ranks[word]]
        if len(self.readings) > self.max_states or len(self.asked) > 4 * self.max_states or len(self.pairs) > 4 * self.max_states:
            self._empty()
        state, out, moves = 0, [], self.moves
        for byte in word:
            key = state << 8 | byte
            move = moves.get(key)
            if move is None:
                if key not in self.asked:
                    self.asked.add(key)
                    return self._read(word)
                self.asked.discard(key)
                move = self._move(state, byte)
            state = move >> 32
            if move & 0xFFFFFFFF:
                out += self.emissions[move & 0xFFFFFFFF]
        out += self.emissions[self.ends[state]]
        return out


#: For the first byte of a character, how many more follow, and the bounds of the second byte.
FOLLOWING = {b: 1 for b in range(0xC2, 0xE0)} | {b: 2 for b in range(0xE0, 0xF0)} | {b: 3 for b in range(0xF0, 0xF5)}
SECOND = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}


def advance(pending: bytes, data: bytes) -> tuple[str, bytes]:
    """The text that data completes after the beginning of a character, and the beginning it leaves open itself."""
    out = []
    for byte in data:
        if pending:
            least, most = SECOND.get(pending[0], (0x80, 0xBF)) if len(pending) == 1 else (0x80, 0xBF)
            if least <= byte <= most:
                pending += bytes([byte])
                if len(pending) > FOLLOWING[pending[0]]:
                    out.append(pending.decode())
                    pending = b""
                continue
            out.append("�")
            pending = b""
        if byte < 0x80:
            out.append(chr(byte))
        elif byte in FOLLOWING:
            pending = bytes([byte])
        else:
            out.append("�")
    return "".join(out), pending


class _Row(dict):
    """What each token adds after a beginning, and the row of what it leaves open; filled as tokens come."""

    def __init__(self, rows: dict[bytes, _Row], bytes_of: dict[int, bytes], pending: bytes):
        self.rows, self.bytes_of, self.pending = rows, bytes_of, pending
        #: of those tokens that leave nothing open after nothing was
        self.whole: dict[int, str] = {}

    def __missing__(self, token: int) -> tuple[str, _Row]:
        text, pending = advance(self.pending, self.bytes_of[token])
        if not (self.pending or pending):
            self.whole[token] = text
        row = self.rows.get(pending)
        if row is None:
            row = self.rows[pending] = _Row(self.rows, self.bytes_of, pending)
        self[token] = (text, row)
        return self[token]


class Decoder:
    """Text of ids as they come: feed returns what is complete, finish what is left."""

    def __init__(self, bytes_of: dict[int, bytes], rows: dict[bytes, _Row] | None = None):
        rows = {} if rows is None else rows
        self.row = rows.get(b"") or rows.setdefault(b"", _Row(rows, bytes_of, b""))

    def feed(self, ids: Iterable[int]) -> str:
        row, parts = self.row, []
        if not row.pending:
            try:  # most stretches hold whole characters only
                return "".join(map(row.whole.__getitem__, ids))
            except KeyError:
                pass
        for token in ids:
            text, row = row[token]
            parts.append(text)
        self.row = row
        return "".join(parts)

    def finish(self) -> str:
        left, self.row = self.row.pending, self.row.rows[b""]
        return "�" if left else ""


class _Kept(dict):
    """Values of a function by its argument; of those not asked for lately, the oldest go."""

    def __init__(self, function: Callable):
        self.function = function
        self.before: dict = {}

    def __missing__(self, key):
        value = self.before.get(key)
        if value is None:
            value = self.function(key)
        self[key] = value
        return value

    def bound(self, most: int) -> None:
        if len(self) > most:
            self.before = dict(self)
            self.clear()


class Codec:
    """Encodes and decodes texts by a rank file and the pattern that cuts texts into words."""

    def __init__(self, ranks_path: str, pattern: str):
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.transducer = Transducer(ranks)
        #: ids as little-endian unsigned 32-bit integers, of a word of the pattern, and of a space and what follows it
        encode = self.transducer.encode
        self.words = _Kept(lambda word: pack(f"<{len(ids := encode(word.encode()))}I", *ids))
        self.spaced = _Kept(lambda text: self.packed(" " + text))
        self.rows: dict[bytes, _Row] = {}
        self.find = regex.compile(pattern).findall
        self.blank_then_space = regex.compile(r"[\s\x1c-\x1f\x85] ").search
        self.edge = regex.compile(r"\S(?=\s)").search

    def packed(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, self.find(text)))

    def parts(self, text: str) -> Iterator[str]:
        begin = 0
        while begin < len(text):
            found = self.edge(text, begin + PART_CHARS) if len(text) - begin > 2 * PART_CHARS else None
            end = found.end() if found else len(text)
            yield text[begin:end]
            begin = end

    def encode(self, text: str) -> bytes:
        """All ids of the text, packed. A space after something that isn't blank begins a word, so that a text whose
        spaces are all such is cut at them, and what follows each is looked up."""
        out = []
        for part in self.parts(text):
            self.words.bound(MAX_WORDS // 2)
            self.spaced.bound(MAX_WORDS)
            if self.blank_then_space(part):
                out.append(self.packed(part))
            else:
                first, *others = part.split(" ")
                out.append(self.packed(first))
                out += map(self.spaced.__getitem__, others)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        if len(self.rows) > 10_000:
            self.rows.clear()
        decoder = Decoder(self.transducer.bytes_of, self.rows)
        return decoder.feed(np.frombuffer(ids, "<u4").tolist()) + decoder.finish()


@lru_cache(maxsize=2)
def codec(ranks_path: str, pattern: str) -> Codec:
    """One for each worker process, which keeps what it has worked out from task to task."""
    made = Codec(ranks_path, pattern)
    gc.freeze()  # the trie stays; the collector needn't walk it
    return made


def _public(ranks_path: str | None) -> tuple[str, str]:
    import public_tokenizers

    return ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def _texts(column: pa.Array) -> Iterator[str]:
    for text in pc.fill_null(column.cast(pa.binary()), b""):
        yield text.as_py().decode("utf-8", "replace")


def encode(docs: DataFrame, ranks_path: str | None = None) -> DataFrame:
    """doc_id and ids (array<int>) of every row of docs. ranks_path names a rank file that every executor has."""
    path, pattern = _public(ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            for k, text in enumerate(_texts(batch.column(1))):
                ids = pa.array([np.frombuffer(own.encode(text), "<u4").astype(np.int32)], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), ids], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ranks_path: str | None = None) -> DataFrame:
    """doc_id and text of every row of (doc_id, ids); null ids give an empty text."""
    path, pattern = _public(ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            for k, ids in enumerate(batch.column(1)):
                text = own.decode(np.array(ids.as_py() or [], "<u4").tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), pa.array([text])], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, ranks_path: str | None = None) -> DataFrame:
    """Per row of docs: doc_id, the number of its tokens, and the digests of the ids and of what they decode to. Texts are
    encoded and decoded in one narrow pass, so that ids don't leave the task."""
    path, pattern = _public(ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            counts, ids_digests, text_digests = [], [], []
            for text in _texts(batch.column(1)):
                ids = own.encode(text)
                counts.append(len(ids) // 4)
                ids_digests.append(hashlib.sha256(ids).hexdigest())
                text_digests.append(hashlib.sha256(own.decode(ids).encode()).hexdigest())
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_digests, pa.string()), pa.array(text_digests, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return chosen.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
