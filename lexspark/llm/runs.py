"""Periodic runs: stretches of words that repeat with a period, found whole, and collapsed to one period.

A run is a stretch with a smallest period q, at least `LEAST_COPIES` x q and `LEAST_WORDS` words long, that no neighbouring
word extends with that period. Every run holds a word sequence of its period's length that is the longest Lyndon sequence
from its first word on, under one order of the words or under the reverse of it. So both orders are scanned from right to
left with a stack of Lyndon sequences (`next_smaller`), which gives one candidate a word and order, and a candidate is
extended to both sides as far as the period holds. How far two stretches agree is found by binary search over rolling
hashes and then verified word by word, so that results don't rest on the hashes; what was verified at one distance is
not compared again. No suffix array is built.

Texts are read whole, each in one row; words are numbered within their text.

Defined cases: a null or empty text has no words and no runs; very long texts are scanned in about linear time, whatever
they repeat; of runs of equal length the first is the greatest, then that of the smallest period; repeated rows have equal
results; an empty table gives no rows; a null doc_id is kept; other columns, of whatever names, are ignored by
`find_runs` and carried along by `collapse`.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.llm.common import carried

LEAST_WORDS, LEAST_COPIES = 6, 4
#: so many words are compared one by one before hashes are asked
DIRECT = 8
WRAP = (1 << 64) - 1
BASE = 0x9E37_79B9_7F4A_7C15

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


class Sequence:
    """A sequence of numbers, and how far two of its stretches agree."""

    def __init__(self, codes: list[int]):
        self.codes, self.n = codes, len(codes)
        self.array = np.array(codes, np.int64)
        self.sums: list[int] = []

    def _hashed(self) -> None:
        mixed = (self.array.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8_FEB8_6659_FD93)
        mixed ^= mixed >> np.uint64(32)
        powers = np.full(self.n + 1, BASE, np.uint64)
        powers[0] = 1
        powers = np.multiply.accumulate(powers)
        self.sums = [0, *np.add.accumulate(mixed * powers[:-1]).tolist()]
        self.powers = powers.tolist()

    def _alike(self, i: int, j: int, length: int) -> bool:
        sums = self.sums
        return ((sums[i + length] - sums[i]) * self.powers[j - i] - sums[j + length] + sums[j]) & WRAP == 0

    def _search(self, most: int, alike) -> int:
        """The largest length up to most for which alike holds, if it holds for all below: steps double, then halve."""
        least, step = 0, 2 * DIRECT
        while least + step <= most and alike(least + step):
            least += step
            step *= 2
        above = min(least + step, most + 1)
        while above - least > 1:
            middle = (least + above) // 2
            if alike(middle):
                least = middle
            else:
                above = middle
        return least

    def ahead(self, i: int, j: int, most: int) -> int:
        """How many words from i on equal those from j on (i < j), at most so many."""
        codes, k, direct = self.codes, 0, min(DIRECT, most)
        while k < direct:
            if codes[i + k] != codes[j + k]:
                return k
            k += 1
        if k == most:
            return k
        if not self.sums:
            self._hashed()
        length = self._search(most, lambda x: self._alike(i, j, x))
        differs = self.array[i : i + length] != self.array[j : j + length]
        return int(differs.argmax()) if differs.any() else length

    def behind(self, i: int, j: int, most: int) -> int:
        """How many words before i equal those before j (i < j), at most so many."""
        codes, k, direct = self.codes, 0, min(DIRECT, most)
        while k < direct:
            if codes[i - 1 - k] != codes[j - 1 - k]:
                return k
            k += 1
        if k == most:
            return k
        if not self.sums:
            self._hashed()
        length = self._search(most, lambda x: self._alike(i - x, j - x, x))
        differs = (self.array[i - length : i] != self.array[j - length : j])[::-1]
        return int(differs.argmax()) if differs.any() else length


def next_smaller(seq: Sequence, reverse: bool = False) -> list[int]:
    """For each place the next one whose suffix is smaller, where the longest Lyndon sequence from the place on ends; a
    suffix is larger than its own beginnings under both orders.

    The places that following the entries from i + 1 on visits are the stack of Lyndon sequences to the right of i.
    """
    codes, n = seq.codes, seq.n
    ends = [n] * n
    verified: dict[int, tuple[int, int]] = {}  # by distance: the last place compared at it, and how far it agreed
    for i in range(n - 2, -1, -1):
        own, j = codes[i], i + 1
        while j < n:
            other = codes[j]
            if own == other:
                distance = j - i
                known = verified.get(distance)
                if known is None:
                    length = seq.ahead(i, j, n - j)
                else:
                    length = seq.ahead(i, j, known[0] - i)
                    if length == known[0] - i:
                        length += known[1]
                verified[distance] = (i, length)
                if j + length == n or (codes[i + length] > codes[j + length]) != reverse:
                    break
            elif (own > other) != reverse:
                break
            j = ends[j]
        ends[i] = j
    return ends


def runs_of(codes: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start and period."""
    n = len(codes)
    if n < LEAST_WORDS:
        return []
    seq, found, places = Sequence(codes), set(), np.arange(n)
    for reverse in (False, True):
        periods = np.array(next_smaller(seq, reverse)) - places
        # the first Lyndon sequence of a run is followed by two more at least
        starts = places[places + (LEAST_COPIES - 1) * periods <= n]
        for _ in range(LEAST_COPIES - 2):
            starts = starts[seq.array[starts] == seq.array[starts + periods[starts]]]
        starts = starts[seq.array[starts] == seq.array[starts + 2 * periods[starts]]]
        reached: dict[int, int] = {}
        for i, q in zip(starts.tolist(), periods[starts].tolist(), strict=True):
            if i + q <= reached.get(q, 0):
                continue  # within the last run of this period
            end = i + q + seq.ahead(i, i + q, n - i - q)
            start = i - seq.behind(i, i + q, i)
            if end - start >= max(LEAST_WORDS, LEAST_COPIES * q):
                found.add((start, end - start, q))
                reached[q] = end
    return sorted(found, key=lambda r: (r[0], r[2]))


def kept_of(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay: those that no run holds after its first period."""
    covered = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        covered[start + period] += 1
        covered[start + length] -= 1
    return np.cumsum(covered)[:n] == 0


def numbered(words: list[bytes]) -> list[int]:
    known: dict[bytes, int] = {}
    return [known.setdefault(w, len(known)) for w in words]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    if not runs:
        return b" ".join(words)
    return b" ".join([words[i] for i in np.nonzero(kept_of(len(words), runs))[0].tolist()])


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words, of which one document in ten repeats a stretch from some word on, as its id decides."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n or doc_id is None:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def _words(column: pa.Array) -> Iterator[list[bytes]]:
    """Words by ASCII white space, which is where bytes are split."""
    for text in pc.fill_null(column.cast(pa.binary()), b""):
        yield text.as_py().split()


def find_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words and runs (start, length, period; in words) of every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, runs = [], []
            for words in _words(batch.column(1)):
                counts.append(len(words))
                runs.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in runs_of(numbered(words))])
            kind = pa.list_(pa.struct([(k, pa.int64()) for k in ("start", "length", "period")]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(runs, kind)], ["doc_id", "n_words", "runs"])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return chosen.mapInArrow(run, f"doc_id long, n_words long, runs {RUNS}")


def _collapsed_text(text: str | None) -> str | None:
    words = (text or "").encode().split()
    runs = runs_of(numbered(words))
    return collapsed(words, runs).decode() if runs else text


def collapse(docs: DataFrame) -> DataFrame:
    """The rows of docs; a text with runs keeps one period of each, its words then parted by single spaces."""
    shortened = F.udf(_collapsed_text, "string", useArrow=True)
    rows = carried(docs, _text=shortened(F.col("text")))
    return rows.select(F.col("_row").withField("text", F.col("_text")).alias("_row")).select("_row.*")


def report(docs: DataFrame) -> DataFrame:
    """Per row of docs, after stretches are planted: the number of runs, the longest one, and digests of all runs and of
    the words that stay."""
    names = ["n_runs", "start", "length", "period", "exponent_milli"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            figures, runs_digests, kept_digests = [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), _words(batch.column(1)), strict=True):
                words = planted(text, doc_id)
                runs = runs_of(numbered(words))
                start, length, period = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
                figures.append((len(runs), start, length, period, 1000 * length // period if runs else None))
                runs_digests.append(hashlib.sha256("".join("%d,%d,%d\n" % r for r in runs).encode()).hexdigest())
                kept_digests.append(hashlib.sha256(collapsed(words, runs)).hexdigest())
            columns = [pa.array([f[k] for f in figures], pa.int64()) for k in range(len(names))]
            digests = [pa.array(runs_digests, pa.string()), pa.array(kept_digests, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, *digests], ["doc_id", *names, "runs_sha256", "collapsed_sha256"])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return chosen.mapInArrow(run, f"doc_id long, {', '.join(f'{n} long' for n in names)}, runs_sha256 string, collapsed_sha256 string")
