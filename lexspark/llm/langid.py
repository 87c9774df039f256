"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built from a bounded sample of labelled text. A text is parsed greedily into
the longest phrases that occur in the sample; the language whose parse needs the fewest phrases per character wins.

Texts are lower-cased, and every run of characters other than letters is one space. Every letter of the samples has a
code of its own, whatever the script; transitions are kept sparse. Texts are parsed whole: they are cut
into blocks that are parsed side by side, and the blocks' parses are then joined so that phrases run over block edges
just as if the text had been parsed from its start.

The sample's rows are passages: documents are cut into passages of `PASSAGE_CHARS` characters from beginning to end, and
about `SAMPLE_PASSAGES` passages of each language are drawn by a hash, wherever they stand.

Defined cases: a null text, or one without a letter, is `und` with score 0; without any labelled text every prediction
is `und`; ties go to the language first by code point; repeated rows are predicted alike; a null lang is never learned;
an empty table gives no rows; other columns, of whatever names, are ignored by `identify` and carried along by
`keep_identified`.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexspark.llm.common import carried, id_bucket

UNDETERMINED = "und"
HELD_OUT_OF, HELD_OUT = 4, 2
#: The bound of the learned sample: so many passages of a language, of so many characters each.
SAMPLE_PASSAGES, PASSAGE_CHARS = 200, 400
#: Characters parsed side by side; only speed depends on these.
BLOCK, EXTRA = 512, 48
SLICE_CHARS = 1 << 20


def normalise(text: str) -> np.ndarray:
    """Code points of the lower-cased text, each run of other characters than letters one space."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(points):
        return points
    distinct, at = np.unique(points, return_inverse=True) if points.max() > 0x2FFFF else (None, None)
    letter = _letters()[points] if distinct is None else np.array([chr(p).isalpha() for p in distinct])[at]
    out = np.where(letter, points, 32)
    gap = ~letter
    gap[1:] &= ~letter[:-1]
    out = out[letter | gap]
    return out if letter.any() else out[:0]


_TABLE: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _TABLE:
        _TABLE.append(np.array([chr(p).isalpha() for p in range(0x30000)]))
    return _TABLE[0]


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a sequence, by state; state 0 is the start."""
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for code in codes:
        new = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        at = last
        while at != -1 and code not in step[at]:
            step[at][code] = new
            at = link[at]
        if at != -1:
            target = step[at][code]
            if length[target] == length[at] + 1:
                link[new] = target
            else:
                clone = len(step)
                step.append(dict(step[target]))
                link.append(link[target])
                length.append(length[at] + 1)
                while at != -1 and step[at].get(code) == target:
                    step[at][code] = clone
                    at = link[at]
                link[target] = link[new] = clone
        last = new
    return step


class Transitions:
    """An automaton's transitions, laid over each other in one sparse row: those of a state lie at its base plus their
    codes, in places that no other state's take. Looked up many at a time."""

    def __init__(self, steps: list[dict[int, int]], alphabet: int):
        count = sum(map(len, steps))
        self.base = np.zeros(len(steps), np.int64)
        size = 2 * count + 4  # half full at most
        owner, target = np.full(size + alphabet, -1, np.int64), np.zeros(size + alphabet, np.int64)
        rng = np.random.default_rng(1)
        by_size: dict[int, list[int]] = {}
        for state, d in enumerate(steps):
            by_size.setdefault(len(d), []).append(state)
        for m in sorted(by_size, reverse=True):  # full states first, while there is room
            if not m:
                break
            states = np.array(by_size[m], np.int64)
            codes = np.array([list(steps[s]) for s in by_size[m]], np.int64)
            targets = np.array([list(steps[s].values()) for s in by_size[m]], np.int64)
            left = np.arange(len(states))
            while len(left):
                base = rng.integers(0, size, len(left))
                places = base[:, None] + codes[left]
                free = (owner[places] < 0).all(axis=1)
                tried, own = places[free], states[left[free], None]
                owner[tried] = own  # of several for one place, one gets it
                won = (owner[tried] == own).all(axis=1)
                lost = tried[~won]
                owner[lost[owner[lost] == own[~won]]] = -1
                target[tried[won]] = targets[left[free][won]]
                self.base[states[left[free][won]]] = base[free][won]
                done = np.zeros(len(left), bool)
                done[np.nonzero(free)[0][won]] = True
                left = left[~done]
        #: The owner in the high half, the state reached in the low half.
        self.row = np.where(owner < 0, np.int64(-1), (owner << 32) | target)
        #: The state after each code from the start; 0 where no phrase begins with it.
        self.first = np.array([steps[0].get(c, 0) for c in range(alphabet)], np.int64)
        self.views = tuple(map(memoryview, (self.row, self.base, self.first)))

    def follow(self, states: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether there is a transition, and the states reached."""
        found = self.row.take(self.base.take(states) + codes)
        return (found >> 32) == states, found & 0xFFFFFFFF


def _spans(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All positions of the spans [start, end)."""
    sizes = np.maximum(ends - starts, 0)
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


class CrossParser:
    """The automata of all languages, and the parse of many texts at once."""

    def __init__(self, samples: dict[str, str]):
        self.languages = sorted(samples)
        texts = [normalise(samples[x]) for x in self.languages]
        self.letters = np.unique(np.concatenate(texts)) if texts else np.zeros(0, np.uint32)  # coded from 1 on
        self.automata = [Transitions(suffix_automaton(self.encode(t).tolist()), len(self.letters) + 1) for t in texts]

    def encode(self, points: np.ndarray) -> np.ndarray:
        """Codes of characters; 0 for those in no sample, which are phrases of their own."""
        if not len(self.letters) or not len(points):
            return np.zeros(len(points), np.int64)
        at = np.minimum(np.searchsorted(self.letters, points), len(self.letters) - 1)
        return np.where(self.letters[at] == points, at + 1, 0)

    @staticmethod
    def _walk(table: Transitions, codes: np.ndarray, marks: np.ndarray, at: np.ndarray, ends: np.ndarray, steps: int):
        """Parses from each position of `at`, where a phrase begins, until one begins at or after its end, or at a mark.

        Sets marks where phrases begin and clears the others passed. Returns where each parse left its block, -1 if it
        met a mark (from there on it is the parse that is marked already); and the lanes, positions and states of
        parses that aren't through after so many steps.
        """
        left = np.full(len(at), -1, np.int64)
        lane, state, at = np.arange(len(at)), np.zeros(len(at), np.int64), at.copy()
        for _ in range(steps):
            if not len(lane):
                break
            code = codes.take(at)
            goes_on, then = table.follow(state, code)
            begins = ~goes_on | (state == 0)
            outside = at >= ends
            stop = begins & (outside | marks.take(at))
            if stop.any():
                out = stop & outside
                left[lane[out]] = at[out]
                go = ~stop
                lane, at, ends, code, then, begins, outside = (x[go] for x in (lane, at, ends, code, then, begins, outside))
            if outside.any():
                marks[at[~outside]] = begins[~outside]
            else:
                marks[at] = begins
            state = np.where(begins, table.first.take(code), then)
            at += 1
        return left, zip(lane.tolist(), at.tolist(), state.tolist(), strict=True)

    @staticmethod
    def _finish(table: Transitions, codes: memoryview, marks: memoryview, at: int, state: int, end: int) -> int:
        """One parse, carried on step by step; returns as _walk does."""
        row, base, first = table.views
        while True:
            code = codes[at]
            found = row[base[state] + code] if state else -1
            if found >> 32 == state:
                state = found & 0xFFFFFFFF
                if at < end:
                    marks[at] = False
            else:
                if at >= end:
                    return at
                if marks[at]:
                    return -1
                marks[at] = True
                state = first[code]
            at += 1

    def phrases(self, texts: list[np.ndarray], block: int = BLOCK, extra: int = EXTRA) -> np.ndarray:
        """[text, language]: the number of phrases of each coded text.

        Blocks are parsed side by side as if each began with a phrase. Then each is parsed anew from where the block
        before was left, until the two parses meet, which mostly takes few steps; the others are carried on one by one,
        from the first block on.
        """
        lengths = np.array([len(t) for t in texts], np.int64)
        first = np.cumsum(lengths + 1) - (lengths + 1)
        codes = np.zeros(int(lengths.sum()) + len(texts), np.int64)  # a 0 ends each text, and any phrase in it
        codes[_spans(first, first + lengths)] = np.concatenate(texts) if texts else 0
        per_text = -(-lengths // block)
        owner = np.repeat(np.arange(len(texts)), per_text)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
        starts = first[owner] + within * block
        ends = np.minimum(starts + block, (first + lengths)[owner])
        later = np.nonzero(within > 0)[0]
        found = np.zeros((len(texts), len(self.automata)), np.int64)
        for k, table in enumerate(self.automata):
            marks = np.zeros(len(codes), bool)
            code_view, mark_view = memoryview(codes), memoryview(marks)
            exits, rest = self._walk(table, codes, marks, starts, ends, block + extra)
            for lane, at, state in rest:
                exits[lane] = self._finish(table, code_view, mark_view, at, state, int(ends[lane]))
            entry = starts.copy()
            entry[later] = exits[later - 1]
            marks[_spans(starts[later], np.minimum(entry[later], ends[later]))] = False
            inside = later[entry[later] < ends[later]]
            now, rest = self._walk(table, codes, marks, entry[inside], ends[inside], extra)
            halfway = {int(inside[lane]): (at, state) for lane, at, state in rest}
            beyond = later[entry[later] >= ends[later]]  # blocks inside one phrase
            moved = np.concatenate([inside[(now >= 0) & (now != exits[inside])], beyond])
            exits[inside] = np.where(now >= 0, now, exits[inside])
            exits[beyond] = entry[beyond]
            todo = sorted({*halfway, *(m + 1 for m in moved.tolist() if m + 1 < len(owner) and within[m + 1])})  # sorted: a heap
            while todo:
                lane = heapq.heappop(todo)
                start, end = int(starts[lane]), int(ends[lane])
                out = int(exits[lane])
                if lane in halfway:
                    left = self._finish(table, code_view, mark_view, *halfway.pop(lane), end)
                    out = left if left >= 0 else out
                before = int(exits[lane - 1])
                if before != entry[lane]:
                    entry[lane] = before
                    marks[start : min(before, end)] = False
                    left = before if before >= end else self._finish(table, code_view, mark_view, before, 0, end)
                    out = left if left >= 0 else out
                if out != exits[lane]:
                    exits[lane] = out
                    if lane + 1 < len(owner) and within[lane + 1] and (not todo or todo[0] != lane + 1):
                        heapq.heappush(todo, lane + 1)
            if len(texts):
                found[:, k] = np.add.reduceat(marks, first, dtype=np.int64)
        return found


def learn_samples(docs: DataFrame, sample_passages: int = SAMPLE_PASSAGES, passage_chars: int = PASSAGE_CHARS) -> dict[str, str]:
    """Bounded samples of labelled text by language, from documents that are not held out.

    About sample_passages of a language are drawn by a hash of their document and place, against a threshold that
    follows from the language's number of passages, so that only counts are gathered and only drawn passages leave
    their tasks. Languages are as many as labels; their number times the bounds is what the driver holds.
    """
    usable = F.col("lang").isNotNull() & F.col("text").isNotNull() & (id_bucket(F.col("doc_id"), HELD_OUT_OF) != HELD_OUT)
    # the length is a column of its own before the lambda looks at it, so that a text is measured once
    measured = docs.where(usable).select("lang", "doc_id", "text", F.length("text").alias("_chars"))
    labelled = measured.withColumn("_n", F.ceil(F.col("_chars") / passage_chars).cast("int")).where(F.col("_n") > 0)
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.sum("_n").alias("n")).collect()}
    if not counts:
        return {}
    most = {k: min((1 << 63) - 1, (sample_passages << 64) // n - (1 << 63)) for k, n in counts.items()}
    last = F.element_at(F.create_map(*[x for k, n in most.items() for x in (F.lit(k), F.lit(n).cast("long"))]), F.col("lang"))
    draw = lambda i: F.xxhash64(F.lit(7), F.col("doc_id"), F.col("_chars"), i)
    drawn = labelled.withColumn("_last", last).withColumn("_places", F.filter(F.sequence(F.lit(0), F.col("_n") - 1), lambda i: draw(i) <= F.col("_last")))
    places = drawn.where(F.size("_places") > 0).select("lang", "doc_id", "text", "_chars", F.explode("_places").alias("_place"))
    passages = places.select("lang", "doc_id", draw(F.col("_place")).alias("_draw"), F.substring(F.col("text"), F.col("_place") * passage_chars + 1, F.lit(passage_chars)).alias("_part"))
    order = Window.partitionBy("lang").orderBy("_draw", "doc_id", "_part")
    samples: dict[str, list[str]] = {}
    for row in passages.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= sample_passages).orderBy("lang", "_rank").collect():
        samples.setdefault(row["lang"], []).append(row["_part"])
    return {k: "\n".join(dict.fromkeys(parts)) for k, parts in samples.items()}


#: One parser a worker, by the content of its samples.
_PARSERS: dict[str, CrossParser] = {}


def parser_of(samples: dict[str, str]) -> CrossParser:
    """The parser of samples with this content, built once a worker."""
    digest = hashlib.sha256(repr(sorted(samples.items())).encode("utf-8", "surrogatepass")).hexdigest()
    if digest not in _PARSERS:
        _PARSERS.clear()
        _PARSERS[digest] = CrossParser(samples)
    return _PARSERS[digest]


def _judged(texts: list[str | None], parser: CrossParser) -> tuple[list[str], np.ndarray]:
    """The languages and scores of some texts."""
    coded = [parser.encode(normalise(t or "")) for t in texts]
    has_letter = np.array([len(c) > 0 for c in coded], bool)
    if not parser.languages or not len(texts):
        return [UNDETERMINED] * len(texts), np.zeros(len(texts))
    totals = parser.phrases(coded)
    best = totals.argmin(axis=1)
    rows = np.arange(len(best))
    least = totals[rows, best].astype(float)
    totals[rows, best] = np.iinfo(np.int64).max
    following = totals.min(axis=1)  # the largest number where there is one language only
    score = np.where(has_letter, 1 - least / np.maximum(following, 1), 0.0)
    return [parser.languages[b] if h else UNDETERMINED for b, h in zip(best.tolist(), has_letter.tolist(), strict=True)], score


def predictions(texts: pa.Array, samples: dict[str, str]) -> tuple[list[str], np.ndarray]:
    """The languages and scores of texts, a bounded slice of them at a time (or one text)."""
    parser = parser_of(samples)
    names: list[str] = []
    scores: list[np.ndarray] = [np.zeros(0)]
    part: list[str | None] = []
    size = 0

    def judge_part() -> None:
        got = _judged(part, parser)
        names.extend(got[0])
        scores.append(got[1])
        part.clear()

    for value in texts:
        text = value.as_py()
        if part and size + len(text or "") > SLICE_CHARS:
            judge_part()
            size = 0
        part.append(text)
        size += len(text or "")
    judge_part()
    return names, np.concatenate(scores)


def identify(docs: DataFrame, samples: dict[str, str] | None = None) -> DataFrame:
    """doc_id, lang_pred, score for every row of docs; samples: text by language, learned from docs if not given.

    The score is how far the winner is ahead: 1 - its phrases / those of the next language.
    """
    learned = learn_samples(docs) if samples is None else samples
    shared = docs.sparkSession.sparkContext.broadcast(learned)  # bounded: languages x passages x their length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = predictions(batch.column(1), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(run, "doc_id long, lang_pred string, score double")


def language_column(docs: DataFrame, samples: dict[str, str] | None = None):
    """A column function text -> struct(lang_pred, score), for filters that keep whole rows."""
    learned = learn_samples(docs) if samples is None else samples
    shared = docs.sparkSession.sparkContext.broadcast(learned)

    @F.pandas_udf("lang_pred string, score double")
    def predicted(texts):
        import pandas as pd

        names, scores = predictions(pa.Array.from_pandas(texts, type=pa.string()), shared.value)
        return pd.DataFrame({"lang_pred": names, "score": scores})

    return predicted


def report(docs: DataFrame) -> DataFrame:
    """identify(docs), with held_out: whether a document was kept from learning."""
    held_out = id_bucket(F.col("doc_id"), HELD_OUT_OF) == HELD_OUT
    return identify(docs).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, min_score: float = 0.0) -> DataFrame:
    """The rows of docs whose language could be told, with a score of at least min_score."""
    rows = carried(docs, text=F.col("text").cast("string"))
    told = rows.withColumn("_language", language_column(docs)(F.col("text")))
    kept = told.where((F.col("_language.lang_pred") != UNDETERMINED) & (F.col("_language.score") >= min_score))
    return kept.select("_row.*")
