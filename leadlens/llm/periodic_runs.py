"""Periodic run detection: seeds on diagonals, extended, with a table of what each lag has covered.

A run is a stretch of words that no neighbouring word extends, whose words equal those ``q`` before
them, q being its least period, and whose length is at least ``max(least, 2 q)``. Written as a
diagonal of the document against itself, it is a stretch of at least ``max(least - q, q)`` places i
with word i = word i + q: that is the overlap which lag q guarantees.

Seeds: lags are taken in bands [1, 8), [8, 16), [16, 32) and so on. The least overlap that a band
guarantees is M = 6 (for 12 words), 8, 16 ... words, so every stretch of the band holds a whole k-gram
that starts at a multiple of M - k + 1, for any k up to M. Such sampled k-grams (k = 4, 4, 8, ...) are
looked up in the index of all k-grams, and only occurrences of the same document at a lag of the band
make a pair. There are at most as many pairs in a band as a document has words, about twice over, also
where it is one word again and again.

Extension: pairs are taken lag by lag in order of place. A table holds for each document and lag how far
it is covered; a pair behind that mark lies on a stretch that is known and is not extended again. (All
diagonals go on side by side; what is left after ``ROUNDS`` stretches of each is marked in one step.)
Grams are numbered by doubling (the numbers of two halves make that of the whole), so equal numbers are
equal grams, and a stretch is measured by steps of falling powers of two. A stretch that a divisor of its
lag also explains has the same ends under the smaller lag; the smaller one is its period.

All documents of a batch are worked on at once in numpy arrays; words are numbered by a dictionary, and
a number of its own ends each document, so that nothing matches across documents. A document is never
cut, whatever its length.

Nulls and odd rows: a null or empty text has no words and no runs. Repeated rows, and rows that share
an id or have none, each give a row of their own. Further columns are not read. An empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlens.llm.common import slices, utf8_rows

#: Least length of a run in words.
LEAST = 12
#: Bytes of text worked on at once; one longer text stays whole.
BATCH_BYTES = 1 << 20
#: Stretches of a diagonal that are extended one after the other before the rest is done at once.
ROUNDS = 16


class _Numbers(dict):
    """Numbers words in the order in which they come."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def _bands(least: int, longest: int) -> Iterator[tuple[int, int, int, int]]:
    """(first lag, lag after the last, length of the grams, distance of the seeds)."""
    low, high = 1, 8
    while low <= longest // 2:
        overlap = min(max(least - q, q) for q in range(low, high))
        k = 1 << (overlap.bit_length() - 1)  # the greatest power of two within the overlap
        if k == overlap and k > 1:
            k //= 2  # half of it lets seeds lie apart
        yield low, high, k, overlap - k + 1
        low, high = high, 2 * high


class _Grams:
    """Numbers of all grams whose lengths are powers of two; a gram that occurs once has a number below 0."""

    def __init__(self, words: np.ndarray):
        self.n = len(words)
        self.levels = [self._numbered(np.arange(self.n), words)]
        self.shared = 0  # the number of levels on which some gram occurs twice
        while (self.level(self.shared) >= 0).any():
            self.shared += 1

    def _numbered(self, at: np.ndarray, keys: np.ndarray) -> np.ndarray:
        out = -1 - np.arange(self.n, dtype=np.int64)
        _, number, count = np.unique(keys, return_inverse=True, return_counts=True)
        often = count[number] > 1
        out[at[often]] = number[often]
        return out

    def level(self, j: int) -> np.ndarray:
        """Numbers of the grams of 2^j words by their start; those that would pass the end occur once."""
        while len(self.levels) <= j:
            half, step = self.levels[-1], 1 << (len(self.levels) - 1)
            at = np.flatnonzero(half[:-step] >= 0) if step < self.n else np.zeros(0, np.int64)
            at = at[half[at + step] >= 0]
            self.levels.append(self._numbered(at, half[at] * (self.n + 1) + half[at + step]))
        return self.levels[j]

    def extent(self, a: np.ndarray, b: np.ndarray, back: bool) -> np.ndarray:
        """How many words from places a and b on (or before them) are equal one by one."""
        a, b, got = a.copy(), b.copy(), np.zeros(len(a), np.int64)
        for j in range(self.shared - 1, -1, -1):
            ids, step = self.level(j), 1 << j
            x, y = (a - step, b - step) if back else (a, b)
            inside = (x >= 0) & (y >= 0) & (x < self.n) & (y < self.n)
            same = np.zeros(len(a), bool)
            same[inside] = ids[x[inside]] == ids[y[inside]]
            got[same] += step
            move = np.where(same, -step if back else step, 0)
            a, b = a + move, b + move
        return got


def _seeds(grams: _Grams, low: int, high: int, k: int, apart: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, lag) of the pairs of a seed and another occurrence of its gram, at the band's lags."""
    ids = grams.level(k.bit_length() - 1)
    n = len(ids)
    at = np.flatnonzero(ids >= 0)
    if not len(at):
        return at, at
    key = np.sort(ids[at] * n + at)  # all occurrences, by gram, then place
    seed = at[at % apart == 0]
    first = ids[seed] * n
    lo = np.searchsorted(key, first + np.minimum(seed + low, n))
    hi = np.searchsorted(key, first + np.minimum(seed + high, n))
    found = hi - lo
    place = np.repeat(seed, found)
    slot = np.arange(found.sum()) - np.repeat(np.cumsum(found) - found, found) + np.repeat(lo, found)
    return place, key[slot] % n - place


def _stretches(grams: _Grams, place: np.ndarray, lag: np.ndarray, document: np.ndarray) -> tuple[np.ndarray, ...]:
    """(start, length, lag) of the greatest stretches of the pairs, each once."""
    n = np.int64(grams.n + 1)
    line = document[place] * n + lag  # a diagonal: a lag within a document
    order = np.lexsort((place, line))
    place, lag, line = place[order], lag[order], line[order]
    key_of = np.unique(line, return_inverse=True)[1]
    # a pair is found by (diagonal, place); each diagonal's mark is how far it is covered
    sought = key_of * n + place
    end = np.r_[np.flatnonzero(np.diff(key_of)) + 1, len(place)] if len(place) else np.zeros(0, np.int64)
    at = np.r_[0, end[:-1]] if len(place) else end
    out: list[tuple] = [(place[:0], place[:0], lag[:0])]

    def extend(at: np.ndarray) -> np.ndarray:
        p, d = place[at], lag[at]
        back = grams.extent(p, p + d, back=True)
        length = back + grams.extent(p, p + d, back=False)
        out.append((p - back, length, d))
        return p - back + length

    for _ in range(ROUNDS):
        covered = extend(at)
        at = np.searchsorted(sought, key_of[at] * n + covered)  # each diagonal's first pair beyond the mark
        rest = at < end
        at, end = at[rest], end[rest]
        if not len(at):
            break
    if len(at):  # diagonals of many stretches: the marks of all their pairs at once, as a running maximum
        size = end - at
        left = np.repeat(at - np.cumsum(size) + size, size) + np.arange(size.sum())
        reach = key_of[left] * n + place[left] + grams.extent(place[left], place[left] + lag[left], back=False)
        mark = np.r_[-1, np.maximum.accumulate(reach)[:-1]]
        extend(left[sought[left] >= mark])
    return tuple(np.concatenate(x) for x in zip(*out))


def runs_of(documents: list[list[bytes]], least: int = LEAST) -> list[np.ndarray]:
    """For each document, given as words, its runs as rows (start, length, period) in that order."""
    sizes = np.array([len(d) for d in documents], np.int64)
    table = _Numbers()
    words, ends = [], []
    for d in documents:
        words += map(table.__getitem__, d)
        ends.append(len(words))
        words.append(0)
    x = np.array(words, np.int64)
    x[ends] = len(table) + np.arange(len(ends))  # what ends a document occurs nowhere else
    base = np.cumsum(sizes + 1) - sizes - 1
    document = np.repeat(np.arange(len(documents)), sizes + 1)
    grams = _Grams(x)
    parts = []
    for low, high, k, apart in _bands(least, int(sizes.max(initial=0))):
        place, lag = _seeds(grams, low, high, k, apart)
        if not len(place):
            if k.bit_length() > grams.shared:
                break  # no gram of this length occurs twice, so no longer one does
            continue
        within = document[place] == document[np.minimum(place + lag, len(x) - 1)]
        start, length, lag = _stretches(grams, place[within], lag[within], document)
        whole = (length >= lag) & (length + lag >= least)
        parts.append(np.stack([start, length + lag, lag], 1)[whole])
    found = np.concatenate(parts) if parts else np.zeros((0, 3), np.int64)
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    first = np.ones(len(found), bool)  # of equal ends the least lag is the period
    first[1:] = (found[1:, :2] != found[:-1, :2]).any(1)
    found = found[first]
    found = found[np.lexsort((found[:, 2], found[:, 0]))]
    cuts = np.searchsorted(found[:, 0], base[1:]) if len(base) > 1 else []
    out = np.split(found, cuts)
    return [part - np.array([b, 0, 0]) for part, b in zip(out, base)] if len(documents) else []


def repeated(n: int, runs: np.ndarray) -> np.ndarray:
    """Of n words, which ones a run holds after its first period."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, runs[:, 0] + runs[:, 2], 1)
    np.add.at(step, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(step)[:n] > 0


RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """One row per document: its id as ``doc_id``, ``n_words``, its ``runs`` by start, then period, and
    ``collapsed``, the words that no run repeats, joined by one space."""
    id_type = docs.schema[id_col].dataType.simpleString()
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", BATCH_BYTES):
            words = [t.split() for t in utf8_rows(b, "text")]
            found = runs_of(words, least)
            kept = []
            for w, r in zip(words, found):
                if len(r):
                    w = [x for x, gone in zip(w, repeated(len(w), r).tolist()) if not gone]
                kept.append(b" ".join(w).decode())
            runs = [[dict(zip(("start", "length", "period"), x)) for x in r.tolist()] for r in found]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(w) for w in words], pa.int64()),
                                              pa.array(runs, kind), pa.array(kept, pa.string())],
                                             names=["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"doc_id {id_type}, n_words bigint, runs {RUNS}, collapsed string")


def planted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the contract's repetitions: where ten divides the id's crc32, the words from a place
    on that the crc32 gives repeat a stretch of the text. Other texts, and those without an id, stay."""
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.array_remove(F.split(F.regexp_replace(F.col(text_col), r"[\x20\x09-\x0D]+", " "), " "), "")
    n = F.size(words).cast("long")
    a = F.pmod(g, n)
    p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
    hit = (F.pmod(h, F.lit(10)) == 0) & F.col(text_col).rlike(r"[^\x20\x09-\x0D]")
    ahead = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), hit.alias("_hit"), F.when(hit, words).alias("_words"),
                        F.when(hit, a).alias("_a"), F.when(hit, p).alias("_p"))
    a, p, rest = F.col("_a").cast("int"), F.col("_p").cast("int"), F.size("_words") - F.col("_a").cast("int")
    again = F.flatten(F.array_repeat(F.slice("_words", a + 1, p), F.ceil(rest / p).cast("int")))
    again = F.concat(F.slice("_words", F.lit(1), a), F.slice(again, F.lit(1), rest))
    return ahead.select("doc_id", F.when(F.col("_hit"), F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from what ``find`` returns."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    rows = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    rows = F.when(F.size("runs") > 0, F.concat(rows, F.lit("\n"))).otherwise("")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), (-best["start"]).alias("start"), best["length"].alias("length"),
                        (-best["period"]).alias("period"), F.floor(best["length"] * 1000 / -best["period"]).alias("exponent_milli"),
                        F.sha2(rows.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
