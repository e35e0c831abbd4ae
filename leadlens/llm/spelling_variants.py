"""Spelling variant grouping: words one edit apart, found by pivotal grams.

Bigrams of all words have one order, the rarer first. A word's prefix is its ``2 e + 1`` rarest bigrams
(e = 1 edit). Any such prefix holds e + 1 bigrams that share no letter; the pair whose bigrams are
rarest together, chosen by dynamic programming over their places, are the word's pivots. One edit
changes at most one of the pivots. So, of two near words, the one whose prefix ends earlier in the order has
a pivot that the other word's prefix holds too.

Position limits: letters before the edit have the same place in both words, and letters after it are as far
from both words' ends. So the edit leaves a pivot in place together with all letters up to it, or from it on, and
more letters are known to be equal by where the edit lies (p and q: the pivots, p first):

* behind q: all letters up to q's end; before p: all letters from p on;
* between them: the letters up to p's end, and those from q on;
* in q: the letters up to p's end, those between p and q, and those behind q; in p: likewise from the other side.

The index holds for each prefix bigram of a word the letters up to its end, alone, with the word's last two letters,
and with the next two; and the same from the other side. A word asks once for each place where the edit may lie, with at
least four letters in nearly all cases. A pair found so is verified on the whole words
within the join: lengths at most one apart, and exactly one letter inserted, deleted or replaced.

The order of bigrams is a table of at most (letters of the alphabet)^2 = 8,100 rows, so each task gets
a copy. Words are counted before anything is shuffled; a common beginning of words is a common key of the
join, an ordinary sort-merge join whose large partitions Spark splits.

Forms: the near word that occurs most, at least ``ratio`` times as often as the word (ties: the least in
code-point order). A form occurs ten times as often as its word, so chains of forms are short; they are followed by
pointer jumping over written tables.

Nulls and odd rows: a null or empty text has no words. Repeated rows count each. Where the id is null,
nothing is deleted from words (``misspelt``). A text is read whole, whatever its length. An empty table gives
an empty result. Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlens.llm.common import written

#: Letters of words: the contract's fixed set.
LETTERS = "[A-Za-zÀ-ÿ]+"
LEAST_LENGTH, LEAST_COUNT, RATIO = 7, 2, 10
EDITS = 1


def lower(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def misspelt(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word) of every run of letters in the texts, with the contract's deletions: where 31 divides the
    crc32 of id and run, the run lacks the letter that the crc32 points at."""
    runs = docs.select(F.col(id_col).cast("string").alias("id"), F.explode(F.regexp_extract_all(lower(F.col(text_col)), F.lit(LETTERS), F.lit(0))).alias("run"))
    hashed = runs.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = F.pmod("h", F.length("run")).cast("int")
    short = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return hashed.select(F.when(F.pmod("h", F.lit(31)) == 0, short).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words long and frequent enough."""
    return (words.where(F.length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") >= least_count))


def order_of_bigrams(words: DataFrame) -> dict[str, int]:
    """The place of each bigram in the order, the rarest first."""
    at = F.explode(F.sequence(F.lit(1), F.length("word") - 1))
    seen = words.where(F.length("word") > 1).select("word", at.alias("at")).select(F.expr("substring(word, at, 2)").alias("gram"))
    rows = seen.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).collect()  # pairs of letters: 8,100 at most
    return {r["gram"]: i for i, r in enumerate(sorted(rows, key=lambda r: (r["n"], r["gram"])))}


def prefix(word: str, order: dict[str, int], edits: int = EDITS) -> list[tuple[int, int]]:
    """(place in the order, place in the word) of the prefix's bigrams; of equal bigrams the first comes first."""
    return sorted((order[word[i:i + 2]], i) for i in range(len(word) - 1))[:2 * edits + 1]


def pivots(grams: list[tuple[int, int]], edits: int = EDITS) -> list[int]:
    """Places of the ``edits + 1`` prefix bigrams without a common letter whose orders add up to the least.

    ``best[j]`` is the least sum of j disjoint bigrams among those read so far, in order of place, with
    their places; a bigram may follow those that end before it starts.
    """
    none = (float("inf"), ())
    rows: list[tuple[int, list]] = []  # after each bigram: its place, and best
    for at, rank in sorted((i, r) for r, i in grams):
        before = next((best for end, best in reversed(rows) if end + 2 <= at), [(0, ())] + [none] * (edits + 1))
        best = list(rows[-1][1]) if rows else [(0, ())] + [none] * (edits + 1)
        for j in range(1, edits + 2):
            if len(before[j - 1][1]) == j - 1:
                best[j] = min(best[j], (before[j - 1][0] + rank, (*before[j - 1][1], at)))
        rows.append((at, best))
    return list(rows[-1][1][edits + 1][1])


GRAMS = "word string, n long, last int, text string, asks boolean"


def held(word: str, at: int) -> list[str]:
    """What the index holds for a prefix bigram."""
    to, rest = word[:at + 2], word[at:]
    return [f"P{to}", f"P{to}-{word[-2:]}", f"S{rest}", f"S{word[:2]}-{rest}",
            *([f"P{word[:at + 4]}+"] if at + 4 <= len(word) else []), *([f"S+{word[at - 2:]}"] if at >= 2 else [])]


def asked(word: str, p: int, q: int) -> list[str]:
    """What a word with pivots p and q looks up, by where the edit lies: behind q, before p, between, in q, in p."""
    gap, head, tail = q - p - 2, p, len(word) - q - 2
    up, on = word[:p + 2], word[q:]
    in_q = f"P{up}-{word[-2:]}" if tail >= 2 else f"P{word[:p + 4]}+" if gap >= 2 else f"P{up}"
    in_p = f"S{word[:2]}-{on}" if head >= 2 else f"S+{word[q - 2:]}" if gap >= 2 else f"S{on}"
    return list(dict.fromkeys([f"P{word[:q + 2]}", f"S{word[p:]}", f"P{up}-{word[-2:]}", in_q, in_p]))


def index(words: DataFrame, order: dict[str, int]) -> DataFrame:
    """What the index holds for each word's prefix bigrams and what the word asks for (``asks``); ``last``: where its prefix
    ends in the order."""
    names = [c.split()[0] for c in GRAMS.split(", ")]
    types = [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for word, n in zip(b.column("word").to_pylist(), b.column("n").to_pylist()):
                grams = prefix(word, order)
                last = grams[-1][0]
                rows += [(word, n, last, t, True) for t in asked(word, *pivots(grams))]
                rows += [(word, n, last, t, False) for t in dict.fromkeys(t for _, at in grams for t in held(word, at))]
            cols = list(zip(*rows)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    return words.select("word", "n").mapInArrow(run, GRAMS)


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, na, b, nb): the pairs of words one edit apart, each once, with their counts, among words of six letters and more.

    In a shorter word the edit may leave too few letters to ask with.
    """
    grams = written(index(words, order_of_bigrams(words)), "spelling_grams")
    key = F.xxhash64("text")  # texts whose hashes meet are told apart by the test of the words
    probe = grams.where("asks").select(key.alias("key"), F.col("word").alias("a"), F.col("n").alias("na"), F.col("last").alias("la"))
    held = grams.where("not asks").select(key.alias("key"), F.col("word").alias("b"), F.col("n").alias("nb"), F.col("last").alias("lb"))
    # the word whose prefix ends earlier asks; where both end alike, each asks the other
    near = (F.abs(F.length("a") - F.length("b")) <= EDITS) & (F.levenshtein("a", "b", EDITS) == EDITS)
    found = probe.join(held, "key").where((F.col("la") <= F.col("lb")) & near)
    ab = F.col("a") < F.col("b")
    return found.select(F.least("a", "b").alias("a"), F.when(ab, F.col("na")).otherwise(F.col("nb")).alias("na"), F.greatest("a", "b").alias("b"),
                        F.when(ab, F.col("nb")).otherwise(F.col("na")).alias("nb")).distinct()


def roots(forms: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(word, root) from (word, form): the last word that following the forms reaches."""
    at = written(forms.select("word", F.col("form").alias("root")), "spelling_roots")
    for _ in range(max_rounds):
        step = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        at = written(at.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling_roots")
        if at.where("moved").isEmpty():
            return at.select("word", "root")
        at = at.select("word", "root")
    raise RuntimeError("the forms did not settle")


def group(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """From (word, n): (word, form, root, n, n_near, form_n) of every word."""
    pairs = near_pairs(words)
    both = (pairs.select(F.col("a").alias("word"), F.col("na").alias("n"), F.col("b").alias("other"), F.col("nb").alias("m"))
            .unionByName(pairs.select(F.col("b").alias("word"), F.col("nb").alias("n"), F.col("a").alias("other"), F.col("na").alias("m"))))
    # the greatest count, then the least word
    best = both.groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best"))
    m = -F.col("best.m")
    isform = m >= ratio * F.col("n")
    near = written(best.select("word", "n_near", F.when(isform, F.col("best.other")).alias("form"), F.when(isform, m).alias("form_n")), "spelling_near")
    ends = roots(near.where("form is not null"))
    return (words.join(near, "word", "left").join(ends, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n"))


def variants(docs: DataFrame) -> DataFrame:
    """The variants among the words of ``docs``, with the contract's deletions."""
    return group(written(vocabulary(misspelt(docs)), "spelling_words"))
