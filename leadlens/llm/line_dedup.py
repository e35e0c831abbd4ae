"""Line dedup: an exact set-similarity join over the corpus's lines, in DataFrame functions alone.

A line is the set of its words. Sets that occur more than once keep their first occurrence (by
document, then line). Among the distinct sets, a set is dropped if an earlier one has a Jaccard
similarity of ``SIMILARITY`` or more. The join is exact. Words are ordered by rarity, and a set is known by the
pairs of words that follow each other in that order within its prefix. Where two sets are alike, the words that one
of them has alone are fewer than the steps from one shared word to the next in the shorter prefix, so that one step has none
within it: its two words follow each other in both sets. Two words meet in far fewer lines than one, so
that a pair groups few sets besides near copies, however large the corpus. Only sets under one pair are compared, by
their sizes (length filter) and by ``BITS`` bits, of which the words of a set set one each: bits that differ show
words that differ, which bounds the overlap. What passes is verified on the whole sets.

Any one order of words makes the join exact; rarity makes pairs selective. It is read from a
table of 262,144 counters over hashes of words (a word counts as often as its counter), which stays
the same size for any corpus; of equal counters the hash decides.

A pair that thousands of near copies share would bring them all together. So each set is first compared
with the earliest set under each of its pairs alone; what matches there is settled. Only sets
not settled so are joined with all earlier ones, and of a crowd two sets only under the first pair of words
that they share.

Sets of three words and fewer are alike only when equal, so that grouping equal sets settles them
and they have no prefix. A line without spaces, as in Chinese or Thai, is one word.

Nulls and odd rows: a null text has no lines and stays null. Lines of fewer than ``min_words``
words are left alone; by default these are the lines without words. A document keeps its other lines,
joined as before; one that loses all its lines becomes empty. Rows that share an id are ordered by a hash of
id and text; rows equal in both are one document, which keeps or loses the same lines in each. Any
length of text or line is read whole.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlens.llm.common import SPACE, fresh, written

SIMILARITY, MIN_WORDS = 0.8, 1
COUNTERS = 1 << 18
#: Bits of a word's key: its hash, under its rarity, a third of a power of two.
HASH_BITS = 56
#: Bits of a word in a prefix, where its key's last ones are kept; words that agree in them share more pairs, not fewer.
PREFIX_BITS = 31
#: Bits of a set's map.
BITS = 256
#: Where more sets than this share a pair of words, two that meet under an earlier pair are not named again.
CROWD = 8


def _split(content: Column) -> Column:
    """A line's words, among them empty ones; splitting at one plain character is the fast way."""
    plain = F.when(content.rlike(r"[\x09-\x0D]"), F.regexp_replace(content, r"[\x09-\x0D]", " ")).otherwise(content)
    return F.split(plain, " ")


def _words(content: Column) -> Column:
    """The distinct words of a line as hashes."""
    words = F.array_distinct(F.transform(_split(content), lambda w: F.xxhash64(w)))
    return F.array_remove(words, F.xxhash64(F.lit("")))


def _counts(content: Column, min_words: int) -> Column:
    """Whether a line has words enough to be compared."""
    return content.rlike(r"^[\x20\x09-\x0D]*([^\x20\x09-\x0D]+[\x20\x09-\x0D]+){%d}[^\x20\x09-\x0D]" % (min_words - 1))


def prefix_size(n: Column) -> Column:
    """Words of the prefix; none where even one word more or less makes sets unlike.

    A set of n words and one like it have a and b words of their own, a + t b <= (1 - t) n. Of the prefix's k words at least k - a
    are shared, with k - a - 1 steps between them; k = 2 a + b + 2 makes these more than a + b. That is most for the greatest a.
    """
    own = n * F.lit(1 - SIMILARITY) + F.lit(1e-9)
    a = F.floor(own).cast("int")
    size = 2 * a + F.floor((own - a) / F.lit(SIMILARITY) + F.lit(1e-9)).cast("int") + 2
    return F.when(n >= (n + 1) * F.lit(SIMILARITY) - F.lit(1e-9), size).otherwise(0)


def rarities(words: DataFrame) -> bytes:
    """A byte a counter, the logarithm of its count in thirds, from word hashes: as many as there are counters."""
    at = F.col("word").bitwiseAND(F.lit(COUNTERS - 1)).cast("int")
    seen = words.groupBy(at.alias("at")).agg(F.count(F.lit(1)).alias("n"))
    found = seen.select("at", F.floor(3 * F.log2("n")).cast("int").alias("r")).toArrow()  # columns, not a row object a counter
    table = np.ones(COUNTERS, np.uint8)
    table[found["at"].to_numpy()] = 1 + found["r"].to_numpy()
    return table.tobytes()


def line_sets(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, row, line, h1, h2, n, prefix, bits) of every line that is long enough."""
    lines = docs.select("doc_id", "row", F.posexplode(F.split("text", "\n")).alias("line", "content")).where(_counts(F.col("content"), min_words))
    words = docs.select(F.explode(_split(F.replace("text", F.lit("\n"), F.lit(" ")))).alias("w")).select(F.xxhash64("w").alias("word"))
    table = F.lit(rarities(words))

    def key(h: Column) -> Column:
        """A word's key: its rarity, then its hash."""
        at = h.bitwiseAND(F.lit(COUNTERS - 1)).cast("int")
        rarity = F.ascii(F.substring(table, at + 1, F.lit(1)).cast("string"))
        return F.shiftleft(rarity.cast("long"), HASH_BITS).bitwiseOR(F.shiftrightunsigned(h, 64 - HASH_BITS))

    keyed = lines.select("doc_id", "row", "line", F.sort_array(F.transform(_words(F.col("content")), key)).alias("keys"))
    n = F.size("keys")

    def part(i: int) -> Column:
        """64 bits of the map, of the words that fall there."""
        here = F.filter("keys", lambda k: k.bitwiseAND(F.lit(BITS - 64)) == 64 * i)
        return F.aggregate(here, F.lit(0).cast("long"), lambda acc, k: acc.bitwiseOR(
            F.call_function("shiftleft", F.lit(1).cast("long"), k.bitwiseAND(F.lit(63)).cast("int"))))

    bits = F.array(*map(part, range(BITS // 64)))
    prefix = F.transform(F.slice("keys", F.lit(1), prefix_size(n)), lambda k: k.bitwiseAND(F.lit((1 << PREFIX_BITS) - 1)).cast("int"))
    return keyed.select("doc_id", "row", "line", F.xxhash64("keys").alias("h1"), F.hash("keys").alias("h2"), n.alias("n"),
                        prefix.alias("prefix"), F.when(prefix_size(n) > 0, bits).alias("bits"))


def kept_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(row, line) of the lines of enough words that stay, from (doc_id, row, text)."""
    at = F.struct("doc_id", "row", "line")
    sets = line_sets(docs, min_words).groupBy("h1", "h2", "n").agg(F.min(F.struct(at.alias("at"), "prefix", "bits")).alias("s"))
    # the first occurrence of each set, numbered in order, so that later sets have greater numbers
    sets = (sets.select("n", "s.at.doc_id", "s.at.row", "s.at.line", "s.prefix", "s.bits")
            .repartitionByRange("doc_id", "row", "line").sortWithinPartitions("doc_id", "row", "line")
            .withColumn("set", F.monotonically_increasing_id()))
    sets = written(sets, "line_sets")
    shared = written(earliest_pairs(sets), "line_shared")
    pairs = written(likely(shared.where("set <> other").select("set", "other"), sets), "line_pairs")
    settled = written(matches(pairs, sets, docs), "line_settled")
    rest = written(all_pairs(shared, sets, settled, pairs), "line_pairs")
    near = settled.select("set")
    if not rest.isEmpty():
        near = near.unionByName(matches(rest, sets, docs).select("set"))
    return sets.select("set", "row", "line").join(near.distinct(), "set", "left_anti").select("row", "line")


def least_overlap(n: Column, m: Column) -> Column:
    """The least overlap of sets of n and m words that are alike enough."""
    return F.ceil((n + m) * F.lit(SIMILARITY / (1 + SIMILARITY)) - F.lit(1e-9))


def in_reach(n: Column, m: Column, x: Column, y: Column) -> Column:
    """Length filter, and of the maps x and y: bits that differ are of different words that are in one set alone."""
    unlike = sum((F.bit_count(F.get(x, F.lit(i)).bitwiseXOR(F.get(y, F.lit(i)))) for i in range(BITS // 64)), F.lit(0))
    return ((F.least(n, m) >= F.greatest(n, m) * F.lit(SIMILARITY) - F.lit(1e-9))
            & (n + m - unlike >= 2 * least_overlap(n, m)))


def steps(prefix: Column) -> Column:
    """The pairs of words that follow each other in a prefix."""
    n = F.greatest(F.size(prefix) - 1, F.lit(0))
    return F.zip_with(F.slice(prefix, F.lit(1), n), F.slice(prefix, F.lit(2), n),
                      lambda a, b: F.shiftleft(a.cast("long"), PREFIX_BITS).bitwiseOR(b.cast("long")))


def by_key(sets: DataFrame) -> DataFrame:
    """(key, set): a row for each pair of words that follow each other in a set's prefix, dealt by the pair; all that read it share one
    exchange, for which what a join would infer of its sides, that nothing is null, is said here."""
    n = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # as many tasks however small the rows are
    return (sets.select("set", F.explode(steps(F.col("prefix"))).alias("key"))
            .where("key is not null and set is not null").repartition(n, "key"))


def earliest_pairs(sets: DataFrame) -> DataFrame:
    """(key, k, set, other): each set under a pair of words that k > 1 sets share, with the earliest of them."""
    keyed = by_key(sets)
    least = keyed.groupBy("key").agg(F.min("set").alias("other"), F.count(F.lit(1)).alias("k")).where("k > 1")
    # only pairs of words that several sets share are held, so that the rows of all need no sort
    return keyed.join(least.hint("shuffle_hash"), "key").select("key", "k", "set", "other")


def likely(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (set, other), each once, that can be alike enough."""
    once = pairs.join(sets.select("set", "n", "bits"), "set").distinct()
    return (once.join(sets.select(F.col("set").alias("other"), F.col("n").alias("m"), F.col("bits").alias("y")), "other")
            .where(in_reach(*map(F.col, ("n", "m", "bits", "y")))).select("set", "other"))


def all_pairs(shared: DataFrame, sets: DataFrame, settled: DataFrame, tested: DataFrame) -> DataFrame:
    """(set, other): each set that is not settled with all earlier ones that share a pair of words; where only two share it,
    they have been compared."""
    done = settled.select("set").distinct().withColumn("done", F.lit(1))
    # the mark goes with the number, in its last bit, so that both sides of the join read the same rows
    marked = sets.join(done, "set", "left").withColumn("mark", F.col("set") * 2 + F.coalesce(1 - F.col("done"), F.lit(1)))
    keys = steps(F.col("prefix"))
    before = F.when(F.col("k") > CROWD, F.slice(keys, F.lit(1), (F.array_position(keys, F.col("key")) - 1).cast("int"))).otherwise(F.array().cast("array<bigint>"))
    n = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = (shared.where("k > 2").select("key", "k", "set").join(marked.select("set", "mark", "n", "prefix", "bits"), "set")
            .select("key", F.col("mark").alias("set"), "n", "bits", before.alias("before"))
            .where("key is not null and set is not null and n is not null and bits is not null and before is not null").repartition(n, "key"))
    other = rows.select("key", F.col("set").alias("o"), F.col("n").alias("m"), F.col("bits").alias("y"), F.col("before").alias("b"))
    number, earlier = F.shiftright("set", 1), F.shiftright("o", 1)
    open_ = number * F.col("set").bitwiseAND(F.lit(1)) > earlier  # false for every settled set
    meet = rows.join(other, "key").where(open_).where(in_reach(*map(F.col, ("n", "m", "bits", "y")))).where(~F.arrays_overlap("before", "b"))
    return meet.select(number.alias("set"), earlier.alias("other")).distinct().join(tested, ["set", "other"], "left_anti")


def matches(pairs: DataFrame, sets: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs whose whole sets are alike enough; the sets are read from the documents again."""
    asked = pairs.select("set").unionByName(pairs.select(F.col("other").alias("set"))).distinct()
    asked = sets.select("set", "row", "line").join(asked, "set", "left_semi")
    lines = asked.groupBy("row").agg(F.collect_list(F.struct("set", "line")).alias("lines"))
    content = (docs.select("row", "text").join(lines, "row")
               .select(F.explode("lines").alias("l"), F.split("text", "\n").alias("all"))
               .select("l.set", _words(F.get("all", F.col("l.line"))).alias("words")))
    content = written(content, "line_contents")
    both = F.size(F.array_intersect("wa", "wb"))
    either = F.size("wa") + F.size("wb") - both
    return (pairs.join(content.select("set", F.col("words").alias("wa")), "set")
            .join(content.select(F.col("set").alias("other"), F.col("words").alias("wb")), "other")
            .where(both >= either * F.lit(SIMILARITY) - F.lit(1e-9)).select("set", "other"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with later copies of lines of ``min_words`` words and more taken out of the text, and ``n_lines``, ``n_removed`` (long)
    in place of columns so named."""
    row, keep = fresh(docs, "row"), fresh(docs, "keep")
    rows = docs.withColumn(row, F.xxhash64(F.col(id_col), F.col(text_col)))
    plain = rows.select(F.col(id_col).alias("doc_id"), F.col(row).alias("row"), F.col(text_col).alias("text"))
    kept = written(kept_lines(plain, min_words).groupBy(F.col("row").alias(row)).agg(F.collect_set("line").alias(keep)), "kept_lines")
    lines = F.split(F.col(text_col), "\n")
    stay = F.filter(lines, lambda x, i: ~_counts(x, min_words) | F.coalesce(F.array_contains(F.col(keep), i), F.lit(False)))
    out = rows.join(kept, row, "left").withColumn(keep, stay)
    return (out.withColumn("n_lines", F.coalesce(F.size(lines), F.lit(0)).cast("long"))
            .withColumn("n_removed", F.coalesce(F.size(lines) - F.size(keep), F.lit(0)).cast("long"))
            .withColumn(text_col, F.when(F.col("n_removed") == 0, F.col(text_col)).otherwise(F.array_join(keep, "\n"))).drop(row, keep))
