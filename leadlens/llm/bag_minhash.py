"""Near-duplicates by BagMinHash signatures of weighted shingles.

A document is a bag of five-word shingles, each weighing as often as it occurs. Weights are cut into
dyadic levels, (0,1], (1,2], (2,4] and so on. Each level of each shingle has a Poisson process in
time whose rate is the level's width; each point falls on one of the signature's places and on a
weight inside the level, drawn at once as the limit of halving the level again and again, and counts only
if the document's weight reaches it. A place holds the first point that fell on it. Two documents agree in
a place with probability equal to their weighted Jaccard similarity, without bias, as the first
point of the union belongs to both exactly in that share. Only points before a time that fills all
places are made, so the work per document is its shingles once, plus a fixed number of points.

Signatures are cut into bands; texts that share a band are candidates. In rounds, the texts of a band's
bucket are compared with one of them: first with the one that lies in the largest buckets, as the original of
a group of copies does, then with ones drawn anew for each bucket, so that a text meets as many others as it
has bands. Pairs whose whole signatures agree in enough places are compared by the exact overlap of
their bags. That joins a group without listing its pairs. Of the texts of a bucket that are still in
different components after ``ROUNDS`` rounds, most are like none of another component: they meet first with signatures
and maps of ``BITS`` bits, of which each shingle sets one. Bits that differ show shingles that one text has alone, which
bounds the overlap; a text that finds no other in reach goes. A text of whose shingles fewer than the similarity's share occur in
any other component cannot be like a text of one, and goes too. The others meet in a last join, whose condition holds
the bounds of sizes, places and maps, taken in the first band that two texts share, so that each pair leaves it once;
their bags are fetched for the pairs in reach alone, and overlapped exactly, so that no link between components is lost. A
row of the last join is some hundred bytes, however long its text: where a few buckets hold much, Spark cuts
both sides and joins each piece with each, in tasks as many as the square of the bytes. Equal
texts are one class from the start.

Nulls and odd rows: texts are compared by their lower-cased words. A text of one to four words is one
shingle. Null texts and texts without words are nobody's duplicates and are each a class of their
own; so is a null id, whose class is null. Repeated rows with one id are one document; different texts under one id
are one document too, which joins the classes of all its texts. A text is known by a 64-bit hash of its id and
itself. Results carry the least id of each class.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlens.llm.common import components, slices, splitmix, utf8_rows, written

WORDS = 5
#: At similarity 0.8 a pair shares no band with probability (1 - 0.8**4)**20, under 3 in 100,000.
BANDS, ROWS = 20, 4
PLACES = BANDS * ROWS
SIMILARITY = 0.8
#: Places of 80 in which a pair must agree to be compared by its texts: at similarity 0.8 they are 64 with
#: a deviation of 3.6, so under one pair in a million stays below.
AGREE = 44
#: Bits kept of each place, one in each plane of two 64-bit words; places that differ agree in them once in 64 times.
PLANES = 6
#: Rounds in which the texts of a bucket are compared with one of them.
ROUNDS = 2
#: Bits of a bag's map.
BITS = 2048


_WORD_HASH: dict[bytes, int] = {}


def shingles(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, hash, weight) of the distinct shingles of documents that all have words.

    A hash has 44 bits beside the document's number, which tell the shingles of one document apart.
    """
    known = _WORD_HASH
    if len(known) > 150_000:
        known.clear()
    flat = [w for ws in words for w in ws]
    for w in set(flat).difference(known):
        known[w] = xxhash.xxh64_intdigest(w)
    h = np.fromiter(map(known.__getitem__, flat), np.uint64, len(flat))
    size = np.array([len(ws) for ws in words], np.int64)
    begin = np.cumsum(size) - size
    doc = np.repeat(np.arange(len(words)), size)
    place = np.arange(len(h)) - begin[doc]
    starts = np.flatnonzero((place + WORDS <= size[doc]) | (place == 0))
    out = np.zeros(len(starts), np.uint64)
    left = size[doc[starts]] - place[starts]  # words from here on; a short text is one shingle
    h = np.append(h, np.zeros(WORDS, np.uint64))
    with np.errstate(over="ignore"):
        for i in range(WORDS):
            out = out * np.uint64(0x9E3779B97F4A7C15) + np.where(i < left, h[starts + i], np.uint64(i))
            out ^= out >> np.uint64(29)
    key = (doc[starts].astype(np.uint64) << np.uint64(44)) | (splitmix(out) >> np.uint64(20))
    key, n = np.unique(key, return_counts=True)
    return (key >> np.uint64(44)).astype(np.int64), splitmix(key & np.uint64((1 << 44) - 1)), n.astype(np.float64)


def _unit(x: np.ndarray) -> np.ndarray:
    """Numbers over 0 to 1 from hashes."""
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def signatures(doc: np.ndarray, hashes: np.ndarray, weights: np.ndarray, n_docs: int) -> np.ndarray:
    """BagMinHash signatures, a row a document: the identity of the first point of each place."""
    total = np.bincount(doc, weights, n_docs)
    owner, seed, rate, low, limit = [doc], [hashes], [np.ones(len(doc))], [np.zeros(len(doc))], [weights]
    width, level = 1.0, 1
    more = weights > 1
    while more.any():  # level (width, 2 * width]
        k = int(more.sum())
        owner.append(doc[more])
        seed.append(splitmix(hashes[more] ^ np.uint64(level * 0x9E37)))
        rate.append(np.full(k, width))
        low.append(np.full(k, width))
        limit.append(weights[more])
        width, level = 2 * width, level + 1
        more = weights > width
    process = [np.concatenate(x) for x in (owner, seed, rate, low, limit)]
    out = np.zeros((n_docs, PLACES), np.uint64)
    until = PLACES * (np.log(PLACES) + 2.5) / np.maximum(total, 1)
    open_docs = total > 0
    while open_docs.any():
        d, s, r, lo, li = (x[open_docs[process[0]]] for x in process)
        end, t, step = until[d], np.zeros(len(d)), 0
        found: list[tuple] = []
        while len(d):  # the next point of each process that is not past the end
            step += 1
            with np.errstate(over="ignore"):
                point = splitmix(s + np.uint64(step * 0xD1342543DE82EF95 & (1 << 64) - 1))
            t = t - np.log(_unit(point)) / r
            on = t <= end
            d, s, r, lo, li, end, t, point = (x[on] for x in (d, s, r, lo, li, end, t, point))
            # the weight inside the level: bit by bit, halves of halves
            ok = lo + r * _unit(splitmix(point ^ np.uint64(0xA5A5))) < li
            found.append((d[ok], t[ok], point[ok]))
        d, t, point = (np.concatenate(x) for x in zip(*found))
        name = splitmix(point + np.uint64(0x5851))
        place = (((name >> np.uint64(32)) * np.uint64(PLACES)) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(-t, kind="stable")
        cell = d * PLACES + place
        out.ravel()[cell[order]] = name[order]  # the earliest is written last
        full = np.bincount(np.unique(cell) // PLACES, minlength=n_docs) == PLACES
        open_docs &= ~full
        until = until * 2
    return out


def bands(sigs: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band, of each signature."""
    x = sigs.reshape(len(sigs), BANDS, ROWS)
    out = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), x.shape[:2])
    for r in range(ROWS):
        out = splitmix(out ^ x[:, :, r])
    return out.view(np.int64)


def planes(sigs: np.ndarray) -> np.ndarray:
    """``PLANES`` bits of each place, a row a signature: bit j of all places lies in the words 2 j and 2 j + 1."""
    out = np.zeros((len(sigs), PLANES, 128), np.uint8)
    for j in range(PLANES):
        out[:, j, :PLACES] = (sigs >> np.uint64(63 - j)) & np.uint64(1)
    return np.packbits(out, axis=2).view(np.int64).reshape(len(sigs), 2 * PLANES)


def signed(texts: list[bytes]) -> tuple[list[int], list[bytes], list[int], np.ndarray, np.ndarray]:
    """Places of the texts with words, digests of their words, sizes of their bags, their signatures and their band keys."""
    words = [t.lower().split() for t in texts]  # of bytes, lower() changes A-Z only
    at = [i for i, w in enumerate(words) if w]
    words = [words[i] for i in at]
    sigs = signatures(*shingles(words), len(words)) if at else np.empty((0, PLACES), np.uint64)
    return at, [xxhash.xxh3_128_digest(b" ".join(w)) for w in words], [max(1, len(w) - WORDS + 1) for w in words], sigs, bands(sigs)


def overlap(a: bytes, b: bytes) -> float:
    """Exact weighted Jaccard similarity of the shingle bags of two texts."""
    bags = []
    for t in (a, b):
        w = t.lower().split()
        n = min(WORDS, len(w))
        bags.append(Counter(zip(*(w[i:len(w) - n + 1 + i] for i in range(n)))) if n else Counter())
    x, y = bags
    both = sum((x & y).values())
    return both / max(1, sum(x.values()) + sum(y.values()) - both)


def band_keys(docs: DataFrame) -> DataFrame:
    """(doc_id, row, words, n, sig, keys) of documents with words: digest of the words, size of the bag, the planes of
    the signature, and the band keys."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 4 << 20):
            at, words, n, sigs, keys = signed(utf8_rows(b, "text"))
            ends = np.arange(len(at) + 1, dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(at, pa.int64())), b.column("row").take(pa.array(at, pa.int64())), pa.array(words, pa.binary()), pa.array(n, pa.int32()),
                 pa.ListArray.from_arrays(pa.array(ends * (2 * PLANES)), pa.array(planes(sigs).ravel())),
                 pa.ListArray.from_arrays(pa.array(ends * BANDS), pa.array(keys.ravel()))],
                names=["doc_id", "row", "words", "n", "sig", "keys"])

    return docs.select("doc_id", "row", "text").mapInArrow(run, f"doc_id {id_type}, row long, words binary, n int, sig array<long>, keys array<long>")


def in_reach(n: Column, m: Column, x: Column, y: Column, similarity: float) -> Column:
    """Whether bags of n and m shingles can be alike enough, and their signatures agree in ``AGREE`` places."""
    unlike = F.lit(0)
    for half in range(2):  # a place differs if it does in any plane
        any_ = [F.get(x, F.lit(2 * j + half)).bitwiseXOR(F.get(y, F.lit(2 * j + half))) for j in range(PLANES)]
        unlike = unlike + F.bit_count(reduce(Column.bitwiseOR, any_))
    return (F.least(n, m) >= F.greatest(n, m) * F.lit(similarity)) & (unlike <= PLACES - AGREE)


def likely(pairs: DataFrame, sigs: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) that can be alike enough, from (rep, n, sig)."""
    return (pairs.join(sigs.select(F.col("rep").alias("a"), "n", F.col("sig").alias("x")), "a")
            .join(sigs.select(F.col("rep").alias("b"), F.col("n").alias("m"), F.col("sig").alias("y")), "b")
            .where(in_reach(*map(F.col, ("n", "m", "x", "y")), similarity)).select("a", "b"))


def texts_of(reps: DataFrame, docs: DataFrame) -> DataFrame:
    """(rep, text) of the texts asked for."""
    return docs.select(F.col("row").alias("rep"), "text").join(reps, "rep", "left_semi").dropDuplicates(["rep"])


def verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose bags overlap enough, from (rep, text)."""
    both = (pairs.join(texts.select(F.col("rep").alias("a"), F.col("text").alias("text")), "a")
            .join(texts.select(F.col("rep").alias("b"), F.col("text").alias("other")), "b"))
    types = f"a {both.schema['a'].dataType.simpleString()}, b {both.schema['b'].dataType.simpleString()}, near boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 4 << 20):
            near = [overlap(x, y) >= similarity for x, y in zip(utf8_rows(b, "text"), utf8_rows(b, "other"))]
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(near, pa.bool_())], names=["a", "b", "near"])

    return both.select("a", "b", "text", "other").mapInArrow(run, types).where("near").select("a", "b")


def bags(texts: DataFrame) -> DataFrame:
    """(rep, bag, map): a text's shingles as hashes, the k-th of equal ones told apart from the others, and ``BITS`` bits,
    of which each sets one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 1 << 20):
            words = [t.lower().split() for t in utf8_rows(b, "text")]
            doc, hashes, weight = shingles(words) if words else (np.empty(0, np.int64),) * 3
            times = weight.astype(np.int64)
            first = np.repeat(np.cumsum(times) - times, times)
            again = (np.arange(len(first)) - first).astype(np.uint64)
            with np.errstate(over="ignore"):
                each = splitmix(np.repeat(hashes, times) + again * np.uint64(0x9E3779B97F4A7C15))
            owner = np.repeat(doc, times)
            ends = np.searchsorted(owner, np.arange(len(words) + 1)).astype(np.int32)
            bits = np.zeros((len(words), BITS), np.uint8)
            bits[owner, (each % np.uint64(BITS)).astype(np.int64)] = 1
            maps = np.packbits(bits, axis=1).view(np.int64).ravel()
            at = np.arange(len(words) + 1, dtype=np.int32) * (BITS // 64)
            yield pa.RecordBatch.from_arrays([b.column("rep"), pa.ListArray.from_arrays(pa.array(ends), pa.array(each.view(np.int64))),
                                              pa.ListArray.from_arrays(pa.array(at), pa.array(maps))], names=["rep", "bag", "map"])

    return texts.select("rep", "text").mapInArrow(run, "rep long, bag array<long>, map array<long>")


def maps_allow(n: Column, m: Column, x: Column, y: Column, similarity: float) -> Column:
    """Whether bags of n and m shingles can be alike enough: bits that differ are of shingles that are in one bag alone."""
    unlike = F.aggregate(F.zip_with(x, y, lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda total, k: total + k)
    return unlike * F.lit(1 + similarity) <= (n + m) * F.lit(1 - similarity) + F.lit(1e-6)


def alike(x: Column, y: Column, similarity: float) -> Column:
    """Whether two bags overlap enough. What is shared is named once, as Spark works out what is named twice before
    it looks at the tests to the left."""
    return F.size(F.array_intersect(x, y)) * F.lit(1 + similarity) >= (F.size(x) + F.size(y)) * F.lit(similarity) - F.lit(1e-6)


def labelled(members: DataFrame, links: DataFrame) -> DataFrame:
    """(rep, label): the least of the texts that chains of links join to each text."""
    found = components(links).withColumnRenamed("id", "rep")
    return written(members.join(found, "rep", "left").select("rep", F.coalesce("label", "rep").alias("label")), "labels")


def ordered(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def links_of_buckets(in_band: DataFrame, sigs: DataFrame, docs: DataFrame, similarity: float) -> DataFrame:
    """(a, b): links enough to join all texts (rep, band, key) that chains of links within buckets join."""
    size = in_band.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    buckets = written(in_band.join(size, ["band", "key"]), "buckets")
    weight = buckets.groupBy("rep").agg(F.sum("n").alias("weight"))
    members = written(weight, "members")
    texts = written(texts_of(members.select("rep"), docs), "near_texts")  # the texts of all others are not shuffled again
    links = tested = label = None
    for turn in range(ROUNDS):
        if label is None:  # every text is a component of its own
            open_ = buckets.join(members, "rep").withColumn("label", F.col("rep"))
            order = F.struct(-F.col("weight"), "rep")
        else:
            open_ = _open(buckets, label)
            order = F.xxhash64("rep", "band", "key", F.lit(turn))
        heads = open_.groupBy("band", "key").agg(F.min(F.struct(order.alias("order"), F.col("rep").alias("head"), F.col("label").alias("to"))).alias("h"))
        star = (open_.join(heads, ["band", "key"]).where("label <> h.to")
                .select("rep", F.col("h.head").alias("head")).select(*ordered("rep", "head")).distinct())
        star = written(star if tested is None else star.join(tested, ["a", "b"], "left_anti"), "pairs")
        found = written(verified(written(likely(star, sigs, similarity), "likely"), texts, similarity), "near")
        tested = star if tested is None else tested.unionByName(star)
        if label is not None and found.isEmpty():
            continue
        links = found if links is None else links.unionByName(found)
        label = labelled(members.select("rep"), links)
    # what lies in one bucket and is still apart: every pair, compared within the joins
    meeting = written(_open(buckets, label).select("rep", "label").distinct(), "meeting")
    if meeting.isEmpty():
        return links
    bag = written(bags(texts.join(meeting, "rep", "left_semi")).join(sigs, "rep"), "bags")
    apart = written(_open(buckets, meeting).select("band", "key", "rep", "label"), "apart")
    x, y = _sides(apart.join(bag.select("rep", "n", "sig", "map"), "rep"))
    possible = [in_reach(*map(F.col, ("n", "m", "sig", "so")), similarity), maps_allow(*map(F.col, ("n", "m", "map", "mo")), similarity)]
    found = x.join(y, _tests([F.col("band") == F.col("band_o"), F.col("key") == F.col("key_o"), F.col("label") != F.col("lo"), *possible]), "left_semi")
    found = written(found.select("rep", "label").distinct(), "meeting")
    kept = written(shared_enough(bag.select("rep", "bag").join(found, "rep"), similarity), "shared")
    # two texts are compared under the first band that they share
    apart = written(_open(buckets, kept).select("band", "key", "rep", "label"), "apart")
    bits = bag.select("rep", "n", "sig", "keys", "map")
    x, y = _sides(apart.join(bits, "rep").withColumn("before", F.slice("keys", F.lit(1), F.col("band"))).drop("keys"))
    rest = x.join(y, _tests([F.col("band") == F.col("band_o"), F.col("key") == F.col("key_o"), F.col("label") < F.col("lo"),
                             possible[0], ~F.arrays_overlap("before", "bo"), possible[1]]))
    rest = written(rest.select(*ordered("rep", "o")).distinct(), "possible")
    return links.unionByName(written(overlapping(rest, bag, similarity), "rest"))


def overlapping(pairs: DataFrame, bag: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose bags (rep, bag) overlap enough."""
    return (pairs.join(bag.select(F.col("rep").alias("a"), F.col("bag").alias("x")), "a")
            .join(bag.select(F.col("rep").alias("b"), F.col("bag").alias("y")), "b")
            .where(alike(F.col("x"), F.col("y"), similarity)).select("a", "b"))


def _tests(tests: list[Column]) -> Column:
    return reduce(Column.__and__, tests)


def _sides(apart: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of texts and buckets under the names of each side of a join."""
    names = {"band": "band_o", "key": "key_o", "rep": "o", "label": "lo", "n": "m", "sig": "so", "before": "bo", "map": "mo"}
    names = {c: to for c, to in names.items() if c in apart.columns}
    return apart.select(*names), apart.select(*(F.col(c).alias(to) for c, to in names.items()))


def shared_enough(bag: DataFrame, similarity: float) -> DataFrame:
    """(rep, label) of the texts of whose bags (rep, label, bag) enough occurs in other components too."""
    grams = bag.select("rep", "label", F.size("bag").alias("n"), F.explode("bag").alias("gram"))
    several = grams.groupBy("gram").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi")
    found = grams.join(several.select("gram"), "gram", "left_semi").groupBy("rep", "label", "n").agg(F.count(F.lit(1)).alias("k"))
    return found.where(F.col("k") >= F.col("n") * F.lit(similarity)).select("rep", "label")


def _open(buckets: DataFrame, label: DataFrame) -> DataFrame:
    """The rows of the buckets that hold more than one component, with their labels."""
    rows = buckets.select("band", "key", "rep").join(label, "rep")
    unlike = rows.groupBy("band", "key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi")
    return rows.join(unlike.select("band", "key"), ["band", "key"])


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id, class_size) of every document: the least id of the documents that chains
    of near-duplicates join to it."""
    every = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = every.where("doc_id is not null").withColumn("row", F.xxhash64("doc_id", "text"))
    keyed = written(band_keys(rows), "bands")
    same = keyed.groupBy("words").agg(F.min("row").alias("rep"), F.min(F.struct("n", "sig", "keys")).alias("s"))
    same = written(same.select("words", "rep", "s.n", "s.sig", "s.keys"), "copies")
    links = links_of_buckets(same.select("rep", F.posexplode("keys").alias("band", "key")), same.select("rep", "n", "sig", "keys"), rows, similarity)
    of = keyed.select("doc_id", "words").join(same.select("words", "rep"), "words").select("doc_id", "rep").distinct()
    # the texts of one id belong together
    several = of.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a <> z")
    links = links.unionByName(of.join(several, "doc_id").where("rep <> a").select("a", F.col("rep").alias("b")))
    label = components(links).withColumnRenamed("id", "rep")
    of = written(of.join(label, "rep", "left").select("doc_id", F.coalesce("label", "rep").alias("label")).distinct(), "labels")
    size = of.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    # texts without words, and rows without an id
    alone = every.select("doc_id").distinct().join(of.select("doc_id"), "doc_id", "left_anti").select(
        "doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"))
    return of.join(size, "label").select("doc_id", "class_id", "class_size").unionByName(alone)
