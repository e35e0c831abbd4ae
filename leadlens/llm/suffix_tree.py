"""Language-model scores from a probabilistic suffix tree, beside a smoothed unigram base.

A text is read as its words, lower-cased (A-Z), joined by single spaces and closed by an end. The
tree's symbols are the UTF-8 bytes of that string, so no word is unknown to it; its contexts are the
up to ``DEPTH`` bytes before. Counts of every string of ``DEPTH`` + 1 bytes are gathered over all
training texts; those of the shorter contexts are their sums. A context is a candidate if it holds
at least the share ``P_MIN`` of all positions, which bounds the tree at any corpus size (1 / P_MIN
contexts of a length), and is kept if its next-symbol distribution diverges from that of its suffix:
the likelihood ratio statistic 2 n KL must exceed ``PENALTY`` for each of its symbols. The suffixes
of a kept context are kept. Distributions are smoothed by absolute discounting: ``DISCOUNT`` comes off
each seen count, and what that frees goes by the suffix's distribution.
A position is scored by the longest kept suffix of what comes before it.

The base needs the corpus count of every word. Words that hold the share ``HOT`` of all tokens, at
most 1 / HOT of them, are shipped to the tasks; each text's other words are joined with the table of
word counts, so neither table size nor any frequent word falls on one task.

Nulls and odd rows: a null text is an empty one: only the end is scored. Without training texts every
count is 0. Repeated rows are scored alike, and count as often as they occur. A null id belongs to
the training part (it has no remainder). Texts are read whole; further columns are not read.
"""

from __future__ import annotations

import io
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadlens.llm.common import ship_file, slices, utf8_rows, written

DEPTH, P_MIN, PENALTY, DISCOUNT, HOT = 5, 2e-6, 4.0, 0.75, 1e-6
END = 10  # no word holds a line feed, so it closes texts
#: Distinct strings and words that a task holds before it passes them on.
HELD_STRINGS, HELD_WORDS = 3_000_000, 300_000


def line(text: bytes) -> bytes:
    return b" ".join(text.lower().split()) + b"\n"  # of bytes, lower() changes A-Z only


def strings(lines: list[bytes]) -> np.ndarray:
    """For each byte of the lines, it and the ``DEPTH`` bytes before as one number; lines follow ends."""
    data = np.frombuffer(bytes([END]) * DEPTH + (bytes([END]) * DEPTH).join(lines), np.uint8).astype(np.uint64)
    out = np.zeros(len(data) - DEPTH, np.uint64)
    for i in range(DEPTH + 1):
        out = (out << np.uint64(8)) | data[i:len(data) - DEPTH + i]
    size = np.array([len(x) for x in lines])
    # positions of the filling between lines are left out
    keep = np.ones(len(out), bool)
    at = np.cumsum(size)[:-1] + np.arange(len(lines) - 1) * DEPTH
    for i in range(DEPTH):
        keep[at + i] = False
    return out[keep]


def count_rows(train: DataFrame) -> DataFrame:
    """(string, word, n): partial counts of byte strings and of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        words: Counter = Counter()

        def merged():
            keys = np.concatenate([k for k, _ in held])
            order = np.argsort(keys)
            keys, n = keys[order], np.concatenate([c for _, c in held])[order]
            first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            return keys[first], np.add.reduceat(n, first)

        def out_strings(keys, n):
            for lo in range(0, len(keys), 50_000):
                k = keys[lo:lo + 50_000].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.nulls(len(k), pa.binary()), pa.array(n[lo:lo + 50_000])],
                                                 names=["string", "word", "n"])

        def out_words():
            items = sorted(words.items())
            for lo in range(0, len(items), 50_000):
                w, n = zip(*items[lo:lo + 50_000])
                yield pa.RecordBatch.from_arrays([pa.nulls(len(w), pa.int64()), pa.array(w, pa.binary()), pa.array(n, pa.int64())],
                                                 names=["string", "word", "n"])

        for b in slices(batches, "text", 4 << 20):
            lines = [line(t) for t in utf8_rows(b, "text")]
            keys, n = np.unique(strings(lines), return_counts=True)
            held.append((keys, n.astype(np.int64)))
            if len(held) > 4:
                held = [merged()]
                if len(held[0][0]) > HELD_STRINGS:
                    yield from out_strings(*held.pop())
            for x in lines:
                words.update(x[:-1].split(b" ") if len(x) > 1 else ())
            words[b""] += len(lines)  # the end token
            if len(words) > HELD_WORDS:
                yield from out_words()
                words = Counter()
        if held:
            yield from out_strings(*merged())
        yield from out_words()

    return train.select("text").mapInArrow(run, "string long, word binary, n long")


class Tree:
    """Kept contexts by length, as sorted arrays: contexts with their back-off, strings with theirs."""

    def __init__(self, levels: list[dict]):
        self.levels = levels

    @classmethod
    def build(cls, counts: list[tuple[np.ndarray, np.ndarray]]) -> "Tree":
        """From (strings, n) of the candidate contexts of each length, from the root on."""
        levels: list[dict] = []
        prob: list[np.ndarray] = []
        data = []
        for k, (key, n) in enumerate(counts):
            order = np.argsort(key)
            key, n = key[order], n[order].astype(float)
            ctx = key >> np.uint64(8)
            first = np.flatnonzero(np.r_[True, ctx[1:] != ctx[:-1]]) if len(key) else np.zeros(0, np.int64)
            of = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(key)]))
            total = np.add.reduceat(n, first) if len(key) else np.zeros(0)
            if k == 0:
                full = np.full(256, 0.5)
                full[key.astype(np.int64)] += n
                key, p = np.arange(256, dtype=np.uint64), full / full.sum()
                data.append((key, np.zeros(1, np.uint64), np.ones(1, bool), np.ones(1)))
                prob.append(p)
                continue
            mask = np.uint64((1 << (8 * k)) - 1)
            parent = prob[-1][np.searchsorted(data[-1][0], key & mask)]  # a suffix occurs as often at least
            symbols = np.diff(np.r_[first, len(key)])
            # absolute discounting: what is taken off the seen symbols goes by the suffix's distribution
            back = DISCOUNT * symbols / total
            p = (n - DISCOUNT) / total[of] + back[of] * parent
            statistic = np.add.reduceat(2 * n * np.log(n / total[of] / parent), first) if len(key) else np.zeros(0)
            data.append((key, ctx[first], statistic > PENALTY * symbols, back))
            prob.append(p)
        for k in range(len(data) - 1, 1, -1):  # a kept context keeps its suffixes
            mask = np.uint64((1 << (8 * (k - 1))) - 1)
            data[k - 1][2][np.searchsorted(data[k - 1][1], data[k][1][data[k][2]] & mask)] = True
        for (key, ctx, keep, back), p in zip(data, prob):
            mine = keep[np.searchsorted(ctx, key >> np.uint64(8))] if len(ctx) else np.zeros(0, bool)
            levels.append({"key": key[mine], "logp": np.log10(p[mine]), "ctx": ctx[keep], "back": np.log10(back[keep])})
        return cls(levels)

    def scores(self, keys: np.ndarray) -> np.ndarray:
        """log10 probability of the last byte of each string after those before it."""
        out = np.zeros(len(keys))
        todo = np.arange(len(keys))
        for k in range(len(self.levels) - 1, -1, -1):
            level = self.levels[k]
            own = keys[todo] & np.uint64((1 << (8 * (k + 1))) - 1)
            at, hit = _find(level["key"], own)
            out[todo[hit]] += level["logp"][at[hit]]
            todo, own = todo[~hit], own[~hit]
            if k:  # the context may be kept without this symbol
                at, hit = _find(level["ctx"], own >> np.uint64(8))
                out[todo[hit]] += level["back"][at[hit]]
        return out

    def dump(self) -> bytes:
        buf = io.BytesIO()
        np.savez(buf, **{f"{name}{k}": a for k, level in enumerate(self.levels) for name, a in level.items()})
        return buf.getvalue()

    @classmethod
    def load(cls, path: str) -> "Tree":
        with np.load(path) as z:
            return cls([{n: z[f"{n}{k}"] for n in ("key", "logp", "ctx", "back")} for k in range(len(z.files) // 4)])


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.searchsorted(table, keys)
    at[at == len(table)] = 0
    return at, table[at] == keys


def fit(train: DataFrame) -> tuple[Tree, DataFrame, int, int]:
    """The tree, the table (word, n), the number of tokens and of distinct tokens."""
    part = written(count_rows(train).groupBy("string", "word").agg(F.sum("n").alias("n")), "lm_counts")
    strings_ = part.where("string is not null").select("string", "n")
    words = part.where("string is null").select("word", "n")
    total = strings_.agg(F.sum("n")).first()[0] or 0
    counts = []
    for k in range(DEPTH + 1):
        key = F.col("string").bitwiseAND(F.lit((1 << (8 * (k + 1))) - 1))
        level = strings_.groupBy(key.alias("key")).agg(F.sum("n").alias("n"))
        if k:
            whole = F.sum("n").over(Window.partitionBy(F.shiftright("key", 8)))
            level = level.withColumn("whole", whole).where(F.col("whole") >= F.lit(total * P_MIN))
        got = level.select("key", "n").toArrow()  # bounded by P_MIN
        counts.append((got["key"].to_numpy().astype(np.uint64), got["n"].to_numpy().astype(np.int64)))
    tokens, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    return Tree.build(counts), words, tokens, distinct


_LOADED: dict[str, object] = {}


def _load(tree_file: str, hot_file: str):
    from pyspark import SparkFiles

    if (tree_file, hot_file) not in _LOADED:
        import pickle

        with open(SparkFiles.get(hot_file), "rb") as f:
            _LOADED.clear()
            _LOADED[tree_file, hot_file] = Tree.load(SparkFiles.get(tree_file)), pickle.load(f)
    return _LOADED[tree_file, hot_file]


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held: int = 1) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every text, learnt
    from those whose crc32 of the id, as text, has another remainder than ``held``."""
    import pickle

    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rest = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds, F.lit(folds))
    tree, words, tokens, distinct = fit(rows.where(rest != held))
    hot = words.where(F.col("n") >= F.lit(max(2, tokens * HOT))).select("word", "n").toArrow()
    below = float(tokens + 0.5 * (distinct + 1))
    tree_file = ship_file(spark, tree.dump(), "suffix-tree", ".npz")
    known = dict(zip(hot["word"].to_pylist(), np.log10((hot["n"].to_numpy() + 0.5) / below).tolist()))
    hot_file = ship_file(spark, pickle.dumps(known), "hot-words", ".bin")
    del hot, known, tree

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = _load(tree_file, hot_file)
        row = TaskContext.get().partitionId() << 33
        for b in slices(batches, "text", 2 << 20):
            lines = [line(t) for t in utf8_rows(b, "text")]
            keys = strings(lines)
            order = np.argsort(keys)
            sorted_ = keys[order]
            first = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]])
            value = np.empty(len(keys))
            value[order] = np.repeat(model.scores(sorted_[first]), np.diff(np.r_[first, len(keys)]))
            begin = np.cumsum([0, *map(len, lines)][:-1])
            total = np.add.reduceat(value, begin)
            out = []
            for x in lines:
                tf = Counter(x[:-1].split(b" ") if len(x) > 1 else ())
                tf[b""] = 1
                base, n_hot, cold = 0.0, 0, []
                for w, n in tf.items():
                    p = known.get(w)
                    if p is None:
                        cold.append((w, n))
                    else:
                        base += n * p
                        n_hot += n
                out.append((sum(tf.values()), n_hot, base, cold))
            n, n_hot, base, cold = zip(*out)
            ends = np.cumsum([0, *map(len, cold)]).astype(np.int32)
            flat = [c for cs in cold for c in cs]
            pair = pa.StructArray.from_arrays([pa.array([w for w, _ in flat], pa.binary()), pa.array([k for _, k in flat], pa.int64())],
                                              names=["word", "tf"])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(row, row + len(lines)), pa.int64()), b.column("doc_id"), b.column("held_out"),
                 pa.array(n, pa.int64()), pa.array(n_hot, pa.int64()), pa.array(base, pa.float64()), pa.array(total),
                 pa.ListArray.from_arrays(pa.array(ends), pair)],
                names=["row", "doc_id", "held_out", "n_tokens", "n_hot", "base", "score", "cold"])
            row += len(lines)

    id_type = rows.schema["doc_id"].dataType.simpleString()
    scored = written(rows.withColumn("held_out", rest == held).select("doc_id", "text", "held_out").mapInArrow(
        run, f"row long, doc_id {id_type}, held_out boolean, n_tokens long, n_hot long, base double, score double, "
             "cold array<struct<word: binary, tf: long>>"), "lm_scored")
    cold = scored.select("row", F.explode("cold").alias("c")).select("row", "c.word", "c.tf")
    # counts of hot words are at hand; of the others only those that some text asks for are met
    cold = cold.join(words, "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    cold = cold.groupBy("row").agg(F.sum(F.col("tf") * F.log10((F.col("n") + 0.5) / F.lit(below))).alias("cold_base"),
                                   F.sum(F.when(F.col("n") > 0, F.col("tf")).otherwise(0)).alias("n_cold"))
    return (scored.drop("cold").join(cold, "row", "left")
            .select("doc_id", "held_out", "n_tokens", (F.col("n_hot") + F.coalesce("n_cold", F.lit(0))).alias("n_known"),
                    F.lit(tokens).cast("long").alias("train_tokens"),
                    (F.col("base") + F.coalesce("cold_base", F.lit(0.0))).alias("base_score"), "score"))
