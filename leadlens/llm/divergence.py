"""Quality rules by distribution divergence.

Each language has two references, gathered over all of its documents: how its text divides into
character classes, and how its words divide into its most common words and the rest. A document is
compared with them by the Jensen-Shannon distance (base 2, so 0 to 1); it is rejected where a
distance is over its bound from every reference, its own language's first. Documents under the
minimum length have too small a histogram to be judged by it, and only the plain counts hold.

A language whose documents hold too few words for a reference cannot be judged by the references of
others: only the base rule decides on its documents, and their distances are null.

Nulls and odd rows: a null or empty text has no words, so it fails the base rule. A null language
names none, so it is compared with the nearest reference of all. With no reference at all (an empty
table) nothing is rejected by distance. Rows that repeat are judged
alike; further columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadlens.llm.common import SPACES, slices, utf8_rows

#: Character classes by UTF-8 byte; a character counts by its first byte.
CLASSES = ("space", "lower", "upper", "digit", "stop", "mark", "latin_more", "other_script", "none")
_SYMBOLS = (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")


def class_table() -> np.ndarray:
    """Class number of each byte value."""
    t = np.full(256, CLASSES.index("mark"), dtype=np.uint8)
    for name, chars in (("space", SPACES), ("lower", "abcdefghijklmnopqrstuvwxyz"),
                        ("upper", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("digit", "0123456789"), ("stop", ".,;:'\"-()?")):
        t[[ord(c) for c in chars]] = CLASSES.index(name)
    t[0x80:0xC0] = CLASSES.index("none")  # inside a character
    t[0xC0:0xCA] = CLASSES.index("latin_more")
    t[0xCA:] = CLASSES.index("other_script")
    return t


@dataclass(frozen=True)
class Rules:
    """min_words: guard of the base rule; judge_words, judge_chars: least length for the distances;
    top: common words of a reference; ref_words: least words of a language with a reference;
    max_char, max_word: bounds of the distances."""

    min_words: int = 50
    max_repeat: float = 0.5
    judge_words: int = 50
    judge_chars: int = 200
    top: int = 100
    ref_words: int = 2000
    max_char: float = 0.30
    max_word: float = 0.55


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    words = text.split()
    n = len(words)
    inside = b"".join(words)
    chars = len(inside.decode("utf-8", "replace"))
    symbols = sum(inside.count(s) for s in _SYMBOLS)
    dup = 0
    if b"\n" in text:
        lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
        dup = len(lines) - len(set(lines))
    grams = list(zip(words, words[1:], words[2:]))
    repeat = 0
    if len(set(grams)) < len(grams):
        seen = Counter(grams)
        end = 0  # words before it are counted
        for i, g in enumerate(grams):
            if seen[g] > 1:
                repeat += i + 3 - max(i, end)
                end = i + 3
    return n, chars, symbols, dup, repeat


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance, base 2, of histograms along the last axis."""
    p = p / np.maximum(p.sum(-1, keepdims=True), 1)
    q = q / np.maximum(q.sum(-1, keepdims=True), 1)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(p > 0, p * np.log2(p / m), 0.0).sum(-1)
        b = np.where(q > 0, q * np.log2(q / m), 0.0).sum(-1)
    return np.sqrt(np.clip((a + b) / 2, 0, 1))


def references(docs: DataFrame, rules: Rules = Rules(), text_col: str = "text", lang_col: str = "lang"):
    """(language, class counts, [(word, count)], other words) for each language, over all documents.

    Every language with ``ref_words`` words has one; it holds ``top`` words, whatever the corpus.
    """
    table = class_table()
    k = len(CLASSES)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = {}
        classes: dict[str, np.ndarray] = {}

        def out():
            rows = [(lang, None, c, n) for lang, h in classes.items() for c, n in enumerate(h.tolist()) if n]
            rows += [(lang, w, None, n) for lang, c in words.items() for w, n in c.items()]
            cols = list(zip(*rows)) if rows else [[], [], [], []]
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.binary()),
                                               pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int64())],
                                              names=["lang", "word", "class", "n"])
        for b in slices(batches, "text", 4 << 20):
            for lang, text in zip(b.column("lang").to_pylist(), utf8_rows(b, "text")):
                if lang is None or not text:
                    continue
                h = np.bincount(table[np.frombuffer(text, np.uint8)], minlength=k)
                if lang not in classes:
                    words[lang], classes[lang] = Counter(), np.zeros(k, np.int64)
                classes[lang] += h
                words[lang].update(text.split())
            if sum(map(len, words.values())) > 200_000:  # what a task holds stays bounded
                yield out()
                words, classes = {}, {}
        yield out()

    part = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).mapInArrow(
        count, "lang string, word binary, class int, n long")
    total = part.groupBy("lang", "word", "class").agg(F.sum("n").alias("n"))
    from leadlens.llm.common import written
    total = written(total, "reference_counts")
    langs = written(total.where("word is not null").groupBy("lang").agg(F.sum("n").alias("words"))
                    .where(F.col("words") >= rules.ref_words), "reference_languages")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    top = (total.where("word is not null").join(langs.select("lang"), "lang").withColumn("r", rank)
           .where(F.col("r") <= rules.top))
    size = {r["lang"]: r["words"] for r in langs.collect()}
    common: dict[str, list] = {lang: [] for lang in size}
    for r in top.select("lang", "word", "n").collect():
        common[r["lang"]].append((bytes(r["word"]), r["n"]))
    classes = {lang: [0] * k for lang in size}
    for r in total.where("word is null").join(langs.select("lang"), "lang").collect():
        classes[r["lang"]][r["class"]] = r["n"]
    refs = []
    for lang in sorted(size):
        words = sorted(common[lang], key=lambda x: (-x[1], x[0]))
        refs.append((lang, classes[lang], words, size[lang] - sum(n for _, n in words)))
    return refs


RESULT = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "char_distance double, word_distance double, base_failed boolean, kept boolean")


def judge(docs: DataFrame, refs: list, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text",
          lang_col: str = "lang") -> DataFrame:
    """One row per document: its id as ``doc_id``, the counts, both distances (null under the
    minimum length, and where the document's language has no reference) and the verdict."""
    table, k = class_table(), len(CLASSES)
    id_type = docs.schema[id_col].dataType.simpleString()
    none = CLASSES.index("none")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cref = np.array([r[1] for r in refs], float).reshape(len(refs), k)
        cref[:, none] = 0
        wref = [(np.array([n for _, n in r[2]] + [r[3]], float), {w: i for i, (w, _) in enumerate(r[2])}) for r in refs]
        own = {r[0]: i for i, r in enumerate(refs)}

        def word_distance(i: int, counts: Counter, n: int) -> float:
            ref, at = wref[i]
            h = np.zeros(len(ref))
            for w, c in counts.items():
                j = at.get(w)
                if j is not None:
                    h[j] = c
            h[-1] = n - h.sum()
            return float(js_distance(h, ref))

        for b in slices(batches, "text", 4 << 20):
            rows = []
            for lang, text in zip(b.column("lang").to_pylist(), utf8_rows(b, "text")):
                n, chars, symbols, dup, repeat = base_counts(text)
                failed = n < rules.min_words or repeat > rules.max_repeat * n
                dc = dw = None
                kept = not failed
                if refs and (lang is None or lang in own) and n >= rules.judge_words and chars >= rules.judge_chars:
                    h = np.bincount(table[np.frombuffer(text, np.uint8)], minlength=k).astype(float)
                    h[none] = 0
                    chars_by = js_distance(h, cref)
                    counts = Counter(text.split())
                    order = [own[lang]] if lang in own else []
                    order += [i for i in np.argsort(chars_by, kind="stable").tolist() if i not in order]
                    for i in order:  # its own language first; the others only where that one is too far
                        c, w = float(chars_by[i]), word_distance(i, counts, n)
                        if dc is None or max(c / rules.max_char, w / rules.max_word) < max(dc / rules.max_char, dw / rules.max_word):
                            dc, dw = c, w
                        if dc <= rules.max_char and dw <= rules.max_word:
                            break
                    kept = kept and dc <= rules.max_char and dw <= rules.max_word
                rows.append((n, chars, symbols, dup, repeat, dc, dw, failed, kept))
            cols = list(zip(*rows))
            kinds = [pa.int64()] * 5 + [pa.float64()] * 2 + [pa.bool_()] * 2
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, kinds))],
                                             names=["doc_id", *(x.split()[0] for x in RESULT.split(", "))])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
                       F.col(lang_col).alias("lang")).mapInArrow(run, f"doc_id {id_type}, {RESULT}")
