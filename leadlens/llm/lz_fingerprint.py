"""Document fingerprints from Lempel-Ziv phrases.

A text is parsed into dictionary phrases: each phrase is the shortest run of bytes that was no
phrase before. The phrases are hashed as they grow, the set of hashes is mixed, and its ``SIZE``
least values, as 8 hex digits each, are the fingerprint. Two fingerprints are compared by the least
values of their union: the part that both hold estimates the share of common phrases, which follows
how much better the texts compress together.

``with_next`` goes through the documents by descending id and compares each with the next one, and
with its own edited text (its last third replaced by the start of the next text). Documents go once
to ranges of ids; the first of each range is also sent to the range before, as its successor.

Nulls and odd rows: a null text is an empty one, whose fingerprint is "". Two empty fingerprints are
alike (1), an empty one and another are not (0). The last phrase of a text counts even where it was
seen before. Rows that share an id come in the order of their texts' hashes; a null id comes last.
An only document is its own next. Ids are whole numbers for ``with_next``, of any type for
``fingerprints``. Texts are parsed whole; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlens.llm.common import prepare, slices, splitmix

SIZE = 64
_MASK, _STEP = (1 << 61) - 1, 0x1F3D5B79A2C4E687


def phrases(data: bytes, known: set[int], grow: int = 0) -> int:
    """Add the hashes of a text's phrases to ``known``; the hash of the unfinished phrase."""
    h = grow
    add = known.add
    for c in data:
        h = (h * _STEP + c + 1) & _MASK
        if h not in known:
            add(h)
            h = 0
    return h


def sketch(known: set[int]) -> np.ndarray:
    """The least mixed hashes of a phrase set, in order."""
    x = np.fromiter(known, np.uint64, len(known))
    x = (splitmix(x) >> np.uint64(32)).astype(np.uint32)
    if len(x) > 4 * SIZE:
        x = np.partition(x, 4 * SIZE - 1)[:4 * SIZE]
    return np.unique(x)[:SIZE]


def fingerprint(text: str) -> np.ndarray:
    known: set[int] = set()
    rest = phrases(text.encode(), known)
    if rest:
        known.add(rest)
    return sketch(known)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of common phrases, 0 to 1."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.union1d(a, b)[:SIZE]
    return float(np.isin(both, np.intersect1d(a, b, assume_unique=True)).sum() / len(both))


def two(text: str, other: str) -> tuple[np.ndarray, np.ndarray, str]:
    """Fingerprints of a text and of its edited text, and the edited text. What both begin with is
    parsed once."""
    n = len(text) // 3
    keep = text[:len(text) - n]
    edited = keep + other[:n]
    known: set[int] = set()
    h = phrases(keep.encode(), known)
    known_edited = set(known)
    for part, seen in ((text[len(keep):], known), (other[:n], known_edited)):
        rest = phrases(part.encode(), seen, h)
        if rest:
            seen.add(rest)
    return sketch(known), sketch(known_edited), edited


def written_hex(x: np.ndarray) -> str:
    return x.astype(">u4").tobytes().hex()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of every document."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 4 << 20):
            out = [written_hex(fingerprint(t or "")) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"doc_id {id_type}, fingerprint string")


RESULT = ("n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document, compared with its edited text and with the next by descending id."""
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.xxhash64("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    # ranges of ids: cut points only, as many as the session's shuffle partitions
    n = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = rows.agg(F.percentile_approx(F.col("doc_id").cast("double"), [i / n for i in range(1, n)], 10000)).first()[0] or []
    cuts = F.array(*[F.lit(c) for c in sorted(set(cuts))]).cast("array<double>")
    # ranges count downwards, as the order does; null ids come after all
    at = F.when(F.col("doc_id").isNull(), n).otherwise(F.size(F.filter(cuts, lambda c: c >= F.col("doc_id").cast("double"))))
    rows = rows.withColumn("range", at)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), (-F.col("doc_id").cast("decimal(38,0)")).alias("down"), "key"))
    heads = rows.groupBy("range").agg(first.alias("h")).orderBy("range").collect()  # one row a range
    if not heads:
        return rows.select("doc_id").limit(0).selectExpr("doc_id", *[
            f"cast(null as {c.split()[1]}) {c.split()[0]}" for c in RESULT.split(", ")])
    # the head of a range is the successor of the last document of the range before; the very
    # first document, of the very last one
    goes = {heads[(i + 1) % len(heads)]["range"]: h["range"] for i, h in enumerate(heads)}
    table = spark.createDataFrame([(h["range"], None if h["h"]["none"] else -h["h"]["down"], h["h"]["key"], goes[h["range"]])
                                   for h in heads], "range int, head decimal(38,0), head_key long, goes int")
    rows = (rows.join(F.broadcast(table), "range")  # a row a range, at most the shuffle partitions
            .withColumn("ghost", (F.col("doc_id").cast("decimal(38,0)").eqNullSafe(F.col("head")))
                        & (F.col("key") == F.col("head_key"))))
    to = F.when(F.col("ghost"), F.array(F.struct(F.col("range").alias("to"), F.lit(0).alias("after")),
                                        F.struct(F.col("goes").alias("to"), F.lit(1).alias("after")))
                ).otherwise(F.array(F.struct(F.col("range").alias("to"), F.lit(0).alias("after"))))
    sent = (rows.select("doc_id", "text", "key", F.explode(to).alias("x")).select("doc_id", "text", "key", "x.to", "x.after")
            .repartitionByRange(n, "to").sortWithinPartitions("to", "after", F.desc_nulls_last("doc_id"), "key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last document, until its successor comes
        out: list = []

        def close(a, nxt):
            mine, mine_edited, edited = two(a[1], nxt)
            return a, mine, mine_edited, hashlib.sha256(edited.encode()).hexdigest()

        # a document's likeness to the next needs the next one's fingerprint, which ghosts give too
        waiting = None  # closed, but for near_next
        range_now, ghost_seen = None, False

        def emit(w, nxt):
            (d, t), mine, mine_edited, sha = w
            out.append((d, len(t), sha, written_hex(mine), written_hex(mine_edited), likeness(mine, mine_edited), likeness(mine, nxt)))

        for b in slices(batches, "text", 4 << 20):
            for d, t, to_, after in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "to", "after"))):
                if to_ != range_now:
                    range_now, ghost_seen, held, waiting = to_, False, None, None
                if after and ghost_seen:
                    continue  # a second copy of the successor
                ghost_seen = bool(after)
                if held is not None:
                    done = close(held, t)
                    if waiting is not None:
                        emit(waiting, done[1])
                    waiting = done
                held = (d, t)
                if after:
                    if waiting is not None:
                        emit(waiting, fingerprint(t))
                    waiting = held = None
            if out:
                yield batch(out, id_kind(b))
                out = []

    def id_kind(b):
        return b.schema.field("doc_id").type

    def batch(out, kind):
        kinds = [kind, pa.int64()] + [pa.string()] * 3 + [pa.float64()] * 2
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)],
                                          names=["doc_id", *(c.split()[0] for c in RESULT.split(", "))])

    return sent.mapInArrow(run, f"doc_id {id_type}, {RESULT}")
