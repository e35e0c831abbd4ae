"""Helpers the training-data operators share: batches, shared files, components."""

from __future__ import annotations

import gc
import hashlib
import io
import os
import uuid
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadlens.session import ensure_checkpoint_dir, work_dir

#: Java and DuckDB pattern of what separates words; ``bytes.split()`` splits on the same six bytes.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\r\x0b\x0c"
#: Rows of one Arrow batch; texts vary from nothing to megabytes, so batches stay small.
BATCH_ROWS = 256


def prepare(spark: SparkSession) -> None:
    """Session settings of the queries: UTC, small Arrow batches, the package on every worker."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    ensure_checkpoint_dir(spark)
    ship_package(spark)


def put_bytes(spark: SparkSession, data: bytes, name: str) -> str:
    """Write one small driver-made file into the shared folder; its URI."""
    uri = work_dir(spark, name)
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(uri)
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    return path.toString()


def ship_file(spark: SparkSession, data: bytes, stem: str, suffix: str = "") -> str:
    """Give every executor a local copy of ``data``; the name for ``SparkFiles.get``.

    The file lies in the shared folder, from which each executor fetches its own copy, also one
    that starts later. The name holds a digest, so equal contents are shipped once.
    """
    name = f"{stem}-{hashlib.sha256(data).hexdigest()[:16]}{suffix}"
    sc = spark.sparkContext
    done = getattr(sc, "_leadlens_files", None)
    if done is None:
        done = sc._leadlens_files = set()
    if name not in done:
        uri = put_bytes(spark, data, name)
        if suffix == ".zip":
            sc.addPyFile(uri)
        else:
            sc.addFile(uri)
        done.add(name)
    return name


def ship_package(spark: SparkSession) -> None:
    """Send this package's sources to the workers, which then need no installed copy."""
    import leadlens

    root = os.path.dirname(os.path.abspath(leadlens.__file__))
    if not os.path.isdir(root):  # imported from an archive, which the launcher has shipped already
        return
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        for d, dirs, names in sorted(os.walk(root)):
            dirs.sort()
            for n in sorted(names):
                if n.endswith(".py"):
                    p = os.path.join(d, n)
                    info = zipfile.ZipInfo(os.path.relpath(p, os.path.dirname(root)))
                    with open(p, "rb") as f:
                        z.writestr(info, f.read())
    ship_file(spark, buf.getvalue(), "leadlens", ".zip")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts the lineage.

    What was shuffled to make it is of no more use. Spark deletes shuffle files when the driver
    collects the plans that made them, which an idle driver does late; so it is asked to.
    """
    spark = df.sparkSession
    path = work_dir(spark, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return back


def utf8_rows(batch: pa.RecordBatch, text: str) -> list[bytes]:
    """The texts of a batch as UTF-8 bytes, null as empty."""
    return [b if b is not None else b"" for b in batch.column(text).cast(pa.binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], text: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``max_bytes`` of text (one longer text stays whole)."""
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        size = np.asarray(_lengths(b.column(text)), dtype=np.int64)
        group = (np.cumsum(size) - size) // max_bytes
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), n]
        for lo, hi in zip(cuts, cuts[1:]):
            yield b.slice(lo, hi - lo)


def _lengths(col: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)


def splitmix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: a well-mixed hash of 64-bit integers."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem = f"_{stem}"
    return stem


def n_words(text) -> "F.Column":
    """Number of words of a text column; null has none."""
    return F.coalesce(F.size(F.array_remove(F.split(text, SPACE), "")), F.lit(0)).cast("long")


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(id, label): the least id of each id's connected component, over edges (a, b), a <> b.

    Every round gives each node the least label around it and the label of that label, so long
    chains shrink by half. Rounds are written to the shared folder; none is kept in executors.
    """
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
                   .distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("a")).alias("label")), "labels")
    for _ in range(max_rounds):
        near = (both.join(labels.select(F.col("id").alias("b"), "label"), "b")
                .groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near")))
        best = labels.join(near, "id").select("id", F.col("label").alias("old"),
                                              F.least("label", "near").alias("label"))
        jump = labels.select(F.col("id").alias("label"), F.col("label").alias("next"))
        new = written(best.join(jump, "label", "left")
                      .select("id", "old", F.least("label", F.coalesce("next", "label")).alias("label")), "labels")
        labels = new.select("id", "label")
        if new.where("old <> label").isEmpty():
            return labels
    raise RuntimeError("the components did not settle")
