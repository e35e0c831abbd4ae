"""Streaming forms of batch operators (T1-T3), Structured Streaming only.

The reference runs stages as batch scripts; these are the incremental
equivalents for landing folders.  ``withWatermark`` needs TIMESTAMP (not
TIMESTAMP_NTZ), so event times are cast first (session zone is UTC, so the
cast does not move them).  Every query takes an explicit checkpoint
location and survives restarts from it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from leadlens.functions import expr as X
from leadlens.operators import discover as D
from leadlens.operators import mutate as M
from leadlens.operators.base import latest_label


def _read(spark: SparkSession, folder: str, schema, fmt: str = "parquet", max_files: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema).format(fmt)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.load(folder)


# ---- T1 -----------------------------------------------------------------------------------
def url_dedupe_stream(discovered: DataFrame, watermark: str = "1 day", url_state: DataFrame | None = None) -> DataFrame:
    """First sighting of each normalised URL (M4/P5 streaming).

    The stream's state drops repeats within the watermark; URLs that ``url_state`` knows already are
    dropped by an anti join with it, so one seen again after the watermark is not new again.
    """
    d = D.with_url_key(discovered).withColumn("event_time", F.col("discovered_at").cast("timestamp"))
    d = d.where(F.col("url_hash").isNotNull())
    if url_state is not None:
        d = d.join(D.with_url_key(url_state).select("url_hash").distinct(), "url_hash", "left_anti")
    return d.withWatermark("event_time", watermark).dropDuplicatesWithinWatermark(["url_hash"])


# ---- T2 -----------------------------------------------------------------------------------
def activity_stream(scores: DataFrame, pv: str, watermark: str = "1 day") -> DataFrame:
    """Daily score rows by band (A6) in event-time windows; late rows past the watermark drop."""
    s = (scores.where((F.col("prompt_version") == pv) & F.col("lead_score").isNotNull())
         .withColumn("event_time", F.col("classified_at").cast("timestamp"))
         .withWatermark("event_time", watermark))
    return (s.groupBy(F.window("event_time", "1 day").alias("w"), X.activity_band("lead_score").alias("band"))
            .agg(F.count(F.lit(1)).alias("n"))
            .select(F.to_date(F.col("w.start")).alias("day"), "band", "n"))


def start_activity(spark: SparkSession, scores_folder: str, schema, pv: str, out: str, checkpoint: str,
                   watermark: str = "1 day", available_now: bool = True) -> StreamingQuery:
    """Run T2 into Parquet in append mode: only closed windows are written."""
    q = activity_stream(_read(spark, scores_folder, schema), pv, watermark)
    w = q.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start(out)


def start_url_dedupe(spark: SparkSession, folder: str, schema, out: str, checkpoint: str,
                     watermark: str = "1 day", available_now: bool = True, url_state: DataFrame | None = None,
                     max_files: int | None = None) -> StreamingQuery:
    """Run T1 into Parquet; ``max_files`` bounds the files of a micro-batch when there is a backlog."""
    q = url_dedupe_stream(_read(spark, folder, schema, max_files=max_files), watermark, url_state)
    w = q.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start(out)


# ---- T3 -----------------------------------------------------------------------------------
def start_score_upsert(spark: SparkSession, folder: str, schema, table_path: str, checkpoint: str,
                       available_now: bool = True, max_files: int | None = None) -> StreamingQuery:
    """Score upsert (M1) as an append-only log, merged on read.

    Each micro-batch writes only its own rows, to ``{table_path}/batch_id=<id>``
    (overwrite, so a batch re-run after a failure is idempotent): the cost of
    a batch is the batch, never the table.  ``current_scores`` applies
    latest-wins over the log (a partial aggregate per key, later batch wins
    ties); ``compact`` writes that result as a snapshot, after which readers
    take the snapshot and the batches since.
    """
    def append(batch: DataFrame, batch_id: int) -> None:
        (batch.select(*schema.fieldNames()).write.mode("overwrite")
         .parquet(f"{table_path}/batch_id={batch_id:012d}"))

    w = (_read(spark, folder, schema, max_files=max_files).writeStream.foreachBatch(append)
         .option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def score_log(spark: SparkSession, table_path: str, schema) -> DataFrame:
    """All logged score rows with their batch id (partition column)."""
    from pyspark.sql import types as T

    full = T.StructType(schema.fields + [T.StructField("batch_id", T.LongType())])
    return spark.read.schema(full).parquet(table_path)


def current_scores(spark: SparkSession, table_path: str, schema, snapshot: str | None = None) -> DataFrame:
    """The score table as of the last committed batch (latest wins per key): the whole log, or a
    snapshot of ``compact`` and the batches after it (pruned by their folder names)."""
    log = score_log(spark, table_path, schema)
    if snapshot is None:
        return M.latest_scores(log)
    old = spark.read.schema(log.schema).parquet(snapshot)
    upto = old.agg(F.max("batch_id")).first()[0]  # one number decides which folders are read
    if upto is not None:
        log = log.where(F.col("batch_id") > F.lit(upto))
    return M.latest_scores(old.unionByName(log))


def compact(spark: SparkSession, table_path: str, schema, out: str, snapshot: str | None = None) -> DataFrame:
    """Write the merged table to a new folder ``out`` (e.g. daily), from an earlier snapshot if there is one.

    Each row keeps the last batch as its ``batch_id``, which says up to where the snapshot reaches."""
    log = score_log(spark, table_path, schema)
    upto = log.agg(F.max("batch_id")).first()[0]
    merged = current_scores(spark, table_path, schema, snapshot)
    merged.withColumn("batch_id", F.lit(upto).cast("long")).write.mode("errorifexists").parquet(out)
    return spark.read.schema(schema).parquet(out)


def start_label_log(spark: SparkSession, folder: str, schema, table_path: str, checkpoint: str,
                    available_now: bool = True, max_files: int | None = None) -> StreamingQuery:
    """T3, label half: labels appended batch by batch, as scores are; ``current_labels`` reads them."""
    return start_score_upsert(spark, folder, schema, table_path, checkpoint, available_now, max_files)


def _label_rows(spark: SparkSession, table_path: str, schema, snapshot: str | None) -> DataFrame:
    """The snapshot's rows and those of the batches after it; without a snapshot, all batches."""
    log = score_log(spark, table_path, schema)
    if snapshot is None:
        return log
    old = spark.read.schema(log.schema).parquet(snapshot)
    upto = old.agg(F.max("batch_id")).first()[0]
    return old.unionByName(log.where(F.col("batch_id") > F.lit(upto)) if upto is not None else log)


def current_labels(spark: SparkSession, table_path: str, schema, snapshot: str | None = None) -> DataFrame:
    """W1 as of the last committed batch: (item_id, label).  The winner is a minimum over the log (a label
    without a time first, then the newest, then the label text), so rows that come late or again change nothing."""
    return latest_label(_label_rows(spark, table_path, schema, snapshot))


def compact_labels(spark: SparkSession, table_path: str, schema, out: str, snapshot: str | None = None) -> DataFrame:
    """Write each item's winning label, with its time, to a new folder ``out``; ``batch_id`` says up to where it reaches."""
    rows = _label_rows(spark, table_path, schema, snapshot)
    upto = score_log(spark, table_path, schema).agg(F.max("batch_id")).first()[0]
    others = [c for c in schema.fieldNames() if c not in ("item_id", "label", "labeled_at")]
    t = F.col("labeled_at")
    first = F.struct(t.isNotNull().alias("has_t"), (-X.ntz_micros(t)).alias("neg_t"), F.col("label").alias("label"),
                     *[F.col(c).alias(c) for c in others], t.alias("labeled_at"))
    best = rows.groupBy("item_id").agg(F.min(first).alias("f")).select(
        *[F.col("item_id") if c == "item_id" else F.col(f"f.{c}").alias(c) for c in schema.fieldNames()])
    best.withColumn("batch_id", F.lit(upto).cast("long")).write.mode("errorifexists").parquet(out)
    return spark.read.schema(schema).parquet(out)
