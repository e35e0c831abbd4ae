"""Table mutations (M1-M7) as DataFrame rewrites: new table versions, no updates in place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from leadlens.operators import discover as D

SCORE_KEY = ["item_id", "model", "prompt_version"]
ITEM_SCORE_FIELDS = ["lead_score", "lead_reason", "lead_classified_at", "classifier_model"]


def upsert_scores(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """One row per (item_id, model, prompt_version); runs coexist.

    Latest ``classified_at`` wins (NULL times lose); at equal times the
    incoming row wins.  ``max`` over a struct of (order keys, row) is a
    partial aggregate, so the merge is idempotent and skew-safe.
    """
    cols = existing.columns
    tagged = (existing.select(*cols, F.lit(0).alias("_src"))
              .unionByName(incoming.select(*cols, F.lit(1).alias("_src"))))
    others = [c for c in cols if c not in SCORE_KEY]
    order = F.struct(F.col("classified_at").isNotNull().alias("_has_t"), F.col("classified_at").alias("_t"),
                     F.col("_src").alias("_src"), *[F.col(c).alias(c) for c in others])
    best = tagged.groupBy(*SCORE_KEY).agg(F.max(order).alias("_w"))
    return best.select(*[F.col(c) if c in SCORE_KEY else F.col(f"_w.{c}").alias(c) for c in cols])


def latest_scores(log: DataFrame, order_col: str = "batch_id") -> DataFrame:
    """M1 over an append-only score log: per key the latest classified_at wins
    (NULL times lose), equal times go to the later ``order_col`` (batch)."""
    cols = [c for c in log.columns if c != order_col]
    others = [c for c in cols if c not in SCORE_KEY]
    order = F.struct(F.col("classified_at").isNotNull().alias("_has_t"), F.col("classified_at").alias("_t"),
                     F.col(order_col).alias("_src"), *[F.col(c).alias(c) for c in others])
    best = log.groupBy(*SCORE_KEY).agg(F.max(order).alias("_w"))
    return best.select(*[F.col(c) if c in SCORE_KEY else F.col(f"_w.{c}").alias(c) for c in cols])


def clear_item_scores(items: DataFrame) -> DataFrame:
    """M2: item-level score fields -> NULL (those present in the table)."""
    sch = {f.name: f.dataType for f in items.schema.fields}
    return items.withColumns({c: F.lit(None).cast(sch[c]) for c in ITEM_SCORE_FIELDS if c in sch})


def truncate_scores(item_scores: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """M3: an empty score table of the same schema, and items with cleared fields.

    The always-false filter keeps the schema and plans as an empty relation (no scan)."""
    return item_scores.where(F.lit(False)), clear_item_scores(items)


def dense_ids(df: DataFrame, order_col: str, start, id_col: str = "id") -> DataFrame:
    """Number rows start, start+1, ... in ``order_col`` order, distributed.

    Range-partition, checkpoint (so partition contents are stable if a task
    is re-run), number within each partition, then add the row count of all
    earlier partitions (a table with one row per partition, safe to broadcast).
    """
    parted = (df.repartitionByRange(order_col).withColumn("_p", F.spark_partition_id()).checkpoint())
    local = parted.withColumn("_r", F.row_number().over(W.partitionBy("_p").orderBy(order_col)))
    counts = parted.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select("_p", (F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)))
                            .alias("_off"))
    return (local.join(F.broadcast(offsets), "_p")
            .withColumn(id_col, start + F.coalesce(F.col("_off"), F.lit(0)) + F.col("_r") - 1)
            .drop("_p", "_r", "_off"))


def upsert_urls(url_state: DataFrame, discovered: DataFrame, as_of=None) -> DataFrame:
    """M4: add URLs whose normalised hash is unknown; known rows stay as they are.

    ``discovered``: (url, source_id[, discovered_at]).  New rows get status
    'new' and ids after the current maximum.
    """
    state = D.with_url_key(url_state)
    d = D.with_url_key(discovered)
    if "discovered_at" not in d.columns:
        d = d.withColumn("discovered_at", F.lit(as_of).cast("timestamp_ntz"))
    first = D.dedupe_urls(d, ["discovered_at", "url"], ["url", "source_id", "discovered_at"])
    new = first.join(state.select("url_hash"), "url_hash", "left_anti")
    start = url_state.agg(F.coalesce(F.max("url_id"), F.lit(-1)) + 1).scalar()
    new = dense_ids(new, "url_hash", start, "url_id")
    new = new.select("url_id", "url", "source_id", F.lit("new").alias("status"), "discovered_at")
    return url_state.select(*new.columns).unionByName(new)


def apply_fetch_outcomes(url_state: DataFrame, outcomes: DataFrame) -> DataFrame:
    """M7: new status by url_id where an outcome exists, else the old one."""
    o = outcomes.select("url_id", F.col("status").alias("_new_status"))
    return (url_state.join(o, "url_id", "left")
            .withColumn("status", F.coalesce("_new_status", "status")).drop("_new_status")
            .select(*url_state.columns))
