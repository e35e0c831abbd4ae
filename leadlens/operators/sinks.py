"""Sinks (K1-K9): appends, CSV exports, CRM export, snapshots, run statistics."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from leadlens.operators import base as B

BOM = "\ufeff"

# CRM import columns (ours; the CRM template itself is not published): source -> header.
CRM_COLUMNS = [
    ("lead_company", "Company Name"), ("lead_city", "City"), ("lead_country", "Country/Region"),
    ("lead_what", "Topic"), ("lead_description", "Description"), ("lead_score", "Rating"),
    ("url", "Website"), ("source_id", "Lead Source"), ("item_id", "Source Article Id"),
]


def append_labels(changes: DataFrame, path: str, as_of) -> None:
    """K1: append (item_id, label, labeled_by, labeled_at=as_of); history is never rewritten."""
    (changes.select("item_id", "label", "labeled_by", F.lit(as_of).cast("timestamp_ntz").alias("labeled_at"))
     .write.mode("append").parquet(path))


# Text written exactly: microsecond timestamps, no whitespace trimming.
CSV_OPTIONS = {"header": True, "escape": '"', "encoding": "UTF-8",
               "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
               "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
               "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
# Snapshots must tell NULL from '' (CSV can't by itself): NULL is written as \N.
SNAPSHOT_NULL = "\\N"


def write_csv(df: DataFrame, path: str, bom: bool = False, single_file: bool = False,
              null_value: str | None = None) -> None:
    """CSV with header.  ``bom`` puts U+FEFF before the first header name.

    ``single_file`` coalesces to one task, for downloads of a filtered set
    only; large exports keep their partitions (one part file each).
    """
    if bom:
        first = df.columns[0]
        df = df.withColumnRenamed(first, BOM + first)
    if single_file:
        df = df.coalesce(1)
    w = df.write.mode("overwrite").options(**CSV_OPTIONS)
    if null_value is not None:
        w = w.option("nullValue", null_value)
    w.csv(path)


def export_file_name(pv: str, min_score: int, epoch: int | None = None) -> str:
    """K2 name: leads_p{PV}_score{min}_{epoch}.csv"""
    return f"leads_p{pv}_score{min_score}_{int(time.time()) if epoch is None else epoch}.csv"


def export_leads_csv(base: DataFrame, path: str, single_file: bool = False) -> None:
    """K2: the full filtered set, export columns, UTF-8 with BOM; ordered part files, or one file
    for a small download."""
    from leadlens.operators.leads import export_frame

    write_csv(export_frame(base), path, bom=True, single_file=single_file)


def export_page_csv(page: DataFrame, path: str) -> None:
    """K3: the current page, UTF-8 without BOM (a page is at most 50 rows)."""
    write_csv(page, path, bom=False, single_file=True)


def crm_leads(item_scores: DataFrame, items: DataFrame, lead_labels: DataFrame, pv: str,
              threshold: int = 8, model: str | None = None) -> DataFrame:
    """K4 frame: newest label 'confirmed' and score >= threshold, CRM column names."""
    base = B.lead_base(item_scores, items, lead_labels, pv, threshold, model=model)
    conf = base.where(B.effective_status() == "confirmed")
    return conf.select(*[F.col(src).alias(dst) for src, dst in CRM_COLUMNS], "model")


def write_leads_table(crm: DataFrame, path: str) -> None:
    """K8: the finalised leads table (overwrite)."""
    crm.write.mode("overwrite").parquet(path)


def gold_snapshot(items: DataFrame, lead_labels: DataFrame, sources: DataFrame, folder: str) -> None:
    """K5: items, labels and sources to CSV with header (round-trips with sources.io.read_table_csv)."""
    for name, df in (("items", items), ("lead_labels", lead_labels), ("sources", sources)):
        write_csv(df, f"{folder}/{name}", null_value=SNAPSHOT_NULL)


def export_scores(item_scores: DataFrame, path: str) -> None:
    """K6: every score row; NULL is written as the snapshots' marker, so that it stays apart from an empty text."""
    write_csv(item_scores, path, null_value=SNAPSHOT_NULL)


def export_benchmark(bench: DataFrame, path: str) -> None:
    """K7: benchmark results (a handful of rows: one per run)."""
    write_csv(bench, path, single_file=True)


def record_run(spark: SparkSession, processed: DataFrame, runs_path: str, script: str, started_at,
               ok_col: str = "ok", skipped_col: str = "skipped", notes: str | None = None,
               write: Callable[[DataFrame], None] | None = None) -> dict:
    """K9: run ``processed`` into its sink, observe counts on the way, append one stats row.

    ``processed`` has boolean columns ``ok`` and ``skipped``; ``write`` writes it (without one it
    runs to no sink). Counts are collected with ``DataFrame.observe`` by that write, so they are of
    the rows that were stored and nothing runs twice.
    """
    obs = Observation(f"run_{script}")
    t0 = time.time()
    observed = processed.observe(obs, F.count(F.lit(1)).alias("n"), F.count_if(F.col(ok_col)).alias("ok"),
                                 F.count_if(F.col(skipped_col)).alias("skipped"))
    if write is None:
        observed.write.format("noop").mode("overwrite").save()
    else:
        write(observed)
    duration = time.time() - t0
    m = obs.get
    n, ok, skipped = int(m["n"]), int(m["ok"]), int(m["skipped"])
    row = {"script": script, "started_at": started_at, "duration_s": float(duration),
           "articles_processed": n, "articles_ok": ok, "articles_err": n - ok - skipped,
           "articles_skipped": skipped, "avg_s_per_article": (duration / n) if n else None, "notes": notes}
    one = spark.createDataFrame(
        [row], "script string, started_at timestamp_ntz, duration_s double, articles_processed int, "
               "articles_ok int, articles_err int, articles_skipped int, avg_s_per_article double, notes string")
    one = one.withColumn("finished_at", F.col("started_at") + F.make_dt_interval(secs=F.lit(duration)))
    one.write.mode("append").parquet(runs_path)
    return row
