"""The three page flows of the dashboard as Spark jobs.

* ``browse``: one lazy lead set; count, page and export are actions on it,
  so it is persisted once (memory and disk) while they run.
* ``review_and_export``: all leads + edits -> changed labels (M6) ->
  append (K1) -> newest label wins on read -> confirmed leads to the CRM
  frame (K4) and the leads table (K8).
* ``run_pipeline``: discover -> fetch queue -> extract -> garbage ->
  keyword filter -> scorer hook -> reply ingest -> score upsert, each stage
  a table written to the work folder, plus one run-statistics row (K9).
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from leadlens.operators import base as B
from leadlens.operators import classify as C
from leadlens.operators import discover as D
from leadlens.operators import extract as T
from leadlens.operators import leads as L
from leadlens.operators import mutate as M
from leadlens.operators import sinks as S


@dataclass
class BrowseResult:
    total: int
    page: int
    pages: int
    first_row: int
    last_row: int
    rows: list
    export_path: str | None


def browse(item_scores: DataFrame, items: DataFrame, lead_labels: DataFrame, pv: str, min_score=7,
           search: str | None = None, page: int = 1, size: int = 10, export_dir: str | None = None,
           epoch: int | None = None, single_file: bool = False) -> BrowseResult:
    """§3.1: count -> clamp page -> page rows -> optional CSV export of the whole set."""
    base = L.browse(item_scores, items, lead_labels, pv, min_score, search).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        total = L.lead_count(base).first()["n"]
        page, pages, first, last = B.page_bounds(total, size, page)
        rows = L.lead_page(base, page, size).collect()  # at most `size` rows reach the driver
        path = None
        if export_dir:
            path = f"{export_dir.rstrip('/')}/{S.export_file_name(pv, B.min_score_for(min_score), epoch)}"
            S.export_leads_csv(base, path, single_file=single_file)
        return BrowseResult(total, page, pages, first, last, rows, path)
    finally:
        base.unpersist()


def review_and_export(item_scores: DataFrame, items: DataFrame, lead_labels_path: str, pv: str,
                      edits: DataFrame, as_of, leads_path: str, min_score: int = 5,
                      export_threshold: int = 8) -> tuple[int, DataFrame]:
    """§3.3: apply review edits (item_id, status) as appended labels, then export confirmed leads."""
    spark = item_scores.sparkSession
    labels = spark.read.parquet(lead_labels_path)
    # the queue shows 100 rows; edits count for every lead of the set, so none is matched against a page
    leads = L.review_rows(item_scores, items, labels, pv, min_score).select("item_id", "status")
    unknown = edits.join(leads, "item_id", "left_anti").select("item_id").distinct().limit(5).collect()
    if unknown:
        raise ValueError(f"edits of items that are no leads: {[r['item_id'] for r in unknown]}")
    changes = L.changed_labels(leads, edits).persist(StorageLevel.MEMORY_AND_DISK)
    n = changes.count()
    S.append_labels(changes, lead_labels_path, as_of)
    changes.unpersist()
    crm = S.crm_leads(item_scores, items, spark.read.parquet(lead_labels_path), pv, export_threshold)
    S.write_leads_table(crm, leads_path)
    return n, spark.read.parquet(leads_path)


def run_pipeline(spark: SparkSession, pages: DataFrame, url_state: DataFrame, work: str, scorer,
                 model: str, prompt_version: str, as_of, per_source: int = 30,
                 score_limit: int | None = None) -> dict[str, DataFrame]:
    """§3.2: one run of every stage; each stage's output is a written table (lineage is cut).

    Runs share ``work``: scores are a log of runs, read with newest-wins (M1), so runs of several
    models coexist and a rerun replaces only its own rows. Items are a log too: of an item that
    several runs extracted the newest run's row counts, and items of earlier runs stay. A run scores
    the items it extracted. ``score_limit`` bounds the items scored
    per run; how many it left over is in the run row's notes.
    """
    w = work.rstrip("/")
    started = as_of if isinstance(as_of, dt.datetime) else dt.datetime.fromisoformat(str(as_of))
    batch = started.strftime("%Y%m%dT%H%M%S%f")
    # discover: links of fetched pages, upserted into url_state by normalised hash
    links = page_links(pages, url_state)
    found = M.upsert_urls(url_state, links, as_of)
    # the pages at hand were fetched (M7); the fetch itself is outside Spark
    held = D.with_url_key(pages.select("url")).select("url_hash").distinct()
    outcomes = (D.with_url_key(found).join(held, "url_hash", "left_semi")
                .select("url_id", F.lit("fetched").alias("status")))
    M.apply_fetch_outcomes(found, outcomes).write.mode("overwrite").parquet(f"{w}/url_state")
    state = spark.read.parquet(f"{w}/url_state")
    D.fetch_queue(state, per_source).write.mode("overwrite").parquet(f"{w}/fetch_queue")
    # extract + garbage + keyword filter on the pages we hold
    ex = T.extract(pages).select(F.col("page_id").alias("item_id"), "url", "title", "clean_text", "extract_method")
    # written, as both ways out of the garbage rules read it
    extracted = f"{w}/extracted/batch_id={batch}"
    ex.write.mode("overwrite").parquet(extracted)
    ex = spark.read.schema(ex.schema).parquet(extracted)
    ex = ex.withColumn("lead_score", F.lit(None).cast("int")).withColumn("classifier_model", F.lit(None).cast("string"))
    ex = T.flag_garbage(ex)
    ok = ex.where(F.col("reject_reason").isNull())
    filtered = T.prefilter(ok).unionByName(
        ex.where(F.col("reject_reason").isNotNull())
          .withColumn("prefilter_pass", F.lit(False)).withColumn("matched_keywords", F.array().cast("array<string>")),
        allowMissingColumns=True)
    filtered.write.mode("overwrite").parquet(f"{w}/items/batch_id={batch}")
    items = spark.read.schema(filtered.schema).parquet(f"{w}/items/batch_id={batch}")
    # classify: scorer hook over ready items, replies parsed and validated; the observed write is the
    # one evaluation of the scorer
    ready = T.ready_for_scoring(items.where(F.col("prefilter_pass")))
    left = 0 if score_limit is None else max(0, ready.count() - score_limit)
    replies = C.score_with(ready, scorer, model, prompt_version, limit=score_limit)
    parsed = (C.parse_replies(replies, "reply").withColumn("ok", F.col("lead_score").isNotNull())
              .withColumn("skipped", F.lit(False)))
    log = f"{w}/item_scores"

    def append(df: DataFrame) -> None:
        (df.select("item_id", "model", "prompt_version", "lead_score", *B.SCORE_FIELDS,
                   F.lit(as_of).cast("timestamp_ntz").alias("classified_at"))
         .write.mode("append").parquet(f"{log}/batch_id={batch}"))

    stats = S.record_run(spark, parsed, f"{w}/pipeline_runs", "classify", started, write=append,
                         notes=f"{left} ready items left over" if left else None)
    scores = M.latest_scores(spark.read.option("basePath", log).schema(SCORE_LOG).parquet(log))
    return {"url_state": state, "items": newest_items(spark, f"{w}/items", filtered.schema), "scores": scores, "stats": stats}


def newest_items(spark: SparkSession, log: str, schema) -> DataFrame:
    """The rows of the newest run for each item of a log of runs; texts are not shuffled to find it."""
    full = StructType([*schema.fields, StructField("batch_id", StringType())])
    rows = spark.read.option("basePath", log).schema(full).parquet(log)
    last = rows.groupBy("item_id").agg(F.max("batch_id").alias("batch_id"))
    return rows.join(last, ["item_id", "batch_id"], "left_semi").drop("batch_id")


SCORE_LOG = ("item_id long, model string, prompt_version string, lead_score int, "
             + ", ".join(f"{f} string" for f in B.SCORE_FIELDS) + ", classified_at timestamp_ntz, batch_id string")


def page_links(pages: DataFrame, url_state: DataFrame) -> DataFrame:
    """(url, source_id) of every link on the pages: a link belongs to the source of its page, which
    url_state knows by the page's url; a page it does not know is a source by its host."""
    known = (D.with_url_key(url_state).groupBy("url_hash").agg(F.min("source_id").alias("source_id")))
    at = D.with_url_key(pages.select("page_id", "url")).join(known, "url_hash", "left")
    host = F.lower(F.regexp_extract("url", D.URL_PARTS, 2))
    at = at.select("page_id", F.coalesce("source_id", host).alias("source_id"))
    return D.html_links(pages).join(at, "page_id").select(F.col("link").alias("url"), "source_id")
