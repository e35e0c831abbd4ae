"""Sinks, restores and streams as queries: each writes to the session's work folder, and what is
compared is the frame read back from there."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlens.operators import leads as L
from leadlens.operators import mutate as M
from leadlens.operators import sinks as K
from leadlens.operators.base import latest_label
from leadlens.plans.dashboard import PV, REVIEW_MIN, SQL_REVIEW, sql_base
from leadlens.plans.registry import register
from leadlens.plans.table_jobs import SQL_RESCORE, _discovered, _rescore
from leadlens.plans.text_jobs import SQL_LINKS, s_normalize_url
from leadlens.session import work_dir
from leadlens.sources import io
from leadlens.sources.tables import ITEM_SCORES_SCHEMA
from leadlens.streaming import streams as ST

S, I, LL, U = "item_scores", "items", "lead_labels", "url_state"
EDIT_TIME = dt.datetime(2031, 1, 1)


def _folder(c, name: str) -> str:
    return work_dir(c.spark, f"{name}-{uuid.uuid4().hex}")


# ---- K1 ---------------------------------------------------------------------------------
@register("k1_label_append", f"""with {sql_base(REVIEW_MIN)},
shown as (select distinct item_id, status from ({SQL_REVIEW} from base) r),
edits as (select distinct item_id, 'confirmed' as label from ({SQL_REVIEW} from base) r where score >= 8),
new as (select e.item_id, e.label from edits e where exists (select 1 from shown s where s.item_id = e.item_id and s.status <> e.label)),
log as (select item_id, label, labeled_at from lead_labels union all select item_id, label, timestamp '2031-01-01' from new)
select item_id, arg_min(label, (labeled_at is not null, -epoch_us(coalesce(labeled_at, timestamp '1970-01-01')), label)) as label
from log group by item_id""", (I, S, LL))
def k1_label_append(c):
    """K1: every lead scoring >= 8 confirmed by appending labels; newest label of the appended table."""
    path = _folder(c, "labels")
    c.lead_labels.write.parquet(path)
    leads = L.review_rows(c.item_scores, c.items, c.lead_labels, PV, REVIEW_MIN)
    edits = leads.where("score >= 8").select("item_id", F.lit("confirmed").alias("status"))
    K.append_labels(L.changed_labels(leads.select("item_id", "status"), edits), path, EDIT_TIME)
    return latest_label(c.spark.read.parquet(path)).select("item_id", "label")


# ---- K8 / K6 ------------------------------------------------------------------------------
@register("k8_leads_table", f"""with {sql_base(8)}
select """ + ", ".join(f'{src} as "{dst}"' for src, dst in K.CRM_COLUMNS) + """, model
from base where coalesce(label, 'new') = 'confirmed'""", (I, S, LL))
def k8_leads_table(c):
    """K8: the leads table, written and read back."""
    path = _folder(c, "leads")
    K.write_leads_table(K.crm_leads(c.item_scores, c.items, c.lead_labels, PV, threshold=8), path)
    return c.spark.read.parquet(path)


@register("k6_scores_csv", """
select item_id, model, prompt_version, lead_score, lead_company, lead_city, lead_country, lead_reason, classified_at,
  lead_city is null as no_city, lead_city = '' as empty_city from item_scores""", (S,))
def k6_scores_csv(c):
    """K6: all scores as CSV, read back; NULL and the empty text stay apart."""
    path = _folder(c, "scores")
    names = ITEM_SCORES_SCHEMA.fieldNames()
    K.export_scores(c.item_scores.select(*names), path)
    back = io.read_table_csv(c.spark, path, "item_scores")
    return back.select("item_id", "model", "prompt_version", "lead_score", "lead_company", "lead_city", "lead_country", "lead_reason",
                       "classified_at", F.col("lead_city").isNull().alias("no_city"), (F.col("lead_city") == "").alias("empty_city"))


# ---- K5 / S5 / M5 / M3 ----------------------------------------------------------------------
def _restored(c) -> dict[str, DataFrame]:
    folder = _folder(c, "snapshot")
    K.gold_snapshot(c.items, c.lead_labels, c.sources, folder)
    return io.restore_gold(c.spark, folder)


@register("k5_snapshot_items", "select item_id, source_id, url, title, clean_text, created_at, published_at, sector, cluster_id from items", (I,))
def k5_snapshot_items(c):
    """K5 + S5: items through a CSV snapshot and back, line breaks, quotes and NULLs kept."""
    return _restored(c)["items"].select("item_id", "source_id", "url", "title", "clean_text", "created_at", "published_at",
                                        "sector", "cluster_id")


@register("m5_restored_counts", """
select 'items' as name, count(*) as n from items union all select 'lead_labels', count(*) from lead_labels
union all select 'sources', count(*) from sources union all select 'item_scores', 0""", (I, LL, "sources"))
def m5_restored_counts(c):
    """M5: rows of each restored table; scores start empty."""
    out = None
    for name, df in _restored(c).items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@register("m3_truncated", """
select count(*) as items, count(lead_score) as scored, cast(0 as bigint) as scores from
  (select item_id, cast(null as integer) as lead_score from items) t""", (I,))
def m3_truncated(c):
    """M3: score rows gone, item-level scores cleared."""
    scores, items = M.truncate_scores(c.item_scores, c.items)
    n = scores.agg(F.count(F.lit(1))).scalar()
    return items.agg(F.count(F.lit(1)).alias("items"), F.count("lead_score").alias("scored")).withColumn("scores", n)


# ---- S7 -------------------------------------------------------------------------------------
@register("s7_gold_import", f"""with r as (
  select url, doc_label.label, sha256({s_normalize_url('url')}) as url_hash from items i
  join (select item_id, min(label) as label from lead_labels group by item_id) doc_label using (item_id)),
f as (select url_hash, min((url, label)) as m, count(*) as k from r where url_hash is not null group by url_hash)
select ('0x' || substr(url_hash, 1, 15))::bigint as item_id, m[2] as label from f""", (I, LL))
def s7_gold_import(c):
    """Labelled items imported by url; of a url with several labels the alphabetically first counts."""
    lab = c.lead_labels.groupBy("item_id").agg(F.min("label").alias("label"))
    rows = c.items.join(lab, "item_id").select("url", "title", "clean_text", "source_id", "label")
    return io.gold_import(rows, EDIT_TIME)[1].select("item_id", "label")


# ---- K9 -------------------------------------------------------------------------------------
@register("k9_run_row", """
select 'rescore' as script, timestamp '2031-01-01' as started_at, count(*) as articles_processed, count(lead_score) as articles_ok,
  count_if(lead_score is null and prompt_version = 'A') as articles_err,
  count_if(lead_score is null and prompt_version <> 'A') as articles_skipped from item_scores""", (S,))
def k9_run_row(c):
    """K9: the statistics row of a run, counted by the write of its rows."""
    w = _folder(c, "run")
    rows = (c.item_scores.withColumn("ok", F.col("lead_score").isNotNull())
            .withColumn("skipped", F.col("lead_score").isNull() & (F.col("prompt_version") != "A")))
    K.record_run(c.spark, rows, f"{w}/runs", "rescore", EDIT_TIME, write=lambda df: df.write.parquet(f"{w}/rows"))
    return c.spark.read.parquet(f"{w}/runs").select(
        "script", "started_at", *[F.col(x).cast("long").alias(x) for x in
                                  ("articles_processed", "articles_ok", "articles_err", "articles_skipped")])


# ---- T1 / T3 ----------------------------------------------------------------------------------
@register("t1_new_urls_stream", f"""with {SQL_LINKS},
d as (select distinct sha256({s_normalize_url('l.link')}) as url_hash from links l
      join url_state s on s.url_id = l.page_id where s.discovered_at is not null),
known as (select sha256({s_normalize_url('url')}) as url_hash from url_state)
select url_hash from d where url_hash not in (select url_hash from known where url_hash is not null)""", (U,))
def t1_new_urls_stream(c):
    """Discovered links as a stream; each unknown url once."""
    w = _folder(c, "t1")
    found = _discovered(c).where("discovered_at is not null")
    found.write.parquet(f"{w}/in")
    q = ST.start_url_dedupe(c.spark, f"{w}/in", found.schema, f"{w}/out", f"{w}/state", "3650 days", url_state=c.url_state)
    q.awaitTermination()
    return c.spark.read.schema("url_hash string").parquet(f"{w}/out")


@register("t3_score_stream", f"""
with u as (select *, 0 as src from item_scores union all select *, 1 as src from ({SQL_RESCORE}) r),
r as (select *, row_number() over (partition by item_id, model, prompt_version
        order by classified_at is not null desc, classified_at desc, src desc) as rn from u)
select item_id, model, prompt_version, lead_score, classified_at from r where rn = 1""", (S,))
def t3_score_stream(c):
    """Scores streamed in two batches, the first one compacted to a snapshot in between."""
    w = _folder(c, "t3")
    schema = c.item_scores.schema
    for i, batch in enumerate((c.item_scores, _rescore(c).select(*schema.fieldNames()))):
        batch.write.parquet(f"{w}/in/part={i}")
        ST.start_score_upsert(c.spark, f"{w}/in", schema, f"{w}/log", f"{w}/state").awaitTermination()
        if i == 0:
            ST.compact(c.spark, f"{w}/log", schema, f"{w}/snapshot")
    return ST.current_scores(c.spark, f"{w}/log", schema, f"{w}/snapshot").select(
        "item_id", "model", "prompt_version", "lead_score", "classified_at")
