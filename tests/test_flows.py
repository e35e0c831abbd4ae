"""End-to-end page flows on sf0.001."""

import datetime as dt
import os
import glob
import uuid

import pandas as pd
import pytest
from pyspark.sql import functions as F

from leadlens.operators import leads as L
from leadlens.plans import flows
from leadlens.sources.tables import Catalog
from tests.conftest import SF_MID


def test_browse_flow(spark, cat_small, tmp):
    r = flows.browse(cat_small.item_scores, cat_small.items, cat_small.lead_labels, "A", 7, page=99, size=10,
                     export_dir=tmp, epoch=0)
    assert r.total == L.lead_count(L.browse(cat_small.item_scores, cat_small.items, cat_small.lead_labels,
                                            "A", 7)).first()["n"]
    assert r.page == r.pages and 0 < len(r.rows) <= 10 and r.last_row == r.total
    assert r.export_path.endswith("leads_pA_score7_0.csv")
    assert len(glob.glob(f"{r.export_path}/part-*.csv")) == 1


def test_review_flow(spark, cat_small, tmp):
    cat_small.lead_labels.write.parquet(f"{tmp}/labels")
    shown = L.review_queue(cat_small.item_scores, cat_small.items, cat_small.lead_labels, "A", 5, "all")
    targets = [r["item_id"] for r in shown.where("score >= 8 and status != 'confirmed'").limit(3).collect()]
    edits = spark.createDataFrame([(i, "confirmed") for i in targets], "item_id long, status string")
    n, leads = flows.review_and_export(cat_small.item_scores, cat_small.items, f"{tmp}/labels", "A", edits,
                                       dt.datetime(2031, 1, 1), f"{tmp}/leads")
    assert n == len(targets)
    exported = {r["Source Article Id"] for r in leads.collect()}
    null_time = {r["item_id"] for r in cat_small.lead_labels.where("labeled_at is null").collect()}
    assert {i for i in targets if i not in null_time} <= exported


def test_pipeline_flow(spark, cat_small, tmp):
    def scorer(pdf):
        return pd.DataFrame({"item_id": pdf["item_id"],
                             "reply": ['Result: {"score": %d, "company": "C%d"}' % (1 + len(t) % 10, i)
                                       for i, t in zip(pdf["item_id"], pdf["clean_text"])]})

    pages = cat_small.pages.withColumn(
        "html", F.regexp_replace("html", "<p>", "<p>New rail terminal and freight siding. "))
    out = flows.run_pipeline(spark, pages, cat_small.url_state, tmp, scorer, "toy", "Z",
                             dt.datetime(2024, 2, 1), score_limit=20)
    assert out["url_state"].count() > cat_small.url_state.count()
    assert out["items"].where("prefilter_pass").count() > 0
    scores = out["scores"]
    assert 0 < scores.count() <= 20
    assert scores.where("lead_score is null or lead_score not between 1 and 10").count() == 0
    runs = spark.read.parquet(f"{tmp}/pipeline_runs").collect()
    assert len(runs) == 1 and runs[0]["articles_processed"] == scores.count()


def _scorer(calls):
    def scorer(pdf):
        for i in pdf["item_id"]:
            open(f"{calls}/{i}-{uuid.uuid4().hex}", "w").close()
        return pd.DataFrame({"item_id": pdf["item_id"], "reply": ['{"score": %d}' % (1 + i % 10) for i in pdf["item_id"]]})
    return scorer


def test_runs_share_their_scores(spark, cat_small, tmp):
    """Two models, two runs: both stay, the scorer sees each item once a run, every source has its own cap."""
    import os

    calls = f"{tmp}/calls"
    os.mkdir(calls)
    pages = cat_small.pages.withColumn("html", F.regexp_replace("html", "<p>", "<p>New rail terminal and freight siding. "))
    first = flows.run_pipeline(spark, pages, cat_small.url_state, f"{tmp}/w", _scorer(calls), "toy", "Z", dt.datetime(2024, 2, 1))
    n = first["scores"].count()
    assert n == len(os.listdir(calls)) == spark.read.parquet(f"{tmp}/w/pipeline_runs").first()["articles_processed"] > 0
    second = flows.run_pipeline(spark, pages, cat_small.url_state, f"{tmp}/w", _scorer(calls), "toy2", "Z", dt.datetime(2024, 2, 2),
                                score_limit=5)
    by = {r["model"]: r["count"] for r in second["scores"].groupBy("model").count().collect()}
    assert by == {"toy": n, "toy2": 5} and len(os.listdir(calls)) == n + 5
    notes = [r["notes"] for r in spark.read.parquet(f"{tmp}/w/pipeline_runs").collect()]
    assert sorted(map(str, notes)) == sorted(["None", f"{n - 5} ready items left over"])
    state = second["url_state"]
    assert state.where("source_id = 'discovered'").count() == 0
    new = {r["source_id"]: r["count"] for r in state.where("status = 'new'").groupBy("source_id").count().collect()}
    queue = {r["source_id"]: r["count"] for r in spark.read.parquet(f"{tmp}/w/fetch_queue").groupBy("source_id").count().collect()}
    assert queue == {s: min(k, 30) for s, k in new.items()}
    assert state.where("status = 'fetched'").count() > 0


def test_review_applies_every_edit(spark, tmp):
    cat = Catalog(spark, SF_MID)
    cat.lead_labels.write.parquet(f"{tmp}/labels")
    leads = L.review_rows(cat.item_scores, cat.items, cat.lead_labels, "A", 3)
    status = {r["item_id"]: r["status"] for r in leads.select("item_id", "status").distinct().collect()}
    edits = {i: "contacted" if s != "contacted" else "rejected" for i, s in status.items()}
    assert len(edits) > 100
    df = spark.createDataFrame(list(edits.items()), "item_id long, status string")
    args = (cat.item_scores, cat.items, f"{tmp}/labels", "A")
    n, _ = flows.review_and_export(*args, df, dt.datetime(2031, 1, 1), f"{tmp}/leads", min_score=3)
    assert n == len(edits)
    unknown = spark.createDataFrame([(-5, "contacted")], "item_id long, status string")
    with pytest.raises(ValueError, match="-5"):
        flows.review_and_export(*args, unknown, dt.datetime(2031, 1, 1), f"{tmp}/leads", min_score=3)


def test_items_last_over_runs(spark, cat_small, tmp):
    """A second run over other pages keeps the first run's items; a page fetched again has its newest text."""
    calls = f"{tmp}/calls"
    os.mkdir(calls)
    pages = cat_small.pages.withColumn("html", F.regexp_replace("html", "<p>", "<p>New rail terminal and freight siding. "))
    half = F.col("page_id") % 2
    args = (f"{tmp}/w", _scorer(calls), "toy", "Z")
    first = flows.run_pipeline(spark, pages.where(half == 0), cat_small.url_state, *args, dt.datetime(2024, 2, 1))
    n = first["items"].count()
    again = pages.where((half == 1) | (F.col("page_id") == 0)).withColumn("html", F.regexp_replace("html", "siding", "depot"))
    second = flows.run_pipeline(spark, again, cat_small.url_state, *args, dt.datetime(2024, 2, 2))
    items = {r["item_id"]: r["clean_text"] for r in second["items"].collect()}
    assert len(items) == second["items"].count() == pages.count() > n
    newest = {i: "depot" if i % 2 or i == 0 else "siding" for i in items}
    assert all(word in items[i] for i, word in newest.items() if items[i] and "New rail" in items[i])
    assert {newest[i] for i, text in items.items() if text and "New rail" in text} == {"depot", "siding"}
    scored = {r["item_id"] for r in second["scores"].collect()}
    assert scored and scored <= items.keys() and {i % 2 for i in scored} == {0, 1}
    third = flows.run_pipeline(spark, again, cat_small.url_state, *args, dt.datetime(2024, 2, 2))  # the same run once more
    assert {r["item_id"]: r["clean_text"] for r in third["items"].collect()} == items
