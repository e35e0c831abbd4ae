"""Sources S2/S4/S6/S7/S8, sinks K3/K6/K7/K8, mutations M3/M5/M7."""

import datetime as dt
import glob
import json
import os

from pyspark.sql import functions as F

from leadlens.operators import benchmark as BM
from leadlens.operators import leads as L
from leadlens.operators import mutate as M
from leadlens.operators import sinks as S
from leadlens.sources import io as IO

T0 = dt.datetime(2024, 2, 1)


def test_parameterised_sql_and_table_exists(spark, cat_small):
    df = IO.run_sql(spark, "select count(*) as n from {s} where prompt_version = :pv and lead_score >= :m",
                    {"pv": "A", "m": 7}, s=cat_small.item_scores)
    want = cat_small.item_scores.where("prompt_version = 'A' and lead_score >= 7").count()
    assert df.first()["n"] == want
    assert not IO.table_exists(spark, "no_such_table_here")
    cat_small.sources.createOrReplaceTempView("sources_view_for_test")
    assert IO.table_exists(spark, "sources_view_for_test")


def test_source_registry_json(spark, tmp):
    path = f"{tmp}/registry.json"
    with open(path, "w") as f:
        for s in [{"source_id": "a", "kind": "rss", "url": "https://a.com/feed", "active": True},
                  {"source_id": "b", "kind": "sitemap", "url": "https://b.com/sitemap.xml", "active": False}]:
            f.write(json.dumps(s) + "\n")
    reg = IO.source_registry(spark, path)
    assert [(r["source_id"], r["active"]) for r in reg.orderBy("source_id").collect()] == [("a", True), ("b", False)]


def test_gold_import_dedupes_by_normalised_url(spark):
    rows = spark.createDataFrame([
        ("https://News.com/a/1?utm_source=x", "T1", "text one", "crm", "confirmed"),
        ("https://news.com/a/1/", "T1b", "text one again", "crm", None),
        ("https://news.com/a/2", "T2", "text two", "monitoring", "rejected"),
        ("nonsense", "T3", "x", "crm", "confirmed"),
    ], "url string, title string, clean_text string, source_id string, label string")
    items, labels = IO.gold_import(rows, T0)
    assert items.count() == 2
    got = {r["url"]: r["item_id"] for r in items.collect()}
    assert set(got) == {"https://News.com/a/1?utm_source=x", "https://news.com/a/2"}
    assert sorted(r["label"] for r in labels.collect()) == ["confirmed", "rejected"]
    items2, _ = IO.gold_import(rows, T0)
    assert items.select("item_id").exceptAll(items2.select("item_id")).count() == 0   # stable ids


def test_landing_payloads(spark, tmp):
    os.makedirs(f"{tmp}/land")
    for i in range(3):
        with open(f"{tmp}/land/feed{i}.xml", "w") as f:
            f.write(f"<rss>\n<item><link>https://x.com/{i}</link></item>\n</rss>")
    from leadlens.operators import discover as D
    p = IO.landing_payloads(spark, f"{tmp}/land", "rss")
    assert p.count() == 3
    assert sorted(r["url"] for r in D.rss_links(p).collect()) == [f"https://x.com/{i}" for i in range(3)]


def test_page_scores_benchmark_and_leads_sinks(spark, cat_small, tmp):
    base = L.browse(cat_small.item_scores, cat_small.items, cat_small.lead_labels, "A", 7)
    S.export_page_csv(L.lead_page(base, 1, 10), f"{tmp}/page")
    part = glob.glob(f"{tmp}/page/part-*.csv")
    assert len(part) == 1 and not open(part[0], "rb").read().startswith(b"\xef\xbb\xbf")
    S.export_scores(cat_small.item_scores, f"{tmp}/scores")
    back = spark.read.option("header", True).csv(f"{tmp}/scores")
    assert back.count() == cat_small.item_scores.count()
    S.export_benchmark(BM.benchmark(cat_small.item_scores, cat_small.lead_labels), f"{tmp}/bench")
    assert spark.read.option("header", True).csv(f"{tmp}/bench").count() == 8
    crm = S.crm_leads(cat_small.item_scores, cat_small.items, cat_small.lead_labels, "A", 8)
    S.write_leads_table(crm, f"{tmp}/leads")
    assert spark.read.parquet(f"{tmp}/leads").count() == crm.count()
    assert "Company Name" in crm.columns


def test_truncate_and_restore(spark, cat_small, tmp):
    empty, cleared = M.truncate_scores(cat_small.item_scores, cat_small.items)
    assert empty.count() == 0 and empty.schema == cat_small.item_scores.schema
    assert cleared.where("lead_score is not null or classifier_model is not null").count() == 0
    S.gold_snapshot(cat_small.items, cat_small.lead_labels, cat_small.sources, tmp)
    back = IO.restore_gold(spark, tmp)
    assert back["items"].count() == cat_small.items.count()
    assert back["sources"].count() == cat_small.sources.count()


def test_fetch_outcomes_keep_other_rows(spark, cat_small):
    out = M.apply_fetch_outcomes(cat_small.url_state,
                                 spark.createDataFrame([(0, "fetched"), (999999, "error")], "url_id long, status string"))
    assert out.count() == cat_small.url_state.count()
    assert out.where("url_id = 0").first()["status"] == "fetched"
    unchanged = out.join(cat_small.url_state.select("url_id", F.col("status").alias("old")), "url_id") \
                   .where("url_id != 0 and status != old").count()
    assert unchanged == 0
