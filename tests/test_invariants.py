"""Layer 4: invariants over the derived tables and round trips."""

from pyspark.sql import functions as F

from leadlens.operators import analytics as A
from leadlens.operators import base as B
from leadlens.operators import cluster as K
from leadlens.operators import sinks as S
from leadlens.sources import io as IO


def test_band_counts_sum_to_scored_rows(cat_small):
    s = cat_small.item_scores.where("prompt_version = 'A'")
    as_of = s.agg(F.max("classified_at")).first()[0]
    act = A.activity_by_band(cat_small.item_scores, "A", as_of=as_of)
    expected = s.where(F.col("lead_score").isNotNull() &
                       (F.col("classified_at") >= F.lit(as_of) - F.expr("INTERVAL 30 DAYS"))).count()
    assert act.agg(F.sum("n")).first()[0] == expected


def test_breakdown_total(cat_small):
    br = A.classification_breakdown(cat_small.items, cat_small.item_scores, "A")
    total = br.agg(F.sum("n")).first()[0]
    unscored = B.unscored_items(cat_small.items, cat_small.item_scores, "A").count()
    scored = cat_small.item_scores.where("prompt_version = 'A'").count()
    assert total == unscored + scored


def test_one_canonical_per_fixture_cluster(cat_small):
    c = (cat_small.items.where(F.col("cluster_id").isNotNull())
         .groupBy("cluster_id").agg(F.count_if(F.col("is_cluster_canonical") == F.lit(True)).alias("k")))
    assert c.where("k != 1").count() == 0


def test_hero_lead_counts_are_score_rows(cat_small):
    h = A.hero(cat_small.items, cat_small.item_scores, "A").first()
    s = cat_small.item_scores.where("prompt_version = 'A'")
    assert h["leads"] == s.where("lead_score >= 5").count()
    assert h["strong_leads"] == s.where("lead_score >= 7").count()


def test_gold_snapshot_round_trip(spark, cat_small, tmp):
    S.gold_snapshot(cat_small.items, cat_small.lead_labels, cat_small.sources, tmp)
    back = IO.restore_gold(spark, tmp)
    for name in ("items", "lead_labels", "sources"):
        a = getattr(cat_small, name).select(*back[name].columns)
        b = back[name]
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0, name
    assert back["item_scores"].count() == 0


def test_export_csv_has_bom_and_header(spark, cat_small, tmp):
    from leadlens.operators import leads as L

    base = L.browse(cat_small.item_scores, cat_small.items, cat_small.lead_labels, "A", 7)
    out = f"{tmp}/{S.export_file_name('A', 7, 0)}"
    S.export_leads_csv(base, out, single_file=True)
    import glob
    part = glob.glob(f"{out}/part-*.csv")
    assert len(part) == 1
    raw = open(part[0], "rb").read()
    assert raw.startswith("﻿score,company,sector".encode("utf-8"))
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(out)
    assert back.count() == L.lead_count(base).first()["n"]


def test_label_append_and_newest_wins(spark, cat_small, tmp):
    from leadlens.operators import leads as L

    shown = L.review_queue(cat_small.item_scores, cat_small.items, cat_small.lead_labels, "A", 5, "all")
    edited = shown.withColumn("status", F.lit("rejected"))
    changes = L.changed_labels(shown, edited)
    n_changes = changes.count()
    as_of = "2030-01-01 00:00:00"
    cat_small.lead_labels.write.parquet(f"{tmp}/labels")
    S.append_labels(changes, f"{tmp}/labels", as_of)
    labels = spark.read.parquet(f"{tmp}/labels")
    assert labels.count() == cat_small.lead_labels.count() + n_changes
    after = L.review_queue(cat_small.item_scores, cat_small.items, labels, "A", 5, "all")
    changed_ids = {r["item_id"] for r in changes.collect()}
    # items whose newest label has a NULL time keep it (NULL sorts first, as in PostgreSQL)
    null_time = {r["item_id"] for r in cat_small.lead_labels.where("labeled_at is null").collect()}
    for r in after.collect():
        if r["item_id"] in changed_ids and r["item_id"] not in null_time:
            assert r["status"] == "rejected"


def test_run_statistics_row(spark, cat_small, tmp):
    import datetime as dt

    processed = cat_small.items.select((F.length("clean_text") > 100).alias("ok"),
                                       (F.col("lead_score").isNull()).alias("skipped"))
    row = S.record_run(spark, processed, f"{tmp}/runs", "extract", dt.datetime(2024, 1, 1))
    runs = spark.read.parquet(f"{tmp}/runs").collect()
    assert len(runs) == 1 and runs[0]["articles_processed"] == cat_small.items.count() == row["articles_processed"]


def test_exact_duplicates_one_canonical(cat_small):
    d = K.exact_duplicate_clusters(cat_small.items)
    c = d.groupBy("cluster_id").agg(F.count_if("is_cluster_canonical").alias("k"))
    assert c.where("k != 1").count() == 0
