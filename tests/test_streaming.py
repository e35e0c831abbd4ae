"""Streaming forms equal their batch operators (closed windows for append mode)."""

import datetime as dt

from pyspark.sql import functions as F

from leadlens.operators import discover as D
from leadlens.operators import mutate as M
from leadlens.streaming import streams as ST


def _land(df, folder, parts):
    df.repartition(parts).write.mode("overwrite").parquet(folder)


def test_activity_stream_closed_windows_equal_batch(spark, cat_small, tmp):
    s = cat_small.item_scores
    _land(s, f"{tmp}/in", 4)
    q = ST.start_activity(spark, f"{tmp}/in", s.schema, "A", f"{tmp}/out", f"{tmp}/ck", watermark="1 day")
    q.awaitTermination()
    got = {(r["day"], r["band"]): r["n"] for r in spark.read.parquet(f"{tmp}/out").collect()}
    # batch A6 without the 30-day cut, restricted to windows closed by the final watermark
    from leadlens.functions import expr as X
    a = s.where("prompt_version = 'A' and lead_score is not null")
    max_t = a.agg(F.max("classified_at")).first()[0]
    wm = max_t - dt.timedelta(days=1)
    batch = (a.groupBy(F.to_date("classified_at").alias("day"), X.activity_band("lead_score").alias("band"))
             .agg(F.count(F.lit(1)).alias("n")).collect())
    closed = {(r["day"], r["band"]): r["n"] for r in batch
              if dt.datetime.combine(r["day"] + dt.timedelta(days=1), dt.time()) <= wm}
    assert closed and got == closed


def test_url_dedupe_stream_equals_batch(spark, cat_small, tmp):
    links = D.html_links(cat_small.pages)
    st = cat_small.url_state.select(F.col("url_id").alias("page_id"), "discovered_at")
    disc = links.join(st, "page_id").select(F.col("link").alias("url"), "discovered_at")
    _land(disc, f"{tmp}/in", 3)
    q = ST.start_url_dedupe(spark, f"{tmp}/in", disc.schema, f"{tmp}/out", f"{tmp}/ck", watermark="3650 days")
    q.awaitTermination()
    got = spark.read.parquet(f"{tmp}/out")
    want = D.with_url_key(disc).where("url_hash is not null").select("url_hash").distinct()
    assert got.count() == want.count()
    assert got.select("url_hash").exceptAll(want).count() == 0


def test_url_dedupe_stream_knows_old_urls(spark, cat_small, tmp):
    """URLs of the table are not new again, however short the watermark is."""
    links = D.html_links(cat_small.pages).select(F.col("link").alias("url"))
    known = cat_small.url_state.select("url").limit(40)
    disc = links.unionByName(known).withColumn("discovered_at", F.lit(dt.datetime(2024, 3, 1)).cast("timestamp_ntz"))
    _land(disc, f"{tmp}/in", 2)
    q = ST.start_url_dedupe(spark, f"{tmp}/in", disc.schema, f"{tmp}/out", f"{tmp}/ck", watermark="1 minute",
                            url_state=cat_small.url_state, max_files=1)
    q.awaitTermination()
    old = D.with_url_key(cat_small.url_state).select("url_hash")
    want = D.with_url_key(links).where("url_hash is not null").select("url_hash").distinct().join(old, "url_hash", "left_anti")
    got = spark.read.parquet(f"{tmp}/out").select("url_hash")
    assert got.join(old, "url_hash").count() == 0
    assert got.distinct().exceptAll(want).count() == 0 and want.exceptAll(got.distinct()).count() == 0


def test_score_upsert_stream_equals_batch(spark, cat_small, tmp):
    s = cat_small.item_scores
    second = (s.where("model = 'gemma3:4b' and item_id % 3 = 0")
              .withColumn("lead_score", ((F.col("lead_score") + 1) % 11).cast("int"))
              .withColumn("classified_at", F.col("classified_at") + F.expr("INTERVAL 1 DAYS")))
    s.write.parquet(f"{tmp}/in/batch=0")
    q = ST.start_score_upsert(spark, f"{tmp}/in", s.schema, f"{tmp}/table", f"{tmp}/ck")
    q.awaitTermination()
    second.write.parquet(f"{tmp}/in/batch=1")
    q = ST.start_score_upsert(spark, f"{tmp}/in", s.schema, f"{tmp}/table", f"{tmp}/ck")
    q.awaitTermination()
    got = ST.current_scores(spark, f"{tmp}/table", s.schema)
    want = M.upsert_scores(s, second)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    # a snapshot and the batches after it read the same as the whole log
    ST.compact(spark, f"{tmp}/table", s.schema, f"{tmp}/snap1")
    third = second.withColumn("classified_at", F.col("classified_at") + F.expr("INTERVAL 2 DAYS")).where("item_id % 2 = 1")
    third.write.parquet(f"{tmp}/in/batch=2")
    q = ST.start_score_upsert(spark, f"{tmp}/in", s.schema, f"{tmp}/table", f"{tmp}/ck")
    q.awaitTermination()
    whole = ST.current_scores(spark, f"{tmp}/table", s.schema)
    late = ST.current_scores(spark, f"{tmp}/table", s.schema, f"{tmp}/snap1")
    assert late.exceptAll(whole).count() == 0 and whole.exceptAll(late).count() == 0
    again = ST.compact(spark, f"{tmp}/table", s.schema, f"{tmp}/snap2", f"{tmp}/snap1")
    assert again.exceptAll(whole).count() == 0 and again.count() == whole.count()


def test_activity_stream_drops_late_rows(spark, cat_small, tmp):
    """Rows older than the watermark arriving in a later batch do not change closed windows."""
    s = cat_small.item_scores.where("prompt_version = 'A' and lead_score is not null")
    max_t = s.agg(F.max("classified_at")).first()[0]
    first_day = s.agg(F.min("classified_at")).first()[0]
    s.write.parquet(f"{tmp}/in/batch=0")
    q = ST.start_activity(spark, f"{tmp}/in", s.schema, "A", f"{tmp}/out", f"{tmp}/ck", watermark="1 day")
    q.awaitTermination()
    before = {(r["day"], r["band"]): r["n"] for r in spark.read.parquet(f"{tmp}/out").collect()}
    late = s.limit(5).withColumn("classified_at", F.lit(first_day).cast("timestamp_ntz"))
    late.write.parquet(f"{tmp}/in/batch=1")
    q = ST.start_activity(spark, f"{tmp}/in", s.schema, "A", f"{tmp}/out", f"{tmp}/ck", watermark="1 day")
    q.awaitTermination()
    after = {(r["day"], r["band"]): r["n"] for r in spark.read.parquet(f"{tmp}/out").collect()}
    assert before and after == before
    assert max_t > first_day
