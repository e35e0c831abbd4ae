"""Stored tables: what a change writes and reads, what a failed run leaves, and plans without exchanges on item_id."""

import datetime as dt
import hashlib
import os
import re

import pytest
from pyspark.sql import functions as F

from leadlens.operators import mutate as M
from leadlens.sources.store import BucketedCatalog, ScoreStore, UrlStore
from leadlens.sources.tables import ITEM_SCORES_SCHEMA, URL_STATE_SCHEMA, Catalog
from tests.conftest import SF_SMALL

T0 = dt.datetime(2030, 1, 1)


def score(item, model="m", pv="A", value=5, at=T0):
    return (item, model, pv, value, *["x"] * 8, at)


def scores(spark, rows):
    return spark.createDataFrame(rows, ITEM_SCORES_SCHEMA)


def files(root):
    """Digest of every data file."""
    out = {}
    for d, _, names in os.walk(f"{root}/data"):
        for n in names:
            if n.endswith(".parquet"):
                with open(f"{d}/{n}", "rb") as f:
                    out[os.path.relpath(f"{d}/{n}", root)] = hashlib.sha256(f.read()).hexdigest()
    return out


def table(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_scores_merge_touches_only_its_folders(spark, tmp):
    store = ScoreStore(spark, tmp, buckets=4)
    store.upsert(scores(spark, [score(i, pv=p) for i in range(40) for p in ("A", "B", None)]))
    before = files(tmp)
    assert len(before) == 12
    new = scores(spark, [score(7, value=9, at=T0 + dt.timedelta(days=1)), score(7, model="n"), score(9, value=1, at=None)])
    want = table(M.upsert_scores(store.read(), new))
    store.upsert(new)
    after = files(tmp)
    assert {k: v for k, v in after.items() if k in before} == before  # byte for byte
    written = {k for k in after if k not in before}
    assert len(written) == len({r[0] for r in new.select(store.bucket()).collect()}) <= 2
    assert all("prompt_version=A" in k for k in written)
    assert table(store.read()) == want and len(want) == 121
    assert table(store.read(0)) == table(scores(spark, [score(i, pv=p) for i in range(40) for p in ("A", "B", None)]))


def test_a_failed_run_leaves_the_old_version(spark, tmp):
    store = ScoreStore(spark, tmp, buckets=2)
    store.upsert(scores(spark, [score(i) for i in range(10)]))
    want = table(store.read())

    @F.udf("int")
    def fails(x):
        raise ValueError("lost")

    with pytest.raises(Exception, match="lost"):
        store.upsert(scores(spark, [score(i, value=1) for i in range(10)]).withColumn("lead_score", fails("lead_score")))
    # data of the next version without its manifest, as after a lost driver
    scores(spark, [score(99)]).withColumn("bucket", F.lit(0)).drop("prompt_version").withColumn("prompt_version", F.lit("A")).write.mode("overwrite").partitionBy("prompt_version", "bucket").parquet(f"{tmp}/data/v=1")
    assert store.version() == 0 and table(store.read()) == want
    store.upsert(scores(spark, [score(3, value=8, at=T0 + dt.timedelta(1))]))
    assert {r.item_id: r.lead_score for r in store.read().collect()} == {i: 8 if i == 3 else 5 for i in range(10)}


def test_empty_store_and_empty_batch(spark, tmp):
    store = ScoreStore(spark, tmp, buckets=2)
    assert store.read().count() == 0
    store.upsert(scores(spark, []))
    assert store.read().count() == 0
    store.upsert(scores(spark, [score(1)]))
    store.upsert(scores(spark, []))
    assert table(store.read()) == table(scores(spark, [score(1)]))


def urls(spark, rows):
    return spark.createDataFrame(rows, URL_STATE_SCHEMA)


def test_urls_are_looked_up_by_stored_hash(spark, tmp):
    store = UrlStore(spark, tmp)
    store.load(urls(spark, [(i, f"https://h.com/a/{i}", "s", "fetched", T0) for i in range(50)] + [(50, "no url", "s", "new", None)]))
    found = spark.createDataFrame([("HTTPS://H.com/a/7/", "s", T0), ("https://h.com/new?utm_x=1", "s", T0), ("https://h.com/new", "t", T0), ("mailto:x", "s", T0)],
                                  "url string, source_id string, discovered_at timestamp_ntz")
    execution = store.unknown(found)._jdf.queryExecution()
    join = execution.optimizedPlan()
    while join.nodeName() != "Join":
        join = join.children().apply(0)
    known = join.children().apply(1).toString()
    assert "parquet" in known and "sha2(" not in known and "sha2(" in execution.optimizedPlan().toString()
    assert "ReadSchema: struct<url_hash:string>" in execution.executedPlan().toString()
    before = files(tmp)
    store.upsert(found)
    got = {r.url_id: (r.url, r.status) for r in store.read().collect()}
    assert len(got) == 52 and got[51] == ("https://h.com/new", "new") and got[7] == ("https://h.com/a/7", "fetched")
    after = files(tmp)
    assert {k: after[k] for k in before} == before and len(after) == len(before) + 1  # one delta
    store.upsert(found)
    assert store.read().count() == 52
    rows = table(store.read())
    store.compact()
    assert table(store.read()) == rows


def test_no_exchange_on_item_id(spark, tmp, cat_small):
    """Joins and aggregates on item_id over the bucketed tables."""
    from leadlens.plans.registry import load_all

    bucketed = BucketedCatalog(Catalog(spark, SF_SMALL), tmp, "leads", buckets=4)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("a10_lead_count", "a17_source_yield", "a24_model_benchmark"):
            query = next(q for n, q in load_all().items() if n.split("_")[0] == name.split("_")[0])
            plan = query.build(bucketed)._jdf.queryExecution().executedPlan().toString()
            assert "hashpartitioning(item_id" not in plan, (name, plan)
            assert "hashpartitioning(item_id" in query.build(cat_small)._jdf.queryExecution().executedPlan().toString()
            assert table(query.build(bucketed)) == table(query.build(cat_small))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", old)
        bucketed.drop()


def test_label_stream_late_and_repeated_rows(spark, tmp):
    from leadlens.operators.base import latest_label
    from leadlens.sources.tables import LEAD_LABELS_SCHEMA
    from leadlens.streaming import streams as ST

    batches = [[(1, "new", "gui", T0), (2, "confirmed", "gui", T0)], [(1, "rejected", "gui", T0 + dt.timedelta(1)), (2, "new", "gui", T0 - dt.timedelta(1))],
               [(3, "confirmed", None, None), (3, "new", "gui", T0)], [(1, "new", "gui", T0), (2, "confirmed", "gui", T0), (3, "rejected", "gui", T0 + dt.timedelta(9))]]
    done = []
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, LEAD_LABELS_SCHEMA).write.parquet(f"{tmp}/in/part={i}")
        ST.start_label_log(spark, f"{tmp}/in", LEAD_LABELS_SCHEMA, f"{tmp}/log", f"{tmp}/state").awaitTermination()
        done += rows
        want = table(latest_label(spark.createDataFrame(done, LEAD_LABELS_SCHEMA)))
        assert table(ST.current_labels(spark, f"{tmp}/log", LEAD_LABELS_SCHEMA)) == want
        if i == 1:
            ST.compact_labels(spark, f"{tmp}/log", LEAD_LABELS_SCHEMA, f"{tmp}/snapshot")
        if i >= 1:
            assert table(ST.current_labels(spark, f"{tmp}/log", LEAD_LABELS_SCHEMA, f"{tmp}/snapshot")) == want
    assert want == [(1, "rejected"), (2, "confirmed"), (3, "confirmed")]


def test_search_index_equals_the_full_scan(spark, tmp):
    from leadlens.operators import leads as L
    from leadlens.sources.search import SearchIndex
    from tests.conftest import SF_MID

    c = Catalog(spark, SF_MID)
    index = SearchIndex(spark, tmp).build(c.items, c.item_scores)
    some = c.items.where("title is not null").select("title").first()[0]
    for text in ("steel", "ste_l", "%", "_", "ab", "log%tics", some[5:20], some[:4].upper() + "%" + some[8:12], "no such text", "a\\%b", None):
        args = (c.item_scores, c.items, c.lead_labels, "A", 1, text)
        assert L.lead_count(L.browse(*args, index=index)).first() == L.lead_count(L.browse(*args)).first(), text
    plan = L.browse(c.item_scores, c.items, c.lead_labels, "A", 1, "steel", index=index)._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan and re.search(r"PartitionFilters: \[folder#\d+ IN|PartitionFilters: \[\(folder#\d+ = |PartitionFilters: \[[^]]*folder", plan)


def test_all_pages_by_seek_equal_the_full_order(spark, tmp, cat_small):
    from leadlens.operators import base as B
    from leadlens.operators import leads as L

    base = L.browse(cat_small.item_scores, cat_small.items, cat_small.lead_labels, "A", 5)
    base = base.withColumn("created_at", F.when(F.col("item_id") % 7 > 1, F.date_trunc("month", "created_at").cast("timestamp_ntz")))  # ties and NULLs
    L.write_ordered(base, tmp)
    want = [tuple(r) for r in base.withColumnRenamed("lead_score", "score").orderBy(*B.lead_order()).select("score", "created_at", "item_id", "model").collect()]
    got, last = [], None
    while page := L.lead_page_after(spark, tmp, last, 40).select("score", "created_at", "item_id", "model").collect():
        got += [tuple(r) for r in page]
        last = page[-1].asDict()
    assert got == want and len(want) > 80 and any(r[1] is None for r in want)
    plan = L.lead_page_after(spark, tmp, last, 40)._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(score" in plan and "TakeOrderedAndProject(limit=40" in plan
