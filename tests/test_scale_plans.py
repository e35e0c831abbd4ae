"""Plan properties that keep the operators scalable, and correctness under skew."""

import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from leadlens.operators import analytics as A
from leadlens.operators import base as B
from leadlens.operators import discover as D
from leadlens.plans import dashboard as Q
from leadlens.plans.registry import load_all
from leadlens.sources.tables import Catalog
from tests.conftest import SF_SMALL
from tests.oracle import compare


def pad(df, table):
    """Add the table's missing columns as typed NULLs."""
    from leadlens.sources.tables import SCHEMAS

    for f in SCHEMAS[table].fields:
        if f.name not in df.columns:
            df = df.withColumn(f.name, F.lit(None).cast(f.dataType))
    return df


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_latest_label_is_a_partial_aggregate(cat_small):
    p = plan_of(B.latest_label(cat_small.lead_labels))
    assert "Window" not in p and "Aggregate" in p


def test_coverage_join_spreads_null_cluster_keys(cat_small):
    base = B.lead_base(cat_small.item_scores, cat_small.items, cat_small.lead_labels, "A", 7)
    p = base._jdf.queryExecution().optimizedPlan().toString()
    assert "coalesce(cluster_id" in p


def test_fetch_queue_limits_before_the_shuffle(cat_small):
    p = plan_of(D.fetch_queue(cat_small.url_state, 3))
    assert "WindowGroupLimit" in p


def test_counter_rows_scan_each_table_once(cat_small):
    df = A.hero(cat_small.items, cat_small.item_scores, "A")
    p = df._jdf.queryExecution().optimizedPlan().toString()
    assert p.count("scalar-subquery") == 2   # one per table: items, item_scores


# the training-data queries run whole jobs while their frames are built, and are tested in a folder of their own
@pytest.mark.parametrize("name", sorted(n for n in load_all() if n != "p18_story_clusters"))
def test_no_cartesian_products(spark, name):
    p = plan_of(E.queries()[name](spark, SF_SMALL))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_materialized_scans_prune(spark, tmp):
    cat = Catalog(spark, SF_SMALL).materialize(f"{tmp}/tables")
    p = plan_of(A.score_histogram(cat.item_scores, "A"))
    assert "PartitionFilters: [isnotnull(prompt_version" in p and "(prompt_version" in p
    assert "ReadSchema: struct<lead_score:int>" in p
    from pyspark.sql import functions as F

    from leadlens.operators import discover as D

    p = plan_of(D.rss_links(cat.feeds.where(F.col("kind") == "rss")))
    assert "PartitionFilters: [isnotnull(kind" in p and "(kind" in p


# ---- skew: one source with a third of all items, one cluster with a third, a hot item -----------
@pytest.fixture(scope="module")
def skewed(spark):
    n = 3000
    t0 = dt.datetime(2024, 1, 1)
    items, scores, labels = [], [], []
    for i in range(n):
        hot = i % 3 == 0
        items.append((i, "hot" if hot else f"s{i % 17}", 7 if hot else (None if i % 2 else i // 10),
                      True if (not hot and i % 2 == 0 and i % 20 == 0) else (None if i % 2 else False),
                      t0 + dt.timedelta(minutes=i), None))
        for m in range(2):
            scores.append((i, f"m{m}", "A", None if (i + m) % 13 == 0 else (i * 7 + m) % 11,
                           t0 + dt.timedelta(minutes=i + m)))
    for k in range(500):
        labels.append((0, "confirmed" if k % 2 else "rejected", "crm", t0 + dt.timedelta(seconds=k)))
    labels.append((3, "rejected", "crm", None))
    it = spark.createDataFrame(items, "item_id long, source_id string, cluster_id long, "
                                      "is_cluster_canonical boolean, created_at timestamp_ntz, "
                                      "published_at timestamp_ntz")
    sc = spark.createDataFrame(scores, "item_id long, model string, prompt_version string, lead_score int, "
                                       "classified_at timestamp_ntz")
    ll = spark.createDataFrame(labels, "item_id long, label string, labeled_by string, labeled_at timestamp_ntz")
    con = duckdb.connect()
    for name, df in (("items", it), ("item_scores", sc), ("lead_labels", ll)):
        con.register(name, df.toArrow())  # Arrow keeps nullable INT (pandas would make it float)
    return it, sc, ll, con


def test_source_performance_under_skew(skewed):
    it, sc, ll, con = skewed
    sql = f"select source_id as source, articles, scored, avg_score, best, leads from ({Q.SQL_PER_SOURCE}) p"
    compare(A.source_performance(it, sc, "A"), con, sql)


def test_coverage_and_latest_label_under_skew(skewed):
    it, sc, ll, con = skewed
    compare(B.cluster_coverage(it), con, f"with {Q.SQL_COVERAGE} select * from cs")
    compare(B.latest_label(ll), con, f"with {Q.SQL_LATEST} select item_id, label from ll")
    base = B.lead_base(pad(sc, "item_scores"), pad(it, "items"), ll, "A", 1)
    n = con.execute("""select count(*) from item_scores s join items i on i.item_id = s.item_id
                       where s.prompt_version = 'A' and s.lead_score >= 1
                         and (i.cluster_id is null or i.is_cluster_canonical = true)""").fetchone()[0]
    assert base.count() == n
