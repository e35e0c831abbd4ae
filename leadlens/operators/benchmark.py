"""Model/prompt benchmark against ground-truth labels.

Relevant = effective label confirmed / follow_up / contacted, irrelevant =
rejected; items whose newest label is anything else are left out.  A run
is one (model, prompt_version).  Precision and recall count labelled items
that the run scored (inner join); mean score and High % count every
scored row of the run.  NULL scores are excluded everywhere.

Plan: one pass over item_scores ⟕ newest label (per item, an aggregate)
builds a histogram (model, prompt_version, score) -> counts.  That table
has at most 11 rows per run, so metrics for one threshold or a sweep of
thresholds are computed from it; the sweep explodes a 1..10 sequence on
histogram rows instead of cross-joining a threshold table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlens.functions import expr as X
from leadlens.operators import base as B

# Which labels count as relevant / irrelevant.
RELEVANT = ["confirmed", "follow_up", "contacted"]
IRRELEVANT = ["rejected"]
RUN_KEYS = ["model", "prompt_version"]


def ground_truth(lead_labels: DataFrame) -> DataFrame:
    """(item_id, relevant boolean) for items whose newest label is decisive."""
    ll = B.latest_label(lead_labels)
    return (ll.where(F.col("label").isin(RELEVANT + IRRELEVANT))
            .select("item_id", F.col("label").isin(RELEVANT).alias("relevant")))


def score_histogram(item_scores: DataFrame, lead_labels: DataFrame) -> DataFrame:
    """(model, prompt_version, score) -> n_all, n_rel, n_irr (score rows)."""
    s = item_scores.where(F.col("lead_score").isNotNull()).select(*RUN_KEYS, "item_id", "lead_score")
    j = s.join(ground_truth(lead_labels), "item_id", "left")
    return j.groupBy(*RUN_KEYS, F.col("lead_score").alias("score")).agg(
        F.count(F.lit(1)).alias("n_all"),
        F.count_if(F.col("relevant") == F.lit(True)).alias("n_rel"),
        F.count_if(F.col("relevant") == F.lit(False)).alias("n_irr"))


def _ratio3(num: Column, den: Column) -> Column:
    return X.round_ratio(num, den, 3)


def _metrics(h: DataFrame, t: Column, keys: list) -> DataFrame:
    ge = F.col("score") >= t
    zero = F.lit(0).cast("long")
    agg = h.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(ge, F.col("n_rel"))), zero).cast("long").alias("tp"),
        F.coalesce(F.sum(F.when(ge, F.col("n_irr"))), zero).cast("long").alias("fp"),
        F.coalesce(F.sum(F.when(~ge, F.col("n_rel"))), zero).cast("long").alias("fn"),
        F.sum("n_all").cast("long").alias("n_scored"),
        F.coalesce(F.sum(F.when(ge, F.col("n_all"))), zero).cast("long").alias("n_high"),
        F.sum(F.col("score") * F.col("n_all")).cast("long").alias("sum_score"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return agg.select(
        *keys, "tp", "fp", "fn",
        _ratio3(tp, tp + fp).alias("precision"),
        _ratio3(tp, tp + fn).alias("recall"),
        _ratio3(2 * tp, 2 * tp + fp + fn).alias("f1"),
        X.round_ratio(F.col("sum_score"), F.col("n_scored"), 2).alias("avg_score"),
        X.round_ratio(F.col("n_high") * 100, F.col("n_scored"), 1).alias("high_pct"),
        "n_scored")


def benchmark(item_scores: DataFrame, lead_labels: DataFrame, threshold: int = 7) -> DataFrame:
    """One row per run at threshold t."""
    h = score_histogram(item_scores, lead_labels)
    return (_metrics(h, F.lit(threshold), RUN_KEYS)
            .withColumn("threshold", F.lit(threshold))
            .orderBy(F.col("f1").desc_nulls_last(), *RUN_KEYS))


def threshold_sweep(item_scores: DataFrame, lead_labels: DataFrame, lo: int = 1, hi: int = 10) -> DataFrame:
    """A24 for every threshold lo..hi."""
    h = score_histogram(item_scores, lead_labels)
    hx = h.withColumn("threshold", F.explode(F.sequence(F.lit(lo), F.lit(hi))))
    return _metrics(hx, F.col("threshold"), RUN_KEYS + ["threshold"]) \
        .orderBy(*RUN_KEYS, "threshold")


def best_combination(bench: DataFrame) -> DataFrame:
    """Best run by F1 and best run by recall (ties: model, prompt)."""
    by_f1 = (bench.orderBy(F.col("f1").desc_nulls_last(), *RUN_KEYS).limit(1)
             .select(F.lit("f1").alias("criterion"), *RUN_KEYS, "precision", "recall", "f1"))
    by_recall = (bench.orderBy(F.col("recall").desc_nulls_last(), *RUN_KEYS).limit(1)
                 .select(F.lit("recall").alias("criterion"), *RUN_KEYS, "precision", "recall", "f1"))
    return by_f1.unionByName(by_recall)


def prompt_deltas(bench: DataFrame, a: str = "A", b: str = "B") -> DataFrame:
    """Per model, metric under prompt b minus prompt a (NULL if a run is missing)."""
    metrics = ["precision", "recall", "f1", "avg_score"]
    wide = bench.groupBy("model").pivot("prompt_version", [a, b]).agg(
        *[F.first(m).alias(m) for m in metrics])
    cols = ["model"]
    for m in metrics:
        ca, cb = F.col(f"{a}_{m}"), F.col(f"{b}_{m}")
        cols += [ca.alias(f"{m}_{a.lower()}"), cb.alias(f"{m}_{b.lower()}"),
                 F.round((cb - ca).cast("decimal(38,12)"), 3).cast("double").alias(f"{m}_delta")]
    return wide.select(*cols).orderBy("model")
