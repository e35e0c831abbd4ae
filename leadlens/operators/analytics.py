"""Dashboard aggregates (A1-A23) with their reshaping (U1-U4) and windows.

Conventions
-----------
* ``pv`` is the prompt version, ``as_of`` the reference time replacing
  ``now()``; when ``as_of`` is None it is the max of the time column used,
  attached as a scalar subquery (no driver round trip).
* Several independent counts in one row (J6) are scalar subqueries over
  one-row aggregates; Catalyst merges those over the same table into a
  single scan (MergeScalarSubqueries).
* Distinct counts per source are computed by pre-aggregating score rows
  per item, joining once, then grouping (source_id, item_id) -> source_id:
  no Expand of the input, map-side partial aggregates at each step, and a
  hot source only ever sees one partial row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from leadlens.functions import expr as X
from leadlens.functions.country import flag_expr
from leadlens.operators import base as B


# ---- helpers -------------------------------------------------------------------
def as_of_col(df: DataFrame, time_col: str, as_of=None) -> Column:
    """``as_of`` literal, or max(time_col) of ``df`` as a scalar subquery."""
    if as_of is not None:
        return F.lit(as_of).cast("timestamp_ntz")
    return df.agg(F.max(time_col)).scalar()


def days_before(as_of: Column, n: int) -> Column:
    return as_of - F.make_dt_interval(F.lit(n))


def count_where(df: DataFrame, pred: Column | None = None) -> Column:
    agg = F.count(F.lit(1)) if pred is None else F.count_if(pred)
    return df.agg(agg).scalar()


def table_row(df: DataFrame, **aggs: Column) -> Column:
    """All aggregates over one table as a single struct-valued scalar subquery.

    J6 in its preferred form: one scan (and one conditional-aggregate pass)
    per table, whatever the number of counters read from it.
    """
    return df.agg(F.struct(*[a.alias(k) for k, a in aggs.items()]).alias("r")).scalar()


def rows_to_one(spark, *fields: tuple[str, Column, str]) -> DataFrame:
    """Flatten (output name, struct subquery, field) triples into a one-row frame."""
    subs: dict[int, tuple[str, Column]] = {}
    for _, sub, _f in fields:
        subs.setdefault(id(sub), (f"_t{len(subs)}", sub))
    base = spark.range(1).select(*[c.alias(n) for n, c in subs.values()])
    return base.select(*[F.col(f"{subs[id(sub)][0]}.{f}").alias(name) for name, sub, f in fields])


def _n(pred: Column | None = None) -> Column:
    return F.count(F.lit(1)) if pred is None else F.count_if(pred)


def _pv(df: DataFrame, pv: str) -> DataFrame:
    return df.where(F.col("prompt_version") == pv)


def dec_round(c: Column, n: int) -> Column:
    """Round a double exactly (decimal, half away from zero) and return double."""
    return F.round(c.cast("decimal(38,12)"), n).cast("double")


# ---- S3 ------------------------------------------------------------------------
def prompt_versions(item_scores: DataFrame) -> DataFrame:
    """Distinct prompt versions in order; default 'A' if present, else the first."""
    v = item_scores.select("prompt_version").distinct()
    has_a = count_where(v, F.col("prompt_version") == "A") > 0
    first = v.agg(F.min("prompt_version")).scalar()
    default = F.when(has_a, F.lit("A")).otherwise(first)
    return v.select("prompt_version", (F.col("prompt_version") == default).alias("is_default"))


# ---- A1 / A7 / A14 / A8: one-row counters ---------------------------------------------
def hero(items: DataFrame, item_scores: DataFrame, pv: str) -> DataFrame:
    """A1: sources, articles, leads (>=5), strong leads (>=7) — score rows, all models."""
    s = _pv(item_scores, pv)
    i = table_row(items, sources=F.countDistinct("source_id"), articles=_n())
    sc = table_row(s, leads=_n(F.col("lead_score") >= 5), strong_leads=_n(F.col("lead_score") >= 7))
    row = rows_to_one(items.sparkSession, ("sources", i, "sources"), ("articles", i, "articles"),
                      ("leads", sc, "leads"), ("strong_leads", sc, "strong_leads"))
    return row.withColumn("articles_text", X.thousands("articles"))


def lead_counters(items: DataFrame, item_scores: DataFrame, pv: str) -> DataFrame:
    """Leads, strong, articles, pending (P13: text > 100 chars and no item score)."""
    s = _pv(item_scores, pv)
    pending = (F.col("clean_text").isNotNull() & (F.length("clean_text") > 100)
               & F.col("lead_score").isNull())
    i = table_row(items, articles=_n(), pending=_n(pending))
    sc = table_row(s, leads=_n(F.col("lead_score") >= 5), strong_leads=_n(F.col("lead_score") >= 7))
    return rows_to_one(items.sparkSession, ("articles", i, "articles"), ("leads", sc, "leads"),
                       ("strong_leads", sc, "strong_leads"), ("pending", i, "pending"))


def analytics_hero(items: DataFrame, item_scores: DataFrame, pv: str) -> DataFrame:
    """Sources, articles, classified (score rows incl. NULL), leads."""
    s = _pv(item_scores, pv)
    i = table_row(items, sources=F.countDistinct("source_id"), articles=_n())
    sc = table_row(s, classified=_n(), leads=_n(F.col("lead_score") >= 5))
    return rows_to_one(items.sparkSession, ("sources", i, "sources"), ("articles", i, "articles"),
                       ("classified", sc, "classified"), ("leads", sc, "leads"))


# The funnel's stage names, in order.
FUNNEL_STAGES = ["URLs Discovered", "Articles Extracted", "Relevance Filter", "AI Scored",
                 "Leads Found", "Strong Leads"]


def funnel(url_state: DataFrame, items: DataFrame, item_scores: DataFrame, pv: str) -> DataFrame:
    """A8 + W4: six stages as rows (stage_no, stage, n, pct_of_first)."""
    s = _pv(item_scores, pv)
    u = table_row(url_state, n=_n())
    i = table_row(items, n=_n(), passed=_n(F.col("prefilter_pass") == F.lit(True)))
    sc = table_row(s, n=_n(), leads=_n(F.col("lead_score") >= 5), strong=_n(F.col("lead_score") >= 7))
    wide = rows_to_one(items.sparkSession, ("c0", u, "n"), ("c1", i, "n"), ("c2", i, "passed"),
                       ("c3", sc, "n"), ("c4", sc, "leads"), ("c5", sc, "strong"))
    rows = F.array(*[F.struct(F.lit(i + 1).alias("stage_no"), F.lit(name).alias("stage"),
                              F.col(f"c{i}").alias("n"))
                     for i, name in enumerate(FUNNEL_STAGES)])
    first = F.col("c0").cast("double")
    return (wide.select(F.inline(rows), first.alias("first"))
            .select("stage_no", "stage", "n",
                    F.when(F.col("first") > 0, F.col("n") * 100.0 / F.col("first")).alias("pct_of_first")))


# ---- A2 / A17 / A18 / A19: per-source ---------------------------------------------
def _per_item_scores(item_scores: DataFrame, pv: str) -> DataFrame:
    s = _pv(item_scores, pv)
    return s.groupBy("item_id").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count("lead_score").alias("n_scored"),
        F.sum("lead_score").alias("sum_score"),
        F.max("lead_score").alias("max_score"),
        F.count_if(F.col("lead_score") >= 5).alias("n_lead_rows"))


def _per_source(items: DataFrame, item_scores: DataFrame, pv: str) -> DataFrame:
    """items ⟕ item_scores(pv) rolled up to (source_id): the J2 aggregates."""
    per_item = _per_item_scores(item_scores, pv)
    j = items.select("item_id", "source_id").join(per_item, "item_id", "left")
    # one row per (source, item): exact distinct counts without an Expand
    k = j.groupBy("source_id", "item_id").agg(
        F.max(F.col("n_rows").isNotNull().cast("int")).alias("scored"),
        F.max((F.col("n_lead_rows") > 0).cast("int")).alias("is_lead"),
        F.sum("sum_score").alias("sum_score"),
        F.sum("n_scored").alias("n_scored"),
        F.max("max_score").alias("max_score"))
    return k.groupBy("source_id").agg(
        F.count("item_id").alias("articles"),
        F.coalesce(F.sum("scored"), F.lit(0)).cast("long").alias("scored"),
        F.coalesce(F.sum("is_lead"), F.lit(0)).cast("long").alias("leads"),
        F.sum("sum_score").alias("sum_score"),
        F.sum("n_scored").alias("n_scored"),
        F.max("max_score").alias("best"))


def articles_by_source(items: DataFrame, item_scores: DataFrame, pv: str, top: int = 15) -> DataFrame:
    """A2 + L1: articles and leads (distinct items scoring >= 5) per source, top 15."""
    p = _per_source(items, item_scores, pv)
    return (p.select("source_id", "articles", "leads")
            .orderBy(F.col("articles").desc(), F.col("source_id").asc()).limit(top))


def _mean(sum_c: str, n_c: str) -> Column:
    return F.try_divide(F.col(sum_c).cast("double"), F.col(n_c))


def source_performance(items: DataFrame, item_scores: DataFrame, pv: str) -> DataFrame:
    """Articles, scored, mean score (1 dp), best, leads per source; mean desc nulls last.

    The mean is over score rows, so several models per item weight it.
    """
    p = _per_source(items, item_scores, pv)
    mean = _mean("sum_score", "n_scored")
    return (p.select(F.col("source_id").alias("source"), "articles", "scored",
                     X.round_ratio(F.col("sum_score"), F.col("n_scored"), 1).alias("avg_score"),
                     "best", "leads", mean.alias("_mean"))
            .orderBy(F.col("_mean").desc_nulls_last(), F.col("source").asc())
            .drop("_mean"))


def _yield(p: DataFrame) -> Column:
    # leads per hundred articles, to one decimal, halves to even; a source without articles counts as one
    arts = F.when(F.col("articles") == 0, F.lit(1)).otherwise(F.col("articles"))
    return F.rint(F.col("leads") / arts * 100 * 10) / 10


def lead_yield(items: DataFrame, item_scores: DataFrame, pv: str, min_articles: int = 5,
               top: int = 12) -> DataFrame:
    """A18 + L9: yield % for sources with >= 5 articles, best 12, shown ascending."""
    p = _per_source(items, item_scores, pv).select(F.col("source_id").alias("source"), "articles", "leads")
    y = p.where(F.col("articles") >= min_articles).withColumn("yield", _yield(p))
    best = y.orderBy(F.col("yield").desc(), F.col("source").asc()).limit(top)
    return best.orderBy(F.col("yield").asc(), F.col("source").desc())


def zero_yield_sources(items: DataFrame, item_scores: DataFrame, pv: str, min_articles: int = 5) -> DataFrame:
    """Sources with >= 5 articles and no lead."""
    perf = source_performance(items, item_scores, pv)
    return (perf.where((F.col("leads") == 0) & (F.col("articles") >= min_articles))
            .select("source", "articles", "avg_score", "best"))


# ---- A3 / A4 / A5 ----------------------------------------------------------------
def articles_per_day(items: DataFrame, as_of=None, days: int = 30) -> DataFrame:
    """A3: articles per calendar day since as_of - 30 days; empty days absent."""
    t = as_of_col(items, "created_at", as_of)
    return (items.where(F.col("created_at") >= days_before(t, days))
            .groupBy(F.to_date("created_at").alias("day"))
            .agg(F.count(F.lit(1)).alias("articles"))
            .orderBy("day"))


def leads_by_sector(items: DataFrame, min_score: int = 5) -> DataFrame:
    """A4: canonical items with item score >= 5 by sector ('' / NULL -> 'unspecified')."""
    return (items.where((F.col("lead_score") >= min_score) & B.canonical_only())
            .groupBy(X.sector_or_unspecified("sector").alias("sector"))
            .agg(F.count(F.lit(1)).alias("leads"))
            .orderBy(F.col("leads").desc(), F.col("sector").asc()))


def leads_by_item_country(items: DataFrame, min_score: int = 5) -> DataFrame:
    """A5: same set, by items.lead_country (present only)."""
    return (items.where((F.col("lead_score") >= min_score) & B.canonical_only()
                        & X.present("lead_country"))
            .groupBy(F.col("lead_country").alias("country"))
            .agg(F.count(F.lit(1)).alias("leads"))
            .orderBy(F.col("leads").desc(), F.col("country").asc()))


# ---- A6 / U3 / U4 / W2 --------------------------------------------------------------
def activity_by_band(item_scores: DataFrame, pv: str, as_of=None, days: int = 30) -> DataFrame:
    """Score rows per (day, band) in the last 30 days; NULL scores excluded."""
    s = _pv(item_scores, pv)
    t = as_of_col(s, "classified_at", as_of)
    return (s.where((F.col("classified_at") >= days_before(t, days)) & F.col("lead_score").isNotNull())
            .groupBy(F.to_date("classified_at").alias("day"), X.activity_band("lead_score").alias("band"))
            .agg(F.count(F.lit(1)).alias("n"))
            .orderBy("day", "band"))


def activity_pivot(activity: DataFrame) -> DataFrame:
    """Day x band, missing -> 0, the four bands as columns in stack order."""
    return (activity.groupBy("day").pivot("band", X.ACTIVITY_BANDS).agg(F.sum("n"))
            .na.fill(0, subset=X.ACTIVITY_BANDS)
            .select("day", *[F.col(f"`{b}`").cast("long").alias(b) for b in X.ACTIVITY_BANDS])
            .orderBy("day"))


def activity_long(pivot: DataFrame) -> DataFrame:
    """U4: melt the pivot back to (day, band, n), zeros included."""
    return pivot.unpivot(["day"], [F.col(f"`{b}`") for b in X.ACTIVITY_BANDS], "band", "n")


def activity_summary(pivot: DataFrame) -> DataFrame:
    """Last 7 rows vs the 7 before, over the days present (not calendar days).

    Matches ``tail(7)`` and ``tail(14).head(7)``: with fewer than 14 rows the
    'previous' rows are the earliest min(7, n) and overlap 'last'.  The
    pivot holds at most one row per day of the window (<= 31 rows), so the
    unpartitioned window below is bounded by the window length, not data.
    """
    total = sum(F.col(f"`{b}`") for b in X.ACTIVITY_BANDS)
    r = pivot.select("day", total.alias("total"), F.col(f"`{X.BAND_ELITE}`").alias("elite"),
                     F.col(f"`{X.BAND_STRONG}`").alias("strong"),
                     F.row_number().over(W.orderBy(F.col("day").desc())).alias("rn"),
                     F.count(F.lit(1)).over(W.partitionBy()).alias("n_rows"))
    m = F.least(F.lit(14), F.col("n_rows"))
    last = F.col("rn") <= 7
    prev = (F.col("rn") <= m) & (F.col("rn") > m - 7)
    zero = F.lit(0).cast("long")
    agg = r.agg(F.coalesce(F.sum(F.when(last, F.col("total"))), zero).cast("long").alias("last7"),
                F.coalesce(F.sum(F.when(prev, F.col("total"))), zero).cast("long").alias("prev7"),
                F.coalesce(F.sum(F.when(last, F.col("elite"))), zero).cast("long").alias("elite7"),
                F.coalesce(F.sum(F.when(last, F.col("strong"))), zero).cast("long").alias("strong7"))
    return agg


# ---- A9 ------------------------------------------------------------------------------
def score_histogram(item_scores: DataFrame, pv: str, count_name: str = "count") -> DataFrame:
    """Score rows per score value (NULL dropped), ascending."""
    return (_pv(item_scores, pv).where(F.col("lead_score").isNotNull())
            .groupBy(F.col("lead_score").alias("score"))
            .agg(F.count(F.lit(1)).alias(count_name))
            .orderBy("score"))


# ---- A12 / A13 / A16 ------------------------------------------------------------------
def kpi_strip(items: DataFrame, item_scores: DataFrame, pv: str, as_of=None) -> DataFrame:
    """A12 + W3: elite (>= 9) last 7 days vs the 7 before, mean score, active countries."""
    s = _pv(item_scores, pv)
    t = as_of_col(s, "classified_at", as_of)
    ca = F.col("classified_at")
    elite = F.col("lead_score") >= 9
    recent = elite & (ca >= days_before(t, 7))
    previous = elite & (ca < days_before(t, 7)) & (ca >= days_before(t, 14))
    sc = table_row(s, elite_7d=_n(recent), elite_prev7=_n(previous), avg_score=X.round_avg("lead_score", 1))
    leads = s.where(F.col("lead_score") >= 5).select("item_id")
    ct = table_row(items.where(X.present("lead_country")).join(leads, "item_id", "left_semi"),
                   countries=F.countDistinct("lead_country"))
    row = rows_to_one(items.sparkSession, ("elite_7d", sc, "elite_7d"), ("elite_prev7", sc, "elite_prev7"),
                      ("avg_score", sc, "avg_score"), ("countries", ct, "countries"))
    return row.select("elite_7d", "elite_prev7", (F.col("elite_7d") - F.col("elite_prev7")).alias("delta"),
                      X.delta_text("elite_7d", "elite_prev7").alias("delta_text"),
                      "avg_score", "countries",
                      F.greatest(F.col("countries") - 4, F.lit(0)).alias("more_countries"))


def top_item_countries(items: DataFrame, item_scores: DataFrame, pv: str, top: int = 10) -> DataFrame:
    """A13 + X14: joined rows (items ⋈ scores >= 5) per items.lead_country, top 10, with flag."""
    per_item = (_pv(item_scores, pv).where(F.col("lead_score") >= 5)
                .groupBy("item_id").agg(F.count(F.lit(1)).alias("k")))
    j = items.where(X.present("lead_country")).select("item_id", "lead_country").join(per_item, "item_id")
    return (j.groupBy(F.col("lead_country").alias("country")).agg(F.sum("k").alias("n"))
            .orderBy(F.col("n").desc(), F.col("country").asc()).limit(top)
            .select("country", "n", flag_expr("country").alias("flag")))


def leads_by_score_country(item_scores: DataFrame, pv: str, min_score: int = 3, top: int = 12) -> DataFrame:
    """Score rows >= 3 by item_scores.lead_country (present), top 12."""
    return (_pv(item_scores, pv).where((F.col("lead_score") >= min_score) & X.present("lead_country"))
            .groupBy(F.col("lead_country").alias("country")).agg(F.count(F.lit(1)).alias("leads"))
            .orderBy(F.col("leads").desc(), F.col("country").asc()).limit(top))


# ---- A15 + U1 -------------------------------------------------------------------------
def classification_breakdown(items: DataFrame, item_scores: DataFrame, pv: str) -> DataFrame:
    """Unscored items by pre-score category ∪ score rows by band, summed per category."""
    unscored = (B.unscored_items(items, item_scores, pv)
                .groupBy(X.prescore_category("classifier_model").alias("category"))
                .agg(F.count(F.lit(1)).alias("n")))
    scored = (_pv(item_scores, pv).groupBy(X.breakdown_band("lead_score").alias("category"))
              .agg(F.count(F.lit(1)).alias("n")))
    return (unscored.unionByName(scored).groupBy("category").agg(F.sum("n").cast("long").alias("n"))
            .orderBy(F.col("n").desc(), F.col("category").asc()))


# ---- L6 / A20 / A21 --------------------------------------------------------------------
def recent_runs(pipeline_runs: DataFrame, n: int = 100) -> DataFrame:
    """L6 + F7: newest 100 finished runs (started_at desc, NULL first as in PostgreSQL)."""
    return (pipeline_runs.where(F.col("finished_at").isNotNull())
            .orderBy(F.col("started_at").desc_nulls_first(), F.col("run_id").desc()).limit(n))


def run_totals(pipeline_runs: DataFrame, n: int = 100) -> DataFrame:
    """Runs, articles, errors (NULL skipped), last start over the newest 100."""
    r = recent_runs(pipeline_runs, n)
    zero = F.lit(0).cast("long")
    return r.agg(F.count(F.lit(1)).alias("runs"),
                 F.coalesce(F.sum("articles_processed"), zero).cast("long").alias("articles"),
                 F.coalesce(F.sum("articles_err"), zero).cast("long").alias("errors"),
                 F.max("started_at").alias("last_start")) \
            .withColumn("last_run", X.short_stamp("last_start"))


SCRIPTS = ["classify", "extract", "fetch", "discover"]


def script_means(pipeline_runs: DataFrame, n: int = 100) -> DataFrame:
    """Per script (fixed order): runs, mean duration, mean articles, mean s/article.

    Means skip NULL; s/article is NULL when no value or when the mean <= 0.
    Means are rounded to 6 dp (exact decimal) so summation order can't show.
    """
    r = recent_runs(pipeline_runs, n).where(F.col("script").isin(SCRIPTS))
    order = F.array_position(F.array(*[F.lit(s) for s in SCRIPTS]), F.col("script"))
    spa = F.avg("avg_s_per_article")
    return (r.groupBy("script").agg(
                F.count(F.lit(1)).alias("runs"),
                dec_round(F.avg("duration_s"), 6).alias("avg_duration_s"),
                dec_round(F.avg("articles_processed"), 6).alias("avg_articles"),
                dec_round(F.when(spa > 0, spa), 6).alias("avg_s_per_article"))
            .withColumn("script_no", order.cast("int"))
            .select("script_no", "script", "runs", "avg_duration_s", "avg_articles", "avg_s_per_article")
            .orderBy("script_no"))


# ---- A22 ----------------------------------------------------------------------------------
def prompt_comparison(item_scores: DataFrame) -> DataFrame:
    """Per prompt version over all models: rows, mean (2 dp), >= 5, >= 7."""
    return (item_scores.groupBy("prompt_version").agg(
                F.count(F.lit(1)).alias("articles"),
                X.round_avg("lead_score", 2).alias("avg_score"),
                F.count_if(F.col("lead_score") >= 5).alias("leads_5+"),
                F.count_if(F.col("lead_score") >= 7).alias("leads_7+"))
            .orderBy("prompt_version"))


# ---- A25 -------------------------------------------------------------------------------------
def items_by_source(items: DataFrame) -> DataFrame:
    return items.groupBy("source_id").agg(F.count(F.lit(1)).alias("n")).orderBy("source_id")


def labels_by_label(lead_labels: DataFrame) -> DataFrame:
    return lead_labels.groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy("label")
