"""Lead browser and review queue.

``browse`` returns the shared lead set once; count, page and export are
actions on it (persist it when all three run, as the dashboard does).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadlens.functions import expr as X
from leadlens.operators import base as B


def browse(item_scores: DataFrame, items: DataFrame, lead_labels: DataFrame, pv: str,
           min_score=7, search: str | None = None, model: str | None = None, index=None) -> DataFrame:
    """J1+J3+J4 with F1-F3: one row per matching score row; ``index`` narrows what a search reads."""
    return B.lead_base(item_scores, items, lead_labels, pv, B.min_score_for(min_score), search, model, index=index)


def lead_count(base: DataFrame) -> DataFrame:
    """A10: size of the filtered lead set (one row)."""
    return base.agg(F.count(F.lit(1)).alias("n"))


def write_ordered(base: DataFrame, path: str) -> None:
    """The lead set range-sorted in page order, for ``lead_page_after``: a page's rows lie in one or two files."""
    order = B.lead_order()
    rows = base.withColumnRenamed("lead_score", "score")
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(path)


def after(last: dict | None) -> Column:
    """Whether a row comes after the row with the key ``last`` (score, created_at, item_id, model) in page order."""
    if last is None:
        return F.lit(True)
    score, t, item, model = (F.lit(last[k]) for k in ("score", "created_at", "item_id", "model"))
    tie = (F.col("item_id") > item) | ((F.col("item_id") == item) & (F.col("model") > model))
    at = F.col("created_at")
    if last["created_at"] is None:  # rows without a time come first
        later, same = at.isNotNull(), at.isNull()
    else:
        later, same = at < t.cast("timestamp_ntz"), at == t.cast("timestamp_ntz")
    # the bound of the score by itself reaches the scan
    return (F.col("score") <= score) & ((F.col("score") < score) | later | (same & tie))


def lead_page_after(spark: SparkSession, path: str, last: dict | None, size: int = 10) -> DataFrame:
    """L4 by seek: the ``size`` rows after ``last``, the key of the last row shown (None: the first page), of what
    ``write_ordered`` wrote. Each task keeps ``size`` rows however deep the page lies."""
    return spark.read.parquet(path).where(after(last)).orderBy(*B.lead_order()).limit(size)


def lead_page(base: DataFrame, page: int = 1, size: int = 10) -> DataFrame:
    """L3 + L4 + F9: one page of lead cards, ordered score desc, created_at desc.

    ``page`` is 1-based and must already be clamped (``base.page_bounds``);
    offset+limit plans as a TakeOrderedAndProject: each task keeps its
    top (offset+limit) rows, never the whole set.
    """
    cards = B.lead_card(base)
    return (cards.orderBy(*B.lead_order()).offset((page - 1) * size).limit(size)
            .select(*B.CARD_COLUMNS))


def export_frame(base: DataFrame) -> DataFrame:
    """F10 + L3: the full filtered set in export column order (global sort)."""
    return B.export_rows(base).orderBy(*B.lead_order()).select(*B.EXPORT_COLUMNS)


def export_table(base: DataFrame) -> DataFrame:
    """the on-screen column subset of the export frame."""
    return B.export_rows(base).orderBy(*B.lead_order()).select(*B.TABLE_COLUMNS)


def review_rows(item_scores: DataFrame, items: DataFrame, lead_labels: DataFrame, pv: str,
                min_score: int = 5) -> DataFrame:
    """F11 over the whole lead set: what the review queue shows 100 rows of."""
    return B.review_rows(B.lead_base(item_scores, items, lead_labels, pv, min_score))


def review_queue(item_scores: DataFrame, items: DataFrame, lead_labels: DataFrame, pv: str,
                 min_score: int = 5, status: str = "new", limit: int = 100) -> DataFrame:
    """L5 + F4 + F11: review rows, score desc, first 100 ('all' disables the status filter)."""
    rows = review_rows(item_scores, items, lead_labels, pv, min_score)
    if status != "all":
        rows = rows.where(F.col("status") == status)
    return (rows.orderBy(F.col("score").desc(), F.col("item_id").asc(), F.col("model").asc())
            .limit(limit).select(*B.REVIEW_COLUMNS))


def review_status_counts(review: DataFrame) -> DataFrame:
    """Count per status over the review rows; all five statuses, zero if absent."""
    wide = review.groupBy().pivot("status", X.STATUSES).agg(F.count(F.lit(1)))
    wide = wide.select(*[F.coalesce(F.col(s), F.lit(0)).cast("long").alias(s) for s in X.STATUSES])
    return wide.unpivot([], X.STATUSES, "status", "n")


def changed_labels(shown: DataFrame, edited: DataFrame) -> DataFrame:
    """M6: items whose edited status differs from the shown one, matched by item_id.

    Review rows are score rows, so an item shown for several models appears
    several times; both sides are reduced to distinct (item_id, status)
    first, giving one label row per changed item and new status.
    Returns (item_id, label, labeled_by='gui') ready for the K1 append.
    """
    e = edited.select("item_id", F.col("status").alias("new_status")).distinct()
    s = shown.select("item_id", F.col("status").alias("old_status")).distinct()
    return (e.join(s, "item_id")
            .where(~F.col("new_status").eqNullSafe(F.col("old_status")))
            .select("item_id", F.col("new_status").alias("label"), F.lit("gui").alias("labeled_by"))
            .distinct())


def members_of_leads(base: DataFrame, items: DataFrame) -> DataFrame:
    """Coverage members for every lead of the set, ordered per lead."""
    cards = B.lead_card(base)
    m = B.cluster_members(cards, items)
    return (m.orderBy("lead_item_id", F.col("member_time").asc_nulls_last(), "member_item_id")
            .drop("member_time"))


def lead_display(base: DataFrame, items: DataFrame, as_of=None) -> DataFrame:
    """The per-row display fields of a lead card, computed in the JVM.

    ``as_of`` defaults to the newest items.created_at (a scalar subquery on
    one column of items, not a second evaluation of the lead set).
    """
    from leadlens.functions.country import flag_expr
    from leadlens.operators.analytics import as_of_col

    cards = B.lead_card(base)
    t = as_of_col(items, "created_at", as_of)
    company = X.display_company("company")
    country = X.blank_placeholder("country")
    project = X.blank_placeholder("what")
    return cards.select(
        "item_id", "model", "score",
        company.alias("company_display"),
        X.initial(company).alias("initial"),
        X.avatar_bucket(company).alias("avatar_bucket"),
        X.stars("score").alias("stars"),
        X.score_percent("score").alias("score_pct"),
        X.emphasis_level("score").alias("emphasis"),
        X.rubric_band("score").alias("rubric"),
        flag_expr(country).alias("flag"),
        F.coalesce(F.nullif(X.html_escape(X.ellipsize(project, 36)), F.lit("")), F.lit(X.PLACEHOLDER)).alias("project_short"),
        X.html_escape("title").alias("title_html"),
        X.age_text("date", t, is_date=True).alias("published_ago"),
        X.money_text("investment_eur").alias("investment_text"),
    )
