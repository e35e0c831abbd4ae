"""Building blocks shared by the dashboard queries.

W1 newest label, A11 cluster coverage, F1-F5 predicates, J1-J7 joins and
the shared lead set ``lead_base`` (item_scores ⋈ items ⟕ label ⟕ coverage).

Scale notes
-----------
* W1 is an aggregate (``min`` of an ordering struct) rather than a
  ``row_number`` window: it gets a map-side partial aggregate, so an item
  with millions of label rows never lands whole in one task.
* A11 counts distinct sources per cluster; Spark's one-distinct plan first
  shuffles on (cluster_id, source_id), so a giant cluster is spread out
  before the final per-cluster merge of partial counts.
* The coverage join keys NULL cluster ids by item id (they can never match,
  an extra ON predicate guarantees it).  Unclustered items — usually most
  of them — would otherwise all hash to the single partition of NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlens.functions import expr as X

SCORE_FIELDS = ["lead_company", "lead_city", "lead_country", "lead_who", "lead_what",
                "lead_when", "lead_reason", "lead_description"]
ITEM_FIELDS = ["source_id", "url", "title", "created_at", "published_at", "sector", "commodity_nst",
               "event_status", "company_role", "investment_eur", "cluster_id", "is_cluster_canonical"]


# ---- predicates ---------------------------------------------------------------
def canonical_only(prefix: str = "") -> Column:
    """unclustered, or the canonical row of its cluster (NULL flag drops)."""
    cid, canon = F.col(prefix + "cluster_id"), F.col(prefix + "is_cluster_canonical")
    return cid.isNull() | (canon == F.lit(True))


def min_score_for(choice) -> int:
    """F1: chip label or number -> minimum score ('All' still means >= 1)."""
    if isinstance(choice, str):
        return X.SCORE_CHOICES[choice]
    return int(choice)


def search_predicate(q: str | None, cols=("lead_company", "title", "sector")) -> Column | None:
    """case-insensitive substring over company, title, sector; '%'/'_' stay wildcards."""
    if not q:
        return None
    pat = f"%{q}%"
    pred = None
    for c in cols:
        p = F.col(c).ilike(pat)
        pred = p if pred is None else (pred | p)
    return F.coalesce(pred, F.lit(False))


def effective_status(label="label") -> Column:
    """Newest label, else 'new'."""
    return F.coalesce(X.col(label), F.lit("new"))


# ---- W1 -------------------------------------------------------------------------
def latest_label(lead_labels: DataFrame) -> DataFrame:
    """Newest label per item, PostgreSQL ``distinct on ... order by labeled_at desc``.

    ``desc`` puts NULL first in PostgreSQL, so a label without a time wins;
    equal times break on the label text (ascending).  Expressed as ``min``
    over the struct (time is NULL?, -time, label) -> one partial aggregate.
    """
    t = F.col("labeled_at")
    key = F.struct(t.isNotNull().alias("has_t"),
                   (-X.ntz_micros(t)).alias("neg_t"),
                   F.col("label").alias("label"))
    return (lead_labels.groupBy("item_id")
            .agg(F.min(key).alias("k"))
            .select("item_id", F.col("k.label").alias("label")))


# ---- A11 ------------------------------------------------------------------------
def cluster_coverage(items: DataFrame) -> DataFrame:
    """Distinct outlets and members per cluster, over all items."""
    return (items.where(F.col("cluster_id").isNotNull())
            .groupBy("cluster_id")
            .agg(F.countDistinct("source_id").alias("source_count"),
                 F.count(F.lit(1)).alias("item_count")))


def with_coverage(df: DataFrame, coverage: DataFrame, id_col: str = "item_id") -> DataFrame:
    """Left join coverage on cluster_id with NULL keys spread by item id."""
    cov = coverage.withColumnRenamed("cluster_id", "cov_cluster_id")
    key = F.coalesce(F.col("cluster_id"), F.col(id_col))
    cond = (key == F.col("cov_cluster_id")) & F.col("cluster_id").isNotNull()
    return df.join(cov, cond, "left").drop("cov_cluster_id")


# ---- J1 + J3 + J4 + F1-F3: the shared lead set ------------------------------------
def lead_base(item_scores: DataFrame, items: DataFrame, lead_labels: DataFrame, pv: str,
              min_score: int = 7, search: str | None = None, model: str | None = None,
              with_item_count: bool = False, index=None) -> DataFrame:
    """Rows of the lead browser before projection and order.

    ``index``: a ``SearchIndex`` that narrows items and scores to those a search may match.

    One row per score row (several models per item multiply rows, as in
    the reference).  Columns: item_id, model, prompt_version, lead_score,
    lead_* fields, classified_at, the item fields, label, source_count.
    """
    s = item_scores.where((F.col("prompt_version") == pv) & (F.col("lead_score") >= min_score))
    if model is not None:
        s = s.where(F.col("model") == model)
    s = s.select("item_id", "model", "prompt_version", "lead_score", *SCORE_FIELDS, "classified_at")
    held = items
    if index is not None and search:
        held, ids = index.narrowed(search)
        s = s if ids is None else s.join(ids, "item_id", "left_semi")
    i = held.where(canonical_only()).select("item_id", *ITEM_FIELDS)
    j = s.join(i, "item_id")
    pred = search_predicate(search)
    if pred is not None:
        j = j.where(pred)
    j = j.join(latest_label(lead_labels), "item_id", "left")
    cov = cluster_coverage(items)
    if not with_item_count:
        cov = cov.drop("item_count")
    out = with_coverage(j, cov)
    return out


# ---- L3 / L4 ----------------------------------------------------------------------
def lead_order() -> list[Column]:
    """Score desc, created_at desc (NULL first as in PostgreSQL), then a key tiebreak."""
    return [F.col("score").desc(), F.col("created_at").desc_nulls_first(),
            F.col("item_id").asc(), F.col("model").asc()]


def page_bounds(total: int, size: int, page: int) -> tuple[int, int, int, int]:
    """L4 arithmetic: (clamped page, pages, first row, last row), rows 1-based (0,0 if empty)."""
    pages = max(1, (total + size - 1) // size)
    page = max(1, min(int(page), pages))
    if total == 0:
        return page, pages, 0, 0
    return page, pages, (page - 1) * size + 1, min(page * size, total)


# ---- F9 / F10 / F11 projections ---------------------------------------------------
def lead_card(base: DataFrame) -> DataFrame:
    """the 22 columns of a lead card (plus model/created_at for ordering)."""
    d = F.lit(X.PLACEHOLDER)
    return base.select(
        "item_id",
        F.col("lead_score").alias("score"),
        F.coalesce("lead_company", d).alias("company"),
        F.coalesce("lead_city", d).alias("city"),
        F.coalesce("lead_country", d).alias("country"),
        F.coalesce("lead_who", d).alias("who"),
        F.coalesce("lead_what", d).alias("what"),
        F.coalesce("lead_when", d).alias("when"),
        F.coalesce("lead_reason", d).alias("reason"),
        F.coalesce("lead_description", d).alias("description"),
        F.coalesce("title", F.lit("(no title)")).alias("title"),
        "source_id", "url",
        F.to_date("created_at").alias("date"),
        effective_status().alias("status"),
        F.coalesce("sector", d).alias("sector"),
        F.coalesce("commodity_nst", d).alias("commodity"),
        F.coalesce("event_status", d).alias("event_status"),
        F.coalesce("company_role", d).alias("company_role"),
        "investment_eur",
        F.coalesce("source_count", F.lit(1).cast("long")).alias("sources"),
        "cluster_id",
        "model", "created_at",
    )


def export_rows(base: DataFrame) -> DataFrame:
    """the 20 export columns in file order (plus order keys)."""
    e = F.lit("")
    return base.select(
        F.col("lead_score").alias("score"),
        F.coalesce("lead_company", e).alias("company"),
        F.coalesce("sector", e).alias("sector"),
        F.coalesce("lead_city", e).alias("city"),
        F.coalesce("lead_country", e).alias("country"),
        F.coalesce("lead_what", e).alias("project"),
        F.coalesce("event_status", e).alias("event_status"),
        F.coalesce("company_role", e).alias("company_role"),
        F.coalesce("commodity_nst", e).alias("commodity"),
        "investment_eur",
        F.coalesce("source_count", F.lit(1).cast("long")).alias("sources"),
        F.coalesce("lead_when", e).alias("when"),
        F.coalesce("lead_reason", e).alias("reason"),
        F.coalesce("lead_description", e).alias("description"),
        F.coalesce("title", e).alias("title"),
        F.col("source_id").alias("source"),
        "url",
        F.to_date("created_at").alias("date"),
        effective_status().alias("status"),
        "cluster_id",
        "item_id", "model", "created_at",
    )


EXPORT_COLUMNS = ["score", "company", "sector", "city", "country", "project", "event_status",
                  "company_role", "commodity", "investment_eur", "sources", "when", "reason",
                  "description", "title", "source", "url", "date", "status", "cluster_id"]
# the on-screen subset of the export frame.
TABLE_COLUMNS = ["score", "company", "sector", "country", "project", "event_status",
                 "company_role", "sources", "title", "source", "url", "date"]
CARD_COLUMNS = ["item_id", "score", "company", "city", "country", "who", "what", "when", "reason",
                "description", "title", "source_id", "url", "date", "status", "sector", "commodity",
                "event_status", "company_role", "investment_eur", "sources", "cluster_id"]


def review_rows(base: DataFrame) -> DataFrame:
    """the 11 review columns (plus model for a deterministic order)."""
    d = F.lit(X.PLACEHOLDER)
    return base.select(
        "item_id",
        F.col("lead_score").alias("score"),
        F.coalesce("lead_company", d).alias("company"),
        F.coalesce("lead_country", d).alias("country"),
        F.coalesce("lead_what", d).alias("project"),
        F.coalesce("lead_reason", d).alias("reason"),
        F.coalesce("sector", d).alias("sector"),
        F.coalesce("title", d).alias("title"),
        "url",
        effective_status().alias("status"),
        F.coalesce("source_count", F.lit(1).cast("long")).alias("sources"),
        "model",
    )


REVIEW_COLUMNS = ["item_id", "score", "company", "country", "project", "reason", "sector", "title",
                  "url", "status", "sources"]


# ---- J5 -----------------------------------------------------------------------------
def unscored_items(items: DataFrame, item_scores: DataFrame, pv: str) -> DataFrame:
    """``item_id not in (select item_id from item_scores where prompt_version = pv)``.

    item_id is part of the unique score key and never NULL, so NOT IN equals
    a left anti join; we still drop NULL keys from the subquery side.
    """
    scored = item_scores.where((F.col("prompt_version") == pv) & F.col("item_id").isNotNull()).select("item_id")
    return items.join(scored, "item_id", "left_anti")


# ---- J7 -----------------------------------------------------------------------------
def cluster_members(leads: DataFrame, items: DataFrame) -> DataFrame:
    """All members of each lead's cluster, one join instead of a query per lead.

    Only leads covered by more than one outlet; only clusters with more
    than one member.  Member order: coalesce(published_at, created_at) asc
    nulls last, then item_id.
    """
    l = (leads.where((F.col("sources") > 1) & F.col("cluster_id").isNotNull())
         .select(F.col("item_id").alias("lead_item_id"), "cluster_id").distinct())
    m = items.where(F.col("cluster_id").isNotNull()).select(
        "cluster_id", F.col("item_id").alias("member_item_id"), "source_id", "title", "url",
        F.col("lead_score").alias("score"),
        F.coalesce("published_at", "created_at").alias("member_time"))
    sizes = m.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("members"))
    return (l.join(sizes.where(F.col("members") > 1), "cluster_id")
            .join(m, "cluster_id")
            .select("lead_item_id", "cluster_id", "members", "member_item_id", "source_id",
                    X.angle_escape(X.clip(F.coalesce("title", F.lit("")), 140)).alias("title"), "url", "score",
                    F.to_date("member_time").cast("string").alias("date"),
                    (F.col("member_item_id") == F.col("lead_item_id")).alias("is_canon"),
                    "member_time"))
