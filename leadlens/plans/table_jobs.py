"""Table-mutation and export queries (M1, M2, M4, M6, M7, K4) with DuckDB twins.

The inputs of a mutation (a second scoring run, discovered links, review
edits, fetch outcomes) are derived from the driver tables by fixed rules,
so the work grows with the data.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from leadlens.operators import discover as D
from leadlens.operators import leads as L
from leadlens.operators import mutate as M
from leadlens.operators import sinks as K
from leadlens.plans.dashboard import PV, REVIEW_MIN, SQL_REVIEW, sql_base
from leadlens.plans.registry import register
from leadlens.plans.text_jobs import SQL_LINKS, s_normalize_url

S, I, LL, U = "item_scores", "items", "lead_labels", "url_state"


# ---- M1 ---------------------------------------------------------------------------------
def _rescore(c):
    """A second gemma3:4b run over the articles it scored in the last 7 days of the data,
    one day later, scores shifted by one."""
    s = c.item_scores
    as_of = s.agg(F.max("classified_at")).scalar()
    s = s.where((F.col("model") == "gemma3:4b") & (F.col("classified_at") >= as_of - F.make_dt_interval(F.lit(7))))
    return (s.withColumn("lead_score", ((F.col("lead_score") + 1) % 11).cast("int"))
             .withColumn("classified_at", F.col("classified_at") + F.make_dt_interval(F.lit(1))))


SQL_RESCORE = """select item_id, model, prompt_version, cast((lead_score + 1) % 11 as integer) as lead_score,
  lead_company, lead_city, lead_country, lead_who, lead_what, lead_when, lead_reason, lead_description,
  classified_at + interval 1 day as classified_at
from item_scores where model = 'gemma3:4b'
  and classified_at >= (select max(classified_at) from item_scores) - interval 7 day"""


@register("m1_upsert_scores", f"""
with u as (select *, 0 as src from item_scores union all select *, 1 as src from ({SQL_RESCORE}) r),
r as (select *, row_number() over (partition by item_id, model, prompt_version
        order by classified_at is not null desc, classified_at desc, src desc) as rn from u)
select item_id, model, prompt_version, lead_score, lead_company, lead_city, lead_country, lead_who, lead_what,
  lead_when, lead_reason, lead_description, classified_at from r where rn = 1""", (S,))
def m1_upsert_scores(c):
    """Score upsert on (item_id, model, prompt_version), latest wins."""
    return M.upsert_scores(c.item_scores, _rescore(c))


@register("m2_clear_item_scores", """
select item_id, cast(null as integer) as lead_score, cast(null as varchar) as classifier_model, source_id from items""",
          (I,))
def m2_clear_item_scores(c):
    """M2: clear item-level score fields before a benchmark run."""
    return M.clear_item_scores(c.items).select("item_id", "lead_score", "classifier_model", "source_id")


# ---- M4 ---------------------------------------------------------------------------------
def _discovered(c):
    links = D.html_links(c.pages)
    st = c.url_state.select(F.col("url_id").alias("page_id"), "discovered_at")
    return (links.join(st, "page_id", "left")
            .select(F.col("link").alias("url"), F.concat(F.lit("src"), (F.col("page_id") % 20).cast("string"))
                    .alias("source_id"), "discovered_at"))


@register("m4_url_upsert", f"""with {SQL_LINKS},
d as (select l.link as url, 'src' || cast(l.page_id % 20 as varchar) as source_id, s.discovered_at,
        sha256({s_normalize_url('l.link')}) as url_hash
      from links l left join url_state s on s.url_id = l.page_id),
f as (select * from (select *, row_number() over (partition by url_hash
        order by discovered_at is null, discovered_at, url) as rn from d where url_hash is not null) t where rn = 1),
known as (select sha256({s_normalize_url('url')}) as url_hash from url_state),
n as (select * from f where url_hash not in (select url_hash from known where url_hash is not null))
select url_id, url, source_id, status, discovered_at from url_state
union all
select (select coalesce(max(url_id), -1) + 1 from url_state) + row_number() over (order by url_hash) - 1 as url_id,
  url, source_id, 'new' as status, discovered_at from n""", (U,))
def m4_url_upsert(c):
    """M4: upsert discovered links into url_state by normalised-URL hash."""
    return M.upsert_urls(c.url_state, _discovered(c))


# ---- M6 ---------------------------------------------------------------------------------
@register("m6_changed_labels", f"""with {sql_base(REVIEW_MIN)},
shown as ({SQL_REVIEW} from base order by score desc, item_id, model limit 100),
edited as (select distinct item_id, case when score >= 8 then 'confirmed' else status end as status from shown),
shown_d as (select distinct item_id, status from shown)
select distinct e.item_id, e.status as label, 'gui' as labeled_by
from edited e join shown_d s on s.item_id = e.item_id where e.status is distinct from s.status""", (I, S, LL))
def m6_changed_labels(c):
    """M6: review edits (every row scoring >= 8 confirmed) that differ from the shown status."""
    shown = L.review_queue(c.item_scores, c.items, c.lead_labels, PV, REVIEW_MIN, "all")
    edited = shown.withColumn("status", F.when(F.col("score") >= 8, F.lit("confirmed"))
                              .otherwise(F.col("status")))
    return L.changed_labels(shown, edited)


# ---- M7 ---------------------------------------------------------------------------------
@register("m7_fetch_outcomes", """
with o as (select s.url_id, case when p.html like '%</html>%' then 'fetched' else 'error' end as status
           from url_state s join pages p on p.page_id = s.url_id where s.status = 'new')
select s.url_id, s.url, s.source_id, coalesce(o.status, s.status) as status, s.discovered_at
from url_state s left join o on o.url_id = s.url_id""", (U,))
def m7_fetch_outcomes(c):
    """M7: write fetch outcomes (page complete -> fetched, cut off -> error) back to url_state."""
    new = c.url_state.where(F.col("status") == "new").select("url_id")
    o = (new.join(c.pages.select(F.col("page_id").alias("url_id"), "html"), "url_id")
         .select("url_id", F.when(F.col("html").contains("</html>"), F.lit("fetched"))
                 .otherwise(F.lit("error")).alias("status")))
    return M.apply_fetch_outcomes(c.url_state, o)


# ---- K4 ---------------------------------------------------------------------------------
@register("k4_crm_export_frame", f"""with {sql_base(8)}
select """ + ", ".join(f'{src} as "{dst}"' for src, dst in K.CRM_COLUMNS) + """, model
from base where coalesce(label, 'new') = 'confirmed'""", (I, S, LL))
def k4_crm_export_frame(c):
    """K4 / K8 frame: confirmed leads with score >= 8 in CRM columns."""
    return K.crm_leads(c.item_scores, c.items, c.lead_labels, PV, threshold=8)
