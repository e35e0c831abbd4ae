"""Stored tables and streams that change by what comes in (M1, M4, T3), each loaded, changed in several
batches and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadlens.operators import discover as D
from leadlens.operators import leads as L
from leadlens.plans.dashboard import BROWSE_MIN, PV, SQL_LATEST, sql_base
from leadlens.plans.registry import register
from leadlens.plans.sink_jobs import _folder
from leadlens.plans.table_jobs import SQL_RESCORE, _rescore
from leadlens.plans.text_jobs import SQL_LINKS, s_normalize_url
from leadlens.sources.search import SearchIndex
from leadlens.sources.store import ScoreStore, UrlStore
from leadlens.streaming import streams as ST

S, LL, U = "item_scores", "lead_labels", "url_state"


# ---- M1 / W7 --------------------------------------------------------------------------------
@register("m1_incremental_merge", f"""
with u as (select *, 0 as src from item_scores union all select *, 1 as src from ({SQL_RESCORE}) r),
r as (select *, row_number() over (partition by item_id, model, prompt_version
        order by classified_at is not null desc, classified_at desc, src desc) as rn from u)
select item_id, model, prompt_version, lead_score, lead_company, lead_city, lead_country, lead_who, lead_what,
  lead_when, lead_reason, lead_description, classified_at from r where rn = 1""", (S,))
def m1_incremental_merge(c):
    """The second run merged into the stored folders it falls in, then merged once more."""
    store = ScoreStore(c.spark, _folder(c, "scores"), buckets=8)
    store.upsert(c.item_scores)
    store.upsert(_rescore(c))
    store.upsert(_rescore(c))
    return store.read()


# ---- M4 ---------------------------------------------------------------------------------------
def _links_of(c, batch: int):
    """The links of every second page, with the time the page was discovered."""
    links = D.html_links(c.pages.where(F.col("page_id") % 2 == batch))
    seen = c.url_state.select(F.col("url_id").alias("page_id"), "discovered_at")
    source = F.concat(F.lit("src"), (F.col("page_id") % 20).cast("string"))
    return links.join(seen, "page_id", "left").select(F.col("link").alias("url"), source.alias("source_id"), "discovered_at")


@register("m4_stored_index", f"""with {SQL_LINKS},
d as (select l.link as url, 'src' || cast(l.page_id % 20 as varchar) as source_id, s.discovered_at, l.page_id % 2 as batch,
        sha256({s_normalize_url('l.link')}) as url_hash
      from links l left join url_state s on s.url_id = l.page_id),
known as (select sha256({s_normalize_url('url')}) as url_hash from url_state),
f as (select * from (select *, row_number() over (partition by url_hash
        order by batch, discovered_at is null, discovered_at, url) as rn from d where url_hash is not null) t where rn = 1),
n as (select * from f where url_hash not in (select url_hash from known where url_hash is not null))
select url_id, url, source_id, status, discovered_at from url_state
union all
select (select coalesce(max(url_id), -1) + 1 from url_state) + row_number() over (order by batch, url_hash) - 1 as url_id,
  url, source_id, 'new' as status, discovered_at from n""", (U,))
def m4_stored_index(c):
    """M4: the links of even pages, then of odd pages, then of even pages again, against stored hashes."""
    store = UrlStore(c.spark, _folder(c, "urls"))
    store.load(c.url_state)
    for batch in (0, 1, 0):
        store.upsert(_links_of(c, batch))
    return store.read().select("url_id", "url", "source_id", "status", "discovered_at")


# ---- T3, label half -----------------------------------------------------------------------------
@register("t3_label_stream", f"with {SQL_LATEST} select item_id, label from ll", (LL,))
def t3_label_stream(c):
    """Labels streamed in three batches, the first one again at the end, a snapshot in between."""
    w = _folder(c, "t3-labels")
    schema = c.lead_labels.schema
    part = F.pmod(F.xxhash64("item_id", "label", "labeled_at"), F.lit(3))
    for i, batch in enumerate((0, 1, 2, 0)):
        c.lead_labels.where(part == batch).write.parquet(f"{w}/in/part={i}")
        ST.start_label_log(c.spark, f"{w}/in", schema, f"{w}/log", f"{w}/state").awaitTermination()
        if i == 1:
            ST.compact_labels(c.spark, f"{w}/log", schema, f"{w}/snapshot")
    return ST.current_labels(c.spark, f"{w}/log", schema, f"{w}/snapshot")


# ---- F3 ---------------------------------------------------------------------------------------------
SEARCHES = ("steel", "st_el", "log%tics", "a", "%", "the%of", "no such text")


@register("f3_indexed_search", "with " + ", ".join(f"q{i} as (with {sql_base(BROWSE_MIN, text)} select count(*) as n from base)" for i, text in enumerate(SEARCHES))
          + " " + " union all ".join(f"select '{text}' as search, n from q{i}" for i, text in enumerate(SEARCHES)), ("items", S, LL))
def f3_indexed_search(c):
    """leads found by seven search texts, with wildcards and without, over the trigram index."""
    index = SearchIndex(c.spark, _folder(c, "search")).build(c.items, c.item_scores)
    out = None
    for text in SEARCHES:
        base = L.browse(c.item_scores, c.items, c.lead_labels, PV, BROWSE_MIN, text, index=index)
        one = L.lead_count(base).select(F.lit(text).alias("search"), "n")
        out = one if out is None else out.unionByName(one)
    return out


# ---- L4 -----------------------------------------------------------------------------------------------
@register("l4_deep_page", f"""with {sql_base(BROWSE_MIN)},
o as (select item_id, model, lead_score as score, created_at, row_number() over (order by lead_score desc, created_at desc nulls first, item_id, model) as place from base)
select place, item_id, model, score, created_at from o where place > (select count(*) from o) // 2
qualify row_number() over (order by place) <= 50""", ("items", S, LL))
def l4_deep_page(c):
    """L4 by seek: the 50 leads after the middle one, of the set written in page order."""
    path = _folder(c, "ordered")
    L.write_ordered(L.browse(c.item_scores, c.items, c.lead_labels, PV, BROWSE_MIN), path)
    rows = c.spark.read.parquet(path)
    middle = rows.count() // 2
    order = L.B.lead_order()
    last = rows.orderBy(*order).limit(middle).orderBy(*[x for x in _reversed()]).limit(1).first()  # where a reader stands
    page = L.lead_page_after(c.spark, path, last.asDict() if last else None, 50)
    return (page.select("item_id", "model", "score", "created_at").coalesce(1).sortWithinPartitions(*order)
            .withColumn("place", F.monotonically_increasing_id() + 1 + middle))


def _reversed():
    return F.col("score").asc(), F.col("created_at").asc_nulls_last(), F.col("item_id").desc(), F.col("model").desc()
