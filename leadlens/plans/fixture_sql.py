"""The fixture derivations of FIXTURES.md §3 as SQL text.

They run unchanged in DuckDB and are the CTE prefix of every oracle query
in ``oracle.py``; the Spark side builds the same tables in
``leadlens.sources.tables.Catalog``.
"""

ITEMS = """
select d.doc_id as item_id, d.source as source_id,
  concat('https://', d.source, '.example.com/a/', d.doc_id) as url,
  case when d.doc_id % 23 = 0 then null else split_part(d.text, chr(10), 1) end as title,
  d.text as clean_text, d.lang as language, e.ts as created_at,
  case when d.doc_id % 4 = 0 then null else p.ts end as published_at,
  case d.doc_id % 7 when 0 then null when 1 then '' when 2 then 'chemicals' when 3 then 'automotive'
    when 4 then 'steel' when 5 then 'timber' else 'logistics' end as sector,
  case d.doc_id % 9 when 0 then null when 1 then '' when 2 then 'Austria' when 3 then 'Germany' when 4 then 'Italy'
    when 5 then 'Poland' when 6 then 'Deutschland' when 7 then 'Hungary' else 'France' end as lead_country,
  case when d.doc_id % 5 < 2 then null else cast(floor(d.doc_id / 24) as bigint) end as cluster_id,
  case when d.doc_id % 5 < 2 then null when d.doc_id % 29 = 0 then null
    else d.doc_id = min(case when d.doc_id % 5 >= 2 and d.doc_id % 29 <> 0 then d.doc_id end)
      over (partition by floor(d.doc_id / 24)) end as is_cluster_canonical,
  case when d.doc_id % 10 = 0 then 'pre-filter' when d.doc_id % 10 = 1 then 'extract_v2'
    when d.doc_id % 10 = 2 then null else 'gemma3:4b' end as classifier_model,
  d.doc_id % 10 >= 2 as prefilter_pass,
  case when d.doc_id % 10 = 2 then null when d.doc_id % 10 < 2 then 0
    else cast((d.doc_id * 7 + d.n_chars) % 11 as int) end as lead_score,
  case when d.doc_id % 3 = 0 then null else cast(d.n_chars * (1 + (d.doc_id % 4) * 100000) as decimal(18,2)) end as investment_eur,
  case d.doc_id % 6 when 0 then null else concat('NST', d.doc_id % 20) end as commodity_nst,
  case d.doc_id % 4 when 0 then null when 1 then 'planned' when 2 then 'under construction' else 'opened' end as event_status,
  case d.doc_id % 5 when 0 then null when 1 then 'operator' when 2 then 'investor' else 'shipper' end as company_role
from documents d
left join events e on e.event_id = d.doc_id * 5
left join events p on p.event_id = d.doc_id * 4
"""

ITEM_SCORES = """
select d.doc_id as item_id, m.model, p.prompt_version,
  case when (d.doc_id + m.mi) % 19 = 0 then null
    else cast((d.doc_id * 7 + d.n_chars + 3 * m.mi + 5 * p.pi) % 11 as int) end as lead_score,
  case d.doc_id % 4 when 0 then null else concat('Company ', d.doc_id % 40) end as lead_company,
  case d.doc_id % 3 when 0 then null else concat('City ', d.doc_id % 12) end as lead_city,
  case d.doc_id % 9 when 0 then null when 1 then '' when 2 then 'Austria' when 3 then 'Germany' when 4 then 'Italy'
    when 5 then 'Poland' when 6 then 'Deutschland' when 7 then 'Hungary' else 'France' end as lead_country,
  case d.doc_id % 5 when 0 then null else concat('who ', d.doc_id) end as lead_who,
  case d.doc_id % 5 when 1 then null else concat('builds site ', d.doc_id) end as lead_what,
  case d.doc_id % 5 when 2 then null else '2024' end as lead_when,
  case d.doc_id % 5 when 3 then null else concat('reason ', m.model) end as lead_reason,
  case d.doc_id % 5 when 4 then null else concat('description ', d.doc_id) end as lead_description,
  e.ts as classified_at
from documents d
cross join (values ('gemma3:4b',0),('llama3.2:3b',1),('mistral:7b',2),('qwen2.5:3b',3)) as m(model,mi)
cross join (values ('A',0),('B',1)) as p(prompt_version,pi)
left join events e on e.event_id = d.doc_id * 5 + m.mi
where d.doc_id % 10 >= 2
"""

LEAD_LABELS = """
select l.doc_id as item_id,
  case when l.toxic = 1 or l.quality = 0 then 'rejected' when l.doc_id % 3 = 0 then 'confirmed'
    when l.doc_id % 3 = 1 then 'follow_up' else 'contacted' end as label,
  'crm' as labeled_by,
  case when l.doc_id % 50 = 0 then null else e.ts end as labeled_at
from labels l left join events e on e.event_id = l.doc_id * 5 + 2
union all
select l.doc_id, 'contacted', 'gui', e.ts
from labels l join events e on e.event_id = l.doc_id * 5 + 4
where l.doc_id % 4 = 0
"""

URL_STATE = """
select pg.page_id as url_id, pg.url, concat('src', pg.page_id % 20) as source_id,
  case pg.page_id % 3 when 0 then 'new' when 1 then 'fetched' else 'error' end as status,
  e.ts as discovered_at
from pages pg left join events e on e.event_id = pg.page_id
"""

PIPELINE_RUNS = """
select event_id as run_id,
  case event_type when 'view' then 'discover' when 'click' then 'fetch' when 'signup' then 'extract' else 'classify' end as script,
  ts as started_at, case when event_type = 'error' then null else ts end as finished_at, value as duration_s,
  cast(regexp_extract(props, '[0-9]+', 0) as int) as articles_processed,
  cast(cast(regexp_extract(props, '[0-9]+', 0) as int) - user_id % 3 as int) as articles_ok,
  case when event_id % 7 = 0 then null else cast(user_id % 3 as int) end as articles_err,
  cast(event_id % 4 as int) as articles_skipped,
  case when cast(regexp_extract(props, '[0-9]+', 0) as int) = 0 then null
    else value / cast(regexp_extract(props, '[0-9]+', 0) as int) end as avg_s_per_article,
  case when event_id % 9 = 0 then 'note' else null end as notes
from events where event_id % 20 = 0
"""

# Our rule for the source registry (FIXTURES.md §3: kind by index, src19 inactive).
SOURCES = """
select source as source_id,
  case cast(regexp_extract(source, '([0-9]+)$', 1) as int) % 3 when 0 then 'rss' when 1 then 'sitemap' else 'html' end as kind,
  concat('https://', source, '.example.com/',
    case cast(regexp_extract(source, '([0-9]+)$', 1) as int) % 3 when 0 then 'feed.xml' when 1 then 'sitemap.xml' else '' end) as url,
  source <> 'src19' as active
from (select distinct source from documents) s
"""

CTES = {
    "items": ITEMS,
    "item_scores": ITEM_SCORES,
    "lead_labels": LEAD_LABELS,
    "url_state": URL_STATE,
    "pipeline_runs": PIPELINE_RUNS,
    "sources": SOURCES,
}


def with_tables(sql: str, *names: str) -> str:
    """Prefix ``sql`` with the CTEs of the named reference tables."""
    parts = [f"{n} as ({CTES[n].strip()})" for n in names]
    body = sql.strip()
    if not parts:
        return body
    word = "with recursive " if body[:15].lower() == "with recursive " else "with "
    head = word + ",\n".join(parts)
    if body[:len(word)].lower() == word:
        return head + ",\n" + body[len(word):]
    return head + "\n" + body
