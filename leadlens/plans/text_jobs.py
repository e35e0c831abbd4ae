"""Text-pipeline queries (discovery P3-P6, extraction P7-P14) with DuckDB twins.

The SQL helpers of URLs and main content mirror the Column expressions, with the same pattern
constants; links, JSON-LD, paragraphs and character references are read another way than the operators do.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from leadlens.functions import html as H
from leadlens.operators import discover as D
from leadlens.operators import extract as T
from leadlens.plans.registry import register


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# ---- SQL mirrors of the Column expressions ------------------------------------------------
def s_unescape(x: str) -> str:
    """Piece by piece between ampersands; names are looked up in a map."""
    names = "map {" + ", ".join(f"{q(k)}: {q(v)}" for k, v in H.REFERENCES.items()) + "}"
    code = "case when ref[2] in ('x', 'X') then ('0x' || ref[3:])::bigint else ref[2:]::bigint end"
    char = (f"case when {code} = 160 then ' ' when {code} between 1 and 55295 or {code} between 57344 and 1114111 then chr(({code})::int) "
            f"else chr(65533) end")
    decoded = f"case when ref[1] = '#' then {char} else {names}[ref] end"
    ref = "regexp_extract(p, '^(#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,9});', 1)"
    one = f"case when i = 1 then p when {ref} = '' then '&' || p else coalesce({decoded.replace('ref', ref)} || p[length({ref}) + 2:], '&' || p) end"
    return f"array_to_string(list_transform(string_split({x}, '&'), lambda p, i: {one}), '')"


def s_text_of(x: str) -> str:
    t = f"regexp_replace({x}, {q(T.TAG)}, ' ', 'g')"
    return f"trim(regexp_replace({s_unescape(t)}, {q(T.SPACES)}, ' ', 'g'))"


def s_strip_noise(h: str) -> str:
    return f"regexp_replace({h}, {q(T.NOISE)}, '', 'g')"


def s_nonempty(x: str) -> str:
    return f"nullif({x}, '')"


def s_paragraph_text(h: str) -> str:
    """Another way than the operator's: every tag that begins or ends a paragraph becomes a control
    character, and paragraphs are read between those."""
    blocks = ("address|article|aside|blockquote|body|details|div|dl|fieldset|figure|footer|form|h1|h2|h3|h4|h5|h6|header|hr|"
              "html|main|nav|ol|pre|section|table|ul")
    marked = f"regexp_replace({s_strip_noise(h)}, '(?i)<p(\\s[^>]*)?>', chr(2), 'g')"
    marked = f"regexp_replace({marked}, '(?i)</p\\s*>', chr(3), 'g')"
    marked = f"regexp_replace({marked}, '(?i)</?({blocks})(\\s[^>]*)?/?>', chr(3), 'g')"
    paras = f"regexp_extract_all({marked}, '\\x02([^\\x02\\x03]*)', 1)"
    texts = f"list_transform({paras}, lambda p: {s_text_of('p')})"
    return f"array_to_string(list_filter({texts}, lambda t: t <> ''), chr(10))"


def s_main_text(h: str) -> str:
    hh = s_strip_noise(h)
    scope = (f"coalesce({s_nonempty(f'regexp_extract({hh}, {q(T.ARTICLE)}, 1)')}, "
             f"{s_nonempty(f'regexp_extract({hh}, {q(T.MAIN)}, 1)')}, "
             f"{s_nonempty(f'regexp_extract({hh}, {q(T.BODY)}, 1)')}, {hh})")
    cleaned = f"regexp_replace({scope}, {q(T.BOILERPLATE)}, ' ', 'g')"
    links = s_text_of(f"array_to_string(regexp_extract_all(b, {q(T.LINK)}, 1), ' ')")
    blocks = (f"list_transform(regexp_split_to_array({cleaned}, {q(T.BLOCK_SPLIT)}), "
              f"lambda b: {{'t': {s_text_of('b')}, 's': length({s_text_of('b')}) - length({links})}})")
    return (f"(select array_to_string(list_transform(list_filter(bl, lambda x: x.s > 0 and x.s * {T.BLOCK_SHARE} >= "
            f"list_max(list_transform(bl, lambda y: y.s))), lambda z: z.t), chr(10)) from (select {blocks} as bl))")


def s_json_ld_field(h: str, field: str) -> str:
    """What lies between the start and end tags of scripts whose start tag names the type."""
    parts = f"list_filter(regexp_split_to_array({h}, '(?i)<script'), lambda s: regexp_matches(s, '(?i)^[^>]*application/ld.json'))"
    blocks = f"list_filter(list_transform({parts}, lambda s: regexp_extract(s, '(?is)^[^>]*>(.*?)</script', 1)), lambda j: json_valid(j) and j <> '')"
    paths = ", ".join(f"list_filter(json_extract_string(j, '{p}'), lambda v: v is not null)[1]" for p in (f'$[*].{field}', f'$."@graph"[*].{field}', f'$[*]."@graph"[*].{field}'))
    values = f"list_transform({blocks}, lambda j: coalesce(json_extract_string(j, '$.{field}'), {paths}))"
    return f"list_filter({values}, lambda v: v is not null)[1]"


def s_title(h: str) -> str:
    return (f"coalesce({s_nonempty(s_text_of(f'regexp_extract({h}, {q(T.H1)}, 1)'))}, "
            f"{s_nonempty(s_text_of(f'regexp_extract({h}, {q(T.TITLE)}, 1)'))}, "
            f"{s_nonempty('trim(' + s_json_ld_field(h, 'headline') + ')')})")


def s_extract(h: str) -> tuple[str, str]:
    cands = [("json_ld", s_json_ld_field(h, "articleBody")), ("paragraphs", s_paragraph_text(h)),
             ("main", s_main_text(h))]
    text = "coalesce(" + ", ".join(f"case when length({x}) > {T.MIN_TEXT} then {x} end" for _, x in cands) + ")"
    method = "coalesce(" + ", ".join(f"case when length({x}) > {T.MIN_TEXT} then '{n}' end" for n, x in cands) + ")"
    return text, method


def s_normalize_url(u: str) -> str:
    u = f"trim({u})"
    P = q(D.URL_PARTS)
    scheme = f"lower(regexp_extract({u}, {P}, 1))"
    host = f"lower(regexp_extract({u}, {P}, 2))"
    path = f"regexp_replace(regexp_extract({u}, {P}, 3), '/+$', '')"
    query = f"regexp_replace(regexp_extract({u}, {P}, 4), '^\\?', '')"
    drops = ", ".join(q(p) for p in D.DROP_PARAMS)
    keep = (f"lambda x: x <> '' and not starts_with(lower(split_part(x, '=', 1)), {q(D.DROP_PARAM_PREFIX)}) "
            f"and lower(split_part(x, '=', 1)) not in ({drops})")
    qs = f"array_to_string(list_filter(string_split({query}, '&'), {keep}), '&')"
    norm = f"{scheme} || '://' || {host} || {path} || case when {qs} <> '' then '?' || {qs} else '' end"
    return f"case when regexp_matches({u}, {P}) then {norm} end"


def s_resolve(h0: str, b: str) -> str:
    h = f"trim(replace({h0}, '&amp;', '&'))"
    P = q(D.URL_PARTS)
    scheme = f"lower(regexp_extract({b}, {P}, 1))"
    host = f"regexp_extract({b}, {P}, 2)"
    path = f"regexp_extract({b}, {P}, 3)"
    bd = f"regexp_extract({path}, '^(.*/)', 1)"
    base_dir = f"case when {bd} = '' then '/' else {bd} end"
    out = (f"case when regexp_matches({h}, {q(D.HTTP)}) then {h} "
           f"when starts_with({h}, '//') then {scheme} || ':' || {h} "
           f"when starts_with({h}, '#') or {h} = '' then null "
           f"when regexp_matches({h}, {q(D.HAS_SCHEME)}) then null "
           f"when starts_with({h}, '/') then {scheme} || '://' || {host} || {h} "
           f"else {scheme} || '://' || {host} || {base_dir} || {h} end")
    return (f"case when regexp_matches({b}, {P}) then {out} "
            f"when regexp_matches({h}, {q(D.HTTP)}) then {h} end")


def sql_links(pages: str = "pages", name: str = "links") -> str:
    """CTEs of every page's links: the page without comments, scripts and styles is cut at every ``<``."""
    bare = "regexp_replace(html, '(?is)<!--.*?-->|<(script|style).*?</(script|style)>', '', 'g')"
    anchors = f"list_filter(string_split({bare}, '<'), lambda t: regexp_matches(t, '(?is)^(a|area)\\s.*\\shref\\s*=|^(a|area)\\s+href\\s*='))"
    value = ("coalesce(" + ", ".join(f"nullif(regexp_extract(t, {q(pattern)}, 1), '')" for pattern in (
        r'(?is)\shref\s*=\s*"([^"]*)"', r"(?is)\shref\s*=\s*'([^']*)'", r"(?is)\shref\s*=\s*([^\s>'" + '"]+)')) + ", '')")
    return f"""{name} as (select page_id, cast(pos as integer) as pos, link from (
  select page_id, {s_resolve('href', 'url')} as link, pos from (
    select page_id, url, unnest(range(len(l))) as pos, {s_unescape('unnest(l)')} as href
    from (select page_id, url, list_transform({anchors}, lambda t: {value}) as l from {pages}) a) b) c
  where link is not null and regexp_matches(link, {q(D.HTTP)}))"""


SQL_LINKS = sql_links()


# ---- discovery --------------------------------------------------------------------------
# The twins of P1/P2 state what the feeds list (the entries the feed documents were built
# from, in id order per block), so they check the build, the escaping and the parse together.
@register("p1_rss_links", """
select i.source_id, cast(floor(i.item_id / 1000) as bigint) as feed_no,
  cast(row_number() over (partition by i.source_id, floor(i.item_id / 1000) order by i.item_id) - 1 as integer) as pos,
  i.url
from items i join sources s on s.source_id = i.source_id
where s.kind = 'rss'""", ("items", "sources"))
def p1_rss_links(c):
    """Article links of every RSS feed document."""
    return D.rss_links(c.feeds.where(F.col("kind") == "rss")).select("source_id", "feed_no", "pos", "url")


@register("p2_sitemap_links", """
select u.source_id, cast(floor(u.url_id / 1000) as bigint) as feed_no,
  cast(row_number() over (partition by u.source_id, floor(u.url_id / 1000) order by u.url_id) - 1 as integer) as pos,
  u.url
from url_state u join sources s on s.source_id = u.source_id
where s.kind = 'sitemap'""", ("url_state", "sources"))
def p2_sitemap_links(c):
    """URLs of every sitemap document."""
    return D.sitemap_links(c.feeds.where(F.col("kind") == "sitemap")).select("source_id", "feed_no", "pos", "url")


@register("p3_html_links", f"with {SQL_LINKS} select * from links")
def p3_html_links(c):
    """Links of every page, resolved, http(s) only."""
    return D.html_links(c.pages)


ODD_LINKS = ("""<link rel="stylesheet" href="/s.css"><!-- <a href="/no">x</a> --><script>var a='<a href="/no">';</script><A class="x"
HREF='/a/%s?x=1&amp;y=2'>1</A><a data-href="/no" href=/b/%s>2</a><a title="a > b" href = "/c/%s#f&uuml;">3</a><a name="z">4</a><a href="mailto:q">5</a>""")


@register("p3_link_branches", f"""with {SQL_LINKS},
base as (select page_id, {s_resolve("'/'", 'url')} as root from pages)
select page_id, pos + 4 as pos, link from links
union all select page_id, p, root || v || page_id || t from base, (values (0, 'a/', '?x=1&y=2'), (1, 'b/', ''), (2, 'c/', '#fü')) as x(p, v, t)
where root is not null""")
def p3_link_branches(c):
    """Every page behind links with single, double and no quotes, and behind tags that are no links."""
    shapes = F.format_string(ODD_LINKS.replace("%s", "%1$s"), F.col("page_id").cast("string"))
    return D.html_links(c.pages.withColumn("html", F.concat(shapes, "html")))


@register("p4_url_normalize", f"""
select url_id, url, {s_normalize_url('url')} as url_norm, sha256({s_normalize_url('url')}) as url_hash
from url_state""", ("url_state",))
def p4_url_normalize(c):
    """Normalised URL and its SHA-256."""
    return D.with_url_key(c.url_state.select("url_id", "url"))


@register("p5_url_dedupe", f"""with {SQL_LINKS},
k as (select page_id, pos, link, sha256({s_normalize_url('link')}) as url_hash from links)
select url_hash, page_id, link, copies from (
  select *, row_number() over (partition by url_hash order by page_id, pos) as rn,
    count(*) over (partition by url_hash) as copies from k where url_hash is not null) t where rn = 1""")
def p5_url_dedupe(c):
    """P5: discovered links deduplicated by normalised-URL hash, earliest page first."""
    links = D.with_url_key(D.html_links(c.pages), "link")
    return D.dedupe_urls(links, ["page_id", "pos"], ["page_id", "link"])


def _sql_fetch(n: int) -> str:
    return f"""select * from (select *, cast(row_number() over (partition by source_id
  order by discovered_at asc nulls last, url_id) as integer) as rank from url_state where status = 'new') t
  where rank <= {n}"""


@register("p6_fetch_queue", _sql_fetch(30), ("url_state",))
def p6_fetch_queue(c):
    """P6 + W5: fetch queue, at most 30 new URLs per source."""
    return D.fetch_queue(c.url_state, 30)


@register("p6_fetch_queue_cap2", _sql_fetch(2), ("url_state",))
def p6_fetch_queue_cap2(c):
    """P6 with a cap of 2 per source (the cap binds at small scale)."""
    return D.fetch_queue(c.url_state, 2)


# ---- extraction ------------------------------------------------------------------------
@register("p7_json_ld", f"""
select page_id, {s_json_ld_field('html', 'articleBody')} as article_body, {s_json_ld_field('html', 'headline')} as headline
from pages""")
def p7_json_ld(c):
    """JSON-LD articleBody / headline (NULL when absent or broken)."""
    return c.pages.select("page_id", T.json_ld_field("html", "articleBody").alias("article_body"),
                          T.json_ld_field("html", "headline").alias("headline"))


@register("p8_paragraph_text", f"select page_id, {s_paragraph_text('html')} as text from pages")
def p8_paragraph_text(c):
    """Paragraph scraping."""
    return c.pages.select("page_id", T.paragraph_text("html").alias("text"))


@register("p9_main_text", f"select page_id, {s_main_text('html')} as text from pages")
def p9_main_text(c):
    """Main-content heuristic."""
    return T.with_main_text(c.pages.select("page_id", "html"), "html", "text").select("page_id", "text")


_text, _method = s_extract("html")


@register("p10_extract", f"""
select page_id, url, {_text} as clean_text, {_method} as extract_method, {s_title('html')} as title from pages""")
def p10_extract(c):
    """P10 + P11: extraction chain (first method over 100 chars) and title."""
    return T.extract(c.pages).select("page_id", "url", "clean_text", "extract_method", "title")


def _sql_garbage() -> str:
    parts = []
    for name, col, pat in T.GARBAGE_RULES:
        parts.append(f"when coalesce(regexp_matches({col}, {q(pat)}), false) then '{name}'")
    parts.append(f"when coalesce(length(clean_text), 0) <= {T.MIN_TEXT} then 'too_short'")
    return "case " + " ".join(parts) + " end"


@register("p12_garbage_flags", f"""
select item_id, {_sql_garbage()} as reject_reason,
  case when {_sql_garbage()} is not null then 'extract_v2' else classifier_model end as classifier_model from items""",
          ("items",))
def p12_garbage_flags(c):
    """Garbage rules (PDF, captcha, login, too short)."""
    return T.flag_garbage(c.items).select("item_id", "reject_reason", "classifier_model")


@register("p13_ready_for_scoring", f"""
select item_id, cast(length(clean_text) as integer) as n_chars from items
where clean_text is not null and length(clean_text) > {T.MIN_TEXT} and lead_score is null""", ("items",))
def p13_ready_for_scoring(c):
    """P13 + X7: items ready for the model."""
    return T.ready_for_scoring(c.items).select("item_id", F.length("clean_text").alias("n_chars"))


def _sql_prefilter() -> tuple[str, str]:
    low = "lower(clean_text)"
    passed = f"coalesce(regexp_matches({low}, {q(T.keyword_pattern(T.KEYWORDS))}), false)"
    hits = ", ".join(f"case when regexp_matches({low}, {q(T.keyword_pattern([w]))}) then {q(w)} end"
                     for w in T.KEYWORDS)
    matched = f"array_to_string(list_filter([{hits}], lambda x: x is not null), ',')"
    return passed, matched


_passed, _matched = _sql_prefilter()


@register("p14_keyword_prefilter", f"""
select item_id, {_passed} as prefilter_pass, {_matched} as matched_keywords,
  case when not {_passed} then 0 else lead_score end as lead_score,
  case when not {_passed} then 'pre-filter' else classifier_model end as classifier_model from items""", ("items",))
def p14_keyword_prefilter(c):
    """Keyword pre-filter over the article text."""
    return (T.prefilter(c.items)
            .select("item_id", "prefilter_pass", F.array_join("matched_keywords", ",").alias("matched_keywords"),
                    "lead_score", "classifier_model"))


# ---- every branch, on texts derived by rule ---------------------------------------------------
@register("p7_json_ld_branches", """
select doc_id, case when doc_id % 7 not in (2, 3) then text end as article_body,
  case when doc_id % 7 = 1 then lang when doc_id % 7 not in (2, 3) then source end as headline
from documents""")
def p7_json_ld_branches(c):
    """Documents as JSON-LD: an object, a list, a cut-off block, none, one after a breadcrumb block, a
    graph, and a later element of a list; with every kind of quotes around the type."""
    kind = F.col("doc_id") % 7
    one = F.to_json(F.struct(F.col("text").alias("articleBody"), F.when(kind == 1, F.col("lang")).otherwise(F.col("source")).alias("headline")))
    one = F.replace(one, F.lit("</"), F.lit("<\\/"))  # as in any script, no end tag within the text

    def script(js, tag='<script type="application/ld+json">'):
        return F.concat(F.lit(tag), js, F.lit("</script>"))

    crumbs = script(F.lit('{"@type": "BreadcrumbList", "itemListElement": []}'))
    graph = F.concat(F.lit('{"@context": "https://schema.org", "@graph": [{"@type": "WebPage"}, '), one, F.lit("]}"))
    later = F.concat(F.lit('[{"@type": "Person"}, '), one, F.lit("]"))
    html = (F.when(kind == 0, script(one)).when(kind == 1, script(F.concat(F.lit("["), one, F.lit("]"))))
            .when(kind == 2, script(F.concat(F.lit('{"articleBody": "'), F.substring("source", 1, 3))))
            .when(kind == 3, F.lit("<p>no block</p>")).when(kind == 4, F.concat(crumbs, script(one)))
            .when(kind == 5, script(graph, "<script id=x type='application/ld+json'>")).otherwise(script(later, "<SCRIPT TYPE=application/ld+json async>")))
    pages = c.documents.select("doc_id", F.concat(F.lit("<html><head>"), html, F.lit("</head></html>")).alias("html"))
    return pages.select("doc_id", T.json_ld_field("html", "articleBody").alias("article_body"),
                        T.json_ld_field("html", "headline").alias("headline"))


@register("p12_garbage_branches", """
select item_id, case item_id % 6 when 0 then 'pdf' when 1 then 'captcha' when 2 then 'login' when 3 then 'too_short' when 4 then 'pdf'
  else case when length(clean_text) <= 100 then 'too_short' end end as reject_reason from items""", ("items",))
def p12_garbage_branches(c):
    """Items changed by rule so that each garbage rule is the first that fits somewhere."""
    k = F.col("item_id") % 6
    items = (c.items.withColumn("url", F.when(k.isin(0, 4), F.concat("url", F.lit("/report.PDF?x=1"))).otherwise(F.col("url")))
             .withColumn("clean_text", F.when(k.isin(1, 4), F.concat(F.lit("Please verify you are a human. "), F.col("clean_text")))
                         .when(k == 2, F.concat(F.lit("Bitte melden Sie sich an. "), F.col("clean_text")))
                         .when(k == 3, F.substring("clean_text", 1, 100)).otherwise(F.col("clean_text"))))
    return T.flag_garbage(items).select("item_id", "reject_reason")


@register("p14_prefilter_branches", f"""
with d as (select item_id, classifier_model, lead_score, case item_id % 4 when 0 then 'Neues Anschlussgleis, viel Fracht. ' || clean_text
  when 1 then clean_text || ' Steel plant' when 2 then 'Freightliner portal steelworks ' || clean_text else clean_text end as clean_text from items)
select item_id, {_passed} as prefilter_pass, {_matched} as matched_keywords, case when not {_passed} then 0 else lead_score end as lead_score
from d""", ("items",))
def p14_prefilter_branches(c):
    """Keywords put into some items, and words that only begin like keywords into others."""
    k, t = F.col("item_id") % 4, F.col("clean_text")
    text = (F.when(k == 0, F.concat(F.lit("Neues Anschlussgleis, viel Fracht. "), t)).when(k == 1, F.concat(t, F.lit(" Steel plant")))
            .when(k == 2, F.concat(F.lit("Freightliner portal steelworks "), t)).otherwise(t))
    return T.prefilter(c.items.withColumn("clean_text", text)).select(
        "item_id", "prefilter_pass", F.array_join("matched_keywords", ",").alias("matched_keywords"), "lead_score")


# a keyword table drawn from the data: every word of 9 to 12 letters of a title, and the first two words of each text
@register("p14_keyword_table", r"""
with t as materialized (
  select item_id, lead_score, classifier_model, title, list_filter(regexp_split_to_array(lower(clean_text), '[^\p{L}\p{N}_]+'), lambda x: x <> '') as w from items),
k as (select distinct unnest(list_filter(regexp_split_to_array(lower(title), '[^\p{L}\p{N}_]+'), lambda x: length(x) between 9 and 12)) as keyword from t
  union select w[1] || ' ' || w[2] from t where len(w) > 1),
g as (select item_id, unnest(w) as gram from t union select item_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) from t),
m as (select item_id, list_sort(list(keyword)) as found from g join k on k.keyword = g.gram group by item_id)
select item_id, found is not null as prefilter_pass, cast(coalesce(len(found), 0) as integer) as n_matched, found[1] as first_keyword,
  md5(coalesce(array_to_string(found, ','), '')) as matched_md5, case when found is null then 0 else lead_score end as lead_score,
  case when found is null then 'pre-filter' else classifier_model end as classifier_model
from t left join m using (item_id)""", ("items",))
def p14_keyword_table(c):
    """The pre-filter joined with a keyword table of words and phrases."""
    def split(column):
        return F.array_remove(F.split(F.lower(column), T.WORD_SPLIT), "")

    none = F.array().cast("array<string>")
    first = F.slice(split("clean_text"), F.lit(1), F.lit(2))
    singles = F.coalesce(F.filter(split("title"), lambda x: F.length(x).between(9, 12)), none)
    pair = F.when(F.size(first) == 2, F.array(F.array_join(first, " "))).otherwise(none)
    keywords = c.items.select(F.explode(F.concat(singles, pair)).alias("keyword")).distinct()  # one reading of the texts for both
    out = T.prefilter_by_table(c.items, keywords)
    found = F.col("matched_keywords")
    return out.select("item_id", "prefilter_pass", F.size(found).alias("n_matched"), F.get(found, F.lit(0)).alias("first_keyword"),
                      F.md5(F.array_join(found, ",")).alias("matched_md5"), "lead_score", "classifier_model")


@register("p15_broken_replies", """
select item_id, model, prompt_version, case item_id % 4 when 0 then 'no_reply' when 1 then 'no_json' when 2 then 'bad_json'
  else case when lead_score is null then 'missing_score' when lead_score not between 1 and 10 then 'out_of_range' end end as invalid_reason,
  case when item_id % 4 = 3 and lead_score between 1 and 10 then lead_score end as lead_score
from item_scores""", ("item_scores",))
def p15_broken_replies(c):
    """Replies that are missing, hold no object, or a broken one."""
    from leadlens.operators import classify as C

    k = F.col("item_id") % 4
    good = C.reply_text(F.col("lead_score"), {f: F.col(f"lead_{f}") for f in C.REPLY_FIELDS})
    raw = (F.when(k == 0, F.lit(None).cast("string")).when(k == 1, F.lit("I can not answer that."))
           .when(k == 2, F.lit('Here: {"score": 7, "company": }')).otherwise(good))
    out = C.parse_replies(c.item_scores.select("item_id", "model", "prompt_version", raw.alias("raw")))
    return out.select("item_id", "model", "prompt_version", "invalid_reason", "lead_score")


# ---- model replies, charset repair, story clustering ----------------------------------------
def _replies(c):
    """Model replies round-tripped from stored scores: JSON in chatter; llama3.2 sends the
    score as a JSON string, qwen2.5 under prompt B as a decimal string."""
    from leadlens.operators import classify as C

    s = c.item_scores
    m, pv = F.col("model"), F.col("prompt_version")
    score = (F.when((m == "qwen2.5:3b") & (pv == "B"), F.concat(F.col("lead_score").cast("string"), F.lit(".5")))
             .when(m == "llama3.2:3b", F.col("lead_score").cast("string")))
    fields = {f: F.col(f"lead_{f}") for f in C.REPLY_FIELDS}
    raw = F.when(score.isNotNull(), C.reply_text(score, fields)).otherwise(C.reply_text(F.col("lead_score"), fields))
    return s.select("item_id", "model", "prompt_version", raw.alias("raw"))


@register("p15_reply_ingest", """
select item_id, model, prompt_version,
  case when model = 'qwen2.5:3b' and prompt_version = 'B' and lead_score is not null then null
       when lead_score between 1 and 10 then lead_score end as lead_score,
  case when lead_score is null then 'missing_score'
       when model = 'qwen2.5:3b' and prompt_version = 'B' then 'not_integer'
       when lead_score not between 1 and 10 then 'out_of_range' end as invalid_reason,
  lead_company, lead_city, lead_country, lead_description, lead_who, lead_what, lead_when, lead_reason
from item_scores""", ("item_scores",))
def p15_reply_ingest(c):
    """Parse and validate model replies (score 1..10, integers only)."""
    from leadlens.operators import classify as C

    out = C.parse_replies(_replies(c))
    return out.select("item_id", "model", "prompt_version", "lead_score", "invalid_reason",
                      *[f"lead_{f}" for f in C.REPLY_FIELDS])


# every third text is garbled by reading its UTF-8 bytes as Latin-1, every other third as code page 437; a
# trigger character that a text holds by itself begins no UTF-8 sequence, and stays
@register("p17_repair_text", """
select doc_id, text as repaired, doc_id % 3 < 2 and text is distinct from
  regexp_replace(text, '[^\\x00-\\x7F]', '', 'g') as was_garbled
from documents""")
def p17_repair_text(c):
    """Texts garbled by rule are repaired to what they were (built-ins only)."""
    from leadlens.functions.textfix import LATIN1_HIGH, repair_text, upper_half

    latin = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    garbled = (F.when(F.col("doc_id") % 3 == 0, latin)
               .when(F.col("doc_id") % 3 == 1, F.translate(latin, LATIN1_HIGH, upper_half("cp437"))).otherwise(F.col("text")))
    out = c.documents.select("doc_id", garbled.alias("garbled"), "text")
    return out.select("doc_id", repair_text("garbled").alias("repaired"),
                      (~F.col("garbled").eqNullSafe(F.col("text"))).alias("was_garbled"))


@register("p18_exact_duplicates", """
with d as (select item_id, md5(lower(trim(regexp_replace(clean_text, '\\s+', ' ', 'g')))) as text_md5,
             coalesce(published_at, created_at) as t from items
           where length(lower(trim(regexp_replace(clean_text, '\\s+', ' ', 'g')))) > 0),
g as (select *, count(*) over (partition by text_md5) as copies, min(item_id) over (partition by text_md5) as cluster_id,
        row_number() over (partition by text_md5 order by t asc nulls last, item_id) as rn from d)
select item_id, cluster_id, copies, rn = 1 as is_cluster_canonical, text_md5 from g where copies > 1""", ("items",))
def p18_exact_duplicates(c):
    """P18 (exact part): copies of the same normalised text."""
    from leadlens.operators import cluster as K

    return K.exact_duplicate_clusters(c.items)


@register("p18_story_clusters", r"""
with recursive t as materialized (
  select item_id, list_filter(regexp_split_to_array(lower(clean_text), '[^\p{L}\p{N}]+'), lambda x: x <> '') as words
  from items where clean_text is not null
), g as materialized (
  select item_id, gram, count(*) as n
  from (select item_id, array_to_string(words[i:i + 4], ' ') as gram
        from (select item_id, words, unnest(range(1, len(words) - 3)) as i from t where len(words) >= 5))
  group by all
), z as (
  select item_id, sum(n) as total from g group by item_id
), p as (
  select a.item_id as a, b.item_id as b, sum(least(a.n, b.n)) as shared
  from g a join g b on a.gram = b.gram and a.item_id < b.item_id group by all
), e as (
  select a, b from p join z x on x.item_id = a join z y on y.item_id = b where shared >= 0.8 * (x.total + y.total - shared) - 1e-9
  union select a.item_id, b.item_id from t a join t b on a.words = b.words and a.item_id < b.item_id where len(a.words) > 0
), u as materialized (
  select a, b from e union select b, a from e
), r(id, seen) as (
  select a, a from u union select r.id, u.b from r join u on u.a = r.seen
), c as (
  select id as item_id, min(seen) as cluster_id from r group by id
)
select i.item_id, i.source_id, c.cluster_id,
       case when c.cluster_id is not null then
         row_number() over (partition by c.cluster_id order by coalesce(published_at, created_at) nulls last, i.item_id) = 1 end as is_cluster_canonical
from items i left join c using (item_id)""", ("items",))
def p18_story_clusters(c):
    """Story clusters of exact copies and near-duplicates (exact set-similarity join)."""
    from leadlens.operators import cluster as K

    return K.story_clusters(c.items).select("item_id", "source_id", "cluster_id", "is_cluster_canonical")
