"""URL discovery (P1-P6): feeds, sitemaps and HTML links to a deduplicated queue.

All parsing is built-in regex / string expressions (JVM); links come from the tag
scanner of ``functions.html``.  The patterns of feeds and URLs are module constants,
portable between Java regex and RE2 (no back-references, no look-around).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from leadlens.functions import html as H

# Fixed patterns.
RSS_ITEM_LINK = r"(?s)<item\b.*?<link>\s*(.*?)\s*</link>"
SITEMAP_LOC = r"(?s)<loc>\s*(.*?)\s*</loc>"
URL_PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]+)([^?#]*)(\?[^#]*)?(#.*)?$"
HAS_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"
HTTP = r"^https?://"
# XML's predefined entities, decoded in this order (ampersand last).
XML_ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&amp;", "&")]
# Query parameters dropped by normalisation: utm_* and ref.
DROP_PARAM_PREFIX = "utm_"
DROP_PARAMS = ["ref"]


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---- P1 / P2 / P3 ------------------------------------------------------------------
def xml_escape(c) -> Column:
    """Text as XML character data: ``&``, ``<``, ``>`` escaped (ampersand first)."""
    out = _c(c)
    for ch, ent in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(ch), F.lit(ent))
    return out


def xml_unescape(c) -> Column:
    out = _c(c)
    for ent, ch in XML_ENTITIES:
        out = F.replace(out, F.lit(ent), F.lit(ch))
    return out


def _payload_links(payloads: DataFrame, body: str, pattern: str) -> DataFrame:
    return (payloads.select("*", F.posexplode(F.regexp_extract_all(_c(body), F.lit(pattern), 1))
                            .alias("pos", "raw"))
            .drop(body).where(F.col("raw") != "")
            .withColumn("url", xml_unescape("raw")).drop("raw"))


def rss_links(payloads: DataFrame, body: str = "body") -> DataFrame:
    """``<item> … <link>`` URLs of an RSS feed, entities decoded; tolerant of cut-off feeds."""
    return _payload_links(payloads, body, RSS_ITEM_LINK)


def sitemap_links(payloads: DataFrame, body: str = "body") -> DataFrame:
    """``<loc>`` URLs of a sitemap (namespace-agnostic), entities decoded."""
    return _payload_links(payloads, body, SITEMAP_LOC)


def resolve(href, base_url) -> Column:
    """Absolute http(s) URL for an href found on ``base_url``; NULL for others."""
    h = F.trim(F.replace(_c(href), F.lit("&amp;"), F.lit("&")))
    b = _c(base_url)
    scheme = F.lower(F.regexp_extract(b, URL_PARTS, 1))
    host = F.regexp_extract(b, URL_PARTS, 2)
    path = F.regexp_extract(b, URL_PARTS, 3)
    base_dir = F.regexp_extract(path, r"^(.*/)", 1)
    base_dir = F.when(base_dir == "", F.lit("/")).otherwise(base_dir)
    out = (F.when(h.rlike(HTTP), h)
           .when(h.startswith("//"), F.concat(scheme, F.lit(":"), h))
           .when(h.startswith("#") | (h == ""), F.lit(None).cast("string"))
           .when(h.rlike(HAS_SCHEME), F.lit(None).cast("string"))
           .when(h.startswith("/"), F.concat(scheme, F.lit("://"), host, h))
           .otherwise(F.concat(scheme, F.lit("://"), host, base_dir, h)))
    ok = b.rlike(URL_PARTS)
    return F.when(ok, out).when(h.rlike(HTTP), h)


def html_links(pages: DataFrame, html: str = "html", url: str = "url", id_col: str = "page_id") -> DataFrame:
    """The ``href`` of every anchor and area of each page, resolved against the page URL, http(s) only.

    ``pos`` counts the page's hrefs, those that resolve to no http(s) URL included."""
    anchors = F.filter(H.tags(html), lambda t: t["name"].isin("a", "area"))
    hrefs = F.filter(F.transform(anchors, lambda t: H.attribute(t["head"], "href")), lambda h: h.isNotNull())
    x = pages.select(id_col, url, F.posexplode(hrefs).alias("pos", "href"))
    return (x.select(id_col, "pos", resolve("href", url).alias("link"))
            .where(F.col("link").isNotNull() & F.col("link").rlike(HTTP)))


# ---- P4 ------------------------------------------------------------------------------
def normalize_url(u) -> Column:
    """Lower scheme and host, drop fragment, utm_*/ref params and trailing '/'.

    NULL when the text is not ``scheme://host…``.
    """
    u = F.trim(_c(u))
    scheme = F.lower(F.regexp_extract(u, URL_PARTS, 1))
    host = F.lower(F.regexp_extract(u, URL_PARTS, 2))
    path = F.regexp_replace(F.regexp_extract(u, URL_PARTS, 3), r"/+$", "")
    query = F.regexp_extract(u, URL_PARTS, 4)

    def keep(p):
        k = F.lower(F.split_part(p, F.lit("="), F.lit(1)))
        return (p != "") & ~F.startswith(k, F.lit(DROP_PARAM_PREFIX)) & ~k.isin(*DROP_PARAMS)

    params = F.filter(F.split(F.regexp_replace(query, r"^\?", ""), "&"), keep)
    q = F.array_join(params, "&")
    norm = F.concat(scheme, F.lit("://"), host, path, F.when(q != "", F.concat(F.lit("?"), q)).otherwise(F.lit("")))
    return F.when(u.rlike(URL_PARTS), norm)


def url_hash(norm) -> Column:
    return F.sha2(_c(norm), 256)


def with_url_key(df: DataFrame, url: str = "url") -> DataFrame:
    n = normalize_url(url)
    return df.withColumn("url_norm", n).withColumn("url_hash", url_hash("url_norm"))


# ---- P5 ------------------------------------------------------------------------------
def dedupe_urls(df: DataFrame, order_cols: list[str], keep_cols: list[str]) -> DataFrame:
    """P5: one row per url_hash, the first by ``order_cols`` (NULLs last), with copies counted.

    ``min`` over a struct is a partial aggregate, so a URL seen a billion
    times is reduced map-side; no group is ever materialised whole.
    """
    key_fields = []
    for c in order_cols:
        key_fields += [F.col(c).isNull().alias(f"_null_{c}"), F.col(c).alias(f"_k_{c}")]
    first = F.struct(*key_fields, *[F.col(c).alias(c) for c in keep_cols])
    return (df.where(F.col("url_hash").isNotNull())
            .groupBy("url_hash")
            .agg(F.min(first).alias("f"), F.count(F.lit(1)).alias("copies"))
            .select("url_hash", *[F.col(f"f.{c}").alias(c) for c in keep_cols], "copies"))


# ---- P6 ------------------------------------------------------------------------------
def fetch_queue(url_state: DataFrame, per_source: int = 30) -> DataFrame:
    """Status 'new', at most N per source, oldest first (ties: url_id).

    ``row_number() <= N`` plans as WindowGroupLimit, which also runs before
    the shuffle, so a source with a third of all URLs sends only N rows per
    task across the network.
    """
    w = W.partitionBy("source_id").orderBy(F.col("discovered_at").asc_nulls_last(), F.col("url_id").asc())
    return (url_state.where(F.col("status") == "new")
            .withColumn("rank", F.row_number().over(w))
            .where(F.col("rank") <= per_source))
