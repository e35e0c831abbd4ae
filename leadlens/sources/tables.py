"""The reference's seven tables as Spark DataFrames.

The driver ships generic tables (documents, events, labels, pages); the
dashboard reads items, item_scores, lead_labels, url_state, sources and
pipeline_runs.  ``Catalog`` derives the latter from the former with the
rules of FIXTURES.md §3, expressed with the DataFrame API, so every
query's work grows with the driver tables.  ``Catalog.materialize``
writes them once as Parquet in the layout we want at scale
(item_scores partitioned by prompt version, everything sorted by key
inside files) and returns a catalog that reads the written copy.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
                 "events", "documents", "embeddings", "pages", "benchmark", "labels",
                 "conversations")

REFERENCE_TABLES = ("items", "item_scores", "lead_labels", "url_state", "sources",
                    "pipeline_runs", "feeds")

# Entries per derived feed document: ids are split into blocks of this many, so a
# payload stays small however many entries its source has.
FEED_BLOCK = 1000
SITEMAP_NS = "http://www.sitemaps.org/schemas/sitemap/0.9"

# Fixed values of the fixture rules (FIXTURES.md §3).
MODELS = [("gemma3:4b", 0), ("llama3.2:3b", 1), ("mistral:7b", 2), ("qwen2.5:3b", 3)]
PROMPTS = [("A", 0), ("B", 1)]
SECTORS = {0: None, 1: "", 2: "chemicals", 3: "automotive", 4: "steel", 5: "timber", 6: "logistics"}
COUNTRIES = {0: None, 1: "", 2: "Austria", 3: "Germany", 4: "Italy", 5: "Poland",
             6: "Deutschland", 7: "Hungary", 8: "France"}
EVENT_STATUS = {0: None, 1: "planned", 2: "under construction", 3: "opened"}
COMPANY_ROLE = {0: None, 1: "operator", 2: "investor", 3: "shipper", 4: "shipper"}
SOURCE_KINDS = ["rss", "sitemap", "html"]


def _case(key: Column, mapping: dict) -> Column:
    out = None
    for k, v in mapping.items():
        val = F.lit(None).cast("string") if v is None else F.lit(v)
        out = F.when(key == k, val) if out is None else out.when(key == k, val)
    return out


class Catalog:
    """Lazily built DataFrames for one data directory."""

    def __init__(self, spark: SparkSession, sf_dir: str, derived_dir: str | None = None):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self.derived_dir = derived_dir

    # ---- driver tables -------------------------------------------------
    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def documents(self) -> DataFrame:
        return self.raw("documents")

    @property
    def events(self) -> DataFrame:
        return self.raw("events")

    @property
    def labels(self) -> DataFrame:
        return self.raw("labels")

    @property
    def pages(self) -> DataFrame:
        return self.raw("pages")

    # ---- reference tables ----------------------------------------------
    def _derived(self, name: str) -> DataFrame | None:
        if self.derived_dir:
            return self.spark.read.parquet(f"{self.derived_dir}/{name}")
        return None

    @cached_property
    def items(self) -> DataFrame:
        got = self._derived("items")
        if got is not None:
            return got
        e = self.events.select(F.col("event_id").alias("e_id"), F.col("ts").alias("e_ts"))
        p = self.events.select(F.col("event_id").alias("p_id"), F.col("ts").alias("p_ts"))
        doc = F.col("doc_id")
        m10 = doc % 10
        cluster_key = F.floor(doc / 24)
        # all that is looked up meets the ids alone, so that the texts are shuffled once, by doc_id
        ids = self.documents.where(doc.isNotNull()).select("doc_id").distinct()
        first = (ids.where((doc % 5 >= 2) & (doc % 29 != 0)).groupBy(cluster_key.alias("first_key"))
                 .agg(F.min("doc_id").alias("canon_min")))
        found = (ids.join(e, F.col("e_id") == doc * 5, "left").join(p, F.col("p_id") == doc * 4, "left")
                 .join(first, F.col("first_key") == cluster_key, "left")
                 .select(doc.alias("found_id"), "e_ts", "p_ts", "canon_min"))
        canon_min = F.col("canon_min")
        j = self.documents.join(found, F.col("found_id") == doc, "left")
        return j.select(
            doc.alias("item_id"),
            F.col("source").alias("source_id"),
            F.concat(F.lit("https://"), F.col("source"), F.lit(".example.com/a/"), doc).alias("url"),
            F.when(doc % 23 == 0, F.lit(None).cast("string"))
             .otherwise(F.split_part(F.col("text"), F.lit("\n"), F.lit(1))).alias("title"),
            F.col("text").alias("clean_text"),
            F.col("lang").alias("language"),
            F.col("e_ts").alias("created_at"),
            F.when(doc % 4 == 0, F.lit(None).cast("timestamp_ntz")).otherwise(F.col("p_ts")).alias("published_at"),
            _case(doc % 7, SECTORS).alias("sector"),
            _case(doc % 9, COUNTRIES).alias("lead_country"),
            F.when(doc % 5 < 2, F.lit(None).cast("long")).otherwise(cluster_key.cast("long")).alias("cluster_id"),
            F.when(doc % 5 < 2, F.lit(None).cast("boolean"))
             .when(doc % 29 == 0, F.lit(None).cast("boolean"))
             .otherwise(doc == canon_min).alias("is_cluster_canonical"),
            F.when(m10 == 0, F.lit("pre-filter")).when(m10 == 1, F.lit("extract_v2"))
             .when(m10 == 2, F.lit(None).cast("string")).otherwise(F.lit("gemma3:4b")).alias("classifier_model"),
            (m10 >= 2).alias("prefilter_pass"),
            F.when(m10 == 2, F.lit(None).cast("int")).when(m10 < 2, F.lit(0))
             .otherwise(((doc * 7 + F.col("n_chars")) % 11).cast("int")).alias("lead_score"),
            F.when(doc % 3 == 0, F.lit(None).cast("decimal(18,2)"))
             .otherwise((F.col("n_chars") * (1 + (doc % 4) * 100000)).cast("decimal(18,2)")).alias("investment_eur"),
            F.when(doc % 6 == 0, F.lit(None).cast("string"))
             .otherwise(F.concat(F.lit("NST"), (doc % 20).cast("string"))).alias("commodity_nst"),
            _case(doc % 4, EVENT_STATUS).alias("event_status"),
            _case(doc % 5, COMPANY_ROLE).alias("company_role"),
        )

    @cached_property
    def item_scores(self) -> DataFrame:
        got = self._derived("item_scores")
        if got is not None:
            return got
        doc = F.col("doc_id")
        models = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(i).alias("mi")) for m, i in MODELS])
        prompts = F.array(*[F.struct(F.lit(p).alias("prompt_version"), F.lit(i).alias("pi")) for p, i in PROMPTS])
        # The 4 x 2 run grid is attached with explode (a Generate), not a join.
        d = (self.documents.where(doc % 10 >= 2)
             .select("doc_id", "n_chars", F.explode(models).alias("m"))
             .select("doc_id", "n_chars", "m.*", F.explode(prompts).alias("p"))
             .select("doc_id", "n_chars", "model", "mi", "p.*"))
        e = self.events.select(F.col("event_id").alias("e_id"), F.col("ts").alias("classified_at"))
        j = d.join(e, e.e_id == doc * 5 + F.col("mi"), "left")
        mi, pi = F.col("mi"), F.col("pi")
        return j.select(
            doc.alias("item_id"), "model", "prompt_version",
            F.when((doc + mi) % 19 == 0, F.lit(None).cast("int"))
             .otherwise(((doc * 7 + F.col("n_chars") + 3 * mi + 5 * pi) % 11).cast("int")).alias("lead_score"),
            F.when(doc % 4 == 0, F.lit(None).cast("string"))
             .otherwise(F.concat(F.lit("Company "), (doc % 40).cast("string"))).alias("lead_company"),
            F.when(doc % 3 == 0, F.lit(None).cast("string"))
             .otherwise(F.concat(F.lit("City "), (doc % 12).cast("string"))).alias("lead_city"),
            _case(doc % 9, COUNTRIES).alias("lead_country"),
            F.when(doc % 5 == 0, F.lit(None).cast("string"))
             .otherwise(F.concat(F.lit("who "), doc.cast("string"))).alias("lead_who"),
            F.when(doc % 5 == 1, F.lit(None).cast("string"))
             .otherwise(F.concat(F.lit("builds site "), doc.cast("string"))).alias("lead_what"),
            F.when(doc % 5 == 2, F.lit(None).cast("string")).otherwise(F.lit("2024")).alias("lead_when"),
            F.when(doc % 5 == 3, F.lit(None).cast("string"))
             .otherwise(F.concat(F.lit("reason "), F.col("model"))).alias("lead_reason"),
            F.when(doc % 5 == 4, F.lit(None).cast("string"))
             .otherwise(F.concat(F.lit("description "), doc.cast("string"))).alias("lead_description"),
            "classified_at",
        )

    @cached_property
    def lead_labels(self) -> DataFrame:
        got = self._derived("lead_labels")
        if got is not None:
            return got
        doc = F.col("doc_id")
        ev = self.events.select("event_id", "ts")
        l = self.labels
        crm = (l.join(ev, ev.event_id == doc * 5 + 2, "left").select(
            doc.alias("item_id"),
            F.when((F.col("toxic") == 1) | (F.col("quality") == 0), F.lit("rejected"))
             .when(doc % 3 == 0, F.lit("confirmed")).when(doc % 3 == 1, F.lit("follow_up"))
             .otherwise(F.lit("contacted")).alias("label"),
            F.lit("crm").alias("labeled_by"),
            F.when(doc % 50 == 0, F.lit(None).cast("timestamp_ntz")).otherwise(F.col("ts")).alias("labeled_at")))
        gui = (l.where(doc % 4 == 0).join(ev, ev.event_id == doc * 5 + 4, "inner").select(
            doc.alias("item_id"), F.lit("contacted").alias("label"), F.lit("gui").alias("labeled_by"),
            F.col("ts").alias("labeled_at")))
        return crm.unionByName(gui)

    @cached_property
    def url_state(self) -> DataFrame:
        got = self._derived("url_state")
        if got is not None:
            return got
        pid = F.col("page_id")
        ev = self.events.select("event_id", "ts")
        return (self.pages.select("page_id", "url").join(ev, ev.event_id == pid, "left").select(
            pid.alias("url_id"), "url",
            F.concat(F.lit("src"), (pid % 20).cast("string")).alias("source_id"),
            F.when(pid % 3 == 0, "new").when(pid % 3 == 1, "fetched").otherwise("error").alias("status"),
            F.col("ts").alias("discovered_at")))

    @cached_property
    def sources(self) -> DataFrame:
        got = self._derived("sources")
        if got is not None:
            return got
        idx = F.regexp_extract("source_id", r"([0-9]+)$", 1).cast("int")
        kind = F.element_at(F.array(*[F.lit(k) for k in SOURCE_KINDS]), (idx % 3) + 1)
        path = (F.when(kind == "rss", F.lit("feed.xml")).when(kind == "sitemap", F.lit("sitemap.xml"))
                .otherwise(F.lit("")))
        return (self.documents.select(F.col("source").alias("source_id")).distinct()
                .select("source_id", kind.alias("kind"),
                        F.concat(F.lit("https://"), F.col("source_id"), F.lit(".example.com/"), path).alias("url"),
                        (F.col("source_id") != "src19").alias("active")))

    @cached_property
    def pipeline_runs(self) -> DataFrame:
        got = self._derived("pipeline_runs")
        if got is not None:
            return got
        eid = F.col("event_id")
        n = F.regexp_extract("props", "[0-9]+", 0).cast("int")
        return (self.events.where(eid % 20 == 0).select(
            eid.alias("run_id"),
            F.when(F.col("event_type") == "view", "discover").when(F.col("event_type") == "click", "fetch")
             .when(F.col("event_type") == "signup", "extract").otherwise("classify").alias("script"),
            F.col("ts").alias("started_at"),
            F.when(F.col("event_type") == "error", F.lit(None).cast("timestamp_ntz"))
             .otherwise(F.col("ts")).alias("finished_at"),
            F.col("value").alias("duration_s"),
            n.alias("articles_processed"),
            (n - F.col("user_id") % 3).cast("int").alias("articles_ok"),
            F.when(eid % 7 == 0, F.lit(None).cast("int")).otherwise((F.col("user_id") % 3).cast("int"))
             .alias("articles_err"),
            (eid % 4).cast("int").alias("articles_skipped"),
            F.when(n == 0, F.lit(None).cast("double")).otherwise(F.col("value") / n).alias("avg_s_per_article"),
            F.when(eid % 9 == 0, F.lit("note")).otherwise(F.lit(None).cast("string")).alias("notes")))

    @cached_property
    def feeds(self) -> DataFrame:
        """S8 landing payloads derived from the tables: (source_id, kind, feed_no, body).

        Every rss source publishes its articles (items) as RSS documents and
        every sitemap source its known URLs (url_state) as sitemaps, one
        document per block of ``FEED_BLOCK`` consecutive ids, entries in id
        order and XML-escaped.  The block bounds each document (and the
        group built for it) whatever the source's share of the rows.
        """
        got = self._derived("feeds")
        if got is not None:
            return got
        from leadlens.operators.discover import xml_escape

        kinds = self.sources.select("source_id", "kind")
        rss = (self.items.join(kinds.where(F.col("kind") == "rss"), "source_id")
               .select("source_id", "kind", F.col("item_id").alias("entry_id"),
                       F.concat(F.lit("<item><title>"), xml_escape(F.coalesce("title", F.lit(""))),
                                F.lit("</title><link>"), xml_escape("url"), F.lit("</link></item>")).alias("entry")))
        lastmod = F.concat(F.lit("<lastmod>"), F.date_format("discovered_at", "yyyy-MM-dd"), F.lit("</lastmod>"))
        sm = (self.url_state.join(kinds.where(F.col("kind") == "sitemap"), "source_id")
              .select("source_id", "kind", F.col("url_id").alias("entry_id"),
                      F.concat(F.lit("<url><loc>"), xml_escape("url"), F.lit("</loc>"),
                               F.coalesce(lastmod, F.lit("")), F.lit("</url>")).alias("entry")))
        blocks = (rss.unionByName(sm)
                  .withColumn("feed_no", F.floor(F.col("entry_id") / FEED_BLOCK).cast("long"))
                  .groupBy("source_id", "kind", "feed_no")
                  .agg(F.array_sort(F.collect_list(F.struct("entry_id", "entry"))).alias("e")))
        decl = F.lit('<?xml version="1.0" encoding="UTF-8"?>')
        head = F.when(F.col("kind") == "rss",
                      F.concat(decl, F.lit('<rss version="2.0"><channel><title>'), F.col("source_id"),
                               F.lit("</title>"))
                      ).otherwise(F.concat(decl, F.lit(f'<urlset xmlns="{SITEMAP_NS}">')))
        tail = F.when(F.col("kind") == "rss", F.lit("</channel></rss>")).otherwise(F.lit("</urlset>"))
        body = F.concat(head, F.array_join(F.transform("e", lambda x: x["entry"]), ""), tail)
        return blocks.select("source_id", "kind", "feed_no", body.alias("body"))

    # ---- layout at scale ---------------------------------------------------
    def materialize(self, path: str) -> "Catalog":
        """Write the reference tables once and return a catalog over them.

        item_scores is partitioned by prompt_version (nearly every query
        filters on it, so the scan prunes directories), feeds by kind, and every table is
        sorted by its key inside each file so Parquet min/max statistics
        skip row groups for key-range filters.
        """
        base = path.rstrip("/")
        # hash on (version, item) spreads the write over all tasks; sorting by version first
        # lets each task write its directories one file at a time
        (self.item_scores.repartition("prompt_version", "item_id")
         .sortWithinPartitions("prompt_version", "item_id")
         .write.mode("overwrite").partitionBy("prompt_version").parquet(f"{base}/item_scores"))
        # feeds by kind: the rss and sitemap readers each prune to their own directory; a source's
        # documents are dealt out by their numbers, so a large source is many tasks
        (self.feeds.repartition("kind", "source_id", "feed_no").sortWithinPartitions("kind", "source_id", "feed_no")
         .write.mode("overwrite").partitionBy("kind").parquet(f"{base}/feeds"))
        for name, key in (("items", "item_id"), ("lead_labels", "item_id"), ("url_state", "url_id"),
                          ("sources", "source_id"), ("pipeline_runs", "run_id")):
            df = getattr(self, name)
            df.sortWithinPartitions(key).write.mode("overwrite").parquet(f"{base}/{name}")
        return Catalog(self.spark, self.sf_dir, derived_dir=base)

    def table(self, name: str) -> DataFrame:
        return getattr(self, name) if name in REFERENCE_TABLES else self.raw(name)


# Explicit schemas for reading exported CSV back (S5): no inference.
ITEMS_SCHEMA = T.StructType([
    T.StructField("item_id", T.LongType()), T.StructField("source_id", T.StringType()),
    T.StructField("url", T.StringType()), T.StructField("title", T.StringType()),
    T.StructField("clean_text", T.StringType()), T.StructField("language", T.StringType()),
    T.StructField("created_at", T.TimestampNTZType()), T.StructField("published_at", T.TimestampNTZType()),
    T.StructField("sector", T.StringType()), T.StructField("lead_country", T.StringType()),
    T.StructField("cluster_id", T.LongType()), T.StructField("is_cluster_canonical", T.BooleanType()),
    T.StructField("classifier_model", T.StringType()), T.StructField("prefilter_pass", T.BooleanType()),
    T.StructField("lead_score", T.IntegerType()), T.StructField("investment_eur", T.DecimalType(18, 2)),
    T.StructField("commodity_nst", T.StringType()), T.StructField("event_status", T.StringType()),
    T.StructField("company_role", T.StringType()),
])

ITEM_SCORES_SCHEMA = T.StructType(
    [T.StructField("item_id", T.LongType()), T.StructField("model", T.StringType()),
     T.StructField("prompt_version", T.StringType()), T.StructField("lead_score", T.IntegerType())]
    + [T.StructField(c, T.StringType()) for c in
       ("lead_company", "lead_city", "lead_country", "lead_who", "lead_what", "lead_when",
        "lead_reason", "lead_description")]
    + [T.StructField("classified_at", T.TimestampNTZType())])

LEAD_LABELS_SCHEMA = T.StructType([
    T.StructField("item_id", T.LongType()), T.StructField("label", T.StringType()),
    T.StructField("labeled_by", T.StringType()), T.StructField("labeled_at", T.TimestampNTZType()),
])

SOURCES_SCHEMA = T.StructType([
    T.StructField("source_id", T.StringType()), T.StructField("kind", T.StringType()),
    T.StructField("url", T.StringType()), T.StructField("active", T.BooleanType()),
])

URL_STATE_SCHEMA = T.StructType([
    T.StructField("url_id", T.LongType()), T.StructField("url", T.StringType()),
    T.StructField("source_id", T.StringType()), T.StructField("status", T.StringType()),
    T.StructField("discovered_at", T.TimestampNTZType()),
])

PIPELINE_RUNS_SCHEMA = T.StructType([
    T.StructField("run_id", T.LongType()), T.StructField("script", T.StringType()),
    T.StructField("started_at", T.TimestampNTZType()), T.StructField("finished_at", T.TimestampNTZType()),
    T.StructField("duration_s", T.DoubleType()), T.StructField("articles_processed", T.IntegerType()),
    T.StructField("articles_ok", T.IntegerType()), T.StructField("articles_err", T.IntegerType()),
    T.StructField("articles_skipped", T.IntegerType()), T.StructField("avg_s_per_article", T.DoubleType()),
    T.StructField("notes", T.StringType()),
])

SCHEMAS = {"items": ITEMS_SCHEMA, "item_scores": ITEM_SCORES_SCHEMA, "lead_labels": LEAD_LABELS_SCHEMA,
           "sources": SOURCES_SCHEMA, "url_state": URL_STATE_SCHEMA, "pipeline_runs": PIPELINE_RUNS_SCHEMA}
