"""What goes through shuffles: a text once for each reading of the items, and rows the same as by plain lookups."""

import contextlib
import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from leadlens.operators import cluster as K
from leadlens.sources.tables import Catalog

DAY = dt.datetime(2024, 1, 1)


@contextlib.contextmanager
def conf(spark, **pairs):
    pairs = {f"spark.sql.{k.replace('_', '.')}": v for k, v in pairs.items()}
    was = {k: spark.conf.get(k, None) for k in pairs}
    for k, v in pairs.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def exchanges(df, column):
    """How many exchanges of the plan carry a column so named."""
    def walk(node):
        own = node.nodeName() == "Exchange" and f"{column}#" in node.output().mkString(",")
        children = node.children()
        return own + sum(walk(children.apply(i)) for i in range(children.length()))

    with conf(df.sparkSession, adaptive_enabled="false", autoBroadcastJoinThreshold="-1"):
        return walk(df.select("*")._jdf.queryExecution().executedPlan())


@pytest.fixture()
def odd(spark, tmp):
    """Tables with repeated and null keys: (catalog, documents, events)."""
    docs = [(i, f"first line {i}\nand more", "en", f"src{i % 3}", 20 + i) for i in range(60)]
    docs += [(7, "again under seven", "de", "src1", 17), (7, "again under seven", "de", "src1", 17), (None, "no id", "en", None, 5), (None, None, None, "src2", None), (3, None, "en", "src0", 0)]
    events = [(i, DAY + dt.timedelta(minutes=i)) for i in range(0, 260, 3)]
    events += [(35, DAY), (35, DAY + dt.timedelta(days=1)), (28, DAY), (28, None), (60, DAY), (None, DAY)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp}/documents.parquet")
    spark.createDataFrame(events, "event_id long, ts timestamp_ntz").write.parquet(f"{tmp}/events.parquet")
    return Catalog(spark, tmp), docs, events


def test_items_of_repeated_and_null_keys(odd):
    c, docs, events = odd
    want = Counter()
    for d, text, *_ in docs:
        created = [t for e, t in events if d is not None and e == d * 5] or [None]
        published = [t for e, t in events if d is not None and e == d * 4] or [None]
        group = [x for x, *_ in docs if d is not None and x is not None and x // 24 == d // 24 and x % 5 >= 2 and x % 29]
        first = None if d is None or d % 5 < 2 or d % 29 == 0 else d == min(group)
        for a in created:
            for b in published:
                want[d, text, a, None if d is None or d % 4 == 0 else b, first] += 1
    rows = c.items.select("item_id", "clean_text", "created_at", "published_at", "is_cluster_canonical").collect()
    assert Counter(map(tuple, rows)) == want


def test_texts_of_items_are_shuffled_once(odd):
    c, _, _ = odd
    assert exchanges(c.items, "text") == 1


def test_exact_duplicates_shuffle_no_text_twice(odd):
    c, _, _ = odd
    out = K.exact_duplicate_clusters(c.items)
    assert exchanges(out, "text") == 0  # only digests are left
    rows = out.collect()
    copies = Counter(r["text_md5"] for r in rows)
    assert rows and all(r["copies"] == copies[r["text_md5"]] for r in rows)


# ---- keyword table --------------------------------------------------------------------------------
def test_keyword_table_shuffles_texts_once_and_tests_grams_before(odd):
    from leadlens.plans.text_jobs import p14_keyword_table

    c, _, _ = odd
    out = p14_keyword_table(c)
    assert exchanges(out, "text") == 1  # the texts that are searched; keywords are a checkpoint
    assert "getbit" in out._jdf.queryExecution().optimizedPlan().toString()


def test_keyword_filter_of_any_size_gives_the_same_hits(spark, monkeypatch):
    from leadlens.operators import extract as T

    keywords = [f"k{i}" for i in range(300)] + [f"k{i} k{i + 1}" for i in range(300)] + ["k1-K2", "", None]
    items = spark.createDataFrame([(i, " ".join(f"{'kx'[(i + j) % 2]}{(i * j) % 400}" for j in range(40))) for i in range(50)] + [(7, "k5 K6"), (None, "k7"), (8, None)], "item_id long, clean_text string")
    table = spark.createDataFrame([(k,) for k in keywords], "keyword string")
    want = Counter()
    for i, text in items.collect():
        t = (text or "").lower().split()
        grams = {*t, *(f"{a} {b}" for a, b in zip(t, t[1:]))}
        want.update((i, k) for k in keywords if k and k.lower().replace("-", " ") in grams)
    for words in (1, 4, T.FILTER_WORDS):
        monkeypatch.setattr(T, "FILTER_WORDS", words)
        assert Counter(map(tuple, T.keyword_hits(items, table).collect())) == want
    kept = spark.createDataFrame([(f"k{i}",) for i in range(20)], "gram string")
    bits = T.filter_bits(kept, T.filter_size(20)).first()["bits"]
    assert sum(bin(b & (1 << 64) - 1).count("1") for b in bits) <= 20 < 64 * len(bits)


# ---- search index -----------------------------------------------------------------------------------
def test_search_index_reads_the_items_once(spark, odd, tmp):
    from leadlens.sources.search import SearchIndex

    c, docs, _ = odd
    seen = spark.sparkContext.accumulator(0)

    def title_of(text):
        seen.add(1)
        return (text or "")[:12]

    docs_ = c.documents.select(F.col("doc_id").alias("item_id"), F.udf(title_of)("text").alias("title"), F.col("lang").alias("sector"))
    scores = c.documents.select(F.col("doc_id").alias("item_id"), F.lit("AcmeAcme").alias("lead_company"))
    SearchIndex(spark, f"{tmp}/index").build(docs_, scores)
    assert seen.value == len(docs)
    want = {(i, x[k:k + 3]) for i, text, lang, *_ in docs for x in ((text or "")[:12].lower(), lang or "", "acmeacme") for k in range(len(x) - 2)}
    got = [tuple(r) for r in spark.read.parquet(f"{tmp}/index/grams").select("item_id", "gram").collect()]
    assert set(got) == want and len(got) == len(want)


# ---- stories --------------------------------------------------------------------------------------------
def test_only_texts_that_share_enough_go_into_the_last_join(spark, monkeypatch):
    words = {i: [f"w{i}x{j}" for j in range(100)] for i in range(40)}
    for i in range(1, 40):
        words[i][:12] = words[0][:12]  # one passage in all: shingles shared, texts unlike
    words[40] = words[3][:97] + ["new", "end", "here"]
    rows = [(i, " ".join(w)) for i, w in words.items()]
    items = spark.createDataFrame([(i, t, None, None) for i, t in rows], "item_id long, clean_text string, published_at timestamp_ntz, created_at timestamp_ntz")
    sets = K.ordered_sets(K.token_sets(items, "item_id", "clean_text")).checkpoint()
    none = spark.createDataFrame([], "id long, label long")
    assert {r["id"] for r in K.shared_enough(sets, none).collect()} == {3, 40}
    joined = []
    real = K.apart_candidates
    monkeypatch.setattr(K, "apart_candidates", lambda rows: joined.append({r["id"] for r in rows.select("id").collect()}) or real(rows))
    monkeypatch.setattr(K, "star_candidates", lambda rows, turn: rows.select("id", rows.id.alias("rep")).limit(0))  # all is left to the last join
    found = {r["item_id"]: r["cluster_id"] for r in K.story_clusters(items).collect()}
    assert found == {i: 3 if i in (3, 40) else None for i in words}
    assert joined == [{3, 40}]


def passages(n=40):
    """Texts that share a passage and are unlike, but for 3 and n."""
    words = {i: [f"w{i}x{j}" for j in range(100)] for i in range(n)}
    for i in range(1, n):
        words[i][:30] = words[0][:30]
    words[n] = words[3][:97] + ["new", "end", "here"]
    return [(i, " ".join(w), None, None) for i, w in words.items()]


ITEMS = "item_id long, clean_text string, published_at timestamp_ntz, created_at timestamp_ntz"


def test_only_whole_sets_that_may_be_alike_are_fetched(spark, monkeypatch):
    fetched = []
    real = K.verified_edges
    monkeypatch.setattr(K, "verified_edges", lambda pairs, sets: fetched.append({r["id"] for r in sets.select("id").collect()}) or real(pairs, sets))
    every = K.star_candidates  # as if each text's prefix held the passage
    monkeypatch.setattr(K, "star_candidates", lambda rows, turn: every(rows, turn).unionByName(spark.createDataFrame([(i, 0) for i in range(1, 41)], "id long, rep long")).distinct())
    found = {r["item_id"]: r["cluster_id"] for r in K.story_clusters(spark.createDataFrame(passages(), ITEMS)).collect()}
    assert found == {i: 3 if i in (3, 40) else None for i in range(41)}
    assert set().union(*fetched) == {3, 40}


def test_texts_of_stories_are_shuffled_once_and_without_lookups(odd):
    c, docs, events = odd
    texts = K.worded(c.items, "item_id", "clean_text")
    assert exchanges(texts.groupBy("words").agg(F.min("id")), "text") == 0
    assert exchanges(texts.groupBy("words").agg(F.min("id")), "words") == 1


def test_prefix_rows_of_elements_that_one_text_has_do_not_go_on(spark):
    sets = K.ordered_sets(K.token_sets(spark.createDataFrame(passages(), ITEMS), "item_id", "clean_text"))
    rows = K.prefix_rows(sets).checkpoint()
    with K.scratch(spark) as keep:
        got = [tuple(r) for r in K.shared_rows(rows, keep).collect()]
    count = Counter(r["key"] for r in rows.collect())
    assert sorted(got) == sorted(tuple(r) for r in rows.collect() if count[r["key"]] > 1) and 0 < len(got) < rows.count()


def test_maps_reject_unlike_sets_only(spark):
    rnd = random.Random(9)
    rows, sets = [], {}
    for i in range(0, 240, 2):
        n = rnd.choice([1, 3, 63, 64, 65, 127, 128, 129, 300, 1000, 1030, 2100])
        base = [rnd.randrange(-1 << 63, 1 << 63) for _ in range(n)]
        other = base[:rnd.randrange(int(0.6 * n), n + 1)]
        other += [rnd.randrange(-1 << 63, 1 << 63) for _ in range(rnd.randrange(0, 1 + n // 10))]
        sets[i], sets[i + 1] = set(base), set(other or base)
    rows = [(i, i % 3, len(s), list(s)) for i, s in sets.items()]
    df = spark.createDataFrame(rows, "id long, copy long, n int, keys array<bigint>")
    maps = K.parity_maps(df).checkpoint()
    for r in maps.collect():
        want = [0] * len(r["map"])
        for e in sets[r["id"]]:
            want[(e >> 6) % len(want)] ^= 1 << (e & 63)
        assert [w & (1 << 64) - 1 for w in r["map"]] == want and len(sets[r["id"]]) <= 64 * len(want) <= 128 + 2 * len(sets[r["id"]])
    pairs = [(i + 1, i) for i in range(0, 240, 2)] + [(i + 2, i) for i in range(0, 200, 2)]
    left = {tuple(r) for r in K.pairs_in_reach(spark.createDataFrame(pairs, "id long, rep long"), maps).collect()}
    alike = {(a, b) for a, b in pairs if len(sets[a] & sets[b]) >= K.SIMILARITY * len(sets[a] | sets[b]) - 1e-9}
    near = {(a, b) for a, b in pairs if 100 < 0.8 * max(len(sets[a]), len(sets[b])) <= min(len(sets[a]), len(sets[b]))}  # in other pairs, sizes decide
    far = {(a, b) for a, b in near if len(sets[a] & sets[b]) < 0.5 * len(sets[a] | sets[b])}
    assert alike and far and alike <= left and not left & far


@pytest.mark.parametrize("crowd", [0, 16])
def test_texts_in_reach_of_other_components(spark, monkeypatch, crowd):
    monkeypatch.setattr(K, "CROWD", crowd)
    sets = K.ordered_sets(K.token_sets(spark.createDataFrame(passages(), ITEMS), "item_id", "clean_text")).withColumn("copy", F.lit(0))
    maps = K.parity_maps(sets).checkpoint()
    for labels, want in (([], {3, 40}), ([(40, 3)], set())):
        rows = K.open_rows(K.prefix_rows(sets), spark.createDataFrame(labels, "id long, label long"))
        assert {r["id"] for r in K.sets_in_reach(rows, maps).collect()} == want


def test_sets_are_found_by_any_number_of_ids(spark, monkeypatch):
    monkeypatch.setattr(K, "TABLE_BITS", 1024)
    sets = spark.range(5000)
    for n in (0, 3, 4000):
        ids = spark.range(n).unionByName(spark.range(n))
        assert sorted(r["id"] for r in K.sets_of(ids, sets).collect()) == list(range(n))


def test_stories_of_repeated_and_null_ids(spark, tmp):
    a, b, c = ([f"{x}{j}" for j in range(40)] for x in "abc")
    rows = [(None, " ".join(a)), (1, " ".join(a)), (2, " ".join(a) + " end"), (3, " ".join(b)), (3, " ".join(c)), (4, " ".join(b) + " end"), (5, " ".join(c)), (6, "x y"), (6, "x y"), (None, None)]
    found = K.story_clusters(spark.createDataFrame([(i, t, None, None) for i, t in rows], ITEMS)).select("item_id", "cluster_id").distinct().collect()
    assert {tuple(r) for r in found} == {(None, None), (1, 1), (2, 1), (3, 3), (4, 3), (5, 3), (6, None)}


def test_stories_leave_no_scratch_tables(spark):
    import glob

    K.story_clusters(spark.createDataFrame(passages(5), ITEMS)).collect()
    assert not glob.glob(f"{spark.conf.get('spark.checkpoint.dir')}/stories-*")


# ---- lines ------------------------------------------------------------------------------------------------
def test_line_prefixes_are_dealt_once_for_a_join(spark):
    from leadlens.llm import line_dedup as L

    sets = spark.range(50).select(F.col("id").alias("set"), F.lit(20).alias("n"), F.lit(7).cast("long").alias("bits"), F.array(F.col("id") % 5, F.col("id") % 7).alias("prefix"))
    path = f"{spark.conf.get('spark.checkpoint.dir')}/line-sets"
    sets.write.mode("overwrite").parquet(path)
    with conf(spark, adaptive_enabled="false", autoBroadcastJoinThreshold="-1"):
        plan = L.earliest_pairs(spark.read.parquet(path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ReusedExchange") == 1
