"""Text extraction and filtering (P7-P14) as built-in Column expressions.

HTML is handled with bounded, lazy regular expressions (no HTML parser is
available to Spark executors, and none is needed for these rules).  The
patterns are shared with the DuckDB twins and avoid back-references and
look-around, so both engines read them the same way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlens.functions import html as H
from leadlens.session import ensure_checkpoint_dir

# ---- fixed patterns ---------------------------------------------------------------------
NOISE = r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->"
# A paragraph runs from its start tag to its end tag, the next paragraph, a block's edge or the end
# of the text: the end tag is optional in HTML, and cut-off pages have none.
PARAGRAPH_START = r"(?i)<p(?:\s[^>]*)?>"
PARAGRAPH_END = (r"(?i)</p\s*>|</?(?:address|article|aside|blockquote|body|details|div|dl|fieldset|figure|footer|form|h[1-6]|"
                 r"header|hr|html|main|nav|ol|pre|section|table|ul)(?:\s[^>]*)?/?>")
TAG = r"<[^>]+>"
SPACES = r"\s+"
JSON_LD_TYPE = "application/ld+json"
ARTICLE = r"(?is)<article\b[^>]*>(.*?)</article>"
MAIN = r"(?is)<main\b[^>]*>(.*?)</main>"
BODY = r"(?is)<body\b[^>]*>(.*)"
BOILERPLATE = (r"(?is)<nav\b.*?</nav>|<footer\b.*?</footer>|<aside\b.*?</aside>|<form\b.*?</form>"
               r'|<div[^>]*class="(?:ad|ads|advert|advertisement)"[^>]*>.*?</div>')
H1 = r"(?is)<h1\b[^>]*>(.*?)</h1>"
TITLE = r"(?is)<title\b[^>]*>(.*?)</title>"
#: Bits of the keyword filter for each keyword, and its 64-bit words at most (16 MB); a fuller one lets more n-grams into the join.
FILTER_SHARE, FILTER_WORDS = 32, 1 << 21
MIN_TEXT = 100  # an extraction method counts when its text is longer than this

# Garbage rules (P12), first match wins: (reason, column, pattern).  Ours:
# the reference names the classes (PDF, captcha, login, too short) only.
GARBAGE_RULES = [
    ("pdf", "url", r"(?i)\.pdf([?#].*)?$"),
    ("captcha", "clean_text", r"(?i)captcha|are you a robot|verify (that )?you are (a )?human"),
    ("login", "clean_text", r"(?i)(log ?in|sign ?in) (to continue|to read|required)|please (log|sign) ?in|bitte (melden sie sich an|einloggen)"),
]

# Keyword pre-filter (P14), ours: the reference's list is not published.
# Lower-case; matched as whole words in lower-cased text.
KEYWORDS = [
    "rail", "railway", "freight", "cargo", "logistics", "terminal", "warehouse", "plant", "factory",
    "production", "investment", "steel", "chemical", "chemicals", "automotive", "timber", "container",
    "intermodal", "siding", "port", "bahn", "güterverkehr", "fracht", "logistik", "werk", "fabrik",
    "standort", "lager", "anschlussgleis", "investition", "stahl", "chemie", "holz",
]
WORD_LEFT = r"(^|[^\p{L}\p{N}_])"
WORD_RIGHT = r"([^\p{L}\p{N}_]|$)"


def keyword_pattern(words) -> str:
    return WORD_LEFT + "(" + "|".join(words) + ")" + WORD_RIGHT


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text_of(fragment) -> Column:
    """Tags -> space, character references decoded, whitespace collapsed, trimmed."""
    t = F.regexp_replace(_c(fragment), TAG, " ")
    return F.trim(F.regexp_replace(H.unescape(t), SPACES, " "))


def strip_noise(html) -> Column:
    return F.regexp_replace(_c(html), NOISE, "")


def _nonempty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


# ---- P7 ---------------------------------------------------------------------------------
def json_ld_blocks(html) -> Column:
    """The contents of a page's JSON-LD scripts, in order."""
    scripts = F.filter(H.tags(html), lambda t: (t["name"] == "script") & (F.lower(F.trim(H.attribute(t["head"], "type"))) == JSON_LD_TYPE))
    return F.transform(scripts, lambda t: t["content"])


def json_ld_nodes(blocks) -> Column:
    """The nodes of JSON-LD blocks as VARIANTs: an object, the elements of a list, and what either holds
    under ``@graph``.  Blocks that are no JSON have none."""
    def nodes(js: Column) -> Column:
        v = F.try_parse_json(js)
        top = F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array(v))
        return F.flatten(F.transform(top, lambda t: F.concat(F.array(t), F.coalesce(F.try_variant_get(t, "$['@graph']", "array<variant>"), F.array().cast("array<variant>")))))

    return F.flatten(F.transform(_c(blocks), nodes))


def json_ld_field(html, field: str) -> Column:
    """``field`` of the first JSON-LD node that has it as a text or number; NULL without one."""
    found = F.transform(json_ld_nodes(json_ld_blocks(html)), lambda n: F.try_variant_get(n, f"$.{field}", "string"))
    return F.get(F.filter(found, lambda x: x.isNotNull()), F.lit(0))


# ---- P8 ---------------------------------------------------------------------------------
def paragraph_text(html) -> Column:
    """Text of every ``<p>`` outside script/style/comments, one per line, closed or not."""
    parts = F.split(strip_noise(html), PARAGRAPH_START)
    starts = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))  # what comes before the first is no paragraph
    texts = F.transform(starts, lambda p: text_of(F.get(F.split(p, PARAGRAPH_END, 2), F.lit(0))))
    return F.array_join(F.filter(texts, lambda t: t != ""), "\n")


# ---- P9 ---------------------------------------------------------------------------------
# Block boundaries and links for the main-content ranking.
BLOCK_SPLIT = r"(?i)</p>|</div>|</section>|</li>|</h[1-6]>|<br\s*/?>|</td>|</tr>|</blockquote>"
LINK = r"(?is)<a\b[^>]*>(.*?)</a>"
BLOCK_SHARE = 10  # keep blocks scoring at least 1/BLOCK_SHARE of the best block


def _scoped(h) -> Column:
    """Noise-stripped html -> the first article/main/body, boilerplate blocks blanked."""
    h = _c(h)
    scope = F.coalesce(_nonempty(F.regexp_extract(h, ARTICLE, 1)), _nonempty(F.regexp_extract(h, MAIN, 1)),
                       _nonempty(F.regexp_extract(h, BODY, 1)), h)
    return F.regexp_replace(scope, BOILERPLATE, " ")


def _blocks(cleaned) -> Column:
    """Scoped html -> array<struct<t: text, s: score>>, each block's text computed once."""
    raw = F.transform(F.split(_c(cleaned), BLOCK_SPLIT), lambda b: F.struct(
        text_of(b).alias("t"), text_of(F.array_join(F.regexp_extract_all(b, F.lit(LINK), 1), " ")).alias("l")))
    return F.transform(raw, lambda x: F.struct(x["t"].alias("t"), (F.length(x["t"]) - F.length(x["l"])).alias("s")))


def main_blocks(html) -> Column:
    """P9, step 1: scoped, cleaned blocks as array<struct<t: text, s: score>>.

    score = text length x (1 - link density) = text length - link-text length.
    """
    return _blocks(_scoped(strip_noise(html)))


def main_from_blocks(blocks) -> Column:
    """P9, step 2: keep blocks scoring > 0 and at least 1/10 of the best, one per line.

    The best score enters the per-block test as an array (array_repeat), so
    no lambda re-evaluates the whole block list per element.
    """
    blocks = _c(blocks)
    scores = F.transform(blocks, lambda x: x["s"])
    best = F.array_repeat(F.array_max(scores), F.size(scores))
    keep = F.zip_with(scores, best, lambda sc, b: (sc > 0) & (sc * BLOCK_SHARE >= b))
    texts = F.zip_with(F.transform(blocks, lambda x: x["t"]), keep, lambda t, k: F.when(k, t))
    return F.array_join(texts, "\n")


def main_text(html) -> Column:
    """A simplified readability stand-in.

    Scope to the first ``<article>``, else ``<main>``, else ``<body>``; drop
    nav/footer/aside/form blocks and ad divs; split into blocks at block-level
    closing tags; score each block by text length x (1 - link density), i.e.
    text length minus link-text length; keep the blocks scoring at least a
    tenth of the best one, in document order, one per line.  On a DataFrame
    prefer ``with_main_text``, which computes the blocks in their own step.
    """
    return main_from_blocks(main_blocks(html))


def with_main_text(df: DataFrame, html: str = "html", out: str = "main_text", when: Column | None = None) -> DataFrame:
    """P9 in stages: noise stripped once (the scope tests read it four times), then
    blocks once per row, then selection; rows failing the optional guard get NULL."""
    h = strip_noise(html)
    df = df.withColumn("_main_h", h if when is None else F.when(when, h))
    df = df.withColumn("_main_blocks", _blocks(_scoped("_main_h")))
    return df.withColumn(out, main_from_blocks("_main_blocks")).drop("_main_h", "_main_blocks")


# ---- P10 / P11 ---------------------------------------------------------------------------
def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """P10: first method whose text is longer than 100 characters.

    Adds clean_text, extract_method ('json_ld' | 'paragraphs' | 'main' |
    NULL) and title (P11: h1, else <title>, else JSON-LD headline).
    """
    h = _c(html)
    cand = [("json_ld", json_ld_field(h, "articleBody")), ("paragraphs", paragraph_text(h)), ("main", None)]
    # each method runs only when the earlier ones came up short (CASE branches are lazy)
    df = pages
    failed = F.lit(True)
    for n, c in cand:
        if n == "main":
            df = with_main_text(df, html, f"_x_{n}", when=failed)
        else:
            df = df.withColumn(f"_x_{n}", F.when(failed, c))
        failed = failed & ~F.coalesce(F.length(F.col(f"_x_{n}")) > MIN_TEXT, F.lit(False))
    long_enough = [(n, F.length(F.col(f"_x_{n}")) > MIN_TEXT) for n, _ in cand]
    text = F.coalesce(*[F.when(ok, F.col(f"_x_{n}")) for n, ok in long_enough])
    method = F.coalesce(*[F.when(ok, F.lit(n)) for n, ok in long_enough])
    title = F.coalesce(_nonempty(text_of(F.regexp_extract(h, H1, 1))),
                       _nonempty(text_of(F.regexp_extract(h, TITLE, 1))),
                       _nonempty(F.trim(json_ld_field(h, "headline"))))
    return (df.withColumn("clean_text", text).withColumn("extract_method", method)
            .withColumn("title", title).drop(*[f"_x_{n}" for n, _ in cand]))


# ---- P12 / P13 ---------------------------------------------------------------------------
def garbage_reason(url="url", text="clean_text", rules=GARBAGE_RULES, min_len: int = MIN_TEXT) -> Column:
    """First matching rule name, 'too_short' for text of <= 100 chars, else NULL."""
    cols = {"url": _c(url), "clean_text": _c(text)}
    out = None
    for name, c, pat in rules:
        cond = F.coalesce(cols[c].rlike(pat), F.lit(False))
        out = F.when(cond, F.lit(name)) if out is None else out.when(cond, F.lit(name))
    short = F.coalesce(F.length(cols["clean_text"]), F.lit(0)) <= min_len
    return out.when(short, F.lit("too_short"))


def flag_garbage(items: DataFrame) -> DataFrame:
    """P12 applied: reject_reason, and classifier_model 'extract_v2' for rejects."""
    r = garbage_reason()
    return (items.withColumn("reject_reason", r)
            .withColumn("classifier_model",
                        F.when(F.col("reject_reason").isNotNull(), F.lit("extract_v2"))
                        .otherwise(F.col("classifier_model"))))


def ready_for_scoring(items: DataFrame, min_len: int = MIN_TEXT) -> DataFrame:
    """Text present, longer than 100 characters, no item-level score yet."""
    return items.where(F.col("clean_text").isNotNull() & (F.length("clean_text") > min_len)
                       & F.col("lead_score").isNull())


# ---- P14 ---------------------------------------------------------------------------------
WORD_SPLIT = r"[^\p{L}\p{N}_]+"


def _is_word(w: str) -> bool:
    return all(ch.isalnum() or ch == "_" for ch in w)


def keyword_matches(text, words=KEYWORDS) -> Column:
    """Keywords found as whole words, in list order.

    Single words are looked up in the text's token array (one split per
    text, hash-set intersection) instead of one regex scan per keyword;
    phrases fall back to a whole-word regex.
    """
    low = F.lower(_c(text))
    tokens = F.split(low, WORD_SPLIT)
    if all(_is_word(w) for w in words):
        return F.array_intersect(F.array(*[F.lit(w) for w in words]), tokens)
    hits = [F.when(F.array_contains(tokens, w), F.lit(w)) if _is_word(w)
            else F.when(low.rlike(keyword_pattern([w])), F.lit(w)) for w in words]
    return F.filter(F.array(*hits), lambda x: x.isNotNull())


def prefilter(items: DataFrame, text: str = "clean_text", words=KEYWORDS) -> DataFrame:
    """Keyword pre-filter; rejects get score 0 and classifier_model 'pre-filter'."""
    matched = keyword_matches(text, words)
    out = items.withColumn("matched_keywords", F.coalesce(matched, F.array().cast("array<string>")))
    passed = F.size("matched_keywords") > 0
    return (out.withColumn("prefilter_pass", passed)
            .select(*items.columns, "prefilter_pass", "matched_keywords")
            .withColumn("lead_score", F.when(~F.col("prefilter_pass"), F.lit(0)).otherwise(F.col("lead_score")))
            .withColumn("classifier_model",
                        F.when(~F.col("prefilter_pass"), F.lit("pre-filter")).otherwise(F.col("classifier_model"))))


def keyword_hits(items: DataFrame, keywords: DataFrame, id_col: str = "item_id", text: str = "clean_text") -> DataFrame:
    """(id, keyword): the keywords of a table (column ``keyword``), words or phrases, that each text holds.

    A keyword is matched by its words in lower case, whatever stands between them.  Each text gives its
    distinct word n-grams, for the lengths that occur in the table only, and these are joined with the table:
    Spark broadcasts it below the session's bound and shuffles above, so a table may be of any length.
    Keywords without words match nothing; keywords that are equal in words each match.

    Most n-grams are no keyword, and a bit table of the keywords' hashes lets only those go into the join
    that are keywords, or share a bit with one (``filter_bits``); the join remains exact.
    """
    ensure_checkpoint_dir(items.sparkSession)
    words = F.array_remove(F.split(F.lower("keyword"), WORD_SPLIT), "")
    table = (keywords.select("keyword", words.alias("w")).where(F.size("w") > 0)
             .select("keyword", F.size("w").alias("n"), F.array_join("w", " ").alias("gram")).distinct().checkpoint())
    held_by_length = {r["n"]: r["c"] for r in table.groupBy("n").agg(F.count(F.lit(1)).alias("c")).collect()}  # phrase lengths: a few numbers
    tokens = F.array_remove(F.split(F.lower(_c(text)), WORD_SPLIT), "")
    held = items.select(id_col, tokens.alias("t")).where(F.size("t") > 0)

    def grams(n: int) -> Column:
        m = F.greatest(F.size("t") - (n - 1), F.lit(0))
        zipped = F.arrays_zip(*(F.slice("t", k + 1, m) for k in range(n)))  # no lambda names a column outside it
        return F.transform(zipped, lambda z: F.concat_ws(" ", *(z[str(k)] for k in range(n))))

    every = F.array_distinct(F.concat(F.array().cast("array<string>"), *map(grams, sorted(held_by_length))))
    size = filter_size(sum(held_by_length.values()))
    word, bit = _filter_place("gram", size)
    likely = held.select(id_col, F.explode(every).alias("gram")).where(
        F.getbit(F.get(filter_bits(table, size).scalar(), word), bit) == 1)
    return likely.join(table, "gram").select(id_col, "keyword")


def filter_size(n: int) -> int:
    """64-bit words of the bit table for n keywords: FILTER_SHARE bits each, rounded up to a power of two, within bounds."""
    return min(max(1 << (n * FILTER_SHARE // 64).bit_length(), 1), FILTER_WORDS)


def _filter_place(gram: str, size: int) -> tuple[Column, Column]:
    """The word, from 0, and the bit in it that stand for a gram in a table of ``size`` words."""
    h = F.xxhash64(gram)
    return F.pmod(h, F.lit(size)).cast("int"), F.shiftrightunsigned(h, 58).cast("int")


def filter_bits(table: DataFrame, size: int) -> DataFrame:
    """One row with an array of ``size`` longs, in which each gram of ``table`` has its bit set."""
    word, bit = _filter_place("gram", size)
    seen = table.groupBy(word.cast("long").alias("id")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("b"))
    dense = table.sparkSession.range(size).join(seen, "id", "left").select(F.struct("id", F.coalesce("b", F.lit(0).cast("long")).alias("b")).alias("w"))
    return dense.agg(F.transform(F.sort_array(F.collect_list("w")), lambda w: w["b"]).alias("bits"))


def prefilter_by_table(items: DataFrame, keywords: DataFrame, id_col: str = "item_id", text: str = "clean_text") -> DataFrame:
    """P14 with a keyword table: adds ``matched_keywords`` (sorted) and ``prefilter_pass``, and marks rejects as ``prefilter`` does."""
    found = keyword_hits(items, keywords, id_col, text).groupBy(id_col).agg(F.sort_array(F.collect_set("keyword")).alias("matched_keywords"))
    out = items.drop("prefilter_pass", "matched_keywords").join(found, id_col, "left")
    passed = F.col("matched_keywords").isNotNull()
    return (out.withColumn("prefilter_pass", passed)
            .withColumn("lead_score", F.when(~passed, F.lit(0)).otherwise(F.col("lead_score")))
            .withColumn("classifier_model", F.when(~passed, F.lit("pre-filter")).otherwise(F.col("classifier_model")))
            .withColumn("matched_keywords", F.coalesce("matched_keywords", F.array().cast("array<string>"))))
