"""Scalar expressions (X1-X21) as built-in Column expressions.

Everything here compiles to JVM expressions inside whole-stage codegen;
no Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: band and category labels shown by the dashboard ----------
# Activity bands (score >= 9 / >= 7 / >= 5 / else).
BAND_ELITE = "elite (≥9)"
BAND_STRONG = "strong (7-8)"
BAND_CANDIDATE = "candidate (5-6)"
BAND_WEAK = "weak (1-4)"
ACTIVITY_BANDS = [BAND_WEAK, BAND_CANDIDATE, BAND_STRONG, BAND_ELITE]  # stack order
# Classification breakdown (score >= 7 / >= 5 / >= 3 / else) and pre-score categories.
CAT_STRONG = "Strong lead (7-10)"
CAT_POSSIBLE = "Possible lead (5-6)"
CAT_WEAK = "Weak signal (3-4)"
CAT_NOT = "Not a lead (0-2)"
CAT_FILTERED_IRRELEVANT = "Filtered (not relevant)"
CAT_FILTERED_BAD = "Filtered (bad content)"
CAT_PENDING = "Pending"
# Scoring rubric of the documentation (9-10 / 7-8 / 5-6 / 3-4 / 1-2 / 0).
RUBRIC = [(9, "Very strong lead"), (7, "Strong lead"), (5, "Moderate"), (3, "Weak signal"),
          (1, "Not relevant"), (0, "Filtered by keyword pre-filter")]
# Review statuses; 'new' is implicit (never stored by default).
STATUSES = ["new", "confirmed", "follow_up", "contacted", "rejected"]
# Score filter chips of the lead browser.
SCORE_CHOICES = {"All": 1, "≥4": 4, "≥5": 5, "≥7": 7, "≥9": 9}
PLACEHOLDER = "—"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ntz_micros(t) -> Column:
    """Microseconds since 1970-01-01 of a TIMESTAMP_NTZ, independent of the session zone
    (a cast to TIMESTAMP would go through the zone and fold DST gaps)."""
    t = col(t)
    days = F.datediff(F.to_date(t), F.lit("1970-01-01").cast("date")).cast("long")
    secs = F.date_part(F.lit("SECOND"), t)
    return (days * 86_400_000_000 + F.hour(t).cast("long") * 3_600_000_000
            + F.minute(t).cast("long") * 60_000_000 + (secs * 1_000_000).cast("long"))


# X3a
def activity_band(score) -> Column:
    s = col(score)
    return (F.when(s >= 9, BAND_ELITE).when(s >= 7, BAND_STRONG)
            .when(s >= 5, BAND_CANDIDATE).otherwise(BAND_WEAK))


# X3b  (NULL score falls to the ELSE branch)
def breakdown_band(score) -> Column:
    s = col(score)
    return (F.when(s >= 7, CAT_STRONG).when(s >= 5, CAT_POSSIBLE)
            .when(s >= 3, CAT_WEAK).otherwise(CAT_NOT))


# X3c  (NULL score stays NULL)
def rubric_band(score) -> Column:
    s = col(score)
    out = None
    for lo, label in RUBRIC:
        out = F.when(s >= lo, label) if out is None else out.when(s >= lo, label)
    return out


# X3d
def emphasis_level(score) -> Column:
    s = col(score)
    return F.when(s >= 7, "high").when(s >= 5, "mid").otherwise("low")


# X4  (simple CASE; NULL model -> Pending)
def prescore_category(classifier_model) -> Column:
    m = col(classifier_model)
    return (F.when(m == "pre-filter", CAT_FILTERED_IRRELEVANT)
            .when(m == "extract_v2", CAT_FILTERED_BAD).otherwise(CAT_PENDING))


# X2 + default used by the sector chart
def sector_or_unspecified(sector) -> Column:
    return F.coalesce(F.nullif(col(sector), F.lit("")), F.lit("unspecified"))


# F5
def present(c) -> Column:
    c = col(c)
    return c.isNotNull() & (c != "")


# X6  round(avg(x)::numeric, n) for an integer column: exact, half away from zero.
def round_ratio(total, count, n: int) -> Column:
    """round(total / count, n) in integer arithmetic (no double or decimal
    rounding on the way), half away from zero; NULL when count is 0."""
    scale = 10 ** n
    a = F.abs(total).cast("long") * (2 * scale) + count
    b = count * 2
    q = (a - F.pmod(a, b)) / b  # exact integer quotient
    return F.when(count > 0, F.signum(total) * q / scale)


def round_avg(c, n: int) -> Column:
    """Aggregate: round(avg(c), n) as PostgreSQL computes it on numeric."""
    return round_ratio(F.sum(col(c)), F.count(col(c)), n)


# X9
def clip(c, n: int) -> Column:
    return F.substring(col(c), 1, n)


def ellipsize(c, n: int = 36) -> Column:
    c = col(c)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("…"))).otherwise(c)


# X10
def score_percent(score) -> Column:
    return F.least(F.lit(100), col(score) * 10)


# X11
def stars(score) -> Column:
    s = F.least(col(score), F.lit(5))
    return F.concat(F.repeat(F.lit("★"), s), F.repeat(F.lit("☆"), F.greatest(F.lit(0), 5 - s)))


# X12  money text; half-even rounding on the exact decimal value, last branch truncates.
def money_text(v) -> Column:
    d = col(v).cast("decimal(38,6)")
    return (F.when(d.isNull(), F.lit(None).cast("string"))
            .when(d >= 1_000_000_000, F.concat(F.lit("€"), F.bround(d / 1_000_000_000, 1).cast("decimal(38,1)").cast("string"), F.lit("B")))
            .when(d >= 1_000_000, F.concat(F.lit("€"), F.bround(d / 1_000_000, 0).cast("decimal(38,0)").cast("string"), F.lit("M")))
            .when(d >= 1_000, F.concat(F.lit("€"), F.bround(d / 1_000, 0).cast("decimal(38,0)").cast("string"), F.lit("K")))
            .otherwise(F.concat(F.lit("€"), F.format_number(d.cast("long"), 0))))


# X13  relative age from an explicit as_of; dates count whole days.
def age_text(t, as_of, is_date: bool = False) -> Column:
    t = col(t)
    if is_date:
        secs = F.datediff(F.to_date(as_of), t).cast("long") * 86400
    else:
        secs = F.timestamp_diff("SECOND", t, as_of)
    days = F.floor(secs / 86400)
    return (F.when(t.isNull(), F.lit(""))
            .when(secs < 3600, F.concat(F.greatest(F.lit(1), F.floor(secs / 60)).cast("string"), F.lit("m ago")))
            .when(secs < 86400, F.concat(F.floor(secs / 3600).cast("string"), F.lit("h ago")))
            .when(days < 7, F.concat(days.cast("string"), F.lit("d ago")))
            .when(days < 30, F.concat(F.floor(days / 7).cast("string"), F.lit("w ago")))
            .when(days < 365, F.concat(F.floor(days / 30).cast("string"), F.lit("mo ago")))
            .otherwise(F.concat(F.floor(days / 365).cast("string"), F.lit("y ago"))))


def age_text_of_string(s, as_of) -> Column:
    """X13 for text input: ISO text is parsed (a 'Z' or '+hh:mm' suffix is cut
    off); empty or NULL gives ''; text that does not parse comes back unchanged."""
    s = col(s)
    head = F.split(F.replace(s, F.lit("Z"), F.lit("+00:00")), r"\+").getItem(0)
    t = F.try_to_timestamp(head).cast("timestamp_ntz")
    return (F.when(s.isNull() | (s == ""), F.lit(""))
            .when(t.isNull(), s)
            .otherwise(age_text(t, as_of)))


# X15 / W3  period-over-period text; Python round() is half-even -> bround.
def delta_text(cur, prev) -> Column:
    cur, prev = col(cur), col(prev)
    delta = cur - prev
    sign = F.when(delta >= 0, F.lit("+")).otherwise(F.lit(""))
    pct = F.bround(100 * delta / prev, 0).cast("long")
    return F.when(prev > 0, F.concat(sign, pct.cast("string"), F.lit("% vs prev 7d"))) \
            .otherwise(F.concat(sign, delta.cast("string"), F.lit(" vs prev 7d")))


# X16
def display_company(company) -> Column:
    c = col(company)
    return F.when(c.isNull() | c.isin(PLACEHOLDER, ""), F.lit("Unknown")).otherwise(c)


def blank_placeholder(c) -> Column:
    c = col(c)
    return F.when(c.isNull() | (c == PLACEHOLDER), F.lit("")).otherwise(c)


def initial(name) -> Column:
    n = col(name)
    return F.when(n.isNull() | (n == ""), F.lit("?")).otherwise(F.upper(F.substring(n, 1, 1)))


def avatar_bucket(name, buckets: int = 8) -> Column:
    """sum of code points modulo the palette size (8)."""
    n = col(name)
    codes = F.transform(F.split(n, ""), lambda ch: F.ascii(ch))
    total = F.aggregate(codes, F.lit(0).cast("long"), lambda acc, x: acc + x)
    return F.when(n.isNull() | (n == ""), F.lit(None).cast("long")).otherwise(total % buckets)


# X17
def short_stamp(t) -> Column:
    return F.date_format(col(t), "dd.MM HH:mm")


# X20  ampersand first
def html_escape(c) -> Column:
    c = F.coalesce(col(c).cast("string"), F.lit(""))
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")),
                     F.lit(">"), F.lit("&gt;"))


def angle_escape(c) -> Column:
    """Member titles: NULL -> '', then only '<' and '>' are escaped."""
    c = F.coalesce(col(c).cast("string"), F.lit(""))
    return F.replace(F.replace(c, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


# X21
def thousands(n) -> Column:
    return F.format_number(col(n), 0)
