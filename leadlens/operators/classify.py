"""Model scoring: the scorer hook (P16) and ingest of model replies.

Model serving itself is outside Spark.  ``score_with`` hands batches of
(item, model, prompt) rows to a user-supplied pandas function through
``mapInPandas`` (Arrow batches, one Python worker per task); ``parse_replies``
turns reply text into typed score rows with built-in JSON functions.
"""

from __future__ import annotations

from typing import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fields of a model reply (doc: score, company, city, country, description, who, what, when, reason).
REPLY_FIELDS = ["company", "city", "country", "description", "who", "what", "when", "reason"]
# The score is read as text first: from_json to INT would turn "8" into NULL.
REPLY_SCHEMA = "score string, " + ", ".join(f"`{f}` string" for f in REPLY_FIELDS)
JSON_OBJECT = r"(?s)\{.*\}"
INTEGER = r"^-?[0-9]+$"
SCORE_MIN, SCORE_MAX = 1, 10
#: Tasks that share the items of a limited scoring run.
SCORING_TASKS = 256
SCORE_OUT_SCHEMA = ("item_id long, model string, prompt_version string, reply string")


def parse_replies(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Reply text -> lead_score (1..10 else NULL), lead_* fields, invalid_reason.

    The JSON object is cut out of surrounding chatter first; a malformed
    object parses to NULL (PERMISSIVE).  Integers given as JSON strings
    ("8") are accepted; decimals ("8.5", 8.5) are not.
    """
    r = F.col(raw)
    js = F.regexp_extract(r, JSON_OBJECT, 0)
    obj = F.from_json(F.when(js != "", js), REPLY_SCHEMA, {"mode": "PERMISSIVE"})
    parsed = df.withColumn("_js", js).withColumn("_o", obj)
    txt = F.trim(F.col("_o.score"))
    as_int = F.when(txt.rlike(INTEGER), txt).try_cast("int")
    score = F.when(as_int.between(SCORE_MIN, SCORE_MAX), as_int)
    any_field = F.lit(False)
    for f in ["score"] + REPLY_FIELDS:
        any_field = any_field | F.col(f"_o.`{f}`").isNotNull()
    valid_obj = F.col("_o").isNotNull() & any_field
    reason = (F.when(r.isNull(), F.lit("no_reply"))
              .when(F.col("_js") == "", F.lit("no_json"))
              .when(~F.coalesce(valid_obj, F.lit(False)), F.lit("bad_json"))
              .when(txt.isNull(), F.lit("missing_score"))
              .when(as_int.isNull(), F.lit("not_integer"))
              .when(score.isNull(), F.lit("out_of_range")))
    out = parsed.withColumn("lead_score", score).withColumn("invalid_reason", reason)
    for f in REPLY_FIELDS:
        out = out.withColumn(f"lead_{f}", F.col(f"_o.`{f}`"))
    return out.drop("_js", "_o")


def reply_text(score: Column, fields: dict[str, Column], score_as_text: Column | None = None) -> Column:
    """Build a reply as a chatty model would send it (used to round-trip stored scores)."""
    sc = score if score_as_text is None else F.when(score_as_text, score.cast("string")).otherwise(score)
    body = F.to_json(F.struct(sc.alias("score"), *[c.alias(k) for k, c in fields.items()]))
    return F.concat(F.lit("Sure, here is my assessment:\n"), body, F.lit("\nLet me know if you need more."))


def score_with(items: DataFrame, scorer: Callable[[pd.DataFrame], pd.DataFrame], model: str,
               prompt_version: str, limit: int | None = None) -> DataFrame:
    """Run ``scorer`` over ready items; returns (item_id, model, prompt_version, reply).

    ``scorer`` gets a pandas frame (item_id, title, clean_text) and returns
    one with (item_id, reply).  Filters stay ahead of the Python stage
    (Catalyst does not move them past ``mapInPandas``); ``limit`` takes the
    first N items by item_id, deterministically.
    """
    src = items.select("item_id", "title", "clean_text")
    if limit is not None:
        # the limit leaves one partition: spread its rows again, so scoring runs in many tasks
        src = src.orderBy("item_id").limit(limit).repartition(max(1, min(limit, SCORING_TASKS)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b) == 0:
                continue
            out = scorer(b[["item_id", "title", "clean_text"]])
            yield pd.DataFrame({"item_id": out["item_id"].astype("int64"), "model": model,
                                "prompt_version": prompt_version, "reply": out["reply"].astype(object)})

    return src.mapInPandas(run, SCORE_OUT_SCHEMA)
