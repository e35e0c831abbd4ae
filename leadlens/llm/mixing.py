"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue in shuffled order; its documents come round at most ``passes`` times. An
item's virtual finish time is the words of its source up to and with it, divided by the source's
target. All items are sorted by finish time and taken while the words taken stay within the budget
(the sum of the targets), so every source comes near its target whenever the list is cut.

The sort is global but no task holds it: words are summed by slot of finish time, the slots' sums
run up in one small table, and only inside a slot are items in order. The same is done inside a
source by slots of its shuffle key, so a source with a third of all rows is many slots.

Nulls and odd rows: a null or empty text has size 0, and such a document is taken with 0 words. A
null source is a source of its own, last. Repeated rows are items of their own, equal in all but
their place in the queue. An empty table
gives an empty result. Further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadlens.llm.common import n_words, written

#: Slots of the whole schedule; a source's shuffled queue has 4,096 (three hex digits).
TIME_SLOTS = 16384
SEED = 20240607


def targets(sizes: DataFrame, weights: tuple = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) of each source, from (source, size) rows.

    Sources in code point order, null last, weigh ``weights`` in turn and share ``share`` of all
    words. A target stops at ``most`` times its source's words; what is over goes to the others by
    weight, until none is above. That level is found at once: sources sorted by the level at which
    they fill up, the first one that the rest can hold.
    """
    by = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    # code points sort as UTF-8 bytes do; one row a source
    key = F.encode(F.col("source"), "UTF-8")
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("source").isNull(), key)) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights)).cast("int") + 1)
    cap = F.col("source_size") * most
    by = by.withColumn("weight", weight).withColumn("fills", cap / F.col("weight"))
    filling = Window.partitionBy(F.lit(0)).orderBy("fills", F.col("source").isNull(), key)
    whole = Window.partitionBy(F.lit(0))
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(whole) * share - F.coalesce(F.sum(cap).over(before), F.lit(0.0))
    level = left / F.sum("weight").over(filling.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    by = by.withColumn("level", level).withColumn("open", F.col("level") <= F.col("fills"))
    level = F.min(F.when(F.col("open"), F.struct("fills", F.col("source").isNull(), key, "level"))).over(whole)["level"]
    target = F.least(cap, F.coalesce(level * F.col("weight"), cap))
    return by.select("source", "source_size", target.cast("double").alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple = (3, 1, 2), share: float = 1.5, passes: int = 2) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every document; ``taken`` counts repeats."""
    # numbered once and written: rows that repeat stay apart
    rows = written(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"),
                               F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size")), "mix_sizes")
    goal = targets(rows, weights, share, float(passes))
    # the shuffled order: by md5, which any engine can repeat; its first digits are the slot
    key = F.md5(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = rows.withColumn("key", key).withColumn("slot", F.substring("key", 1, 3))
    # words of the source in earlier slots
    sums = rows.groupBy("source", "slot").agg(F.sum("size").alias("words"))
    sums = sums.withColumn("before", F.coalesce(F.sum("words").over(
        Window.partitionBy("source").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    heads = _with_goal(sums, goal)
    inside = Window.partitionBy("source", "slot").orderBy("key", "doc_id", "size", "row").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    named = heads.select(F.col("source").alias("source_"), F.col("slot").alias("slot_"), "before", "source_size", "target")
    items = (rows.withColumn("upto", F.sum("size").over(inside))
             .join(named, F.col("source").eqNullSafe(F.col("source_")) & (F.col("slot") == F.col("slot_")))
             .select("row", "doc_id", "source", "key", "size", "source_size", "target",
                     (F.col("before") + F.col("upto")).alias("upto")))
    items = items.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))))
    finish = F.when(F.col("target") > 0, (F.col("pass") * F.col("source_size") + F.col("upto")) / F.col("target"))
    items = items.withColumn("finish", F.coalesce(finish, F.lit(0.0)))
    # slots of all finish times from 0 on, finest where the budget can cut, around 1
    items = items.withColumn("at", F.floor(F.col("finish") / (1 + F.col("finish")) * TIME_SLOTS).cast("int"))
    items = written(items, "mix_items")
    times = items.groupBy("at").agg(F.sum("size").alias("words"))
    times = times.withColumn("earlier", F.coalesce(F.sum("words").over(
        Window.partitionBy(F.lit(0)).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    budget = goal.agg(F.round(F.sum("target"), 3)).scalar()
    # slots that fit are taken whole; the one that the budget cuts is summed item by item
    times = times.withColumn("budget", budget).select(
        "at", "earlier", F.when(F.col("earlier") + F.col("words") <= F.col("budget"), 1)
        .when(F.col("earlier") >= F.col("budget"), 0).alias("all"), "budget")
    items = items.join(times, "at")
    cut = items.where(F.col("all").isNull())
    order = Window.partitionBy("at").orderBy("finish", "key", "source", "doc_id", "pass", "size", "row").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    cut = cut.withColumn("all", (F.col("earlier") + F.sum("size").over(order) <= F.col("budget")).cast("int"))
    both = items.where(F.col("all").isNotNull()).unionByName(cut)
    return (both.groupBy("row", "doc_id", "size", "source_size", "target")
            .agg(F.sum(F.col("size") * F.col("all")).cast("long").alias("taken"), F.sum("all").cast("int").alias("times"))
            .select("doc_id", "size", "source_size", "target", "taken", "times"))


def _with_goal(sums: DataFrame, goal: DataFrame) -> DataFrame:
    goal = goal.select(F.col("source").alias("goal_source"), "source_size", "target")
    return sums.join(goal, F.col("source").eqNullSafe(F.col("goal_source"))).drop("goal_source")
