"""F3 over an index: trigrams of company, title and sector, and items laid out by ranges of item_id.

``build`` writes two tables: ``grams`` (gram, item_id), in folders by hash of the gram and sorted by it, and
``items`` in folders of ``RANGE`` ids.  A search text is cut into literals at its wildcards ``%`` and ``_``;
the trigrams of the literals name the folders of ``grams`` that are read, and an item that may match has all
of them.  Those items prune the folders of ``items`` (a join on the range, which Spark turns into dynamic
partition pruning) and the score rows; what is left is tested with ``ilike`` as before, so the result is that
of the full scan.  A search text without a literal of three characters, or with an escape, is not
narrowed.
"""

from __future__ import annotations

import re
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FOLDERS, RANGE = 64, 1000


def trigrams_of(search: str) -> list[str] | None:
    """The trigrams that a match holds; None where the text cannot be narrowed."""
    if "\\" in search:
        return None
    found = {part[i:i + 3] for part in re.split("[%_]", search.lower()) for i in range(len(part) - 2)}
    return sorted(found) or None


def folder_of(gram: str) -> int:
    return zlib.crc32(gram.encode()) % FOLDERS


class SearchIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def build(self, items: DataFrame, item_scores: DataFrame) -> "SearchIndex":
        """Write both tables; titles and sectors are read from the written items, without their texts."""
        (items.withColumn("range", F.floor(F.col("item_id") / RANGE).cast("long")).repartition("range").sortWithinPartitions("range", "item_id")
         .write.mode("overwrite").partitionBy("range").parquet(f"{self.path}/items"))
        held = self.spark.read.schema(items.select("item_id", "title", "sector").schema).parquet(f"{self.path}/items")
        texts = (held.select("item_id", F.explode(F.array("title", "sector")).alias("text"))
                 .unionByName(item_scores.select("item_id", F.col("lead_company").alias("text")))
                 .where("text is not null").select("item_id", F.lower("text").alias("text")).distinct())
        # a text's distinct trigrams, then one shuffle by folder, in which those of several texts of an item meet
        cut = F.transform(F.sequence(F.lit(1), F.length("text") - 2), lambda at: F.substring(F.col("text"), at, F.lit(3)))
        grams = texts.where(F.length("text") >= 3).select("item_id", F.explode(F.array_distinct(cut)).alias("gram"))
        folder = F.pmod(F.crc32(F.col("gram").cast("binary")), F.lit(FOLDERS)).cast("int")
        (grams.withColumn("folder", folder).repartition("folder").dropDuplicates(["folder", "gram", "item_id"])
         .select("gram", "item_id", "folder").sortWithinPartitions("folder", "gram", "item_id")
         .write.mode("overwrite").partitionBy("folder").parquet(f"{self.path}/grams"))
        return self

    def candidates(self, search: str | None) -> DataFrame | None:
        """(range, item_id) of the items that hold all trigrams of the search text; None for all items."""
        grams = trigrams_of(search) if search else None
        if grams is None:
            return None
        rows = self.spark.read.schema("gram string, item_id long, folder int").parquet(f"{self.path}/grams")
        rows = rows.where(F.col("folder").isin(sorted({folder_of(g) for g in grams})) & F.col("gram").isin(grams))
        found = rows.groupBy("item_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(grams))
        return found.select(F.floor(F.col("item_id") / RANGE).cast("long").alias("range"), "item_id")

    def narrowed(self, search: str | None) -> tuple[DataFrame, DataFrame | None]:
        """The items that may match, from pruned folders, and their ids (None for all)."""
        items = self.spark.read.parquet(f"{self.path}/items")
        ids = self.candidates(search)
        if ids is not None:
            items = items.join(ids, ["range", "item_id"], "left_semi")
        return items.drop("range"), None if ids is None else ids.select("item_id")
