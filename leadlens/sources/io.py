"""Sources S1-S8: database, parameterised SQL, CSV restore, registry, gold import, payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadlens.operators import discover as D
from leadlens.sources.tables import SCHEMAS


def read_jdbc(spark: SparkSession, url: str, table: str, partition_column: str | None = None,
              lower: int | None = None, upper: int | None = None, num_partitions: int = 8,
              properties: dict | None = None) -> DataFrame:
    """A table of a live database, split into ``num_partitions`` range reads."""
    props = dict(properties or {})
    if partition_column is None:
        return spark.read.jdbc(url, table, properties=props)
    return spark.read.jdbc(url, table, column=partition_column, lowerBound=lower, upperBound=upper,
                           numPartitions=num_partitions, properties=props)


def run_sql(spark: SparkSession, sql: str, args: dict | None = None, **frames: DataFrame) -> DataFrame:
    """A parameterised query; named ``:params`` and ``{frame}`` references.

    Errors propagate (the dashboard swallowed them and showed nothing).
    """
    return spark.sql(sql, args=args or None, **frames)


def table_exists(spark: SparkSession, name: str) -> bool:
    """S4."""
    return spark.catalog.tableExists(name)


def read_table_csv(spark: SparkSession, path: str, name: str, null_value: str = "\\N") -> DataFrame:
    """A table exported as CSV with header, read back with its explicit schema.

    Article text holds newlines and quotes, hence multiLine and '"' escapes;
    whitespace is kept and NULL is the ``\\N`` marker of our snapshots
    (pass ``null_value=""`` for files where an empty field means NULL).
    """
    from leadlens.operators.sinks import CSV_OPTIONS

    return (spark.read.schema(SCHEMAS[name]).options(**CSV_OPTIONS).option("multiLine", True)
            .option("nullValue", null_value).option("mode", "FAILFAST").csv(path))


def restore_gold(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """M5 with S5: sources, items, labels from a K5 snapshot; scores start empty."""
    out = {n: read_table_csv(spark, f"{folder}/{n}", n) for n in ("sources", "items", "lead_labels")}
    out["item_scores"] = spark.createDataFrame([], SCHEMAS["item_scores"])
    return out


def source_registry(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """The source registry kept as a table (source_id, kind, url, active)."""
    return spark.read.schema(SCHEMAS["sources"]).format(fmt).load(path)


def gold_import(rows: DataFrame, as_of) -> tuple[DataFrame, DataFrame]:
    """Rows of (url, title, clean_text, source_id, label) -> (items, lead_labels).

    URLs are normalised and hashed; one item per hash (first by url); the
    item id is derived from the hash prefix so re-imports are stable.
    """
    k = D.with_url_key(rows).where(F.col("url_hash").isNotNull())
    first = D.dedupe_urls(k, ["url"], ["url", "title", "clean_text", "source_id", "label"])
    item_id = F.conv(F.substring("url_hash", 1, 15), 16, 10).cast("long")
    items = first.select(item_id.alias("item_id"), "source_id", "url", "title", "clean_text",
                         F.lit(as_of).cast("timestamp_ntz").alias("created_at"), "url_hash")
    labels = first.where(F.col("label").isNotNull()).select(
        item_id.alias("item_id"), "label", F.lit("crm").alias("labeled_by"),
        F.lit(as_of).cast("timestamp_ntz").alias("labeled_at"))
    return items, labels


def landing_payloads(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """Raw fetched payloads from a landing folder, one row per file."""
    df = spark.read.text(folder, wholetext=True)
    return df.select(F.input_file_name().alias("path"), F.lit(kind).alias("kind"), F.col("value").alias("body"))
