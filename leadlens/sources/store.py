"""Stored tables that grow by what changes: versioned folders with a manifest, and bucketed copies.

``Versions`` keeps a table as Parquet folders under ``{root}/data/v=<version>/...`` and, for each
version, a manifest that names the folders which make up the table.  A manifest is written after all data
of its version, so a reader follows the newest whole one; what a failed or repeated run leaves behind is in
no manifest and is never read.  Folders that a change does not touch are named again and not written.

* ``ScoreStore`` (M1 / W7): score rows in folders by prompt version and bucket of item_id; an upsert
  reads, merges and writes only the folders that the incoming rows fall in.
* ``UrlStore`` (M4): url rows with their normalised url and its hash stored, in folders by hash prefix; new
  links are looked up by an anti join against the hashes of the prefixes they fall in, and appended.
* ``BucketedCatalog`` (J1-J5, J8): items, scores and labels as tables bucketed and sorted by item_id,
  so that joins and aggregates on item_id need no exchange.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadlens.operators import discover as D
from leadlens.operators import mutate as M
from leadlens.sources.tables import ITEM_SCORES_SCHEMA, URL_STATE_SCHEMA, Catalog

VERSION = "v"


class Versions:
    """The folders that make up a table, version by version; one writer at a time."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, keys: T.StructType):
        """``keys``: the partition columns below the version, all of them also in the manifest."""
        self.spark, self.root, self.keys = spark, root.rstrip("/"), keys
        names = keys.fieldNames()
        self.stored = T.StructType([f for f in schema.fields if f.name not in names]
                                   + [T.StructField(VERSION, T.LongType())] + list(keys.fields))
        self.columns = schema.fieldNames()

    def _fs(self, path: str):
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()), hadoop

    def version(self) -> int | None:
        """The newest version whose manifest is whole."""
        fs, path = self._fs(f"{self.root}/manifest")
        if not fs.exists(path):
            return None
        names = [s.getPath() for s in fs.listStatus(path)]
        whole = [int(p.getName()) for p in names if p.getName().isdigit() and fs.exists(self._fs(f"{p}/_SUCCESS")[1])]
        return max(whole, default=None)

    def manifest(self, version: int | None = None) -> DataFrame:
        """(v, partition columns, next_id) of a version, by default of the newest one: a row for each live folder."""
        version = self.version() if version is None else version
        schema = T.StructType([T.StructField(VERSION, T.LongType()), *self.keys.fields, T.StructField("next_id", T.LongType())])
        if version is None:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/manifest/{version:012d}")

    def read(self, version: int | None = None) -> DataFrame:
        """The table as of a version, with the partition columns that are its own."""
        return self.within(self.manifest(version).collect()).select(*self.columns)  # a row for each folder

    def within(self, folders: list) -> DataFrame:
        """The rows of some live folders, with all partition columns."""
        if not folders:
            return self.spark.createDataFrame([], self.stored)
        paths = [f"{self.root}/data/{VERSION}={f[VERSION]}/" + "/".join(f"{k}={_folder(f[k])}" for k in self.keys.fieldNames()) for f in folders]
        return self.spark.read.schema(self.stored).option("basePath", f"{self.root}/data").parquet(*paths)

    def publish(self, rows: DataFrame, keep: DataFrame, next_id: int = 0) -> int:
        """Write ``rows`` (with the partition columns) as the next version, and its manifest: the folders
        written and those of ``keep``."""
        version = 1 + max([-1, *([] if self.version() is None else [self.version()])])
        names = self.keys.fieldNames()
        path = f"{self.root}/data/{VERSION}={version}"
        # a task a folder; "overwrite" clears what a failed run of this version left
        (rows.select(*[f.name for f in self.stored.fields if f.name != VERSION]).repartition(*names)
         .write.mode("overwrite").partitionBy(*names).parquet(path))
        new = self.spark.read.schema(self.stored).option("basePath", f"{self.root}/data").parquet(path).select(*names).distinct()
        all_ = new.withColumn(VERSION, F.lit(version).cast("long")).unionByName(keep.select(*names, VERSION))
        (all_.select(VERSION, *names, F.lit(next_id).cast("long").alias("next_id")).coalesce(1)
         .write.mode("overwrite").parquet(f"{self.root}/manifest/{version:012d}"))
        return version


def _folder(value) -> str:
    """A partition value as Spark names its folder."""
    if value is None or value == "":
        return "__HIVE_DEFAULT_PARTITION__"
    odd = '"#%\'*/:=?\\{[]^\x7f' + "".join(map(chr, range(1, 32)))
    return "".join(f"%{ord(c):02X}" if c in odd else c for c in str(value))


class ScoreStore(Versions):
    """M1 / W7 as an incremental merge."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64, schema: T.StructType = ITEM_SCORES_SCHEMA):
        keys = T.StructType([T.StructField("prompt_version", T.StringType()), T.StructField("bucket", T.IntegerType())])
        super().__init__(spark, root, schema, keys)
        self.buckets = buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64("item_id"), F.lit(self.buckets)).cast("int")

    def upsert(self, incoming: DataFrame) -> int:
        """Merge rows into the folders they fall in; latest ``classified_at`` wins, as in ``upsert_scores``."""
        rows = incoming.select(*self.columns).withColumn("bucket", self.bucket())
        names = self.keys.fieldNames()
        touched = rows.select(*names).distinct().collect()  # prompt versions x buckets at most
        hit = {tuple(r[n] for n in names) for r in touched}
        old = self.manifest().collect()
        keep = self.manifest().where(F.lit(False)) if not old else self.spark.createDataFrame(
            [r for r in old if tuple(r[n] for n in names) not in hit], self.manifest().schema)
        known = self.within([r for r in old if tuple(r[n] for n in names) in hit]).select(*self.columns)
        return self.publish(M.upsert_scores(known, rows.select(*self.columns)).withColumn("bucket", self.bucket()), keep)


URL_SCHEMA = T.StructType(URL_STATE_SCHEMA.fields + [T.StructField("url_norm", T.StringType()), T.StructField("url_hash", T.StringType())])


class UrlStore(Versions):
    """M4 over a stored hash index: hashes are computed once, when a url is added."""

    def __init__(self, spark: SparkSession, root: str, digits: int = 1):
        """``digits``: hex digits of the hash that name a folder."""
        super().__init__(spark, root, URL_SCHEMA, T.StructType([T.StructField("prefix", T.StringType())]))
        self.digits = digits

    def prefix(self) -> Column:
        """The folder of a hash; urls that are none have no hash and one folder of their own."""
        return F.coalesce(F.substring("url_hash", 1, self.digits), F.lit("none"))

    def load(self, url_state: DataFrame) -> int:
        """Take over a table of known urls."""
        start = url_state.agg(F.coalesce(F.max("url_id"), F.lit(-1)) + 1).first()[0]
        return self.publish(D.with_url_key(url_state).withColumn("prefix", self.prefix()), self.manifest().where(F.lit(False)), start)

    def unknown(self, discovered: DataFrame) -> DataFrame:
        """The discovered links whose hash is not stored, each hash once."""
        found = D.with_url_key(discovered)
        first = (D.dedupe_urls(found, ["discovered_at", "url"], ["url", "url_norm", "source_id", "discovered_at"])
                 .withColumn("prefix", self.prefix()))
        touched = [r[0] for r in first.select("prefix").distinct().collect()]  # 16^digits at most
        known = self.within([r for r in self.manifest().collect() if r["prefix"] in touched]).select("prefix", "url_hash")
        return first.join(known, ["prefix", "url_hash"], "left_anti")

    def upsert(self, discovered: DataFrame) -> int:
        """Append the unknown urls with status 'new' and the next ids, in order of hash."""
        old = self.manifest()
        start = old.agg(F.coalesce(F.max("next_id"), F.lit(0))).first()[0]
        new = M.dense_ids(self.unknown(discovered), "url_hash", F.lit(start), "url_id").withColumn("status", F.lit("new")).checkpoint()
        return self.publish(new, old, start + new.count())

    def compact(self) -> int:
        """One folder a prefix again."""
        start = self.manifest().agg(F.coalesce(F.max("next_id"), F.lit(0))).first()[0]
        return self.publish(self.read().withColumn("prefix", self.prefix()), self.manifest().where(F.lit(False)), start)


class BucketedCatalog(Catalog):
    """The reference tables with items, scores and labels bucketed and sorted by item_id."""

    TABLES = ("items", "item_scores", "lead_labels")

    def __init__(self, source: Catalog, path: str, name: str, buckets: int = 64):
        """Writes the tables below ``path``, a folder that all executors share, as ``{name}_<table>``."""
        super().__init__(source.spark, source.sf_dir, source.derived_dir)
        self.name = name
        for table in self.TABLES:
            writer = (getattr(source, table).repartition(buckets, "item_id").write.mode("overwrite")
                      .bucketBy(buckets, "item_id").sortBy("item_id").option("path", f"{path.rstrip('/')}/{table}"))
            writer.saveAsTable(f"{name}_{table}")

    def _derived(self, name: str) -> DataFrame | None:
        return self.spark.table(f"{self.name}_{name}") if name in self.TABLES else super()._derived(name)

    def drop(self) -> None:
        """Forget the tables; their folders stay."""
        reduce(lambda _, t: self.spark.sql(f"drop table if exists {self.name}_{t}"), self.TABLES, None)
