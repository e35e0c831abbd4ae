"""URL filters over a sorted digest array.

Rules (a host with its subdomains, and a path prefix) are kept as a sorted array of 64-bit xxhash
keys beside their full strings, in one file that every executor maps into memory: workers of a
machine share its pages, whatever its size. A batch of urls makes all keys that could be listed
(each suffix of the host with each path prefix of a length that occurs), finds them by vectorised
binary search, and compares the stored string of each hit, so equal digests of unlike strings
decide nothing. The longest rule that fits wins.

The file is made on the driver from a list of checked size (``MAX_BYTES``); a longer list is joined
as a table instead (``judge_by_join``), on the same keys and with the same result.

Nulls and odd rows: a url that is null or has no ``://`` has an empty host and path and no rule. A
url of any length is read whole. Repeated rows are judged alike; an empty table gives an empty
result; further columns are not read.
"""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlens.llm.common import ship_file, written

#: The largest list that is sent to the executors as a file.
MAX_BYTES = 1 << 30
#: Verdict of a url that no rule fits: what is not listed is let through.
UNLISTED = "allow"


def build(rules: list[tuple[str, str, str]], digest=xxhash.xxh64_intdigest) -> bytes:
    """The file of (verdict, host, path) rules: counts, path lengths, keys, offsets, strings.

    Strings are the verdict's first letter and host + path; a rule given twice keeps its last verdict.
    """
    last = {host + path: verdict for verdict, host, path in rules}
    lengths = sorted({len(path) for _, _, path in rules})
    keyed = sorted((digest(s.encode()), s) for s in last)
    strings = [last[s][0].encode() + s.encode() for _, s in keyed]
    ends = np.cumsum([0, *map(len, strings)], dtype=np.int64)
    out = io.BytesIO()
    out.write(struct.pack("<qq", len(keyed), len(lengths)))
    out.write(np.array(lengths, np.int64).tobytes())
    out.write(np.array([k for k, _ in keyed], np.uint64).tobytes())
    out.write(ends.tobytes())
    out.write(b"".join(strings))
    return out.getvalue()


class Digests:
    """The mapped file."""

    def __init__(self, path: str, digest=xxhash.xxh64_intdigest):
        raw = np.memmap(path, np.uint8, "r")
        n, k = (int(x) for x in raw[:16].view(np.int64))
        at = 16 + 8 * k
        self.lengths = raw[16:at].view(np.int64).tolist()
        self.keys = raw[at:at + 8 * n].view(np.uint64)
        self.ends = raw[at + 8 * n:at + 16 * n + 8].view(np.int64)
        self.strings = raw[at + 16 * n + 8:]
        self.digest = digest

    def find(self, wanted: list[bytes]) -> list[bytes | None]:
        """The verdict letter of each string that is listed."""
        keys = np.fromiter(map(self.digest, wanted), np.uint64, len(wanted))
        at = np.searchsorted(self.keys, keys)
        hit = np.flatnonzero((at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == keys)) if len(self.keys) else []
        out: list[bytes | None] = [None] * len(wanted)
        for i in hit:
            j = int(at[i])
            while j < len(self.keys) and self.keys[j] == keys[i]:  # unlike strings may share a digest
                s = self.strings[self.ends[j]:self.ends[j + 1]].tobytes()
                if s[1:] == wanted[i]:
                    out[i] = s[:1]
                    break
                j += 1
        return out


_OPEN: dict[str, Digests] = {}


def parts(df: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path) of every url: the host up to the first of / ? # with A-Z lower-cased,
    the path up to ? or #."""
    # one part of a url that has no "://" is no host
    rest = F.coalesce(F.regexp_extract(F.col(url_col), r"(?s)^.*?://([^?#]*)", 1), F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    host = F.translate(F.substring_index(rest, "/", 1), upper, upper.lower())
    return df.select(F.col(id_col).alias("page_id"), host.alias("host"),
                     F.substr(rest, F.length(F.substring_index(rest, "/", 1)) + 1).alias("path"))


def judge(df: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url",
          unlisted: str = UNLISTED) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every url."""
    data = build(rules)
    if len(data) > MAX_BYTES:
        raise ValueError("a list over MAX_BYTES belongs in a table: use judge_by_join")
    name = ship_file(df.sparkSession, data, "digests", ".bin")
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _OPEN:
            from pyspark import SparkFiles

            _OPEN[name] = Digests(SparkFiles.get(name))
        listed = _OPEN[name]
        word = {v[:1].encode(): v for v in ("allow", "block")}
        for b in batches:
            if not b.num_rows:
                continue
            wanted: dict[bytes, None] = {}
            options = []
            for host, path in zip(b.column("host").to_pylist(), b.column("path").to_pylist()):
                mine = []
                if host:
                    tails = [host]
                    while "." in tails[-1]:
                        tails.append(tails[-1].split(".", 1)[1])
                    mine = [(t + path[:n]).encode() for t in tails for n in listed.lengths if n <= len(path)]
                    # the longest rule wins; of equal lengths the longer host
                    mine.sort(key=len, reverse=True)
                    wanted.update(dict.fromkeys(mine))
                options.append(mine)
            found = dict(zip(wanted, listed.find(list(wanted))))
            best = [next((m for m in mine if found[m]), None) for mine in options]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([m.decode() if m else None for m in best], pa.string()),
                 pa.array([word[found[m]] if m else unlisted for m in best], pa.string())],
                names=["page_id", "host", "path", "rule", "verdict"])

    return parts(df, id_col, url_col).mapInArrow(run, f"page_id {id_type}, host string, path string, rule string, verdict string")


def judge_by_join(df: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url",
                  unlisted: str = UNLISTED) -> DataFrame:
    """As ``judge``, with the rules (verdict, host, path) as a table of any length."""
    keyed = rules.select(F.concat("host", "path").alias("rule"), "verdict").withColumn("key", F.xxhash64("rule"))
    # the lengths that occur: at most as many as the longest path has characters
    lengths = F.array(*[F.lit(r[0]) for r in rules.select(F.length("path").alias("n")).distinct().orderBy("n").collect()]).cast("array<int>")
    urls = written(parts(df, id_col, url_col).withColumn("row", F.monotonically_increasing_id()), "urls")
    names = F.split("host", r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.size(names)), lambda i: F.array_join(F.slice(names, i, F.size(names)), "."))
    pairs = F.flatten(F.transform(tails, lambda t: F.transform(
        F.filter(lengths, lambda n: n <= F.length("path")), lambda n: F.concat(t, F.substr("path", F.lit(1), n)))))
    asked = urls.select("row", F.explode(F.when(F.col("host") != "", pairs)).alias("rule"))
    asked = asked.withColumn("key", F.xxhash64("rule"))
    best = (asked.join(keyed, ["key", "rule"])
            .groupBy("row").agg(F.max(F.struct(F.length("rule").alias("n"), "rule", "verdict")).alias("best")))
    return urls.join(best, "row", "left").select("page_id", "host", "path", F.col("best.rule").alias("rule"),
                                                 F.coalesce("best.verdict", F.lit(unlisted)).alias("verdict"))
