"""URL filters on a sorted digest array: 64-bit xxhash keys in a memory-mapped file, probed by binary search.

A rule or list entry is a host and a path prefix. The entries' strings are hashed, sorted by digest and written as one
file, which Spark hands to every executor; tasks map it and look up all keys that a batch of URLs could match in one
vectorised search. A digest that is found counts only if the stored string is the key itself.

Edge cases: a URL that is null or has no `://` has an empty host and path and matches nothing; an empty path matches no
rule, as rules' paths begin with a slash; of several fitting entries the longest string wins, ties cannot occur; an
entry given both as allow and block counts as block; an entry without a slash is its whole host, a null or empty one is
passed over; an empty list allows everything. Columns named like an output are
replaced by it; all other columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloom.llm.common import fresh, quoted, shared_path

#: Largest list that is handed to every executor as a file.
MAX_BYTES = 1 << 30
#: The rules of the task: fixed values.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
#: Hosts the filter itself blocks where no rule fits.
BLOCKED_HOSTS = ("spam-farm.example.com", "spam-farm.example.net", "spam-farm.example.org", "cheap-pills.example.com", "cheap-pills.example.net", "cheap-pills.example.org")


def after_scheme(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, url.substr(at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(after_scheme(url), r"^([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def listed(entries: DataFrame) -> DataFrame:
    """(key, block, rule) of the distinct entries; a key without a slash is a whole host, a null or empty one is nothing."""
    whole = F.when(F.contains("key", F.lit("/")), F.col("key")).otherwise(F.concat("key", F.lit("/")))
    rows = entries.filter("key <> ''").select(whole.alias("key"), "verdict", "rule")
    return rows.groupBy("key").agg(F.max(F.col("verdict") == "block").alias("block"), F.max("rule").alias("rule"))


def build(spark: SparkSession, entries: DataFrame) -> tuple[str, list[int]]:
    """Write the digest array of `entries` (key, verdict, rule boolean); returns the file's name and the path lengths.

    File: count, sorted digests, ends of the strings, verdict bytes, then the strings. The list is a filter's
    configuration; beyond `MAX_BYTES` it is refused, and `judge_by_join` is the way for such lists.
    """
    one = listed(entries)
    size = one.agg(F.coalesce(F.sum(F.octet_length("key") + 17), F.lit(0))).first()[0]
    if size > MAX_BYTES:
        raise ValueError(f"the list takes {size} bytes; use judge_by_join")
    rows = one.toArrow().to_pylist()
    keyed = sorted((xxhash.xxh64_intdigest(r["key"].encode()), r["key"].encode(), r["block"] + 2 * r["rule"]) for r in rows)
    digests = np.array([d for d, *_ in keyed], dtype="<u8")
    ends = np.cumsum([len(k) for _, k, _ in keyed], dtype="<u8") if keyed else np.zeros(0, "<u8")
    verdicts = np.array([v for *_, v in keyed], dtype=np.uint8)
    blob = np.array([len(keyed)], "<u8").tobytes() + digests.tobytes() + ends.tobytes() + verdicts.tobytes() + b"".join(k for _, k, _ in keyed)
    path = shared_path(spark, "digests") + ".bin"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    with_stream = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target)
    with_stream.write(blob)
    with_stream.close()
    spark.sparkContext.addFile(path)
    lengths = sorted({len(k) - k.index(b"/") for _, k, _ in keyed})
    return path.rsplit("/", 1)[1], lengths


class DigestArray:
    """The mapped file; `find` gives each key's verdict bits, or -1."""

    def __init__(self, path: str):
        raw = np.memmap(path, np.uint8, "r")
        n = int(raw[:8].view("<u8")[0])
        self.digests, self.ends = raw[8 : 8 + 8 * n].view("<u8"), raw[8 + 8 * n : 8 + 16 * n].view("<u8")
        self.verdicts, self.strings = raw[8 + 16 * n : 8 + 17 * n], raw[8 + 17 * n :]

    def find(self, keys: list[bytes]) -> np.ndarray:
        found = np.full(len(keys), -1, dtype=np.int64)
        if not len(self.digests) or not keys:
            return found
        digests = np.fromiter((xxhash.xxh64_intdigest(k) for k in keys), np.uint64, len(keys))
        at = np.searchsorted(self.digests, digests)
        for i in np.flatnonzero(self.digests[np.minimum(at, len(self.digests) - 1)] == digests):
            j = int(at[i])
            while j < len(self.digests) and self.digests[j] == digests[i]:
                begin = int(self.ends[j - 1]) if j else 0
                if self.strings[begin : int(self.ends[j])].tobytes() == keys[i]:
                    found[i] = int(self.verdicts[j])
                    break
                j += 1
        return found


def candidates(host: str, path: str, lengths: list[int]) -> list[bytes]:
    """Every entry that could fit, the longest string first."""
    labels = host.split(".") if host else []
    hosts = [".".join(labels[i:]) for i in range(len(labels))]
    raw = path.encode()
    keys = [h.encode() + raw[:n] for h in hosts if h for n in lengths if n <= len(raw)]
    return sorted(keys, key=len, reverse=True)


def rule_entries(spark: SparkSession, rules=RULES, hosts=BLOCKED_HOSTS) -> DataFrame:
    """The rules and the filter's own hosts as entries; a rule's key is its string, a host's is host/ ."""
    return spark.createDataFrame([(k, v, True) for k, v in rules] + [(f"{h}/", "block", False) for h in hosts], "key string, verdict string, rule boolean")


def split(pages: DataFrame, url: str = "url") -> DataFrame:
    """`pages` with `host` and `path`."""
    kept = [c for c in pages.columns if c.lower() not in ("host", "path")]
    name = fresh(pages, "whole_url")
    with_url = pages.select(*[F.col(quoted(c)) for c in kept], F.col(quoted(url)).alias(name))
    return with_url.withColumns({"host": host_of(F.col(name)), "path": path_of(F.col(name))}).drop(name)


def judge(pages: DataFrame, entries: DataFrame, url: str = "url") -> DataFrame:
    """`pages` with `host`, `path`, `rule` and `verdict`.

    The longest fitting rule decides; without one, a fitting list entry blocks, and everything else is allowed.
    """
    rows = split(pages, url)
    kept = [c for c in rows.columns if c.lower() not in ("rule", "verdict")]
    rows = rows.select(*[F.col(quoted(c)) for c in kept])
    file, lengths = build(pages.sparkSession, entries)
    schema = T.StructType([*[rows.schema[c] for c in kept], T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array = DigestArray(SparkFiles.get(file))
        for batch in batches:
            hosts, paths = batch.column(kept.index("host")).to_pylist(), batch.column(kept.index("path")).to_pylist()
            keys = [candidates(h, p, lengths) for h, p in zip(hosts, paths, strict=True)]
            found = array.find([k for own in keys for k in own])
            rule, verdict, at = [], [], 0
            for own in keys:
                bits = found[at : at + len(own)]
                at += len(own)
                fits = np.flatnonzero((bits >= 0) & (bits & 2 > 0))
                rule.append(own[fits[0]].decode() if len(fits) else None)
                blocked = bits[fits[0]] & 1 if len(fits) else (bits >= 0).any()
                verdict.append("block" if blocked else "allow")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=[*kept, "rule", "verdict"])

    return rows.mapInArrow(run, schema)


def judge_by_join(pages: DataFrame, entries: DataFrame, lengths: list[int], url: str = "url", key: str = "page_id") -> DataFrame:
    """(key, rule, verdict) like `judge`, for lists too large for every executor: a shuffled join on digest and string."""
    rows = split(pages.select(F.col(quoted(key)).alias("_id"), F.col(quoted(url)).alias("_u")), "_u")
    labels = F.split("host", r"\.")
    tail = F.explode_outer(F.when(F.col("host") != "", F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))))
    ways = rows.withColumn("_h", tail).withColumn("_n", F.explode(F.array(*[F.lit(n) for n in lengths or [1]])))
    probes = ways.withColumn("_key", F.when((F.length("path") >= F.col("_n")) & (F.col("_h") != ""), F.concat("_h", F.expr("substring(path, 1, _n)"))))
    known = listed(entries).select(F.col("key").alias("_key"), F.col("block").alias("_block"), F.col("rule").alias("_rule"))
    hit = probes.withColumn("_digest", F.xxhash64("_key")).join(known.withColumn("_digest", F.xxhash64("_key")), ["_digest", "_key"], "left")
    best = F.max(F.when(F.col("_rule"), F.struct(F.length("_key").alias("l"), F.col("_key").alias("k"), F.col("_block").alias("b"))))
    out = hit.groupBy("_id").agg(best.alias("_best"), F.coalesce(F.max("_block"), F.lit(False)).alias("_any"))
    verdict = F.when(F.coalesce(F.col("_best.b"), F.col("_any")), "block").otherwise("allow")
    return out.select(F.col("_id").alias(key), F.col("_best.k").alias("rule"), verdict.alias("verdict"))
