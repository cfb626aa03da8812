"""Problem 3: how often each value or term occurs and in how many records, kept up to date by signed deltas.

`TermStore` is a folder that outlives the session. It holds the counts in files by hash bucket of the term, and for each
record a digest and the text as last counted. `update` takes the records as they are now. A join of digests, without texts,
tells which records were added, changed or deleted; only their texts are read: the new ones count +1, those that they
replace, or that are gone, count -1. These signed texts are aggregated to changes of occurrences and record counts by
term, within each Arrow batch and partition before anything is shuffled, and merged into the buckets that they touch.
A version becomes visible when its manifest is written, so a run that was stopped leaves the one before.
The number of records of a field is itself kept, as the count of the term null.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialize
from .codes import code_points, whole

DELTA = "field string, term string, occurrences bigint, records bigint"
#: Terms of a bucket; with more the number of buckets is doubled.
BUCKET_TERMS = 1 << 17
_FIRST, _LAST = 0x4E00, 0x9FFF
_WIDTH = _LAST - _FIRST + 1


def latest_texts(deliveries: DataFrame, key: str, text: str, order: str) -> DataFrame:
    """key, text: each record once, as delivered last (equal times go by text; a null time is the oldest).

    Records delivered once, nearly all, aren't shuffled: the keys of the others are found without texts."""
    rows = deliveries.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(order).alias("_at"))
    # written, so that its size is known before anything with texts is joined with it
    several = materialize(rows.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("key"), "repeated")
    rank = F.row_number().over(W.partitionBy("key").orderBy(F.desc_nulls_last("_at"), F.desc_nulls_last("text")))
    again = rows.join(several, "key", "left_semi").withColumn("_rank", rank).filter("_rank = 1")
    return rows.join(several, "key", "left_anti").select("key", "text").unionByName(again.select("key", "text"))


def value_deltas(signed: DataFrame, field: str) -> DataFrame:
    """Each whole text is one term; null and empty texts are no terms and no records of the field."""
    texts = signed.filter("text is not null and text <> ''")
    sums = (F.sum("sign").cast("bigint").alias("occurrences"), F.sum("sign").cast("bigint").alias("records"))
    terms = texts.groupBy(F.lit(field).alias("field"), F.col("text").alias("term")).agg(*sums)
    total = texts.agg(*sums).select(F.lit(field).alias("field"), F.lit(None).cast("string").alias("term"), *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("occurrences", "records")))
    return terms.unionByName(total)


def _pairs(field: str, most_held: int = 1 << 20):
    schema = pa.schema([("field", pa.string()), ("term", pa.string()), ("occurrences", pa.int64()), ("records", pa.int64())])
    none = (np.empty(0, np.int64),) * 3

    def out(held: tuple[np.ndarray, ...], total: int) -> pa.RecordBatch:
        ids, occurrences, records = held
        pairs = np.stack([ids // _WIDTH + _FIRST, ids % _WIDTH + _FIRST], axis=1).astype(np.uint32)
        joined = pairs.tobytes().decode("utf-32-le")
        terms = [joined[i : i + 2] for i in range(0, len(joined), 2)]
        return pa.record_batch([pa.array([field] * (len(terms) + 1)), pa.array([*terms, None], pa.string()), pa.array([*occurrences, total], pa.int64()), pa.array([*records, total], pa.int64())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = none, 0
        for batch in batches:
            signs = batch.column("sign").to_numpy().astype(np.int64)
            total += int(signs.sum())
            for numbers, pieces in whole(batch.column("text").to_pylist()):
                codes, lengths = code_points(pieces)
                inside = (codes >= _FIRST) & (codes <= _LAST)
                text_of = np.repeat(np.arange(len(pieces)), lengths)
                at = np.flatnonzero(inside[:-1] & inside[1:] & (text_of[:-1] == text_of[1:])) if codes.size else np.empty(0, np.int64)
                pair = (codes[at].astype(np.int64) - _FIRST) * _WIDTH + (codes[at + 1] - _FIRST)
                keys = text_of[at].astype(np.int64) << 29 | pair
                keys.sort()
                first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if keys.size else keys
                count, keys = np.diff(np.r_[first, keys.size]), keys[first]
                sign = signs[np.asarray(numbers, np.int64)[keys >> 29]]
                new = (np.r_[held[0], keys & ((1 << 29) - 1)], np.r_[held[1], sign * count], np.r_[held[2], sign])
                ids, where = np.unique(new[0], return_inverse=True)
                held = (ids, *(np.bincount(where, weights=x, minlength=ids.size).astype(np.int64) for x in new[1:]))
                if ids.size > most_held:
                    yield out(held, 0)
                    held = none
        yield out(held, total)

    return run


def pair_deltas(signed: DataFrame, field: str) -> DataFrame:
    """Terms are the pairs of adjacent ideographs U+4E00 to U+9FFF; pairs may overlap, each counts.
    Every record counts in the total, whether or not its text is null, empty or has such pairs."""
    return signed.select(F.col("sign").cast("int"), "text").mapInArrow(_pairs(field), DELTA)


class TermStore:
    """Counts by field and term in a folder that all executors share, as of a version. One writer at a time."""

    COUNTS = "field string, term string, occurrences bigint, records bigint"
    INDEX = "field string, key bigint, digest_a bigint, digest_b bigint, part string"
    TEXTS = "field string, key bigint, text string"

    def __init__(self, spark: SparkSession, path: str):
        """The newest version in the folder; an empty store where there is none."""
        self.spark, self.path, self.version, self.buckets = spark, path, 0, 1
        self.parts: dict[int, str] = {}
        self.index_folder: str | None = None
        versions = [int(name[1:]) for name in _folders(spark, f"{path}/manifest")]
        if versions:
            self.version = max(versions)
            rows = spark.read.parquet(f"{path}/manifest/v{self.version}").collect()  # a row a bucket
            self.buckets, self.index_folder = rows[0]["buckets"], rows[0]["index_folder"]
            self.parts = {r["bucket"]: r["folder"] for r in rows if r["folder"]}

    def _read(self, schema: str, *folders: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        return self._read(self.COUNTS, *(f for b, f in self.parts.items() if buckets is None or b in buckets))

    def _signed(self, field: str, now: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        """sign, text of what differs from the store; and the field's index from now on."""
        digest = (F.xxhash64("text").alias("digest_a"), F.xxhash64(F.lit(1), "text").alias("digest_b"))
        fresh = now.select("key", *digest)
        plus = F.lit(1).alias("sign")
        if self.index_folder is None:
            now.select(F.lit(field).alias("field"), "key", "text").write.parquet(f"{self.path}/texts/{name}")
            written = self._read(self.TEXTS, f"{self.path}/texts/{name}")
            return written.select(plus, "text"), written.select(F.lit(field).alias("field"), "key", *digest, F.lit(name).alias("part"))
        known = self._read(self.INDEX, self.index_folder).filter(F.col("field") == field).drop("field")
        both = fresh.join(known.select("key", F.col("digest_a").alias("_a"), F.col("digest_b").alias("_b"), "part"), "key", "full")
        same = F.col("part").isNotNull() & F.col("digest_a").isNotNull() & (F.col("digest_a") == F.col("_a")) & (F.col("digest_b") == F.col("_b"))
        both = materialize(both.withColumn("same", same), "digests")
        came = materialize(both.filter("not same and digest_a is not null").select("key"), "came")
        now.join(came, "key", "left_semi").select(F.lit(field).alias("field"), "key", "text").write.parquet(f"{self.path}/texts/{name}")
        signed = self._read(self.TEXTS, f"{self.path}/texts/{name}").select(plus, "text")
        gone = materialize(both.filter("not same and part is not null").select("key", "part"), "gone")
        folders = [f"{self.path}/texts/{r[0]}" for r in gone.select("part").distinct().collect()]  # a row a version at most
        if folders:
            old = self._read(self.TEXTS, *folders).filter(F.col("field") == field).withColumn("part", F.element_at(F.split(F.input_file_name(), "/"), -2))
            signed = signed.unionByName(old.join(gone, ["key", "part"], "left_semi").select(F.lit(-1).alias("sign"), "text"))
        index = both.filter("digest_a is not null").select(F.lit(field).alias("field"), "key", "digest_a", "digest_b", F.when(F.col("same"), F.col("part")).otherwise(name).alias("part"))
        return signed, index

    def update(self, records: dict[str, tuple[DataFrame, Callable[[DataFrame, str], DataFrame]]]) -> TermStore:
        """field -> (key bigint, text: all its records as they are now, each once; how to count signed texts).
        The store as of a new version; the old one stays whole until its files are removed. Fields that aren't named
        stay as they are."""
        name = f"{self.version + 1}-{uuid.uuid4().hex}"
        deltas = index = None
        for field, (now, count) in records.items():
            signed, mine = self._signed(field, now, f"{name}-{len(deltas.columns) if deltas is not None else 0}-{field}")
            part = count(signed, field)
            deltas, index = (part, mine) if deltas is None else (deltas.unionByName(part), index.unionByName(mine))
        if self.index_folder is not None:
            index = index.unionByName(self._read(self.INDEX, self.index_folder).filter(~F.col("field").isin(*records)))
        index.write.parquet(f"{self.path}/index/{name}")
        sums = (F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
        deltas = materialize(deltas.groupBy("field", "term").agg(*sums).filter("occurrences <> 0 or records <> 0"), "term-deltas")
        return self._merge(deltas, name)

    def _merge(self, deltas: DataFrame, name: str) -> TermStore:
        """Only buckets that a delta touches are read and written again; terms whose counts come to nothing leave."""
        terms = deltas.count() + (self.read().count() if self.parts else 0)
        buckets = self.buckets
        while terms > buckets * BUCKET_TERMS:
            buckets *= 2
        bucket = F.pmod(F.xxhash64("field", "term"), F.lit(buckets)).cast("int").alias("bucket")
        touched = sorted(self.parts) if buckets != self.buckets else sorted(r[0] for r in deltas.select(bucket).distinct().collect())  # a row a bucket
        rows = self.read([b for b in touched if b in self.parts]).unionByName(deltas) if self.parts else deltas
        sums = rows.groupBy("field", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records")).filter("occurrences <> 0 or records <> 0")
        folder = f"{self.path}/counts/{name}"
        sums.withColumn("bucket", bucket).repartition(buckets, "bucket").write.partitionBy("bucket").parquet(folder)
        kept = {} if buckets != self.buckets else {b: f for b, f in self.parts.items() if b not in touched}
        parts = kept | {int(b.split("=")[1]): f"{folder}/{b}" for b in _folders(self.spark, folder) if b.startswith("bucket=")}
        manifest = [(b, parts.get(b), buckets, f"{self.path}/index/{name}") for b in range(buckets)]
        self.spark.createDataFrame(manifest, "bucket int, folder string, buckets int, index_folder string").coalesce(1).write.parquet(f"{self.path}/manifest/v{self.version + 1}")
        return TermStore(self.spark, self.path)


def _folders(spark: SparkSession, folder: str) -> list[str]:
    """Names of the folders in a folder whose writing was finished (a manifest without its mark doesn't count)."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [s.getPath() for s in fs.listStatus(path) if s.isDirectory()]
    done = lambda p: p.getName().startswith("bucket=") or fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))
    return [p.getName() for p in names if done(p)]


def marked_terms(counts: DataFrame, common_share: dict[str, float], rare_records: int = 1) -> DataFrame:
    """field, term, occurrences, records, share, mark: `rare` in at most `rare_records` records, `common`
    in more than the field's share of its records, else null. A term that is both counts as common."""
    totals = counts.filter("term is null").select("field", F.col("records").alias("total"))  # a row a field
    limit = F.create_map(*(F.lit(x) for pair in common_share.items() for x in pair))
    share = F.col("records") / F.col("total")
    mark = F.when(share > limit[F.col("field")], "common").when(F.col("records") <= rare_records, "rare")
    return counts.filter("term is not null").join(totals, "field").select("field", "term", "occurrences", "records", share.alias("share"), mark.alias("mark"))
