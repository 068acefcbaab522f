"""Tables of Parquet files that change together.

A folder holds a few tables. Which files belong to them is said by its manifests, one for each version; a version becomes
visible by the one rename that puts its manifest in place. Files are written before that under names of their own, so a job
that dies in between leaves files that no manifest names, and no table changes. A manifest also keeps marks, such as the last
micro-batch of a query that is in the tables: one that comes again is known to be there.

Keyed tables are merged by rewriting only the files that may hold a key. Their rows are dealt into buckets by a hash of the
key, a folder each, and an index beside them has a Bloom filter of every file, as rows (file, bucket, word, bits) that new
keys are joined with. One writer at a time."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 8
INDEX_WORDS = 1 << 14
"""Words of 64 bits of a file's filter: at 16 bits a key for files of 65,000 keys; with more keys it says yes more often."""
MOST_FILES = 8
"""Files of a bucket; where there are more, the next merge that adds to the bucket makes them one."""


@dataclass
class Change:
    """What one commit does to a table."""

    added: list[dict] = field(default_factory=list)
    removed: set[str] = field(default_factory=set)
    index: list[str] = field(default_factory=list)


class Snapshots:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._conf = spark._jsc.hadoopConfiguration()

    # Manifests

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self._conf)

    def versions(self) -> list[int]:
        fs, folder = self._fs(), self._path("manifests")
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """Tables (name to files) and marks, of the newest version or another one."""
        if version is None:
            version = max(self.versions(), default=0)
        if not version:
            return {"version": 0, "tables": {}, "index": {}, "marks": {}}
        stream = self._fs().open(self._path(f"manifests/{version:012d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, changes: dict[str, Change], marks: dict | None = None) -> int:
        """All changes and marks as one new version; gives its number."""
        old = self.manifest()
        new = {"version": old["version"] + 1, "tables": dict(old["tables"]), "index": dict(old["index"]), "marks": {**old["marks"], **(marks or {})}}
        for name, change in changes.items():
            files = [f for f in old["tables"].get(name, []) if f["path"] not in change.removed] + change.added
            live = {f["commit"] for f in files}
            new["tables"][name] = files
            new["index"][name] = [i for i in [*old["index"].get(name, []), *change.index] if i.rpartition("commit=")[2] in live]
        fs, name = self._fs(), f"manifests/{new['version']:012d}.json"
        if fs.exists(self._path(name)):
            raise RuntimeError(f"another writer has made version {new['version']} of {self.folder}")
        hidden = self._path(f"manifests/.{uuid.uuid4().hex}")
        stream = fs.create(hidden, True)
        try:
            stream.write(bytearray(json.dumps(new).encode()))
        finally:
            stream.close()
        if not fs.rename(hidden, self._path(name)):
            raise RuntimeError(f"version {new['version']} of {self.folder} could not be put in place")
        return new["version"]

    def vacuum(self, keep: int = 1) -> int:
        """Delete manifests but the newest few, and files that none of these name; gives how many files went."""
        fs, versions = self._fs(), self.versions()
        kept = [self.manifest(v) for v in versions[-keep:]]
        plain = lambda p: self.spark._jvm.org.apache.hadoop.fs.Path(p).toUri().getPath()
        live = {plain(f["path"]) for m in kept for files in m["tables"].values() for f in files}
        indexed = [f"{plain(i)}/" for m in kept for names in m["index"].values() for i in names]
        gone = 0
        for name in {n for m in kept for n in m["tables"]}:
            for top in (name, f"{name}.index"):
                found = fs.listFiles(self._path(top), True) if fs.exists(self._path(top)) else None
                while found is not None and found.hasNext():
                    path = found.next().getPath()
                    own = path.toUri().getPath()
                    if own.endswith(".parquet") and own not in live and not any(own.startswith(i) for i in indexed):
                        gone += bool(fs.delete(path, False))
        for v in versions[:-keep]:
            fs.delete(self._path(f"manifests/{v:012d}.json"), False)
        return gone

    # Plain tables

    def files(self, name: str, version: int | None = None) -> list[str]:
        return [f["path"] for f in self.manifest(version)["tables"].get(name, [])]

    def read(self, name: str, schema: T.StructType | str, version: int | None = None, files: Iterable[str] | None = None) -> DataFrame:
        """A table's rows, of a version (None: the newest), or of some of its files."""
        paths = self.files(name, version) if files is None else list(files)
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def append(self, name: str, rows: DataFrame) -> Change:
        """Files with these rows, to be committed."""
        commit = uuid.uuid4().hex
        path = f"{self.folder}/{name}/commit={commit}"
        rows.write.parquet(path)
        return Change([{"path": p, "commit": commit, "bucket": None} for p in self._written(path, rows.schema)])

    def _written(self, path: str, schema: T.StructType) -> list[str]:
        return sorted(self.spark.read.schema(schema).parquet(path).inputFiles())

    # Keyed tables

    def _write_keyed(self, name: str, rows: DataFrame, key: list[str], buckets: int, words: int) -> Change:
        commit = uuid.uuid4().hex
        path, index = (f"{self.folder}/{n}/commit={commit}" for n in (name, f"{name}.index"))
        dealt = rows.withColumn("bucket", bucket_of(key, buckets))
        dealt.repartition("bucket").write.partitionBy("bucket").parquet(path)
        files = self._written(path, rows.schema)
        stored = self.spark.read.schema(rows.schema).parquet(path).select(*key, F.input_file_name().alias("file"))
        word, bits = filter_bits(key, words)
        filters = stored.select("file", bucket_of(key, buckets).alias("bucket"), word.alias("word"), bits.alias("bits")).groupBy("file", "bucket", "word").agg(F.bit_or("bits").alias("bits"))
        filters.write.parquet(index)
        return Change([{"path": p, "commit": commit, "bucket": int(p.rpartition("bucket=")[2].split("/")[0])} for p in files], set(), [index])

    def touched(self, name: str, keys: DataFrame, key: list[str], buckets: int = BUCKETS, words: int = INDEX_WORDS) -> list[str]:
        """The files that may hold one of the keys; no other file does."""
        manifest = self.manifest()
        files, index = manifest["tables"].get(name, []), manifest["index"].get(name, [])
        if not files:
            return []
        word, bits = filter_bits(key, words)
        asked = keys.select(bucket_of(key, buckets).alias("bucket"), word.alias("word"), bits.alias("asked")).distinct()
        filters = self.spark.read.schema("file string, bucket int, word int, bits long").parquet(*index)
        hit = filters.join(asked, ["bucket", "word"]).where(F.col("bits").bitwiseAND(F.col("asked")) == F.col("asked"))
        found = {r.file for r in hit.select("file").distinct().collect()}  # names of files, as a manifest lists them
        return [f["path"] for f in files if f["path"] in found]

    def merge(self, name: str, rows: DataFrame, key: list[str], order: list[Column], buckets: int = BUCKETS, words: int = INDEX_WORDS) -> Change:
        """Of each key, among the table and new rows, the one that is last in the order; `_new` in it is 1 for new rows.

        Only files that may hold one of the new keys are written anew; the others keep their names."""
        columns = rows.columns
        new = newest(rows.withColumn("_new", F.lit(1)), key, order).drop("_new").persist()
        try:
            old = self.touched(name, new, key, buckets, words)
            counts: dict[int, int] = {}
            for f in self.manifest()["tables"].get(name, []):
                counts[f["bucket"]] = counts.get(f["bucket"], 0) + 1
            crowded = [b for b, n in counts.items() if n >= MOST_FILES]
            if crowded:
                full = {r.b for r in new.select(bucket_of(key, buckets).alias("b")).where(F.col("b").isin(crowded)).distinct().collect()}
                old = sorted({*old, *(f["path"] for f in self.manifest()["tables"][name] if f["bucket"] in full)})
            both = self.read(name, rows.schema, files=old).withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
            change = self._write_keyed(name, newest(both, key, order).select(*columns), key, buckets, words)
        finally:
            new.unpersist()
        change.removed = set(old)
        return change

    def insert(self, name: str, rows: DataFrame, key: list[str], order: list[Column], buckets: int = BUCKETS, words: int = INDEX_WORDS) -> Change:
        """Of each new key that the table lacks the last row in the order; no file is written anew."""
        new = newest(rows, key, order).persist()
        try:
            there = self.read(name, rows.schema, files=self.touched(name, new, key, buckets, words))
            held = there.select(*(F.col(k).alias(f"_{k}") for k in key))
            same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key]
            return self._write_keyed(name, new.join(held, same, "left_anti").select(*rows.columns), key, buckets, words)
        finally:
            new.unpersist()


def bucket_of(key: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def filter_bits(key: list[str], words: int) -> tuple[Column, Column]:
    """The word of a file's filter that a key is in, and its four bits there."""
    h = F.xxhash64(F.lit(1), *key)
    bit = lambda shift: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, shift).bitwiseAND(63).cast("int"))
    return F.pmod(F.shiftrightunsigned(h, 24), F.lit(words)).cast("int"), bit(0).bitwiseOR(bit(6)).bitwiseOR(bit(12)).bitwiseOR(bit(18))


def newest(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """Of each key the row that is last in the order, by an aggregate."""
    rest = [c for c in rows.columns if c not in key]
    last = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_last"))
    return last.select(*key, "_last.*").select(*rows.columns)
