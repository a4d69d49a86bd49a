"""A record store: typed columns beside the payload for pushed-down search, and appends that two writers can't both make."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identity import content_hash, entity_id

#: Bytes in a row group: a search reads the groups whose statistics may hold the value.
GROUP_BYTES = 8 << 20
#: Times that an append is made ready anew after another writer was first.
ATTEMPTS = 20


class Conflict(Exception):
    """Another writer has added a version meanwhile."""


class Store:
    """Records (id, kind, payload, content_hash, and fields that may be searched) in a folder of Parquet files.

    A version is a small file in `versions`, named by its number, that lists one folder of data; what the store holds is what its
    versions list. A version is added by creating its file, which fails if it exists: of two writers with the same next number one is first,
    and the other looks again which ids are new. This asks of the file system that creating a file which exists fails, as HDFS does, and object stores with
    conditional writes; on a local disk the check and the creation are two steps. Nothing is changed or removed. Folders of
    appends that were never listed aren't read.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.fs = self.jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str) -> Any:
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def versions(self) -> list[dict]:
        """What each version says, in order: a file for each append, read as one small table."""
        if not self.fs.exists(self._at("versions")):
            return []
        rows = self.spark.read.schema("version long, folder string, fields array<string>").json(f"{self.path}/versions").filter("folder is not null").orderBy("version").collect()
        return [r.asDict() for r in rows]

    def commit(self, version: int, folder: str, fields: Sequence[str]) -> None:
        """List a folder as this version, unless the version exists."""
        target = self._at(f"versions/{version:012d}.json")
        try:
            out = self.fs.create(target, False)
        except Exception as e:
            if self.fs.exists(target):
                raise Conflict(str(target)) from e
            raise
        out.write(bytearray(json.dumps({"version": version, "folder": folder, "fields": list(fields)}).encode()))
        out.close()

    def prepare(self, records: DataFrame, fields: Sequence[str]) -> tuple[int, str]:
        """Write what the store doesn't have yet, without listing it: the number that its version would have, and its folder."""
        known = self.versions()
        new = records.dropDuplicates(["id"])
        if known:
            new = new.join(self._read(known).select("id"), "id", "left_anti")
        folder = f"data/{uuid.uuid4().hex}"
        placed = new.repartitionByRange(F.col("kind"), *fields, F.col("id")).sortWithinPartitions("kind", *fields, "id")
        placed.write.option("parquet.block.size", GROUP_BYTES).parquet(f"{self.path}/{folder}")
        return (known[-1]["version"] + 1 if known else 1), folder

    def append(self, records: DataFrame, fields: Sequence[str] = ()) -> int:
        """Add the records whose id isn't there; the version that holds them. Of rows with one id any one is added."""
        for _ in range(ATTEMPTS):
            version, folder = self.prepare(records, fields)
            try:
                self.commit(version, folder, fields)
            except Conflict:
                continue
            return version
        raise Conflict(f"{ATTEMPTS} other writers were first")

    def _read(self, known: list[dict]) -> DataFrame:
        parts = [self.spark.read.parquet(f"{self.path}/{v['folder']}") for v in known]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p, allowMissingColumns=True)
        return out

    def read(self) -> DataFrame:
        """All records of the versions that are there now; a field that a version doesn't have is null."""
        known = self.versions()
        if not known:
            return self.spark.createDataFrame([], "id string, kind string, payload string, content_hash string")
        same = {tuple(v["fields"]) for v in known}
        if len(same) == 1:
            return self.spark.read.parquet(*[f"{self.path}/{v['folder']}" for v in known])
        return self._read(known)

    def find(self, kind: str, **equal: Any) -> DataFrame:
        """Records of a kind whose fields have these values; kind and fields are compared where the files are read."""
        out = self.read().filter(F.col("kind") == kind)
        for k, v in equal.items():
            out = out.filter(F.col(k) == v)
        return out

    def verified(self) -> DataFrame:
        """(id, kind, intact): whether each payload has the hash it was added with."""
        return self.read().select("id", "kind", (content_hash(F.col("payload")) == F.col("content_hash")).alias("intact"))


def as_rows(df: DataFrame, prefix: str, kind: str, identity: Sequence[str], fields: Sequence[str] = ()) -> DataFrame:
    """(id, kind, payload, content_hash, fields...): payload is JSON of all columns by name; equal identity gives an equal id."""
    payload = F.to_json(F.struct(*sorted(df.columns)))
    rows = df.select(entity_id(prefix, kind, *[F.col(c) for c in identity]).alias("id"), F.lit(kind).alias("kind"), payload.alias("payload"), *fields)
    return rows.withColumn("content_hash", content_hash(F.col("payload"))).select("id", "kind", "payload", "content_hash", *fields)
