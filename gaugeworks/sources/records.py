"""Append-only records with content hashes, and manifests of what was written."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identity import content_hash, entity_id
from ..functions.running import RunningSha256, openssl
from ..operators.ordering import shared

#: Bytes of a file that one task hashes whole; longer ones are hashed split by split.
WHOLE = 128 << 20
#: Lines from this length on are left out by the reader.
LINE = 16 << 20
MARK = b"\xef\xbb\xbf"


def as_records(df: DataFrame, prefix: str, kind: str, identity: list[str]) -> DataFrame:
    """(id, kind, payload, content_hash): payload is JSON of all columns; equal identity gives an equal id."""
    payload = F.to_json(F.struct(*sorted(df.columns)))
    return df.select(entity_id(prefix, kind, *[F.col(c) for c in identity]).alias("id"), F.lit(kind).alias("kind"), payload.alias("payload")).withColumn("content_hash", content_hash(F.col("payload")))


def append(records: DataFrame, path: str) -> None:
    """Add records whose id isn't there yet; nothing is changed or removed.

    Two writers at once can both add one id; equal ids have equal identity, and readers keep one of them (verified).
    """
    spark = records.sparkSession
    new = records.dropDuplicates(["id"])
    try:
        there = spark.read.parquet(path).select("id")
    except Exception as e:  # no folder yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
    else:
        new = new.join(there, "id", "left_anti")
    new.write.mode("append").parquet(path)


def verified(spark: SparkSession, path: str) -> DataFrame:
    """(id, kind, payload, intact): whether each payload still has its hash."""
    r = spark.read.parquet(path)
    return r.select("id", "kind", "payload", (content_hash(F.col("payload")) == F.col("content_hash")).alias("intact"))


def find(records: DataFrame, **equal: str) -> DataFrame:
    """Records whose payload has these values, in order of id."""
    out = records
    for k, v in equal.items():
        out = out.filter(F.get_json_object("payload", f"$.{k}") == v)
    return out.orderBy("id")


def manifest(spark: SparkSession, path: str, whole: int = WHOLE) -> DataFrame:
    """(name, bytes, sha256) of each file under a folder.

    A file of at most `whole` bytes is hashed by the task that reads it. A longer one is
    hashed split by split when this is called (hash_by_splits): no task reads more than a
    split, and as many follow each other as the longest file has splits. Only where that
    can't be done is a longer file read whole; Spark refuses that beyond 2 GB. Empty files
    have no row, as Spark's file sources pass over them.
    """
    files = lambda at: spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(at)
    name, schema = F.element_at(F.split("path", "/"), -1).alias("name"), "name string, bytes long, sha256 string"
    hashed = lambda f: f.select(name, F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    out = hashed(files(path).filter(F.col("length") <= whole))
    long = files(path).filter(F.col("length") > whole).select("path", name, "length").collect()
    if not long:
        return out
    with ThreadPoolExecutor(min(len(long), spark.sparkContext.defaultParallelism)) as pool:
        sums = [*pool.map(inheritable_thread_target(spark)(lambda r: hash_by_splits(spark, r["path"], r["length"])), long)]
    out = out.unionByName(spark.createDataFrame([(r["name"], r["length"], h) for r, h in zip(long, sums) if h], schema))
    left = [literal(r["path"]) for r, h in zip(long, sums) if not h]
    return out.unionByName(hashed(files(left))) if left else out


def literal(path: str) -> str:
    """A path whose characters stand for themselves where patterns are allowed."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def hash_by_splits(spark: SparkSession, path: str, length: int) -> str | None:
    """SHA-256 of a file whose splits are hashed by one task after the other, each going on from the state of the last.

    Spark's text source gives a file's lines as they are, except for their ends, a byte order
    mark before the first and lines of LINE bytes or more, so what is hashed is the file once
    the bytes add up. None if they don't, neither with lines ended by newlines nor by zero
    bytes, if Spark would decompress the file by its name, or without OpenSSL's functions.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    if not openssl() or jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(jvm.org.apache.hadoop.fs.Path(path)):
        return None
    for end in (b"\n", b"\0"):
        state, n = _lines_hashed(spark, path, end, b"")
        if length - n in (len(MARK), len(MARK) + 1):
            state, n = _lines_hashed(spark, path, end, MARK)
        if length - n in (0, 1):
            sha = RunningSha256(openssl(), state)
            sha.update(end * (length - n))
            return sha.hexdigest()
    return None


def _lines_hashed(spark: SparkSession, path: str, end: bytes, head: bytes) -> tuple[bytes, int]:
    """The hash's state after head and all lines with `end` between them, and the number of these bytes."""
    sha = RunningSha256(openssl())
    sha.update(head)
    state, n, rows, start = sha.state, len(head), 0, 0
    text = spark.read.option("lineSep", end.decode()).option("mapreduce.input.linerecordreader.line.maxlength", LINE).text(literal(path))
    lines = text.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_block_start").alias("start"))
    for k in range(lines.rdd.getNumPartitions()):
        step = lines.mapInArrow(_going_on(state, n, rows, start, end), "state binary, n long, rows long, start long").rdd
        for r in spark.sparkContext.runJob(step, list, [k]):
            state, n, rows, start = bytes(r["state"]), r["n"], r["rows"], r["start"]
    return state, n


def _going_on(state: bytes, n: int, rows: int, start: int, end: bytes) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha, size, seen, at = RunningSha256(openssl(), state), n, rows, start
        for b in batches:
            if not b.num_rows:
                continue
            starts = b.column("start")
            if starts[0].as_py() < at or starts[-1].as_py() < starts[0].as_py():
                raise ValueError("splits of a file aren't read in their order")
            at = starts[-1].as_py()
            lines = b.column("value").cast(pa.binary())
            data = pc.binary_join(pa.ListArray.from_arrays([0, len(lines)], lines), end)[0].as_py()
            if seen:
                sha.update(end)
            sha.update(data)
            size += len(data) + (len(end) if seen else 0)
            seen += len(lines)
        yield pa.RecordBatch.from_pydict({"state": [sha.state], "n": [size], "rows": [seen], "start": [at]})

    return run


def write_json_lines(df: DataFrame) -> str:
    """Rows as JSON lines in a new folder of the shared one, its path; keys in order of name, nulls kept."""
    path = f"{shared(df.sparkSession)}/lines-{uuid.uuid4().hex}"
    df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("value")).write.text(path)
    return path


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines. A line that doesn't fit the schema stops the job: nothing is read as null in silence."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
