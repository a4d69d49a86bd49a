"""Hashes of files that no task reads whole, against hashlib."""

import gzip
import hashlib
import random

import pytest

from gaugeworks.functions.running import RunningSha256, openssl
from gaugeworks.sources import records

SPLIT = 1000


@pytest.fixture
def conf(spark):
    """Sets options and takes them back."""
    before = {}

    def put(name, value):
        before.setdefault(name, spark.conf.get(name, None))
        spark.conf.set(name, value)

    yield put
    for name, value in before.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def written(folder, files):
    for name, data in files.items():
        (folder / name).write_bytes(data)
    return {name: (len(data), hashlib.sha256(data).hexdigest()) for name, data in files.items()}


def found(spark, folder):
    return {r["name"]: (r["bytes"], r["sha256"]) for r in records.manifest(spark, str(folder), whole=SPLIT).collect()}


def test_a_hash_goes_on_from_its_state_at_any_byte():
    data = random.Random(1).randbytes(300)
    for cut in range(len(data) + 1):
        first = RunningSha256(openssl())
        first.update(data[:cut])
        second = RunningSha256(openssl(), first.state)
        second.update(data[cut:])
        assert second.hexdigest() == second.hexdigest() == hashlib.sha256(data).hexdigest()


def test_long_files_are_hashed_without_being_read_whole(spark, conf, tmp_path):
    rng, mark = random.Random(2), b"\xef\xbb\xbf"
    lines = b"".join(rng.randbytes(rng.randrange(300)) + b"\n" for _ in range(30))
    files = {
        "short": b"ab\n", "limit": b"x" * SPLIT, "random.parquet": rng.randbytes(5003), "ended": lines, "not ended": lines + b"x", "two ends": lines + b"\n\n",
        "newlines": b"\n" * 3001, "begins with one": b"\n" + lines, "crlf": b"a\r\n" * 1500 + b"\r", "one line": b"a" * 4500, "one line ended": b"a" * 4499 + b"\n",
        "mark": mark + lines, "mark, not ended": mark + lines + b"x", "two marks": mark + mark + lines, "mark, newline": mark + b"\n" + lines, "mark later": b"a\n" + mark + lines,
        "of splits": (b"a" * (SPLIT - 1) + b"\n") * 4, "over by one": (b"a" * SPLIT + b"\n") * 4, "odd [a]{b}*?.bin": rng.randbytes(2500),
    }
    for k in range(4):
        files[f"mixed {k}"] = bytes(rng.choices(b"\n\r\0a", (1, 1, 1, 20 * k), k=2500 + k))
    want = written(tmp_path, files)
    conf("spark.sql.files.maxPartitionBytes", str(SPLIT))
    conf("spark.sql.sources.binaryFile.maxLength", str(SPLIT))  # longer ones can't be read whole
    assert found(spark, tmp_path) == want


def test_lines_that_are_not_held_are_noticed(spark, conf, tmp_path, monkeypatch):
    """With lines of at most 200 bytes: zeros are read by another end, what has neither end is read whole, nothing is hashed in part."""
    monkeypatch.setattr(records, "LINE", 200)
    rng = random.Random(3)
    ordinary = b"".join(rng.randbytes(50).replace(b"\0", b"") + b"\n" for _ in range(50))
    want = written(tmp_path, {"zeros": bytes(3500), "zeros within": ordinary + bytes(2500) + ordinary[:-1], "neither": b"a" * 5000, "neither within": ordinary + b"a" * 3100 + ordinary, "just": (b"a" * 199 + b"\n") * 9})
    conf("spark.sql.files.maxPartitionBytes", str(SPLIT))
    assert found(spark, tmp_path) == want
    by_splits = {name: records.hash_by_splits(spark, str(tmp_path / name), n) for name, (n, _) in want.items()}
    assert by_splits["zeros"] == want["zeros"][1] and all(h in (None, want[name][1]) for name, h in by_splits.items())
    assert by_splits["neither"] is None and by_splits["neither within"] is None


def test_files_that_spark_would_decompress_are_hashed_as_they_are(spark, tmp_path):
    want = written(tmp_path, {"a.gz": gzip.compress(random.Random(4).randbytes(3000))})
    assert found(spark, tmp_path) == want


def test_a_file_that_is_longer_than_said_has_no_hash_by_splits(spark, tmp_path):
    written(tmp_path, {"f": b"a\n" * 1000})
    assert records.hash_by_splits(spark, str(tmp_path / "f"), 1500) is None
