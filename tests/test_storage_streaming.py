from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gaugeworks.sources import records, store
from gaugeworks.streaming import state, windows

SF = "/root/testdata/sf0.001"


def test_records_are_added_once_and_verified(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "name string, v int")
    path = str(tmp_path / "records")
    r = records.as_records(df, "thg", "Thing", ["name"])
    records.append(r, path)
    records.append(r, path)
    back = records.verified(spark, path).collect()
    assert len(back) == 2 and all(x["intact"] for x in back)
    assert records.manifest(spark, path).count() >= 1


def test_stream_gives_the_batch_windows(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).select(*windows.EVENTS.names)
    e.repartition(1).sortWithinPartitions("ts").write.parquet(str(tmp_path / "in"))
    windows.run_available(windows.tumbling(windows.read_events(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "state"))
    got = {(r["start"], r["event_type"]): r["n"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r["start"], r["event_type"]): r["n"] for r in windows.tumbling(e).collect()}
    last = e.agg(F.max("ts")).first()[0]
    closed = {k: n for k, n in want.items() if k[0] + timedelta(days=2) <= last}  # the watermark is a day behind
    assert closed and got == closed


def plain_drift(batches, width=86_400, late=86_400):
    """Windows closed and rows missed, batch by batch, for one key each."""
    out, keys = [], {}
    for batch in batches:
        for key in sorted({r[0] for r in batch}):
            k = keys.setdefault(key, {"open": {}, "closed": None, "top": None, "n": 0, "sum": 0.0})
            rows = [r for r in batch if r[0] == key]
            k["top"] = max([r[1] for r in rows] + ([] if k["top"] is None else [k["top"]]))
            missed = {}
            for _, at, v in rows:
                s = at // width * width
                if k["closed"] is not None and s < k["closed"]:
                    missed[s] = missed.get(s, 0) + 1
                else:
                    k["open"].setdefault(s, []).append(v)
            out += [(key, s, 0, None, n) for s, n in missed.items()]
            for s in sorted(k["open"]):
                if s + width + late <= k["top"]:
                    v = k["open"].pop(s)
                    out.append((key, s, len(v), round(sum(v) / len(v) - k["sum"] / k["n"], 6) if k["n"] else None, 0))
                    k["n"], k["sum"], k["closed"] = k["n"] + len(v), k["sum"] + sum(v), s + width
    return sorted(out, key=repr)


def test_stateful_stream_goes_on_after_a_restart_and_counts_late_rows(spark, tmp_path):
    rows = [(r["event_type"], int(r["at"]), r["value"]) for r in spark.read.parquet(f"{SF}/events.parquet").selectExpr("event_type", "unix_timestamp(cast(ts as timestamp)) AS at", "value").orderBy("ts", "event_id").collect()]
    late = [(t, at, v) for k, (t, at, v) in enumerate(rows) if k % 40 == 7]
    on_time = [r for k, r in enumerate(rows) if k % 40 != 7]
    size = len(on_time) // 5
    batches = [on_time[k * size : (k + 1) * size if k < 4 else None] for k in range(5)]
    batches[4] = batches[4] + late  # most of their windows are closed by then
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))

    def arrive(k):
        moved = [(k, t, datetime.fromtimestamp(at), v, 0) for t, at, v in batches[k]]
        spark.createDataFrame(moved, "event_id long, event_type string, ts timestamp, value double, user_id long").select(*windows.EVENTS.names).coalesce(1).write.mode("append").parquet(source)

    for upto in ((0, 1), (2,), (3, 4)):  # three runs from one checkpoint
        for k in upto:
            arrive(k)
            windows.run_available(state.expanding_drift(windows.read_events(spark, source), "event_type", "ts", "value"), out, check)
    got = [(r["key"], r["start"], r["n"], None if r["shift"] is None else round(r["shift"], 6), r["n_late"]) for r in spark.read.parquet(out).collect()]
    assert sorted(got, key=repr) == plain_drift(batches)
    assert sum(r[4] for r in got) > 0


def rows_of(spark, names, size=None):
    df = spark.createDataFrame([(n, k % 50) for k, n in enumerate(names)], "name string, v int") if size is None else spark.range(size).selectExpr("concat('n', id) AS name", "cast(id % 50 AS int) AS v")
    return store.as_rows(df, "thg", "Thing", ["name"], ["v"])


def test_of_two_writers_one_is_first_and_no_id_is_added_twice(spark, tmp_path):
    a, b = store.Store(spark, str(tmp_path)), store.Store(spark, str(tmp_path))
    assert a.append(rows_of(spark, ["x"]), ["v"]) == 1
    one, two = a.prepare(rows_of(spark, ["x", "y", "z"]), ["v"]), b.prepare(rows_of(spark, ["y", "w"]), ["v"])
    assert one[0] == two[0] == 2  # both saw the first version
    a.commit(*one, ["v"])
    with pytest.raises(store.Conflict):
        b.commit(*two, ["v"])
    assert b.append(rows_of(spark, ["y", "w"]), ["v"]) == 3  # made ready anew
    names = [r[0] for r in b.read().select(F.get_json_object("payload", "$.name")).collect()]
    assert sorted(names) == ["w", "x", "y", "z"] and all(r["intact"] for r in a.verified().collect())


def test_a_damaged_payload_is_told(spark, tmp_path):
    s = store.Store(spark, str(tmp_path))
    good = rows_of(spark, ["x", "y"])
    s.append(good.withColumn("payload", F.when(F.col("v") == 0, F.concat("payload", F.lit(" "))).otherwise(F.col("payload"))), ["v"])
    assert sorted(r["intact"] for r in s.verified().collect()) == [False, True]


def test_stores_of_other_fields_and_none(spark, tmp_path):
    s = store.Store(spark, str(tmp_path))
    assert s.read().collect() == [] and s.versions() == []
    s.append(rows_of(spark, ["x"]), ["v"])
    s.append(store.as_rows(spark.createDataFrame([("q", 1.5)], "name string, u double"), "oth", "Other", ["name"], ["u"]), ["u"])
    assert [r["u"] for r in s.find("Other", u=1.5).collect()] == [1.5] and s.find("Thing", v=0).count() == 1


def test_a_search_reads_only_row_groups_that_may_match(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "GROUP_BYTES", 64 << 10)
    s = store.Store(spark, str(tmp_path))
    s.append(rows_of(spark, None, 60_000), ["v"])
    found = s.find("Thing", v=7)
    rows = found.collect()
    plan = found._jdf.queryExecution().executedPlan()
    leaf = plan.collectLeaves().head()
    read = leaf.metrics().apply("numOutputRows").value()
    assert len(rows) == 1200 and 1200 <= read < 20_000
