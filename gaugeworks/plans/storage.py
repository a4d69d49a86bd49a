"""Scan and record queries and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import frames
from ..operators.ordering import shared
from ..sources import records as R
from ..sources import store
from ..status import q9 as Q9
from .evaluation import q9
from .stress import framed

T = frames.table


def stored(s, d):
    """Customers as records in a new store, in two appends that overlap, and those of one nation and segment found by pushed-down fields."""
    c = T(s, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    rows = store.as_rows(c, "cus", "Customer", ["c_name"], ["c_nationkey", "c_mktsegment"])
    at = store.Store(s, f"{shared(s)}/store-{uuid.uuid4().hex}")
    at.append(rows.filter("c_nationkey < 15"), ["c_nationkey", "c_mktsegment"])
    at.append(rows.filter("c_nationkey > 5"), ["c_nationkey", "c_mktsegment"])
    found = at.find("Customer", c_mktsegment="BUILDING").join(at.verified().select("id", "intact"), "id")
    return found.select("id", "c_nationkey", F.get_json_object("payload", "$.c_name").alias("name"), "intact")


QUERIES = {
    "record_store": stored,
    "tabular_scan": lambda s, d: T(s, d, "customer").select("c_custkey", "c_mktsegment", F.when(F.col("c_custkey") % 5 == 0, "test").otherwise("train").alias("split")),
    "random_access": lambda s, d: T(s, d, "orders").filter("o_orderkey = 7").select("o_orderkey", "o_orderstatus"),
    "tensor_scan": lambda s, d: T(s, d, "embeddings").select("vec_id", F.size("embedding").alias("width"), Q9(F.floor(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x) * 1e4 + 0.5) / F.lit(1e4)).alias("total")),
    "feature_columns": lambda s, d: T(s, d, "events").select("event_id", Q9("value").alias("value"), F.expr("try_cast(event_type as double)").alias("event_type")),
    "records": lambda s, d: R.as_records(T(s, d, "region").select("r_regionkey", "r_name"), "reg", "Region", ["r_name"]).select("id", "kind", "payload", "content_hash"),
    "record_search": lambda s, d: R.find(R.as_records(T(s, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), "nat", "Nation", ["n_name"]), n_regionkey="1").select("id"),
}
_REC = f"""SELECT 'reg_' || substr(sha256({framed("'Region'", 'r_name')}), 1, 32) AS id, 'Region' AS kind, '{{"r_name":"' || r_name || '","r_regionkey":' || r_regionkey || '}}' AS payload FROM region"""
SQL = {
    "record_store": f"SELECT 'cus_' || substr(sha256({framed("'Customer'", 'c_name')}), 1, 32) AS id, c_nationkey, c_name AS name, TRUE AS intact FROM customer WHERE c_mktsegment = 'BUILDING'",
    "tabular_scan": "SELECT c_custkey, c_mktsegment, CASE WHEN c_custkey % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM customer",
    "random_access": "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey = 7",
    "tensor_scan": f"SELECT vec_id, CAST(len(embedding) AS INTEGER) AS width, {q9('floor(list_sum(embedding::DOUBLE[]) * 1e4 + 0.5) / 1e4')} AS total FROM embeddings",
    "feature_columns": f"SELECT event_id, {q9('value')} AS value, try_cast(event_type AS DOUBLE) AS event_type FROM events",
    "records": f"WITH r AS ({_REC}) SELECT *, 'sha256:' || sha256(payload) AS content_hash FROM r",
    "record_search": f"SELECT 'nat_' || substr(sha256({framed("'Nation'", 'n_name')}), 1, 32) AS id FROM nation WHERE n_regionkey = 1",
}
