"""Tail probabilities, the keyed store, and id manifests."""

import json
import math

import pytest
from pyspark.sql import functions as F

from threadloom.functions.scoring import student_t_two_sided
from threadloom.operators import agreement, requests
from threadloom.sources import readers

# Two-sided tails of Student's t from published tables and closed forms: one degree of freedom is 1 - 2 atan(t) / pi,
# two are 1 - t / sqrt(2 + t * t).
KNOWN = [(12.706205, 1, 0.05), (2.570582, 5, 0.05), (4.032143, 5, 0.01), (2.228139, 10, 0.05), (2.042272, 30, 0.05), (1.983972, 100, 0.05), (2.625891, 100, 0.01)]


def test_student_tails(spark):
    rows = [(t, n, p) for t, n, p in KNOWN] + [(-t, n, p) for t, n, p in KNOWN]
    rows += [(t, 1, 1 - 2 * math.atan(t) / math.pi) for t in (0.01, 0.5, 3.0, 900.0)] + [(t, 2, 1 - t / math.sqrt(2 + t * t)) for t in (0.01, 0.5, 3.0, 200.0)]
    rows += [(0.0, 7, 1.0), (2.0, 10**9, math.erfc(2.0 / math.sqrt(2))), (1e-3, 10**9, math.erfc(1e-3 / math.sqrt(2))), (60.0, 1000, 0.0)]
    df = spark.createDataFrame([(float(t), n, float(p)) for t, n, p in rows], "t double, n long, p double")
    for r in df.withColumn("got", student_t_two_sided(F.col("t"), F.col("n"))).collect():
        assert r["got"] == pytest.approx(r["p"], abs=2e-6), r
    assert spark.createDataFrame([(None, 5), (1.0, 0)], "t double, n long").select(student_t_two_sided(F.col("t"), F.col("n")).alias("p")).distinct().collect()[0]["p"] is None


def test_correlation_p_values(spark):
    rows = [("a", x, y) for x, y in zip(range(1, 9), [2, 1, 4, 3, 7, 5, 8, 6])] + [("line", i, i) for i in range(5)] + [("flat", i, 1) for i in range(5)] + [("two", 1, 2), ("two", 2, 1)]
    got = {r["g"]: r for r in agreement.spearman(spark.createDataFrame(rows, "g string, x long, y long"), ["g"], "x", "y").collect()}
    rho = 1 - 6 * sum((x - y) ** 2 for x, y in zip(range(1, 9), [2, 1, 4, 3, 7, 5, 8, 6])) / (8 * 63)
    assert got["a"]["rho"] == pytest.approx(rho) and 0 < got["a"]["p_value"] < 0.05
    # Six degrees of freedom in closed form.
    c = got["a"]["t_stat"] / math.sqrt(6 + got["a"]["t_stat"] ** 2)
    s = 1 - c * c
    assert got["a"]["p_value"] == pytest.approx(1 - c * (1 + s / 2 + 3 * s * s / 8), abs=1e-9)
    assert got["line"]["p_value"] == 0.0 and got["flat"]["p_value"] is None and got["two"]["p_value"] is None


def test_a_key_stored_again_is_replaced(spark, tmp_path):
    store = requests.ResponseStore(spark, str(tmp_path / "store"), buckets=4)
    rows = lambda *pairs: spark.createDataFrame(list(pairs), "key string, response string")
    assert store.read().count() == 0
    store.append(rows(("a", "1"), ("b", "1"), ("b", "0")))
    store.append(rows(("a", "2"), ("c", "3"), (None, "x")))
    asked = spark.createDataFrame([("a",), ("a",), ("b",), ("z",), (None,)], "key string")
    got = sorted(((r["key"], r["response"], r["hit"]) for r in requests.lookup(asked, store.rows()).collect()), key=str)
    assert got == sorted([("a", "2", True), ("a", "2", True), ("b", "0", True), ("z", None, False), (None, None, False)], key=str)
    assert [r["key"] for r in requests.misses(asked.filter("key IS NOT NULL"), store.rows()).collect()] == ["z"]
    small = store.compact(str(tmp_path / "small"))
    assert store.rows().count() == 4 and sorted(map(tuple, small.rows().select("key", "response").collect())) == [("a", "2"), ("b", "0"), ("c", "3")]
    again = requests.ResponseStore(spark, str(tmp_path / "store"), buckets=4)
    assert again.read().count() == 3


def test_the_store_is_not_shuffled_for_its_latest_rows(spark, tmp_path):
    store = requests.ResponseStore(spark, str(tmp_path / "store"), buckets=4)
    store.append(spark.createDataFrame([("a", "1"), ("b", "1")], "key string, response string"))
    assert "Exchange" not in store.read()._jdf.queryExecution().executedPlan().toString()


def test_a_plain_frame_with_a_key_twice_answers_once(spark):
    store = spark.createDataFrame([("a", "2"), ("a", "1")], "key string, response string")
    assert [r["response"] for r in requests.lookup(spark.createDataFrame([("a",)], "key string"), store).collect()] == ["1"]


def test_id_manifest(spark, tmp_path):
    ids = spark.range(2500).select(F.when(F.col("id") % 3 == 0, "test").otherwise("dev").alias("split"), "id")
    readers.write_id_manifest(ids, str(tmp_path / "m"), chunk=100)
    assert sorted(map(tuple, readers.read_id_manifest(spark, str(tmp_path / "m")).collect())) == sorted(map(tuple, ids.collect()))
    lines = spark.read.json(str(tmp_path / "m"))
    assert lines.agg(F.max(F.size("ids"))).first()[0] == 100 and lines.count() == 26
    readers.write_id_manifest(ids.limit(0), str(tmp_path / "none"))
    assert readers.read_id_manifest(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("indent", [None, 1])
def test_manifest_document_is_read_by_many_tasks(spark, tmp_path, indent):
    doc = {"total_golden_examples": 3000, "seed": 42, "dev_golden_ids": list(range(1000, 3000)), "note": "x", "test_golden_ids": [5, -7, 9], "empty_golden_ids": [], "one_golden_ids": [4], "dev_count": 2000}
    path = tmp_path / "manifest.json"
    path.write_text(json.dumps(doc, indent=indent))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        rows = readers.read_manifest_document(spark, str(path))
        assert rows.rdd.getNumPartitions() > 3
        got = sorted(map(tuple, rows.collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == sorted([("dev", i) for i in doc["dev_golden_ids"]] + [("test", i) for i in (5, -7, 9)] + [("one", 4)])
