import pytest
from pyspark.sql import functions as F

from sparkveil.operators import governance as gv, integrity as ig, reports as rp


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_files_and_jobs_keep_what_has_no_partner(spark):
    files = spark.createDataFrame([(1, "a.csv", 1, 7), (2, "b.csv", 1, None), (3, "c.csv", 9, 7)], "file_id int, filename string, file_type_id int, created_by int")
    types = spark.createDataFrame([(1, "table")], "file_type_id int, type_label string")
    users = spark.createDataFrame([(7, "kim", 2)], "user_id int, username string, role_id int")
    assert rows(rp.file_list(files, types, users)) == [(1, "a.csv", "table", "kim"), (2, "b.csv", "table", None)]
    jobs = spark.createDataFrame([(1, "batch", 1), (2, "stream", 8), (3, "batch", None)], "job_id int, pipeline_type string, file_id int")
    violations = spark.createDataFrame([(1,), (1,), (None,)], "job_id int")
    assert rows(rp.job_violation_counts(jobs, files, violations)) == [(1, "batch", "a.csv", 2), (2, "stream", None, 0), (3, "batch", None, 0)]
    roles = spark.createDataFrame([(1, "admin")], "role_id int, role_code string")
    assert rows(gv.users_with_roles(users, roles)) == []


@pytest.mark.parametrize("ranges", ["1", "5"])
def test_ranks_and_best_with_ties_and_nulls(spark, ranges):
    data = [("a", i, float(i % 7)) for i in range(200)] + [("b", 500, None), ("c", 501, -1.0), (None, 502, 6.0)]
    df = spark.createDataFrame(data, "g string, k int, r double")
    best = rows(rp.best_of(df, "g", "k", F.col("r"), "rate"))
    assert best == sorted([("a", 195, 6.0), ("c", 501, -1.0), (None, 502, 6.0)], key=repr)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    try:
        got = {r["k"]: r["rank"] for r in rp.ranking(df, "k", F.col("r"), "rate").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    order = sorted((d for d in data if d[2] is not None), key=lambda d: (-d[2], d[1]))
    assert got == {d[1]: i for i, d in enumerate(order, 1)}
    assert rp.ranking(df.limit(0), "k", F.col("r"), "rate").count() == 0
    assert rows(rp.first_rows(df, ["k"], ["g"], 2)) == [("a",), ("a",)]


def test_differences_of_ids_and_fields(spark):
    old = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "id string")
    new = spark.createDataFrame([("b",), ("c",), ("c",)], "id string")
    assert rows(ig.id_difference(old, new, "id")) == sorted([("a", "missing"), ("c", "extra"), (None, "missing")], key=repr)
    maps = spark.createDataFrame([({"z": "1", "a": None}, {"b": "2", "a": "3"}), (None, {"q": "1"}), (None, None)], "a map<string,string>, b map<string,string>")
    assert [r[0] for r in maps.select(ig.key_union(F.col("a"), F.col("b"))).collect()] == [["a", "b", "z"], ["q"], []]


def test_fields_drift_by_record(spark):
    texts = ['{"id":1,"name":"x"}'] * 3 + ['{"id":2}', '{"id":1,"name":null}', '{"id":1,"name":"x","age":4}', "no json", "[1]", None, "{}"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    out = {(tuple(r["added"]), tuple(r["removed"])): (r["records"], r["first_text"]) for r in ig.record_drift(df, "t", ["id", "name"]).collect()}
    assert out == {((), ("name",)): (1, '{"id":2}'), (("age",), ()): (1, texts[5]), ((), ("id", "name")): (4, "[1]")}
    schemas = {r["schema"]: r["records"] for r in ig.record_schemas(df, "t").collect()}
    assert schemas["OBJECT<id: BIGINT, name: STRING>"] == 3 and schemas["OBJECT<id: BIGINT>"] == 1 and schemas[None] == 2
    assert ig.record_drift(df.limit(0), "t", ["id"]).count() == 0
