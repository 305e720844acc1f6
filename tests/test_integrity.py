from pyspark.sql import functions as F

from sparkveil.functions.hashing import record_hash
from sparkveil.operators import baselines as bl, history as hs, integrity as ig, reports as rp


def events(trusted, current, **kwargs):
    return sorted((r["change_type"], r["record_id"]) for r in ig.detect_changes(trusted, current, "id", **kwargs).collect())


def test_three_outcomes_and_field_difference(spark):
    trusted = spark.createDataFrame([("1", "a", 1.5), ("2", "b", None), ("3", "c", 2.0)], "id string, t string, x double")
    current = spark.createDataFrame([("1", "a", 1.5), ("2", "b", 0.0), ("4", "d", 2.0)], "id string, t string, x double")
    assert events(trusted, current) == [("record_added", "4"), ("record_deleted", "3"), ("record_modified", "2")]
    row = ig.detect_changes(trusted, current, "id").filter("record_id = '2'").first()
    assert {k: (v["old"], v["new"]) for k, v in row["affected_fields"].items()} == {"x": (None, "0.0")}
    assert (row["severity"], row["compliance_impact"]) == ("high", "medium")
    assert events(trusted, trusted) == []


def test_every_copy_of_a_repeated_id_is_checked(spark):
    trusted = spark.createDataFrame([("1", "a"), ("2", "b")], "id string, t string")
    current = spark.createDataFrame([("1", "a"), ("1", "z"), ("1", "z"), ("2", "b")], "id string, t string")
    assert events(trusted, current, with_fields=False) == [("record_modified", "1")] * 2


def test_hash_ignores_column_order_but_not_null(spark):
    a = spark.createDataFrame([("x", 1)], "t string, n int")
    b = spark.createDataFrame([(1, "x")], "n int, t string")

    def one(df):
        return df.select(record_hash(df.schema).alias("h")).first()["h"]

    assert one(a) == one(b)
    nothing, empty = spark.createDataFrame([(None,)], "t string"), spark.createDataFrame([("",)], "t string")
    assert one(nothing) != one(empty)
    near, nearer = spark.createDataFrame([(0.1,)], "x double"), spark.createDataFrame([(0.1 + 1e-16,)], "x double")
    assert one(near) != one(nearer)


def test_baseline_summary_counts_copies(spark):
    df = spark.createDataFrame([("1", "a"), ("2", "b")], "record_id string, t string")
    at = F.lit("2024-01-01").cast("timestamp")

    def content(x):
        return ig.baseline_summary(ig.baseline(x, "B", at)).first()["content_hash"]

    assert content(df) == content(df.orderBy(F.desc("t")))
    assert content(df) != content(df.unionByName(df))


def test_latest_active_baseline(spark):
    df = spark.createDataFrame(
        [("f", "b1", 1, True), ("f", "b2", 2, True), ("f", "b3", 3, False), ("g", "b9", 1, False)],
        "file_id string, baseline_id string, created_at int, is_active boolean",
    )
    assert [(r["file_id"], r["baseline_id"]) for r in ig.latest_active(df).collect()] == [("f", "b2")]


def test_drift(spark):
    ten, eleven, twelve = (spark.range(n) for n in (10, 11, 12))
    assert ig.count_drift(ten, eleven).count() == 0
    assert ig.count_drift(ten, twelve).first()["change_percentage"] == 20.0
    assert ig.count_drift(spark.range(0), ten).count() == 0
    assert ig.schema_drift(["id"], ten).count() == 0
    row = ig.schema_drift(["key"], ten).first()
    assert row["added"] == ["id"] and row["removed"] == ["key"]


def test_only_deletions_are_escalated(spark):
    trusted = spark.createDataFrame([("1", "a"), ("2", "b")], "id string, t string")
    current = spark.createDataFrame([("1", "z"), ("3", "c")], "id string, t string")
    out = ig.escalated(ig.detect_changes(trusted, current, "id", with_fields=False)).collect()
    assert [(r["record_id"], r["severity"]) for r in out] == [("2", "critical")]


def test_resolution_is_the_newest_one(spark):
    ev = spark.createDataFrame([(1, "open"), (2, "open")], "event_id int, status string")
    res = spark.createDataFrame(
        [(1, "investigating", "n1", "u", 1), (1, "resolved", "n2", "v", 2)],
        "event_id int, status string, notes string, resolved_by string, resolved_at int",
    )
    rows = {r["event_id"]: r for r in ig.resolve(ev, res).collect()}
    assert (rows[1]["status"], rows[1]["resolution_notes"]) == ("resolved", "n2")
    assert (rows[2]["status"], rows[2]["resolved_by"]) == ("open", None)


def test_updates_of_unknown_ids_are_ignored(spark):
    records = spark.createDataFrame([("1", "a"), ("2", "b")], "record_id string, t string")
    updates = spark.createDataFrame([("2", "c"), ("9", "x")], "record_id string, t string")
    merged, changes = ig.apply_updates(records, updates)
    assert sorted(tuple(r) for r in merged.collect()) == [("1", "a"), ("2", "c")]
    row = changes.collect()
    assert len(row) == 1 and row[0]["changed_fields"]["t"]["new"] == "c" and row[0]["old_hash"] != row[0]["new_hash"]


def test_job_state_keeps_last_non_null(spark):
    log = spark.createDataFrame(
        [(1, 1, "pending", None), (1, 2, "running", 10), (1, 3, "running", None), (1, 4, "failed", None), (2, 1, "pending", 5)],
        "job int, moment int, status string, progress int",
    )
    rows = {r["job"]: r for r in rp.latest_state(log, "job", ["moment"], ["progress"]).collect()}
    assert (rows[1]["status"], rows[1]["progress"], rows[1]["started_at"], rows[1]["completed_at"]) == ("failed", 10, 2, 4)
    assert (rows[2]["status"], rows[2]["started_at"]) == ("pending", None)


def test_type_lists_stay_small(spark):
    records = spark.createDataFrame([(1,), (2,)], "r int")
    viol = spark.range(5000).select(F.lit(1).alias("r"), F.concat(F.lit("t"), F.col("id") % 3).alias("violation_type"))
    rows = {r["r"]: r for r in rp.records_with_violations(records, viol, "r").collect()}
    assert rows[1]["violation_count"] == 5000 and [(v["type"], v["n"]) for v in rows[1]["violation_types"]] == [("t0", 1667), ("t1", 1667), ("t2", 1666)]
    assert rows[2]["violation_count"] == 0


def test_violations_are_counted_in_finer_partitions_than_they_are_joined_in(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        records = spark.range(2000).select(F.col("id").alias("r"))
        made = spark.range(8000).select((F.col("id") % 1900).alias("r"), F.concat(F.lit("t"), F.col("id") % 3).alias("violation_type"))
        out = rp.records_with_violations(records, made.join(records, "r"), "r")
        rows = out.select("*", F.spark_partition_id().alias("part")).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # The session has 4 shuffle partitions; joined, counted and listed in the same ones, a task held all of it at once.
    assert len({r["part"] for r in rows}) > 4
    assert len(rows) == 2000 and sum(r["violation_count"] for r in rows) == 8000
    assert all((r["violation_types"] is None) == (r["r"] >= 1900) for r in rows)


def test_expectations(spark):
    df = spark.createDataFrame([(1, 5.0), (2, None), (3, 500.0)], "k int, x double")
    rows = {r["expectation"]: r for r in ig.expectations(df, 5, 10, {"x": (0, 100)}, ["x"]).collect()}
    assert rows["row_count"]["alert"] and rows["range_x"]["observed"] == 1 and rows["null_x"]["observed"] == 1


def test_record_hash_tells_borders_and_nulls_apart(spark):
    from sparkveil.functions.hashing import record_hash

    rows = [("1\u0001b\u00012", "3"), ("1", "2\u0001b\u00013"), (None, "x"), ("\u0000", "x"), ("N", "x")]
    df = spark.createDataFrame(rows, "a string, b string")
    assert df.select(record_hash(df.schema).alias("h")).distinct().count() == len(rows)


def _store(spark, tmp_path, name, rows, **kwargs):
    bl.store(spark.createDataFrame(rows, "record_id string, t string, x int"), f"{tmp_path}/{name}", **kwargs)
    return f"{tmp_path}/{name}"


def test_only_ranges_that_differ_are_read(spark, tmp_path):
    rows = [(f"r{i}", "a", i) for i in range(4000)]
    now = [(i, "z" if i == "r17" else t, x) for i, t, x in rows if i != "r99"] + [("new", None, 1), ("new", None, 1)]
    old, new = _store(spark, tmp_path, "old", rows), _store(spark, tmp_path, "new", now)
    found = bl.changes(spark, old, new).collect()
    assert sorted((r.change_type, r.record_id, r.copies) for r in found) == [("record_added", "new", 2), ("record_deleted", "r99", 1), ("record_modified", "r17", 1)]
    modified = next(r for r in found if r.record_id == "r17")
    assert {k: (v["old"], v["new"]) for k, v in modified.affected_fields.items()} == {"t": ("a", "z")}
    nodes = [r.node for r in bl.changed_ranges(spark, old, new).collect()]
    assert 1 <= len(nodes) <= 3
    scan = bl.read_ranges(spark, old, nodes)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(node" in scan or "PartitionFilters: [node" in scan
    for path in (old, new):  # what differs nowhere may be gone
        for part in (tmp_path / path).glob("records/node=*/*"):
            if int(part.parent.name.split("=")[1]) not in nodes:
                part.unlink()
    assert {(r.change_type, r.record_id) for r in bl.changes(spark, old, new).collect()} == {(r.change_type, r.record_id) for r in found}
    row = bl.report(spark, old, new).first()
    assert row.changed_ranges == len(nodes) and row.records == 8001 and row.records_read < 200


def test_equal_and_empty_baselines(spark, tmp_path):
    rows = [("a", "x", 1), ("b", None, None), ("b", None, None)]
    one, two = _store(spark, tmp_path, "one", rows), _store(spark, tmp_path, "two", rows[::-1])
    assert bl.changes(spark, one, two).count() == 0 and bl.report(spark, one, two).first().changed_ranges == 0
    none = _store(spark, tmp_path, "none", [])
    assert sorted((r.change_type, r.record_id) for r in bl.changes(spark, none, two).collect()) == [("record_added", "a"), ("record_added", "b")]
    secret = _store(spark, tmp_path, "keyed", rows, secret=b"k" * 64)
    roots = [bl.tree(spark, p).where("level = 0").first().digest for p in (one, two, secret)]
    assert roots[0] == roots[1] != roots[2]


def test_versions_and_names_of_their_time(spark):
    changes = spark.createDataFrame(
        [("r", 1, 10, "u"), ("r", 2, 20, "u"), ("r", 3, 20, "w"), ("s", 4, 5, "u"), ("s", 5, 30, None), (None, 6, 1, "u"), (None, 7, 2, "u")],
        "record string, change int, at int, user string",
    )
    names = spark.createDataFrame([("u", "Ann", 8, 1), ("u", "Anne", 20, 2), ("w", "Bob", 0, 1)], "user string, name string, since int, name_id int")
    rows = hs.record_history(changes, names, "record", "at", "change", "user").collect()
    got = {r.change: (r.version, r.valid_from, r.valid_to, r.username) for r in rows}
    assert got == {
        1: (1, 10, 20, "Ann"), 2: (2, 20, 20, "Anne"), 3: (3, 20, None, "Bob"), 4: (1, 5, 30, None), 5: (2, 30, None, None),
        6: (1, 1, 2, None), 7: (2, 2, None, None),
    }
    assert [r.change for r in rows if r.record == "r"] == [3, 2, 1]
    assert hs.record_history(changes.limit(0), names, "record", "at", "change", "user").count() == 0
