import hashlib
import math
import os

from pyspark.sql import functions as F, types as T

from sparkveil import schemas as sc
from sparkveil.functions import text as tx
from sparkveil.operators import compliance as co, generate as gen
from sparkveil.sources import files, rejects, sinks, topics


def test_load_with_matching_header(spark, tmp_path):
    path = tmp_path / "customers.csv"
    path.write_text("email,id,name,phone,address,date_of_birth,created_at,updated_at\na@b.cc,1,Ann,,x,1990-02-03,2024-01-01 10:00:00,bad\n")
    df, report = files.load_checked(spark, str(path))
    assert report.matched and report.schema_name == "customer" and df.columns == sc.CUSTOMER.names
    row = df.first()
    assert str(row["date_of_birth"]) == "1990-02-03" and row["updated_at"] is None and row["phone"] is None


def test_load_with_other_header(spark, tmp_path):
    path = tmp_path / "payment.csv"
    path.write_text("id,account_number,colour\n1,A,red\n")
    df, report = files.load_checked(spark, str(path))
    assert not report.matched and "colour" in report.extra and "location" in report.missing and df.count() == 1
    other = tmp_path / "misc.csv"
    other.write_text("a,b\n1,2\n")
    assert files.load_checked(spark, str(other))[1].schema_name is None


def test_coercion_and_nan(spark):
    df = spark.createDataFrame([("2024-01-02 03:04:05", "True"), ("never", "no"), (None, None)], "timestamp string, has_violation string")
    rows = files.coerce(df).collect()
    assert [r["has_violation"] for r in rows] == [True, False, False]
    assert rows[0]["timestamp"].hour == 3 and rows[1]["timestamp"] is None
    cleaned = files.nan_to_null(spark.createDataFrame([(math.nan, "NaN"), (1.0, "x")], "x double, t string")).collect()
    assert [tuple(r) for r in cleaned] == [(None, None), (1.0, "x")]


def test_misaligned_runs_are_kept_apart(spark, tmp_path):
    for i, body in enumerate(("a,b\n1,2\n3,4\n", "a,b\n5,6\n7,8,9\n")):
        folder = tmp_path / f"x-run-{i}"
        folder.mkdir()
        (folder / "r.csv").write_text(body)
    good, bad = files.read_runs(spark, str(tmp_path), "r.csv", T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType())]))
    assert sorted((r["run"], r["a"]) for r in good.collect()) == [("x-run-0", 1), ("x-run-0", 3), ("x-run-1", 5)]
    assert [(r["run"], r["_corrupt_record"]) for r in bad.collect()] == [("x-run-1", "7,8,9")]


def test_fingerprints_equal_hashlib(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(os.urandom(300_000))
    (tmp_path / "b.bin").write_bytes(b"x")
    rows = {os.path.basename(r["path"]): r for r in files.fingerprints(spark, str(tmp_path), chunk_bytes=1000).collect()}
    for name, row in rows.items():
        data = (tmp_path / name).read_bytes()
        assert row["file_hash"] == hashlib.sha256(data).hexdigest() and row["length"] == len(data)
    assert len(rows) == 2


def test_cleaning_goes_through_nested_values(spark):
    schema = "m map<string, double>, a array<double>, s struct<t: string, x: double>, d date"
    df = spark.createDataFrame([({"k": math.inf}, [1.0, math.nan], ("nan", 2.0), None), (None, None, None, None)], schema)
    rows = sinks.clean_records(df).collect()
    assert rows[0]["m"] == {"k": None} and rows[0]["a"] == [1.0, None] and tuple(rows[0]["s"]) == (None, 2.0)
    assert rows[1]["s"] is None


def test_json_lines_and_stored_names(spark):
    df = spark.createDataFrame([(1, math.nan, None)], "k int, x double, t string")
    assert sinks.to_json_lines(df).first()["value"] == '{"k":1,"x":null,"t":null}'
    name = spark.range(1).select(files.stored_name(F.lit("a.csv"), F.lit("2024-01-02 03:04:05").cast("timestamp")).alias("n")).first()["n"]
    assert name == "20240102_030405_a.csv"


def test_column_roles_of_the_generated_sets(spark):
    base = F.lit("2024-01-01 00:00:00").cast("timestamp")
    df = gen.records(spark, "ecommerce", 500, base)
    plain, aliased = (df.select(co.violation_count(df, "ecommerce", aliases=a).alias("n")).agg(F.sum("n")).first()[0] for a in (None, sc.ALIASES["ecommerce"]))
    assert aliased == plain + df.filter("NOT consent_marketing").count()


def test_messages_survive_the_round_trip(spark):
    df = spark.createDataFrame([(1, "a\"b", None), (2, None, 2.5)], "id int, t string, x double")
    back = topics.parse(topics.as_messages(df), df.schema)
    assert sorted(tuple(r)[:3] for r in back.collect()) == sorted(tuple(r) for r in df.collect())
    broken = topics.parse(spark.createDataFrame([("{oops",)], "value string"), df.schema).first()
    assert broken["_unreadable"] == "{oops"


def test_experiment_log_defaults(spark):
    runs = spark.createDataFrame([("e", 2.0, 4.0, 1000), ("z", 0.0, 1.0, 0)], "experiment_id string, pure_processing_time_seconds double, total_time_seconds double, records_processed long")
    out = sinks.experiment_log(runs)
    assert len(out.columns) == 34
    rows = {r["experiment_id"]: r for r in out.collect()}
    assert (rows["e"]["records_per_second"], rows["e"]["avg_latency_ms"], rows["e"]["max_latency_ms"], rows["e"]["e2e_latency_ms"]) == (500.0, 2.0, 2.0, 4.0)
    assert rows["z"]["records_per_second"] == 0.0 and rows["z"]["success"] is True


def test_text_patterns_read_whole_texts(spark):
    far = "word " * 30000 + "call (555) 123-4567 or a@b.org, card 4000-1234-5678-9010"
    df = spark.createDataFrame([(1, far), (2, None)], "k int, t string")
    row = tx.scan(df, "t", ["k"]).orderBy("k").collect()
    assert (row[0]["phone_hits"], row[0]["email_hits"], row[0]["credit_card_hits"], row[1]["phone_hits"]) == (1, 1, 1, 0)
    masked = df.select(tx.mask(F.col("t")).alias("m")).first()["m"]
    assert masked.endswith("call [PHONE] or [EMAIL], card [CREDIT_CARD]")


def test_generated_records_violate_at_the_planted_rate(spark):
    base = F.lit("2024-01-01 00:00:00").cast("timestamp")
    for kind, rules, rate in (("healthcare", "healthcare", 0.2), ("ecommerce", "ecommerce", 0.1), ("iot", "iot", 0.15)):
        df = gen.records(spark, kind, 4000, base)
        if kind == "healthcare":
            df = df.drop("medical_record_number")  # exposed in every record
        if kind == "iot":
            df = df.drop("data_retention_days")
        flags = df.select("has_violation", co.violates(df, rules).alias("found"))
        assert flags.filter("has_violation <> found").count() <= 2
        assert abs(flags.filter("has_violation").count() / 4000 - rate) < 0.03
    assert len(gen.records(spark, "setup_healthcare", 1, base).columns) == 22
    assert len(gen.records(spark, "setup_financial", 1, base).columns) == 21


def test_generation_does_not_depend_on_partitions(spark):
    base = F.lit("2024-01-01 00:00:00").cast("timestamp")
    once = gen.financial(spark.range(0, 500, 1, 1), "id", base)
    again = gen.financial(spark.range(0, 500, 1, 7), "id", base)
    assert once.exceptAll(again).count() == 0 and once.select("id").distinct().count() == 500


def test_schema_of_generated_records_is_the_declared_one(spark):
    base = F.lit("2024-01-01 00:00:00").cast("timestamp")
    assert sorted(gen.records(spark, "healthcare", 1, base).columns) == sorted(sc.HEALTHCARE.names)
    assert set(sc.FINANCIAL.names) <= set(gen.records(spark, "financial", 1, base).columns)


def test_text_email_pattern_finds_what_the_rule_pattern_finds(spark):
    """The scan form of the pattern against the plain one, on random texts full of near misses."""
    import random
    import re

    from sparkveil.functions.patterns import EMAIL

    rng = random.Random(11)
    texts = ["".join(rng.choice("ab.@@-_1 \n%Zx") for _ in range(rng.randrange(1, 120))) for _ in range(3000)]
    texts += ["a@b.com.x@y.org", "x" * 50000 + " a@b.cc", "me@host.tld@other.net", "@a.bc a@b.c1 a@b.cde."]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = {}
    for r in tx.matches(df, "t", ["k"]).filter("pattern = 'email'").collect():
        got.setdefault(r["k"], []).append(r["value"])
    counts = {r["k"]: r["email_hits"] for r in tx.scan(df, "t", ["k"]).collect()}
    for k, t in enumerate(texts):
        expected = re.findall(EMAIL, t)
        assert sorted(got.get(k, [])) == sorted(expected) and counts[k] == len(expected), t


def test_late_misfits_are_read_and_rejects_are_listed(spark, tmp_path):
    from sparkveil import schemas as sc
    from sparkveil.sources import files

    path = tmp_path / "late.csv"
    path.write_text("a\n" + "\n".join(map(str, range(3000))) + "\n12.75\nn/a\n")
    values = {r.a for r in files.read_csv(spark, str(path)).collect()}
    assert {"12.75", "n/a", "7"} <= values
    schema = sc.Schema("s", "generic", (sc.Field("n", "int"), sc.Field("t")))
    df = spark.createDataFrame([("5", "x"), ("five", "y"), (None, None)], "n string, t string")
    rows = files.conform(df, schema, rejects="bad").collect()
    assert [r.n for r in rows] == [5, None, None]
    assert [[(x.column, x.value) for x in r.bad] for r in rows] == [[], [("n", "five")], []]


def test_load_lists_misfits_and_torn_lines(spark, tmp_path):
    path = tmp_path / "customers.csv"
    head = "email,id,name,phone,address,date_of_birth,created_at,updated_at\n"
    path.write_text(head + "a@b.cc,1,Ann,,x,1990-02-03,2024-01-01 10:00:00,bad\nshort,2\na@b.cc,,B,,x,never,,\na,3,b,c,d,,,,too,many\n")
    df, report = files.load_checked(spark, str(path))
    assert df.count() == 2 and [r.id for r in df.orderBy("name").collect()] == ["1", None]
    found = {(r.key, r.column, r.value, r.reason) for r in report.rejects.collect()}
    assert found == {
        ("1", "updated_at", "bad", "not a timestamp"), (None, "date_of_birth", "never", "not a date"), (None, "id", None, "missing"),
        (None, None, "short,2", "number of fields"), (None, None, "a,3,b,c,d,,,,too,many", "number of fields"),
    }
    assert {(r.column, r.reason, r.rejects) for r in report.counts.collect()} >= {(None, "number of fields", 2), ("id", "missing", 1)}
    assert {r.file.rsplit("/", 1)[1] for r in report.rejects.collect()} == {"customers.csv"}
    totals = rejects.totals(report.tagged).first()
    assert (totals.records, totals.rejected_records, totals.rejects) == (4, 4, 5)
    assert files.conform(spark.createDataFrame([("maybe",), ("0",), ("",)], "f string"), sc.Schema("s", "generic", (sc.Field("f", "boolean"),)), "bad").collect()[0].bad[0].value == "maybe"


def test_fields_of_another_kind_are_told_from_absent_ones(spark):
    schema = T.StructType.fromDDL("a int, b string, t timestamp, f boolean, d double, n struct<x: int, l: array<int>>, m map<string,int>, k bigint NOT NULL")
    cases = [
        ('{"a":1,"b":"x","t":"2024-01-01T10:00:00","f":true,"d":1.5,"k":1}', []),
        ('{"k":2}', []),
        ('{"a":null,"n":null,"k":3}', []),
        ('{"a":1.5,"b":5,"t":7,"f":"maybe","d":"n/a","k":4}', [("a", "1.5"), ("t", "7"), ("f", "maybe"), ("d", "n/a")]),
        ('{"a":"7","f":1,"d":"2.5","k":5}', []),
        ('{"a":12345678901,"d":true,"k":6}', [("a", "12345678901"), ("d", "true")]),
        ('{"n":{"x":"q","l":[1,"u",3]},"m":{"p":1,"q":"z"},"k":7}', [("n.x", "q"), ("n.l[1]", "u"), ("m.q", "z")]),
        ('{"n":5,"m":[1],"k":8}', [("n", "5"), ("m", "[1]")]),
        ('{"a":3.0,"d":1e400,"k":9}', [("d", None)]),
        ('{"a":1}', [("k", None)]),
        ("nope", [(None, "nope")]), ("[1]", [(None, "[1]")]), (None, [(None, None)]), ('{"k":1,"k":2}', [(None, '{"k":1,"k":2}')]),
    ]
    df = spark.createDataFrame([(i, d) for i, (d, _) in enumerate(cases)], "o int, value string")
    rows = topics.parse(df, schema, keep=("o",)).orderBy("o").collect()
    for row, (text, want) in zip(rows, cases):
        got = [(x.column, x.value if x.column != "d" or "e400" not in text else None) for x in row["_rejects"]]
        assert sorted(got, key=str) == sorted(want, key=str), text
    assert rows[0].a == 1 and rows[0].t.hour == 10 and rows[4].a == 7 and rows[4].f is True and rows[4].d == 2.5 and rows[8].a == 3
    assert rows[6].n.l == [1, None, 3] and rows[6].m == {"p": 1, "q": None} and rows[3].b == "5"
    assert [r["_unreadable"] for r in rows][-4:] == ["nope", "[1]", None, '{"k":1,"k":2}']
