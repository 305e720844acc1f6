"""Consent changes and events in one stream, over several micro-batches and in any order."""

import random

from pyspark.sql import functions as F

from sparkveil.streaming import consent, jobs

SCHEMA = "s string, id long, at timestamp, w boolean"


def _day(n, seconds=0):
    return F.timestamp_add("SECOND", F.lit(n * 86400 + seconds), F.lit("2024-01-01").cast("timestamp"))


class Feed:
    """A folder that grows by a file per micro-batch, and what the stream has said so far."""

    def __init__(self, spark, tmp_path, horizon="60 days", spread=3):
        self.spark, self.base, self.horizon, self.spread = spark, str(tmp_path), horizon, spread

    def add(self, *rows):
        df = self.spark.createDataFrame([(s, i, d, w) for s, i, d, w in rows], "s string, id long, d long, w boolean")
        at = F.timestamp_add("SECOND", (F.col("d") * 3600).cast("int"), F.lit("2024-01-01").cast("timestamp"))
        df.select("s", "id", at.alias("at"), "w").coalesce(1).write.mode("append").parquet(f"{self.base}/in")

    def run(self):
        schema = self.spark.createDataFrame([], SCHEMA).schema
        stream = jobs.file_stream(self.spark, f"{self.base}/in", schema, files_per_trigger=1)
        out = consent.decide(stream, "s", "id", "at", F.col("w"), self.horizon, self.spread)
        jobs.finish(jobs.start_table(out, f"{self.base}/out", f"{self.base}/c"))
        return self.spark.read.schema(out.schema).parquet(f"{self.base}/out")

    def latest(self):
        return {int(r.id): (r.blocked, r.revision) for r in consent.latest(self.run()).collect()}


def test_a_withdrawal_in_one_batch_blocks_the_next_and_reopens_the_last(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    feed.add(("a", 1, 1, None), ("b", 2, 1, None))
    feed.add(("a", 3, 20, None))
    assert feed.latest() == {1: (False, 0), 2: (False, 0), 3: (False, 0)}
    feed.add(("a", 100, 10, True))  # late for event 3, which is finished
    assert feed.latest() == {1: (False, 0), 2: (False, 0), 3: (True, 1), 100: (True, 0)}
    feed.add(("a", 4, 30, None), ("b", 5, 30, None))
    assert feed.latest()[4] == (True, 0) and feed.latest()[5] == (False, 0)
    feed.add(("a", 101, 15, False))  # consent was given again in between
    got = feed.latest()
    assert got[3] == (False, 2) and got[4] == (False, 1) and got[1] == (False, 0)


def test_any_order_ends_at_the_same_decisions(spark, tmp_path):
    rng = random.Random(9)
    rows = [(rng.choice("xxxyz"), i, rng.randrange(200), rng.choice((None, None, None, True, False))) for i in range(300)]
    feed, shuffled = Feed(spark, tmp_path), rows[:]
    rng.shuffle(shuffled)
    for i in range(0, 300, 60):
        feed.add(*shuffled[i:i + 60])
    got = {k: v[0] for k, v in feed.latest().items()}
    want = {}
    for s, i, d, _ in rows:
        before = [(t, w) for q, _, t, w in rows if q == s and w is not None and t <= d]
        newest = max((t for t, _ in before), default=None)
        want[i] = newest is not None and any(w for t, w in before if t == newest)
    assert got == want


def test_finished_events_are_forgotten_after_the_horizon(spark, tmp_path):
    feed = Feed(spark, tmp_path, horizon="10 hours", spread=1)
    feed.add(("a", 1, 1, None), ("a", 50, 0, False))
    feed.add(("a", 2, 100, None))
    feed.add(("a", 3, 101, None))  # the watermark is now past event 1 and its horizon
    assert feed.latest()[3] == (False, 0)
    feed.add(("a", 60, 95, True))
    got = feed.latest()
    assert got[2] == (True, 1) and got[3] == (True, 1) and got[1] == (False, 0)


def test_state_is_kept_by_a_bounded_number_of_keys(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    feed.add(*[(f"s{i}", i, 10, None) for i in range(400)], *[(f"s{i}", 1000 + i, 20, True) for i in range(0, 400, 2)])
    feed.add(*[(f"s{i}", 2000 + i, 5, True) for i in range(0, 400, 4)], (None, 3000, 5, True), ("s1", None, 30, None))
    stream = jobs.file_stream(spark, f"{feed.base}/in", spark.createDataFrame([], SCHEMA).schema, files_per_trigger=1)
    out = consent.decide(stream, "s", "id", "at", F.col("w"), "60 days", 3)
    query = jobs.start_table(out, f"{feed.base}/out", f"{feed.base}/c")
    jobs.finish(query)
    # A call per subject and part of it took most of the time; the keys do not grow with the subjects.
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress) <= consent.KEYS < 400
    got = {r.id: (r.blocked, r.revision) for r in consent.latest(spark.read.schema(out.schema).parquet(f"{feed.base}/out")).collect()}
    assert len(got) == 400 + 200 + 100 + 1 and got[None] == (False, 0)
    for i in range(400):
        assert got[str(i)] == ((True, 1) if i % 4 == 0 else (False, 0))
