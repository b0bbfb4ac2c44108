"""Operators of recovery and views on small tables: odd rows, empty tables, and what SQL does not see."""

from pyspark.sql import functions as F

from flowloom.functions.text import loopback_origin
from flowloom.operators import connections, logs, recordings, recovery, views


def log(spark, rows):
    return spark.createDataFrame(rows, "id int, n long, kind string, size long, segment int")


def snapshot(df):
    return recovery.committed_snapshot(df, ["id"], "n", "size", F.col("kind") == "m", "segment", ["kind", "size"])


def test_snapshot_digests(spark):
    rows = [(1, 1, "d", 10, 0), (1, 2, "d", 20, 0), (1, 3, "m", 5, 1), (1, 4, "d", 7, 1), (2, 1, "d", 1, 0)]
    (one,) = snapshot(log(spark, rows)).collect()
    assert (one["id"], one["marker"], one["records"], one["bytes"], one["first_segment"], one["last_segment"]) == (1, 3, 2, 30, 0, 1)
    (again,) = snapshot(log(spark, rows[::-1]).repartition(3)).collect()
    assert again == one  # no order
    (later,) = snapshot(log(spark, [*rows[:3], (1, 4, "d", 8, 1)])).collect()
    assert later["input_digest"] == one["input_digest"]  # what is not committed does not count
    (other,) = snapshot(log(spark, [(1, 1, "d", 20, 0), (1, 2, "d", 10, 0), *rows[2:]])).collect()
    assert other["input_digest"] != one["input_digest"] and other["marker_digest"] == one["marker_digest"]
    assert snapshot(log(spark, [])).count() == 0


def test_repair_keeps_damage_in_other_segments(spark):
    df = log(spark, [(1, 0, "d", 4, 0), (1, 50, "d", 4, 0), (1, 0, "d", 4, 1), (1, 50, "d", 4, 1)])
    tails = spark.createDataFrame([(1, 40)], "id int, tail_offset long")
    kept, report = recovery.repair_tail(df, tails, ["id"], "segment", "n", "size")
    assert sorted((r["segment"], r["n"]) for r in kept.collect()) == [(0, 0), (0, 50), (1, 0)]
    assert [tuple(r) for r in report.collect()] == [(1, 40, 4)]


def test_quota_pressure_by_headroom(spark):
    rows = [(100, 0, 50, 100, 0, "none"), (99, 0, 50, 100, 0, "recoverable"), (150, 51, 50, 100, 0, "recoverable"), (150, 50, 50, 100, 99, "none"), (10, 5, 50, 100, 51, "terminal"), (10, 5, 50, 100, 50, "recoverable")]
    df = spark.createDataFrame(rows, "free long, reserved long, quota long, least long, managed long, want string")
    got = df.select(recordings.quota_pressure(*[F.col(c) for c in ("free", "reserved", "quota", "least", "managed")]).alias("got"), "want").collect()
    assert all(r["got"] == r["want"] for r in got)


def test_reconciled_status(spark):
    rows = [(True, False, True, None, "published"), (True, True, True, None, "inconsistent"), (False, True, True, "published", "inconsistent"), (False, True, True, "failed", "recoverable"), (False, False, False, "failed", "failed"), (False, False, False, None, "in_progress")]
    df = spark.createDataFrame(rows, "published boolean, incomplete boolean, present boolean, advisory string, want string")
    got = df.select(recordings.reconcile_status(*[F.col(c) for c in ("published", "incomplete", "present", "advisory")]).alias("got"), "want").collect()
    assert all(r["got"] == r["want"] for r in got)


def test_empty_fragments_overlap_with_nothing(spark):
    df = spark.createDataFrame([(1, 1, 100, 50), (1, 2, 120, 0), (1, 3, 140, 20), (1, 4, 4294967290, 120)], "c int, p int, s long, n long")
    got = {(r["first"], r["second"]) for r in connections.overlaps(df, ["c"], "p", "s", "n").collect()}
    assert got == {(1, 3), (1, 4)}


def test_lag_counts_committed_data_alone(spark):
    rows = [(1, n, kind, 10, created, committed) for n, kind, created, committed in [(1, "d", 1000, True), (2, "m", 1000, True), (3, "d", 5000, True), (4, "m", 5000, True), (5, "d", 9000, False)]]
    df = spark.createDataFrame(rows, "id int, n long, kind string, size long, created long, committed boolean")
    lag = lambda cursor: tuple(logs.lag_report(df, ["id"], "n", F.col("size"), F.col("kind") == "m", F.col("committed"), F.col("created"), F.lit(cursor), F.lit(12_345)).first())
    assert lag(2) == (1, 1, 10, 7) and lag(4) == (1, 0, 0, 0)


def test_counts_below_are_ranks(spark):
    points = spark.createDataFrame([("a", x) for x in (-25, 0, 7, 10, 10, 31)] + [("b", 5)], "k string, x long")
    values = spark.createDataFrame([("a", x) for x in (-30, -25, 3, 10, 10, 30, 99)], "k string, y long")
    got = sorted(tuple(r) for r in connections.counts_below(points, values, ["k"], "x", "y", 10).collect())
    plain = [-30, -25, 3, 10, 10, 30, 99]
    assert got == sorted([("a", x, sum(y < x for y in plain)) for x in (-25, 0, 7, 10, 10, 31)] + [("b", 5, 0)])


def test_list_of_a_recording_without_end(spark):
    entries = spark.createDataFrame([(1, "x", 5, "published", 7), (2, None, 5, "in_progress", None), (3, "z", 9, "published", 8)], "recording_id int, name string, created_at long, status string, session_id int")
    at = "timestamp'2020-01-01 00:00:02'"
    summaries = spark.sql(f"SELECT 1 AS recording_id, {at} AS started_at, CAST(NULL AS TIMESTAMP) AS ended_at, 4 AS operation_count UNION ALL SELECT 3, {at}, timestamp'2020-01-01 00:00:01', 6 UNION ALL SELECT 2, {at}, {at}, 9")
    got = [(r["recording_id"], r["duration_ms"], r["sessions"], r["operations"]) for r in views.list_recordings(entries, summaries).collect()]
    assert got == [(3, 0, 1, 6), (2, None, 0, 0), (1, None, 1, 4)]


def test_loopback_addresses_are_addresses(spark):
    wanted = {"http://127.0.0.1:80": ("127.0.0.1", 80), "http://127.255.0.9:1/": ("127.255.0.9", 1), "http://[::1]:9": ("::1", 9), "http://[0:0:0:0:0:0:0:1]:9": ("::1", 9)}
    wanted |= dict.fromkeys(["http://127.999.1.1:80", "http://127.0.0.01:80", "http://128.0.0.1:80", "http://127.0.0.1:0", "http://127.0.0.1:65536", "http://[::2]:9", "https://127.0.0.1:80"])
    df = spark.createDataFrame([(t,) for t in wanted], "t string")
    got = {r["t"]: r["o"] and tuple(r["o"]) for r in df.select("t", loopback_origin(F.col("t")).alias("o")).collect()}
    assert got == wanted
