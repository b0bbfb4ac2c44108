import random
import struct
import threading

import pytest
from pyspark.sql import functions as F

from flowloom.operators import capture, connections, exchanges, logs, recordings


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def item(kind, body):
    return struct.pack("<4sHBBI", b"CHRN", 1, kind, 1, 12 + len(body)) + body


def test_kernel_items(spark):
    socket = struct.pack("<QQQQQII", 9, 7, 5, 0, 3, 1, 2)
    v4 = lambda a, p: bytes(a) + bytes(12) + struct.pack("<H", p)
    mapped = bytes(10) + b"\xff\xff" + bytes([10, 0, 0, 1]) + struct.pack("<H", 80)
    items = [
        item(1, socket + b"\x04" + v4([127, 0, 0, 1], 8080) + b"\x01"), item(3, socket + b"\x01" + bytes(4) + b"\x06" + mapped + mapped + b"\x01"),
        item(5, socket + b"\x04" + bytes(17) + b"hello"), item(3, socket + b"\x02" + bytes(4)), b"junk", item(3, socket + b"\x01" + bytes(4)), item(1, bytes(48) + b"\x04"),
    ]
    df = capture.observations(spark.createDataFrame([(i,) for i in items], "item binary"))
    got = [tuple(r) for r in df.select("kind", "problem", "signal", "remote", "payload").collect()]
    assert got[0] == ("connect", None, "intent", "127.0.0.1:8080", None)
    assert got[1] == ("lifecycle", None, "active_established", "10.0.0.1:80", None)
    assert got[2][2:] == ("egress", None, b"hello") and got[3][2] == "close"
    assert [g[1] for g in got[4:]] == ["body", "body", "identity"]


def test_terminal_loss_codec():
    loss = {"start_clock": "boot", "start_ns": 1, "end_clock": "é", "end_ns": 2**63, "records": 3, "bytes": 4}
    assert capture.decode_terminal_loss(capture.encode_terminal_loss(loss)) == loss
    with pytest.raises(ValueError):
        capture.decode_terminal_loss(capture.encode_terminal_loss(loss) + b"x")


def test_scope_listeners_ranges(spark):
    df = spark.createDataFrame([(1, "10.0.0.1:1"), (0, "0.0.0.0:5"), (9, "[::]:1")], "cgroup_id bigint, remote string")
    assert rows(capture.in_scope(df, spark.createDataFrame([(1,)], "cgroup_id bigint")), "cgroup_id") == [(0,), (1,)]
    assert rows(capture.specified(df), "cgroup_id") == [(1,)]
    listeners = spark.createDataFrame([(1, 80, 4), (2, 80, 6), (3, 81, 4), (4, 82, 4)], "inode bigint, port int, family int")
    sockets = spark.createDataFrame([(1,), (2,), (3,)], "inode bigint")
    wanted = spark.createDataFrame([(80, 4), (81, None), (82, None)], "port int, family int")
    assert rows(capture.owned_listeners(listeners, sockets, wanted), "inode") == [(1,), (3,)]
    r = spark.createDataFrame([("p", i, 10, i) for i in range(10)], "part string, ordinal bigint, size bigint, ns bigint")
    spans = spark.createDataFrame([("p", "a", 2, 4), ("p", "b", 6, 6)], "part string, range string, first bigint, last bigint")
    assert rows(capture.outcome_ranges(r, spans, ["part"], "ordinal", "size", "ns"), "range", "records", "bytes", "first_ns", "last_ns") == [("a", 3, 30, 2, 4), ("b", 1, 10, 6, 6)]


def test_small_decisions(spark):
    one = spark.range(1)
    got = one.select(
        capture.truncation(F.lit(3), F.lit(5), F.lit(False)).alias("a"), capture.truncation(F.lit(3), F.lit(None).cast("int"), F.lit(False)).alias("b"), capture.error_code(F.lit("bad record checksum")).alias("c"),
        capture.setting(F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit("env"), F.lit("d")).alias("d"), capture.valid_endpoint(F.lit("::1"), F.lit(1)).alias("e"), capture.valid_endpoint(F.lit("01.2.3.4"), F.lit(1)).alias("f"),
        capture.counter_total(F.array(F.lit(1), F.lit(2))).alias("g"),
    ).first()
    assert tuple(got) == ("truncated", "unknown", "frame_crc", "env", True, False, 3)
    assert capture.recorder_config("commit_ms = 5")["commit_ms"] == 5
    with pytest.raises(ValueError):
        capture.recorder_config("speed = 1")
    r = capture.rendered(spark.createDataFrame([(1, None)], "a int, b string"), "{a} is {b}!").first()
    assert r["text"] == "1 is -!" and r["json"] == '{"a":1}'
    with pytest.raises(Exception, match="recorder"):
        capture.process_scope(spark.createDataFrame([(1, "s")], "pid int, scope string"), 1).collect()


def test_circle_of_sequences(spark):
    df = spark.createDataFrame([("a", 4294967290), ("a", 5), ("a", 20), ("b", 7), ("c", 0), ("c", 1 << 31)], "k string, s bigint")
    got = dict((r["k"], (r["start"], r["ambiguous"])) for r in connections.circular_start(df, ["k"], "s").collect())
    assert got == {"a": (4294967290, False), "b": (7, False), "c": (None, True)}
    assert spark.range(1).select(connections.wrapping_minus(F.lit(5), F.lit(4294967290)).alias("d")).first()["d"] == 11


def test_idle_gap_of_exactly_the_timeout_closes(spark):
    df = spark.createDataFrame([("c", 1, 0), ("c", 2, 299), ("c", 3, 599)], "c string, n bigint, ns bigint")
    assert rows(connections.idle_sessions(df, ["c"], [], "n", F.col("ns"), 300), "n", "session") == [(1, 0), (2, 0), (3, 1)]


def test_limits_restart_a_connection(spark):
    df = spark.createDataFrame([("c", i, z) for i, z in enumerate([4, 4, 4, 9, 20, 1])], "c string, n bigint, z bigint")
    assert rows(connections.split_at_limits(df, ["c"], "n", "z", 10, 100), "n", "incarnation", "kept") == [(0, 0, True), (1, 0, True), (2, 0, False), (3, 1, True), (4, 1, False), (5, 2, True)]


def test_interval_join_counts_a_pair_once(spark):
    a = spark.createDataFrame([("x", 1, -25, 42), ("x", 2, 100, 100)], "k string, i int, a bigint, b bigint")
    b = spark.createDataFrame([("x", 9, -30, 200), ("x", 8, 43, 99), ("x", 7, 42, 43)], "k string, j int, c bigint, d bigint")
    assert rows(connections.interval_join(a, b, ["k"], ("a", "b"), ("c", "d"), 10), "i", "j") == [(1, 7), (1, 9), (2, 9)]


def test_terminal_loss_of_another_clock(spark):
    events = spark.createDataFrame([("a", "x", 5), ("b", "y", 5), ("c", "x", 50)], "conn string, clock string, ns bigint")
    losses = spark.createDataFrame([("x", 4, 6)], "clock string, start_ns bigint, end_ns bigint")
    assert rows(connections.affected_by_terminal_loss(events, losses, ["conn"], "clock", "ns", 10), "conn") == [("a",), ("b",)]


def test_points_inside_any_span(spark):
    rng = random.Random(5)
    points = [(rng.choice("abc"), i, rng.randint(-300, 300)) for i in range(300)] + [("a", 300, None), (None, 301, 0), ("d", 302, 0), ("e", 303, 5 * 10**11), ("e", 304, 10**12 + 1), ("f", 305, 5)]
    spans = [(rng.choice("abc"), s, s + rng.choice([-5, 0, 1, 9, 40])) for s in (rng.randint(-300, 300) for _ in range(60))]
    spans += [("a", None, 500), ("a", -400, None), (None, -9, 9), ("e", -(10**12), 10**12), ("f", 5, 5)]  # one over 2 * 10**11 buckets
    want = [i for k, i, x in points if x is not None and k and any(k == o and None not in (s, t) and s <= x <= t for o, s, t in spans)]
    a, b = spark.createDataFrame(points, "k string, i int, x bigint"), spark.createDataFrame(spans, "k string, s bigint, t bigint")
    assert [r[0] for r in rows(connections.points_inside(a, b, ["k"], "x", ("s", "t"), 10), "i")] == want
    assert 50 < len(want) < 290
    assert connections.points_inside(a, b.limit(0), ["k"], "x", ("s", "t"), 10).count() == 0


def test_terminal_losses_longer_than_any_bucket(spark):
    events = spark.createDataFrame([("a", "x", 5), ("b", "x", 2 * 10**12), ("c", "x", -1)], "conn string, clock string, ns bigint")
    losses = spark.createDataFrame([("x", 0, 10**12)], "clock string, start_ns bigint, end_ns bigint")
    assert rows(connections.affected_by_terminal_loss(events, losses, ["conn"], "clock", "ns", 10), "conn") == [("a",)]


def test_terminal_losses_make_no_pairs(spark):
    n = 400_000  # all in one bucket: every second event lies in half of the losses on average, the others in none
    events = spark.range(n).selectExpr("id AS conn", "'x' AS clock", "if(id % 2 = 0, 2 * id, -1 - id) AS ns")
    losses = spark.range(n).selectExpr("'x' AS clock", "2 * id AS start_ns", f"{2 * n} AS end_ns")
    spark.sparkContext.setJobGroup("no pairs", "points in spans", True)
    late = threading.Timer(90, spark.sparkContext.cancelJobGroup, ["no pairs"])
    late.start()
    try:
        got = connections.affected_by_terminal_loss(events, losses, ["conn"], "clock", "ns", 10**7).agg(F.count("*"), F.sum("conn"), F.max(F.col("conn") % 2)).first()
    finally:
        late.cancel()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert tuple(got) == (n // 2, sum(range(0, n, 2)), 0)


def test_queue_and_rank_pairing_differ_on_an_orphan(spark):
    df = spark.createDataFrame([(1, 1, "response"), (1, 2, "request"), (1, 3, "response")], "c bigint, n bigint, kind string")
    assert rows(exchanges.pair_fifo(df, "c", "n", "kind"), "state", "request", "response") == [("orphan_response", None, 1), ("paired", 2, 3)]
    assert rows(exchanges.pair_by_rank(df, ["c"], "n", F.col("kind") == "request", F.col("kind") == "response").na.fill(-1), "request", "response") == [(-1, 3), (2, 1)]


def test_store_rules(spark):
    have = spark.createDataFrame([("k1", "d1"), ("k2", "d2")], "key string, digest string")
    new = spark.createDataFrame([("k1", "d1"), ("k2", "x"), ("k3", "d3"), ("k4", "d4")], "key string, digest string")
    got = recordings.put_if_absent(have, new, "key", "digest", spark.createDataFrame([("k4",)], "key string"))
    assert rows(got, "key", "outcome") == [("k1", "already_exists_matching"), ("k2", "conflict"), ("k3", "created"), ("k4", "conflict")]
    with pytest.raises(Exception, match="limit of 1 rows"):
        recordings.at_most(have.withColumn("p", F.lit(1)), ["p"], 1).collect()
    assert recordings.resolve(have, "k1", "key", "digest", ["key"]).count() == 1


def test_log_rules(spark):
    log = spark.createDataFrame([("r", i, "m" if i in (3, 6) else "d", 5) for i in range(9)], "r string, n bigint, k string, z bigint")
    mark = F.col("k") == "m"
    assert rows(logs.commit_batches(log, ["r"], "n", F.col("z"), mark), "marker", "records", "durable_records", "durable_bytes") == [(3, 3, 3, 15), (6, 2, 5, 25)]
    assert rows(logs.reopen_preview(log.withColumn("s", F.expr("n div 7")), ["r"], "n", F.col("z"), "s", mark), "discarded_records", "next_sequence", "removed_segments") == [(2, 7, 1)]
    batches = logs.commit_batches(log, ["r"], "n", F.col("z"), mark)
    said = batches.withColumn("durable_bytes", F.when(F.col("marker") == 6, 1).otherwise(F.col("durable_bytes")))
    assert rows(logs.check_markers(batches, said, ["r"]), "marker") == [(6,)]
