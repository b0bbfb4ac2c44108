import json
import struct

import pytest
from pyspark.sql import functions as F

from flowloom.functions import http, text
from flowloom.operators import sessions
from flowloom.sources import fixtures, log, store

REC = "00000000-0000-4000-8000-000000000001"


def test_crc32c_check_value():
    assert log.crc32c(b"123456789") == 3808858755


def test_log_round_trip_and_segments(spark, tmp_path):
    batches = [[(1, b"a" * 10), (2, b"b")], [(1, b"")], [(1, b"c" * 30), (1, b"d")]]
    log.write_log(str(tmp_path / "l"), REC, batches, per_segment=150)
    rows = [tuple(r) for r in log.read_log(spark, str(tmp_path / "l")).orderBy("sequence").select("sequence", "kind", "payload", "segment_ordinal").collect()]
    assert [r[0] for r in rows] == list(range(8))
    assert [bytes(r[2]) for r in rows if r[1] != "commit_marker"] == [b"a" * 10, b"b", b"", b"c" * 30, b"d"]
    assert len({r[3] for r in rows}) > 1
    marker = log.decode_marker(bytes(rows[-1][2]))
    assert (marker["durable_through"], marker["record_count"], marker["batch_first"], marker["batch_last"]) == (6, 5, 5, 6)
    same = [tuple(r) for r in log.read_log_files(spark, str(tmp_path / "l")).orderBy("sequence").select("sequence", "kind", "payload", "segment_ordinal").collect()]
    assert same == rows
    assert log.read_log(spark, str(tmp_path / "l")).where("sequence > 6").count() == 1


def test_log_damage(tmp_path):
    data = log.encode_segment_header(REC, 0, 0, 0) + log.encode_record(REC, 0, 1, b"xyz")
    header = log.decode_segment_header(data)
    assert len(list(log.scan_records(data[:-1], header, True))) == 0
    with pytest.raises(log.Corrupt):
        list(log.scan_records(data[:-1], header, False))
    with pytest.raises(log.Corrupt):
        list(log.scan_records(data[:-1] + b"!", header, True))
    with pytest.raises(log.Corrupt):
        list(log.scan_records(data + log.encode_record(REC, 5, 1, b""), header, True))
    with pytest.raises(log.Corrupt):
        log.decode_segment_header(b"XXXX" + data[4:64])
    with pytest.raises(log.Corrupt):
        log.decode_marker(struct.pack("<H", 2) + bytes(74))


def test_http_detection():
    assert http.detect(b"GET /a HTTP/1.1\r\n", b"") == ("confirmed", 100)
    assert http.detect(b"GET /a\r\n", b"")[0] == "rejected"
    assert http.detect(b"\x16\x03\x01", b"")[0] == "rejected"
    assert http.detect(b"GE", b"")[0] == "need_more"
    assert http.detect(b"", b"HTTP/1.1 200 OK\r\n") == ("probable", 90)
    assert http.detect(b"", b"x")[0] == "unknown"
    assert http.select_protocol([("a", "probable", 90), ("b", "confirmed", 100), ("c", "confirmed", 100), ("d", "unknown", 0)]) == "c"


@pytest.mark.parametrize("data,code", [
    (b"GET / HTTP/1.0\r\n\r\n", "unsupported_version"), (b"CONNECT a:1 HTTP/1.1\r\n\r\n", "unsupported_target"), (b"GET / HTTP/1.1\r\nUpgrade: x\r\n\r\n", "unsupported_upgrade"),
    (b"GET / HTTP/1.1\r\nTransfer-Encoding: gzip\r\n\r\n", "unsupported_transfer_encoding"), (b"GET / HTTP/1.1\r\nContent-Length: 1\r\nContent-Length: 1\r\n\r\n", "malformed"),
    (b"GET / HTTP/1.1\r\nbad header\r\n\r\n", "malformed"),
])
def test_http_refusals(data, code):
    with pytest.raises(http.Unreadable) as e:
        http.read_message(data, "request", 1)
    assert e.value.code == code


def test_http_byte_by_byte_is_the_same():
    c = b"POST /a HTTP/1.1\r\nContent-Length: 3\r\n\r\nabcHEAD /b HTTP/1.1\r\n\r\n"
    s = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n2;x\r\nhi\r\n0\r\n\r\nHTTP/1.1 200 OK\r\nContent-Length: 9\r\n\r\n"
    whole = http.operations([("client_to_server", 1, c), ("server_to_client", 2, s)])
    frames = [("client_to_server", i, c[i : i + 1]) for i in range(len(c))] + [("server_to_client", 1000 + i, s[i : i + 1]) for i in range(len(s))]
    small = http.operations(frames)
    keys = ("method", "target", "status", "request", "response")
    assert [[o.get(k) for k in keys] for o in whole] == [[o.get(k) for k in keys] for o in small]
    assert [o.get("response") for o in whole] == [b"hi", b""]
    assert whole[1]["codes"] == ["pipelined"]


def fixture(events, **more):
    conn = {"id": "c", "socket_cookie": 1, "first_seen_ns": 5, "network_namespace": None, "local_endpoint": {"host": "192.0.2.1", "port": 1}, "remote_endpoint": {"host": "192.0.2.2", "port": 2}, "role": "active", "transport": "tcp", "process": None}
    rows = [{"sequence": i + 1, "timestamp": f"2026-01-01T00:00:{i:02d}Z", "connection_id": "c", "direction": d, "payload_hex": p.hex(), "truncated": t, "flags": 0} for i, (d, p, t) in enumerate(events)]
    return {"schema_version": 1, "connections": [conn], "events": rows} | more


def test_fixture_to_inspection(spark, tmp_path):
    c, s = "client_to_server", "server_to_client"
    for name, doc in {
        "good": fixture([(c, b"GET /x HTT", False), (c, b"P/1.1\r\n\r\n", False), (s, b"HTTP/1.1 200 OK\r\nContent-Length: 2\r\n\r\nOK", False)]),
        "cut": fixture([(c, b"POST /t HTTP/1.1\r\nContent-Length: 4\r\n\r\nab", True)]),
        "alone": fixture([(c, b"DELETE /t HTTP/1.1\r\n\r\n", False)]),
        "other": fixture([(c, b"GET /t\r\n", False)]),
    }.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(doc))
    rows = fixtures.read_fixtures(spark, str(tmp_path / "*.json"))
    assert fixtures.problems(rows).count() == 0
    ops = sessions.from_fixtures(rows).cache()
    got = {r["fixture"]: (r["method"], r["effect"], r["completeness"]) for r in ops.collect()}
    assert got == {"good": ("GET", "read", "complete"), "cut": (None, "unknown", "incomplete"), "alone": ("DELETE", "write", "unmatched"), "other": (None, "unknown", "unsupported")}
    seen = {r["fixture"]: (r["replayability"], r["blockers"]) for r in sessions.inspect(ops, ["fixture"], "connection_id").collect()}
    assert seen["good"] == ("fully_replayable", "") and seen["alone"] == ("not_replayable", "unmatched")
    times = sessions.timeline(ops, ["fixture"], "connection_id")
    conns = fixtures.connections(rows).select("fixture", F.col("id").alias("connection_id"))
    assert sessions.violations(conns, ops, times, ["fixture"], "connection_id").count() == 0
    assert sessions.violations(conns, ops, times.limit(0), ["fixture"], "connection_id").count() == 4


def test_fixture_problems(spark, tmp_path):
    bad = fixture([("client_to_server", b"a", False), ("client_to_server", b"b", False)], schema_version=2)
    bad["events"][1] |= {"sequence": 3, "timestamp": "2025-01-01T00:00:00Z", "payload_hex": "abc", "connection_id": "nobody"}
    bad["connections"][0]["transport"] = "udp"
    (tmp_path / "bad.json").write_text(json.dumps(bad))
    got = {r["problem"] for r in fixtures.problems(fixtures.read_fixtures(spark, str(tmp_path / "bad.json"))).collect()}
    assert got == {"schema_version", "sequence", "timestamp", "payload", "unknown_connection", "transport_or_role"}


def test_publish_once(spark, tmp_path):
    df = spark.createDataFrame([("s", 1, b"x"), ("s", 2, b""), ("s", 3, b"x")], "session string, n int, response binary")
    named, payloads = store.externalize(df, ["session"], "response")
    assert payloads.count() == 1
    back = store.hydrate(named, payloads, ["session"], "response").orderBy("n").collect()
    assert [bytes(r["response"]) for r in back] == [b"x", b"", b"x"]
    path = str(tmp_path / "session")
    assert store.publish(df, path) == "created"
    assert store.publish(df, path) == "already_published"
    with pytest.raises(FileExistsError):
        store.publish(df.limit(1), path)
    assert store.summaries(spark, path, ["session"], 5).first()["operation_count"] == 3


def test_text_functions(spark):
    df = spark.createDataFrame([("a\u0007b\u0085", "http://127.0.0.1:80/", "  1: 0100007F:1F90 00000000:0000 0A 0:0 0:0 0 0 0 4242 1")], "t string, o string, l string")
    r = df.select(text.escape_control(F.col("t")).alias("t"), text.loopback_origin(F.col("o")).alias("o"), text.loopback_origin(F.lit("http://10.0.0.1:80")).alias("p"), text.listener(F.col("l")).alias("l"), text.parse_duration(F.lit("99999999999999999999s")).alias("d"), text.parse_duration(F.lit("0s")).alias("z"), text.safe_relative_path(F.lit("a/../b")).alias("s"), text.decode_hex(F.lit("abc")).alias("h")).first()
    assert r["t"] == "a\\u{7}b\\u{85}" and tuple(r["o"]) == ("127.0.0.1", 80) and r["p"] is None
    assert tuple(r["l"]) == ("127.0.0.1", 8080, 4242)
    assert r["d"] is None and r["z"] is None and r["s"] is False and r["h"] is None
