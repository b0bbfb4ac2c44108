"""Operators at the edge of capture: kernel items to events, scopes, listeners, loss payloads, settings, reports."""

from __future__ import annotations

import ipaddress
import struct
import tomllib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The items' mark, version, kinds, signals and sizes.
MAGIC, VERSION, LITTLE_ENDIAN = b"CHRN", 1, 1
KINDS = {1: "connect", 2: "connect", 3: "lifecycle", 4: "payload", 5: "payload", 6: "loss_counters"}
SIGNALS = {1: "active_established", 2: "close", 3: "reset", 4: "ambiguous", 5: "passive_established"}
HEAD, SOCKET = struct.Struct("<4sHBBI"), struct.Struct("<QQQQQII")
OBSERVATION = "kind string, problem string, ns bigint, socket_cookie bigint, first_seen_ns bigint, network_namespace bigint, cgroup_id bigint, pid bigint, tid bigint, signal string, family int, local string, remote string, payload binary"
ERROR_CODES = (
    ("marker checksum", "marker_crc"), ("record checksum", "frame_crc"), ("segment header", "header_corrupt"), ("marker version", "marker_version"), ("record version", "frame_version"),
    ("batch digest", "marker_digest"), ("marker count", "marker_reference"), ("sequence", "sequence"), ("identity", "identity"),
)


def address(raw: bytes, family: int) -> str:
    """Canonical text; an IPv4 address in IPv6 form becomes IPv4."""
    if family == 4:
        if any(raw[4:]):
            raise ValueError("padding")
        return str(ipaddress.IPv4Address(raw[:4]))
    ip = ipaddress.IPv6Address(raw)
    return str(ip.ipv4_mapped or ip)


def _endpoint(data: bytes, at: int, family: int) -> str:
    port = struct.unpack_from("<H", data, at + 16)[0]
    if not port:
        raise ValueError("port")
    host = address(data[at : at + 16], family)
    return f"[{host}]:{port}" if ":" in host else f"{host}:{port}"


def observe(item: bytes) -> dict:
    """One kernel item's columns; an item that cannot be read has a problem and no more."""
    try:
        magic, version, kind, order, size = HEAD.unpack_from(item)
        if magic != MAGIC or version != VERSION or order != LITTLE_ENDIAN or size != len(item) or kind not in KINDS:
            return {"problem": "header"}
        body = item[HEAD.size :]
        if KINDS[kind] == "loss_counters":
            return {"kind": "loss_counters", "ns": struct.unpack_from("<Q", body)[0], "payload": body}
        ns, cookie, first, namespace, cgroup, pid, tid = SOCKET.unpack_from(body)
        if not cookie or not first:
            return {"problem": "identity"}
        out = {"kind": KINDS[kind], "ns": ns, "socket_cookie": cookie, "first_seen_ns": first, "network_namespace": namespace or None, "cgroup_id": cgroup, "pid": pid, "tid": tid}
        rest = body[SOCKET.size :]
        if out["kind"] == "connect":
            out |= {"family": rest[0], "remote": _endpoint(rest, 1, rest[0]), "signal": "intent"}
            if rest[0] != (4 if kind == 1 else 6) or rest[19] != 1:
                return {"problem": "connect"}
        elif out["kind"] == "lifecycle":
            out["signal"] = SIGNALS[rest[0]]
            if out["signal"].endswith("established"):
                if rest[42] != (1 if rest[0] == 1 else 2) or len(rest) != 43:
                    return {"problem": "lifecycle"}
                out |= {"family": rest[5], "local": _endpoint(rest, 6, rest[5]), "remote": _endpoint(rest, 24, rest[5])}
        else:
            out |= {"family": rest[0], "signal": "ingress" if kind == 4 else "egress", "payload": rest[18:]}
        return out
    except (struct.error, ValueError, IndexError, KeyError):
        return {"problem": "body"}


def observations(items: DataFrame, column: str = "item") -> DataFrame:
    """Kernel items (binary) as columns, in Arrow batches."""
    fields = [c.split() for c in OBSERVATION.split(", ")]
    types = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}

    def run(batches):
        for batch in batches:
            rows = [observe(x or b"") for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], types[t]) for n, t in fields], [n for n, _ in fields])

    return items.select(column).mapInArrow(run, OBSERVATION)


def in_scope(df: DataFrame, scopes: DataFrame, cgroup: str = "cgroup_id") -> DataFrame:
    """Rows whose control group is the root or a descendant of it; group 0 is allowed while attaching."""
    allowed = scopes.select(F.col("cgroup_id").alias(cgroup)).union(scopes.sparkSession.createDataFrame([(0,)], f"{cgroup} bigint")).distinct()
    return df.join(allowed, cgroup, "left_semi")


def specified(df: DataFrame, remote: str = "remote") -> DataFrame:
    """Rows whose remote address is one."""
    return df.where(F.col(remote).isNull() | ~F.col(remote).rlike(r"^(0\.0\.0\.0|\[::\]):"))


def truncation(captured: Column, observed: Column, flagged: Column) -> Column:
    """truncated, whole, or unknown where the observed length is not known."""
    return F.when(flagged | (captured < observed), "truncated").when(observed.isNull(), "unknown").otherwise("whole")


def valid_endpoint(host: Column, port: Column) -> Column:
    """A port, and an address in its canonical text."""

    @F.pandas_udf("boolean")
    def canonical(s):  # noqa: ANN001, ANN202
        def good(x):
            try:
                return str(ipaddress.ip_address(x)) == x
            except ValueError:
                return False

        return s.map(good)

    return port.between(1, 65535) & canonical(host)


def process_scope(threads: DataFrame, recorder: int) -> DataFrame:
    """pid, scope of the processes of chosen threads, once each; the recorder itself must not be one."""
    rows = threads.select("pid", "scope").distinct()
    return rows.where(F.when(F.col("pid") == recorder, F.raise_error(F.lit("the recorder is inside its own scope")).cast("boolean")).otherwise(True))


def owned_listeners(listeners: DataFrame, sockets: DataFrame, wanted: DataFrame) -> DataFrame:
    """Listeners that a process in scope owns and that a requirement (port, family or null) asks for."""
    owned = listeners.join(sockets.select("inode").distinct(), "inode", "left_semi")
    any_family, one_family = wanted.where("family is null").select("port").distinct(), wanted.where("family is not null").select("port", "family").distinct()
    return owned.join(any_family, "port", "left_semi").unionByName(owned.join(any_family, "port", "left_anti").join(one_family, ["port", "family"], "left_semi"))


def counter_total(per_cpu: Column) -> Column:
    """The sum over processors; an overflow is an error."""
    return F.aggregate(per_cpu, F.lit(0).cast("bigint"), lambda a, x: a + x)


def outcome_ranges(rows: DataFrame, ranges: DataFrame, part: list[str], ordinal: str, size: str, ns: str) -> DataFrame:
    """part, range, records, bytes, first_ns, last_ns of the rows in each range (first, last). Rows get their range by one
    ordered pass: the latest start at or before them."""
    from pyspark.sql.window import Window as W

    starts = ranges.select(*part, F.col("first").alias(ordinal), F.struct("range", "last").alias("_range"), F.lit(0).alias("_side"))
    line = rows.withColumn("_side", F.lit(1)).unionByName(starts, allowMissingColumns=True)
    w = W.partitionBy(*part).orderBy(ordinal, "_side").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = line.withColumn("_in", F.last("_range", ignorenulls=True).over(w)).where(f"_side = 1 and {ordinal} <= _in.last")
    return placed.groupBy(*part, F.col("_in.range").alias("range")).agg(F.count("*").alias("records"), F.sum(size).alias("bytes"), F.min(ns).alias("first_ns"), F.max(ns).alias("last_ns"))


def decode_terminal_loss(payload: bytes) -> dict:
    """start and end (clock, ns), records, bytes of a terminal loss record."""
    at, out = 0, {}
    for side in ("start", "end"):
        n = struct.unpack_from("<H", payload, at)[0]
        if at + 2 + n + 8 > len(payload):
            raise ValueError("cut off")
        out[f"{side}_clock"] = payload[at + 2 : at + 2 + n].decode()
        out[f"{side}_ns"] = struct.unpack_from("<Q", payload, at + 2 + n)[0]
        at += 10 + n
    out["records"], out["bytes"], reason, unsure = struct.unpack_from("<QQBB", payload, at)
    if at + 18 != len(payload) or (reason, unsure) != (1, 1):
        raise ValueError("unknown reason or trailing bytes")
    return out


def encode_terminal_loss(loss: dict) -> bytes:
    out = b""
    for side in ("start", "end"):
        clock = loss[f"{side}_clock"].encode()
        out += struct.pack("<H", len(clock)) + clock + struct.pack("<Q", loss[f"{side}_ns"])
    return out + struct.pack("<QQBB", loss["records"], loss["bytes"], 1, 1)


def error_code(message: Column) -> Column:
    """The code of the first phrase that a message has, in order."""
    code = F.lit("other")
    for phrase, name in reversed(ERROR_CODES):
        code = F.when(message.contains(phrase), name).otherwise(code)
    return code


def setting(explicit: Column, configured: Column, environment: Column, default: Column) -> Column:
    return F.coalesce(explicit, configured, environment, default)


def recorder_config(text: str) -> dict:
    """A recorder's TOML settings with defaults; unknown names are an error."""
    defaults = {"version": 1, "max_wal_bytes": 4 << 30, "commit_bytes": 4 << 20, "commit_ms": 10, "poll_ms": 250, "batch_records": 4096}
    given = tomllib.loads(text)
    unknown = given.keys() - defaults.keys()
    if unknown or given.get("version", 1) != 1:
        raise ValueError(f"unknown settings: {sorted(unknown) or 'version'}")
    return defaults | given


def rebuild_manifest(rollup: DataFrame, old: DataFrame, segment: list[str]) -> DataFrame:
    """segment, last_committed, change (kept, updated, added): what a manifest says after a scan."""
    before = old.select(*segment, F.col("last_committed").alias("_old"))
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_old") == F.col("last_committed"), "kept").otherwise("updated")
    return rollup.join(before, segment, "left").select(*segment, "last_committed", change.alias("change"))


def rendered(df: DataFrame, text: str) -> DataFrame:
    """json and text of each row: all columns, and a line by a format of their names in braces."""
    line, rest = [], text
    while "{" in rest:
        before, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        line += [F.lit(before), F.coalesce(F.col(name).cast("string"), F.lit("-"))]
    return df.select(F.to_json(F.struct("*")).alias("json"), F.concat(*line, F.lit(rest)).alias("text"))
