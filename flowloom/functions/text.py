"""Scalar functions on text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UUID = "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
# Milliseconds of the units of a duration.
UNITS = {"": 1_000, "s": 1_000, "ms": 1, "m": 60_000, "h": 3_600_000, "d": 86_400_000}


def escape_control(text: Column) -> Column:
    """Control characters as \\u{hex}."""
    def one(c: Column) -> Column:
        code = F.ascii(c)
        # ascii() gives a character's code point
        return F.when((code < 32) | ((code >= 127) & (code < 160)), F.concat(F.lit("\\u{"), F.lower(F.hex(code)), F.lit("}"))).otherwise(c)

    changed = F.array_join(F.transform(F.split(text, ""), one), "")
    return F.when(text.rlike(r"[\x00-\x1f\x7f-\x9f]"), changed).otherwise(text)


def parse_id(text: Column, prefix: str) -> Column:
    """The id behind an optional lower-case prefix, in its canonical form, or null."""
    bare = F.when(text.startswith(prefix), F.substr(text, F.lit(len(prefix) + 1))).otherwise(text)
    return F.when(F.lower(bare).rlike(f"^{UUID}$"), F.lower(bare))


def format_id(ident: Column, prefix: str) -> Column:
    return F.concat(F.lit(prefix), ident)


def valid_name(name: Column) -> Column:
    """1 to 128 bytes, no ASCII control characters, not a reserved word or prefix."""
    return F.octet_length(name).between(1, 128) & ~name.rlike(r"[\x00-\x1f\x7f]") & (name != "latest") & ~name.startswith("rec_")


def parse_duration(text: Column) -> Column:
    """Milliseconds of digits and a unit; null if it is none, zero, or does not fit."""
    trimmed = F.trim(text)
    number, unit = F.regexp_extract(trimmed, r"^(\d+)(.*)$", 1), F.regexp_extract(trimmed, r"^(\d+)(.*)$", 2)
    scale = F.when(unit == "", UNITS[""])
    for name, ms in UNITS.items():
        if name:
            scale = scale.when(unit == name, ms)
    ms = F.try_multiply(F.when(number != "", number).try_cast("bigint"), scale.cast("bigint"))
    return F.when(ms > 0, ms)


def format_millis(ms: Column) -> Column:
    """Seconds, rounded up, with minutes if there are any."""
    seconds = F.floor((ms + 999) / 1000)
    return F.when(seconds < 60, F.concat(seconds.cast("string"), F.lit("s"))).otherwise(F.concat(F.floor(seconds / 60).cast("string"), F.lit("m "), (seconds % 60).cast("string"), F.lit("s")))


def millis_between(start: Column, end: Column) -> Column:
    """Whole milliseconds from start to end, 0 at least."""
    return F.greatest(F.floor((F.unix_micros(end) - F.unix_micros(start)) / 1000), F.lit(0)).cast("bigint")


def decode_hex(text: Column) -> Column:
    """Bytes of an even number of hexadecimal digits, else null."""
    return F.when(text.rlike("^([0-9a-fA-F]{2})*$"), F.unhex(text))


def digest(data: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(data, 256))


def content_uuid(domain: str, *parts: Column) -> Column:
    """An id that follows from content: equal parts give equal ids. Version 8, variant 1."""
    h = F.sha2(F.concat_ws("\x1f", F.lit(domain), *[p.cast("string") for p in parts]), 256)
    third = F.concat(F.lit("8"), F.substring(h, 14, 3))
    fourth = F.concat(F.lit("8"), F.substring(h, 18, 3))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), third, fourth, F.substring(h, 21, 12))


def safe_key(key: Column, parts: int = 4) -> Column:
    """So many parts between slashes, none empty or leading upwards, no backslash."""
    pieces = F.split(key, "/")
    return (F.size(pieces) == parts) & F.forall(pieces, lambda p: (p != "") & (p != ".") & (p != "..")) & ~key.contains("\\")


def safe_relative_path(path: Column) -> Column:
    return (path != "") & ~path.startswith("/") & ~path.contains("\\") & F.forall(F.split(path, "/"), lambda p: (p != "") & (p != ".") & (p != ".."))


def loopback_origin(text: Column) -> Column:
    """struct(host, port) of http://loopback-address:port, or null."""
    pattern = r"^http://(127(?:\.(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)){3}|\[::1\]|\[(?:0{1,4}:){7}0{0,3}1\]):(\d{1,5})/?$"
    host, port = F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2).try_cast("int")
    return F.when(port.between(1, 65535), F.struct(F.when(host.startswith("["), "::1").otherwise(host).alias("host"), port.alias("port")))


def _six(raw: Column) -> Column:
    """The text of an IPv6 address from a socket table's four little-endian words: the first of the longest runs of two or
    more zeros is left out, an IPv4 address inside is written as one."""
    byte = lambda n: F.substring(raw, 8 * (n // 4) + 7 - 2 * (n % 4), 2)
    groups = [F.lower(F.conv(F.concat(byte(2 * i), byte(2 * i + 1)), 16, 16)) for i in range(8)]
    whole, short = F.concat_ws(":", *groups), None
    for n in range(8, 1, -1):
        pattern = f"^(.*?)(?:^|:)0(?::0){{{n - 1}}}(?:$|:)(.*)$"
        cut = F.regexp_replace(whole, pattern, "$1::$2")
        short = F.when(whole.rlike(pattern), cut) if short is None else short.when(whole.rlike(pattern), cut)
    four = F.concat_ws(".", *[F.conv(byte(i), 16, 10) for i in range(12, 16)])
    return F.when(whole.startswith("0:0:0:0:0:ffff:"), F.concat(F.lit("::ffff:"), four)).otherwise(short.otherwise(whole))


def listener(line: Column) -> Column:
    """struct(address, port, inode) of a listening IPv4 or IPv6 socket's line in a kernel socket table, or null."""
    f = F.split(F.trim(line), r"\s+")
    local = F.split(F.get(f, F.lit(1)), ":")
    raw = F.get(local, F.lit(0))
    octet = lambda i: F.conv(F.substring(raw, i, 2), 16, 10)  # noqa: E731  little-endian
    four = F.concat_ws(".", octet(7), octet(5), octet(3), octet(1))
    shape = line.rlike(r"^\s*\d+: (?:[0-9A-F]{8}|[0-9A-F]{32}):[0-9A-F]{4} ") & (F.get(f, F.lit(3)) == "0A") & (F.size(f) > 9)
    address = F.when(F.length(raw) == 8, four).otherwise(_six(raw))
    return F.when(shape, F.struct(address.alias("address"), F.conv(F.get(local, F.lit(1)), 16, 10).cast("int").alias("port"), F.get(f, F.lit(9)).cast("long").alias("inode")))
