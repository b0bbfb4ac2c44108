"""Queries over whole tables, held against plain loops over all rows."""

import os

import pytest
from pyspark.sql import functions as F

from flowloom.plans import catalog, connection_queries
from flowloom.plans.log_queries import events

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def log(spark):
    """event_id, user_id, event_type, us of all events."""
    return [tuple(r) for r in events(spark, SF).select("event_id", "user_id", "event_type", "us").collect()]


def windows(log):
    """clock, end clock, start, end, known, reason of the loss window that every event gives."""
    reasons = ["counter regressed", "new generation", "unreadable", None]
    return [(kind, "other" if n % 11 == 0 else kind, us, us + n % 50 * connection_queries.HOUR, n % 3 != 0, reasons[n % 4]) for n, _, kind, us in log]


def test_loss_join_over_all_events(spark, log):
    assert connection_queries.losses(spark, SF).count() == len(log)
    users = {}
    for _, user, kind, us in log:
        a, b = users.setdefault(user, {}).get(kind, (us, us))
        users[user][kind] = min(a, us), max(b, us)
    names = ["overlaps", "outside", "unknown", "reset", "clock_mismatch"]
    for row in catalog.QUERIES["interval_loss_join"](spark, SF).collect():
        want = dict.fromkeys(names, 0)
        for clock, other, s, t, known, reason in windows(log):
            if clock != other:
                k = "clock_mismatch"
            elif not known:
                k = "reset" if reason and ("generation" in reason or "regressed" in reason) else "unknown"
            elif clock not in users[row["user_id"]]:
                k = "clock_mismatch"
            else:
                a, b = users[row["user_id"]][clock]
                k = "outside" if t < a or s > b else "overlaps"
            want[k] += 1
        assert [row[k] for k in names] == [want[k] for k in names]
        assert sum(want.values()) == len(log)


def test_points_in_all_loss_windows(spark, log):
    clicks = [(s, t) for clock, _, s, t, _, _ in windows(log) if clock == "click"]
    want = {user for _, user, kind, us in log if kind == "click" and any(s <= us <= t for s, t in clicks)}
    got = [r["user_id"] for r in catalog.QUERIES["point_in_interval_semi"](spark, SF).collect()]
    assert sorted(got) == sorted(want)


def test_catalog_has_all_orders(spark):
    orders = spark.read.parquet(f"{SF}/orders.parquet").select((F.col("o_custkey") + 500).alias("k")).distinct()
    want = {r["k"] for r in orders.collect()}
    got = catalog.QUERIES["catalog_full_outer"](spark, SF).where(F.col("found_in").contains("0")).collect()
    assert sorted(r["recording_id"] for r in got) == sorted(want)
