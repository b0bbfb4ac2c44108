"""Markers that disagree with the log, against a plain loop over it."""

import os

from flowloom.operators import logs
from flowloom.plans import catalog
from flowloom.plans.log_queries import events

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_wrong_markers_are_found(spark):
    want, data = [], {}
    for user, n, kind in sorted(map(tuple, events(spark, SF).select("user_id", "event_id", "event_type").collect())):
        if kind != "signup":
            data[user] = True
            continue
        # an empty batch has no first or last place to get wrong
        if n % 6 in (1, 2) or n % 6 in (3, 4) and data.get(user):
            want.append((user, n))
        data[user] = False
    got = sorted(map(tuple, catalog.QUERIES["marker_disagreements"](spark, SF).select("user_id", "marker").collect()))
    assert want and got == want


def test_markers_of_no_batch_disagree(spark):
    columns = "user_id long, marker long, durable_records long, durable_bytes long, batch_first long, batch_last long"
    batches = spark.createDataFrame([(1, 5, 3, 30, 1, 4), (2, 9, 0, 0, None, None)], columns)
    said = spark.createDataFrame([(1, 5, 3, 30, 1, 4), (2, 9, 0, 0, None, None), (1, 7, 0, 0, None, None), (3, 5, 3, 30, 1, 4)], columns)
    assert sorted(map(tuple, logs.check_markers(batches, said, ["user_id"]).collect())) == [(1, 7), (3, 5)]
