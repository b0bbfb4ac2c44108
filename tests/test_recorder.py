"""The recorder's decisions, against plain loops and on odd rows."""

import random

from pyspark.sql import functions as F

from flowloom.functions import text
from flowloom.operators import recorder


def test_due_samples_as_a_loop(spark):
    r = random.Random(3)
    rows = [(p, r.choice([None, r.randrange(400)]), 5) for p in (1, 2, 3) for _ in range(150)] + [(4, 7, 5), (None, 300, 5)]
    want = []
    for part in (1, 2, 3, 4, None):
        due = 5 + 20
        for at in sorted(t for p, t, _ in rows if p == part and t is not None):
            if at >= due:
                want.append((part, at))
                due = at + 20
    polls = spark.createDataFrame(rows, "part int, at long, attached long")
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "7")  # the next due time is carried over batches
        got = [tuple(x) for x in recorder.due_samples(polls, "part", "at", "attached", 20).collect()]
    finally:
        spark.conf.set(name, before)
    assert sorted(got, key=str) == sorted(want, key=str)
    assert recorder.due_samples(polls.limit(0), "part", "at", "attached").count() == 0


def test_evidence_with_nulls_agrees(spark):
    rows = [("a", 1, None, "x"), ("a", 2, None, "y"), ("a", 3, "4", "x"), (None, 4, "4", "x")]
    got = recorder.evidence_cache(spark.createDataFrame(rows, "socket string, n int, family string, _first string").drop("_first"), ["socket"], "n", ["family"])
    assert sorted((x["n"], x["verdict"]) for x in got.collect() if x["socket"]) == [(1, "cached"), (2, "refreshed"), (3, "conflict")]


def test_cleanup_never_deletes_what_differs(spark):
    d, other = "a" * 64, "b" * 64
    step = lambda **k: recorder.cleanup_recovery(*[F.lit(({"enabled": True, "transaction": "t", "digest": d, "safe": True, "source": None, "trashed": None, "tombstone": None} | k)[c]).cast("boolean" if c in ("enabled", "safe") else "string") for c in ("enabled", "transaction", "digest", "safe", "source", "trashed", "tombstone")])
    cases = [
        (step(source=d), "move_and_delete"),
        (step(source=other), "digest_mismatch"),
        (step(trashed=d), "delete"),
        (step(trashed=other), "digest_mismatch"),
        (step(source=d, trashed=d), "invalid_intent"),
        (step(tombstone=d), "forget_intent"),
        (step(tombstone=other), "invalid_intent"),
        (step(), "missing_artifact"),
        (step(transaction="a/b", source=d), "invalid_intent"),
        (step(safe=False, source=d), "unsafe_path"),
        (step(digest=None, source=d), "missing_intent"),
        (step(enabled=False, digest=None), "production_disabled"),
    ]
    row = spark.range(1).select(*[c.alias(str(i)) for i, (c, _) in enumerate(cases)]).first()
    assert list(row) == [w for _, w in cases]


def test_listeners_of_both_families(spark):
    line = "  0: {} 00000000:0000 {} 0:0 0:0 0 0 0 42 1"
    rows = [line.format("0100007F:0050", "0A"), line.format("00000000000000000000000001000000:0050", "0A"), line.format("0100007F:0050", "01"), line.format("0100007F00:0050", "0A"), "  sl  local_address", "", None]
    got = [x["l"] and tuple(x["l"]) for x in spark.createDataFrame([(t,) for t in rows], "t string").select(text.listener(F.col("t")).alias("l")).collect()]
    assert got == [("127.0.0.1", 80, 42), ("::1", 80, 42), None, None, None, None, None]
