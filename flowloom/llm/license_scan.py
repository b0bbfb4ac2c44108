"""License notices by diagonal voting.

Every run of K words of a text that occurs in a template votes, through a join with the template's positions, for the
offset between the two. Votes on one offset are a diagonal; neighbouring diagonals (a word added or left out) merge to
a span, and a span counts if it covers enough of the template within a stretch of about its length. A phrase counts on
one diagonal only, with all of its runs.

Words are numbered by the templates' own vocabulary, so a run is written as the number whose digits are its words':
a hash without collisions, and a vote is a verified match of K words. A run with a word that no template has cannot
meet any and is left out before the join.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .shared import small_batches, spark_schema, stamps, text_bytes

#: Words in a run; the shortest phrase has as many.
K = 3
#: Words that a span may shift by from one diagonal to the next, and the share of a notice that has to be there.
SHIFT, COVERED = 3, 0.7
#: So many positions of all templates together are broadcast; more are joined by a shuffle.
MOST_POSITIONS = 20_000

#: Phrases whose every place counts, with their labels.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)
#: Notices that count when most of them is there. Public texts; of those that differ by a word, the part around it, so that
#: most of one is not most of another.
NOTICES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "isc"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache-2"),
    ("neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "bsd-3"),
    ("permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", "bsl-1"),
    ("permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions", "zlib"),
    ("of the gnu general public license", "gpl"),
    ("of the gnu lesser general public license", "lgpl"),
    ("of the gnu affero general public license", "agpl"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("commons attribution sharealike 4 0 international license", "cc-by-sa"),
    ("commons attribution 4 0 international license", "cc-by"),
)

_TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: bytes) -> list[bytes]:
    """Lower-cased (A to Z) words of digits, letters a to z and whatever is not ASCII."""
    return text.translate(_TO_WORDS).split()


@dataclass(frozen=True)
class Templates:
    """Phrases and notices as numbered words."""

    phrases: tuple[tuple[str, str], ...] = PHRASES
    notices: tuple[tuple[str, str], ...] = NOTICES

    def rows(self) -> tuple[dict[bytes, int], list[tuple]]:
        """The vocabulary, and (run, template, label, exact, position, runs) of every position."""
        number: dict[bytes, int] = {}
        texts = [(words(t.encode()), label, True) for t, label in self.phrases] + [(words(t.encode()), label, False) for t, label in self.notices]
        for ws, _, _ in texts:
            if len(ws) < K:
                raise ValueError(f"a template needs {K} words: {ws}")
            for w in ws:
                number.setdefault(w, len(number) + 1)
        base, out = len(number) + 1, []
        for t, (ws, label, exact) in enumerate(texts):
            runs = len(ws) - K + 1
            for p in range(runs):
                run = 0
                for w in ws[p : p + K]:
                    run = run * base + number[w]
                out.append((run, t, label, exact, p, runs))
        if base**K >= 1 << 62:
            raise ValueError(f"runs of {K} numbers up to {base} do not fit a long")
        return number, out


def runs_of(docs: DataFrame, number: dict[bytes, int], text: str, keep: tuple[str, ...]) -> DataFrame:
    """Per row: a number of its own, the columns of keep, n_words, and the places and values of its runs of known words."""
    small_batches(docs.sparkSession)
    base = len(number) + 1

    def run(batches):
        own, get = stamps(), number.get
        for batch in batches:
            n_words, places, values = [], [], []
            for t in text_bytes(batch.column(0)):
                ws = words(t)
                ids = np.fromiter((get(w, 0) for w in ws), np.int64, len(ws))
                n_words.append(len(ws))
                known = np.flatnonzero(ids)
                start = known[: max(0, len(known) - K + 1)]
                start = start[known[K - 1 :] - start == K - 1] if len(known) >= K else known[:0]
                value = np.zeros(len(start), np.int64)
                for j in range(K):
                    value = value * base + ids[start + j]
                places.append(start)
                values.append(value)
            lists = [pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(x) for x in xs])]).astype(np.int32), np.concatenate([*xs, np.empty(0, np.int64)]).astype(np.int64)) for xs in (places, values)]
            stamp = pa.array([next(own) for _ in n_words], pa.int64())
            yield pa.RecordBatch.from_arrays([stamp, *batch.columns[1:], pa.array(n_words, pa.int64()), *lists], ["_row", *keep, "n_words", "_places", "_runs"])

    fields = spark_schema(_row="long").fields + docs.select(*keep).schema.fields + spark_schema(n_words="long", _places="array<long>", _runs="array<long>").fields
    schema = spark_schema(_row="long")
    schema.fields, schema.names = list(fields), [f.name for f in fields]
    return docs.select(docs[text].cast("string").alias("_text"), *keep).mapInArrow(run, schema)


def license_spans(docs: DataFrame, templates: Templates = Templates(), text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row for each span, with nulls if it does not count, and one with nulls for a row of docs without votes: _row (a
    number for the row of docs), the columns of keep, n_words, label, exact (a phrase), first_word, last_word (of the
    span), covered (0 to 1).

    Null texts count as empty; repeated rows are scanned each by itself. Texts may be of any length; what is grouped
    are a text's votes, which are few. Templates that share words each get their own spans; of votes at one place all
    count. An empty table gives no rows; names that begin with ``_`` are taken, other columns are not read.
    """
    spark = docs.sparkSession
    number, positions = templates.rows()
    spots = spark.createDataFrame(positions, spark_schema(_run="long", tpl="int", label="string", exact="boolean", _tpos="int", _runs_all="int"))
    spots = F.broadcast(spots) if len(positions) <= MOST_POSITIONS else spots.hint("merge")
    # a row without runs keeps one null place
    found = runs_of(docs, number, text, keep).withColumn("_hit", F.explode_outer(F.arrays_zip("_places", "_runs")))
    by = ["_row", *keep, "n_words"]
    votes = found.select(*by, F.col("_hit._places").alias("_place"), F.col("_hit._runs").alias("_run")).join(spots, "_run", "left")
    # one exchange, by row, serves all that follows
    votes = votes.withColumn("_diagonal", F.col("_place") - F.col("_tpos")).repartition(F.col("_row"))
    # votes of a text go to one task: as many as it has words of the templates at most
    order = W.partitionBy("_row", "tpl").orderBy("_diagonal", "_place")
    far = F.col("_diagonal") - F.lag("_diagonal").over(order) > F.when(F.col("exact"), F.lit(0)).otherwise(F.lit(SHIFT))
    spanned = votes.withColumn("_span", F.sum(F.coalesce(far, F.lit(True)).cast("int")).over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    # a votes' place is counted once a template position, whatever diagonals meet there
    spans = spanned.groupBy(*by, "tpl", "label", "exact", "_runs_all", "_span", "_tpos").agg(F.min("_place").alias("_from"), F.max("_place").alias("_to"))
    spans = spans.groupBy(*by, "tpl", "label", "exact", "_runs_all", "_span").agg(F.min("_from").alias("first_word"), (F.max("_to") + (K - 1)).alias("last_word"), F.count("_tpos").alias("_met"))
    covered = F.col("_met") / F.col("_runs_all")
    near = F.col("last_word") - F.col("first_word") < 2 * (F.col("_runs_all") + K)
    good = F.when(F.col("exact"), F.col("_met") == F.col("_runs_all")).otherwise((covered >= COVERED) & near)
    kept = F.coalesce(good, F.lit(False))
    return spans.select(*by, *[F.when(kept, F.col(c)).alias(c) for c in ("label", "exact", "first_word", "last_word")], F.when(kept, covered).alias("covered"))
