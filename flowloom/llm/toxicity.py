"""A toxicity classifier that does not mind which group a sentence names.

A logistic regression over the words of a text and their beginnings, and over n-grams of unspaced runs. In every labelled
text that names a group, the name is also swapped for others of its kind; the fit is charged for the squares of the
changes in score that the swaps make, so that names of groups that happen to stand in insulting texts get no weight of
their own.
"""

from __future__ import annotations

import math
import pickle
import re
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import small_batches, spark_schema, text_bytes

#: Labelled rows that the classifier is fitted on at most: those with the smallest hashes of their ids.
MOST_ROWS = 6000
#: Features kept at most, in how many texts one has to occur, how far (in standard deviations) toxic texts have to be
#: more or fewer among them than among all, and bytes of the beginnings that count as features.
MOST_FEATURES, LEAST_TEXTS, LEAST_WORTH, BEGINNINGS = 2500, 4, 4.5, (3, 4, 5, 6)
#: Words of up to so many bytes are read whole. Of a longer run (unspaced scripts, joined strings) all strings of NGRAMS
#: characters count, by their hashes of NGRAM_BITS bits.
WORD_BYTES, NGRAMS, NGRAM_BITS = 40, (2, 4), 16
#: Weight of the squares of the weights, weight of the squared score changes under swaps, steps of the fit.
RIDGE, SWAP_PENALTY, STEPS = 0.002, 4.0, 400
#: Score from which a text is predicted toxic.
THRESHOLD = 0.7

#: Names of groups, by kind; a name is swapped for the others of its kind.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("female", "male"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino"),
    ("immigrant", "native", "refugee", "foreigner"),
    ("immigrants", "natives", "refugees", "foreigners"),
    ("old", "young", "elderly"),
    ("disabled", "deaf", "blind"),
    ("frauen", "männer"),
    ("femmes", "hommes"),
    ("mujeres", "hombres"),
)

_WORD = re.compile(rb"[^\x00-\x26\x28-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def _run_ngrams(run: bytes) -> set[bytes]:
    """Hashes of the strings of NGRAMS characters anywhere in a run, marked as such."""
    chars = np.frombuffer(run.decode("utf-8", "replace").encode("utf-32-le"), np.uint32).astype(np.uint64)
    out = set()
    for n in NGRAMS:
        h = np.full(max(0, len(chars) - n + 1), n, np.uint64)
        for j in range(n):
            h = (h ^ chars[j : j + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
        out.update(b"~%x" % x for x in np.unique(h & np.uint64((1 << NGRAM_BITS) - 1)).tolist())
    return out


def text_words(text: bytes) -> set[bytes]:
    """Distinct words, and the marked n-grams of runs that are too long for a word."""
    met = set(_WORD.findall(text.lower()))
    long = [w for w in met if len(w) > WORD_BYTES]
    return met.difference(long).union(*map(_run_ngrams, long))


def _features(word: bytes) -> list[bytes]:
    """The word itself, and its beginnings marked as such; an n-gram is one feature."""
    return [word] if word.startswith(b"~") else [word, *(b"^" + word[:n] for n in BEGINNINGS if len(word) >= n)]


@dataclass
class Model:
    """weights: of features that are there or not; a text of no known features scores the bias alone."""

    weights: dict[bytes, float]
    bias: float
    of_word: dict[bytes, tuple] = field(default_factory=dict, repr=False)

    def logit(self, words: set[bytes]) -> float:
        known, weights = self.of_word, self.weights
        met = set()
        for w in words:
            got = known.get(w)
            if got is None:
                got = tuple(f for f in _features(w) if f in weights)
                if len(known) < 500_000:
                    known[w] = got
            if got:
                met.update(got)
        return self.bias + math.fsum(weights[f] for f in met)

    def score(self, text: bytes) -> float:
        z = self.logit(text_words(text))
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def fit(texts: Sequence[set[bytes]], labels: list[int], groups=IDENTITY_TERMS, swap_penalty: float = SWAP_PENALTY, ridge: float = RIDGE, steps: int = STEPS) -> Model:
    """The classifier of the texts' word sets. With labels of one kind only, or none, it scores that kind's share (0.5 for none)."""
    if len(set(labels)) < 2:
        share = (sum(labels) + 0.5) / (len(labels) + 1)
        return Model({}, math.log(share / (1 - share)))
    y = np.asarray(labels, np.float32)
    seen, toxic = Counter(), Counter()
    for ws, label in zip(texts, labels, strict=True):
        bag = {f for w in ws for f in _features(w)}
        seen.update(bag)
        if label:
            toxic.update(bag)
    n, p = len(y), float(y.mean())
    names = {g.encode(): [x.encode() for x in kind if x != g] for kind in groups for g in kind}

    def worth(f: bytes) -> float:
        """How far the texts with the feature are from their expected number of toxic ones, in standard deviations."""
        c = seen[f]
        return abs(toxic[f] - c * p) / math.sqrt(c * p * (1 - p) + 1)

    chosen = sorted((f for f in seen if seen[f] >= LEAST_TEXTS and worth(f) >= LEAST_WORTH), key=lambda f: (-worth(f), f))[:MOST_FEATURES]
    chosen += sorted({f for g in names for f in _features(g) if f in seen} - set(chosen))
    at = {f: i for i, f in enumerate(chosen)}
    x = np.zeros((n, len(chosen)), np.float32)
    changes = Counter()
    for i, ws in enumerate(texts):
        bag = {f for w in ws for f in _features(w)}
        x[i, [at[f] for f in bag if f in at]] = 1
        for g in sorted(ws & names.keys()):
            for other in names[g]:
                swapped = {f for w in (ws - {g}) | {other} for f in _features(w)}
                d = tuple(sorted((at[f], 1 if f in swapped else -1) for f in bag ^ swapped if f in at))
                if d:
                    changes[d] += 1
    # the mean of the changes' outer products: its size is that of the features, however many swaps there are
    moved = np.zeros((len(chosen), len(chosen)))
    for d, times in changes.items():
        where, sign = (np.array(v) for v in zip(*d, strict=True))
        moved[np.ix_(where, where)] += times * np.outer(sign, sign)
    moved = (moved / max(1, changes.total())).astype(np.float32)
    # rarer classes count as much as common ones
    each = np.where(y > 0, 0.5 / p, 0.5 / (1 - p)).astype(np.float32) / n
    w, b = np.zeros(len(chosen), np.float32), 0.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, steps + 1):  # Adam
        r = (1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30))) - y) * each
        grad = x.T @ r + ridge * w
        if changes:
            grad += swap_penalty * (moved @ w)
        gb = float(r.sum())
        m, v, mb, vb = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb**2
        rate = 0.05 / (1 + step / 100)
        c1, c2 = 1 - 0.9**step, 1 - 0.99**step
        w -= rate * (m / c1) / (np.sqrt(v / c2) + 1e-6)
        b -= rate * (mb / c1) / (math.sqrt(vb / c2) + 1e-6)
    return Model({f: float(w[i]) for f, i in at.items() if abs(w[i]) > 1e-3}, float(b))


def train(docs: DataFrame, labels: DataFrame, usable: Column, text: str = "text", doc: str = "doc_id", most: int = MOST_ROWS) -> Model:
    """Fits on the labelled rows that ``usable`` (a condition on the id) allows: all, or the ``most`` with the smallest
    hashes of their ids. Rows with a null label or id are left out, of several labels of a document the larger counts."""
    spark = docs.sparkSession
    small_batches(spark)
    some = labels.where(F.col("toxic").isNotNull() & F.col(doc).isNotNull()).groupBy(doc).agg(F.max("toxic").cast("int").alias("_toxic")).where(usable)
    some = some.orderBy(F.xxhash64(F.col(doc)), doc).limit(most)  # a bounded number of ids and labels
    bounded = spark.createDataFrame([tuple(r) for r in some.collect()], some.schema)

    def bags(batches):
        for batch in batches:
            packed = [pickle.dumps(sorted(text_words(t))) for t in text_bytes(batch.column(0))]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(packed, pa.binary())], ["toxic", "bag"])

    met = docs.select(F.col(text).cast("string").alias("_text"), F.col(doc)).join(F.broadcast(bounded), doc)
    rows = met.select("_text", "_toxic").mapInArrow(bags, spark_schema(toxic="int", bag="binary"))
    rows = rows.orderBy(F.xxhash64("bag"), "toxic").limit(most).collect()  # more than most only if ids repeat
    return fit(_Bags([r["bag"] for r in rows]), [r["toxic"] for r in rows])


class _Bags:
    """Word sets that are kept packed."""

    def __init__(self, packed: list[bytes]):
        self.packed = packed

    def __iter__(self):
        return (set(pickle.loads(x)) for x in self.packed)

    def __len__(self):
        return len(self.packed)


def toxicity(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """docs with ``out``, the score (0 to 1) of its whole text; null counts as empty, an empty text scores the bias alone.

    One pass, no shuffle: every row by itself, so repeated rows score the same, and so do texts of the same words (a score
    has no ties to break). Texts of any length are scored whole. An empty table stays empty, with the column. A column
    named ``out`` is replaced.
    """
    spark = docs.sparkSession
    small_batches(spark)
    known = spark.sparkContext.broadcast((model.weights, model.bias))
    keep = [c for c in docs.columns if c != out]
    schema = docs.select(*keep).schema.add(out, "double")

    def run(batches):
        own = Model(*known.value)
        for batch in batches:
            scores = pa.array([own.score(t) for t in text_bytes(batch.column(0))], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], scores], [*keep, out])

    return docs.select(docs[text].cast("string").alias("_text"), *keep).mapInArrow(run, schema)


def doc_bucket(doc: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts."""
    return F.crc32(doc.cast("string").cast("binary")) % parts
