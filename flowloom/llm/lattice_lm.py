"""Language-model scores by subword lattices: the probability of a text over all its segmentations.

A unigram model over the pieces of an existing vocabulary gives a text the sum, over all ways of cutting it into
pieces, of the products of the pieces' probabilities: a forward recursion in log space over the text's positions. A word
carries the space before it, and no piece has a space inside, so every segmentation cuts between words; a text's sum
is the product of its words' sums and of the end's probability, and a word's sum is worked out once in the corpus.

The vocabulary stays as it is. The scores in its file are ranks only (a piece's is minus its place), so the first weights
follow its order (Zipf's law); rounds of expectation maximisation over the words of the training texts, all of them with
their counts, weigh the same pieces, and the end, by how often the training texts need them. No word has an edge of its
own: the score is the lattice's alone.

Words move in packed lists: a chunk of documents names each of its different words once for each share of the words;
the share adds up their training counts and answers with counts and scores. No list of words goes to the driver or to
all executors; only sums for each piece do, as many as the vocabulary has.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ngram_join import mix
from .shared import materialize, pack, spark_schema, text_bytes, unpack

#: Rounds of expectation maximisation, and what each piece's count gets beforehand.
ROUNDS, PRIOR = 2, 0.05
#: What is added to the counts of the base model.
BASE_PRIOR = 0.1
#: Words up to so many bytes are scored together with others of their length, and how many cells at once.
TOGETHER, CELLS = 40, 1 << 20
#: Bytes of text for which there is one share of the words.
SHARE_BYTES = 16 << 20
#: Pieces whose sums move together.
PART = 1024
END = b""  # the word that ends a text

_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
_BASE = np.uint64(0xE7037ED1A0B428DB)


def read_pieces(path: str) -> dict[bytes, float]:
    """The pieces of a sentencepiece model as bytes, a space for its mark of one, with weights by their order."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces: dict[bytes, float] = {}
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            continue
        text = model.id_to_piece(i)
        raw = bytes([int(text[3:5], 16)]) if model.is_byte(i) else text.replace("▁", " ").encode()
        if b" " not in raw[1:]:
            pieces[raw] = max(pieces.get(raw, 0.0), 1.0 / (3.0 + i))
    for b in range(256):
        pieces.setdefault(bytes([b]), 1.0 / (3.0 + model.get_piece_size()))
    return pieces


class Lattice:
    """Unigram log probabilities (natural) of pieces; every single byte is a piece, so every text has a segmentation."""

    def __init__(self, pieces: list[bytes], logs: np.ndarray):
        self.pieces, self.logs = pieces, np.append(np.asarray(logs, np.float64), -np.inf)
        self.by_length, self.found = {}, None
        lengths = np.array([len(p) for p in pieces])
        for n in np.unique(lengths).tolist():
            ids = np.flatnonzero(lengths == n)
            raw = np.frombuffer(b"".join(pieces[i] for i in ids), np.uint8).reshape(-1, n)
            h = self._hash(raw, n)[:, 0]
            order = np.argsort(h)
            self.by_length[n] = h[order], ids[order]

    def __getstate__(self):
        return self.pieces, self.logs[:-1]  # tables are built again

    def __setstate__(self, state):
        self.__init__(*state)

    @staticmethod
    def _hash(raw: np.ndarray, n: int) -> np.ndarray:
        out = _TABLE[raw[:, : raw.shape[1] - n + 1]]
        for i in range(1, n):
            out = out * _BASE + _TABLE[raw[:, i : raw.shape[1] - n + 1 + i]]
        return out

    def _cells(self, raw: np.ndarray) -> dict[int, np.ndarray]:
        """For each length of pieces, which piece begins at each position of each word; the last (of log 0) if none."""
        out = {}
        for n, (hashes, ids) in self.by_length.items():
            if n <= raw.shape[1]:
                h = self._hash(raw, n)
                at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                found = np.where(hashes[at] == h, ids[at], len(self.pieces))
                if (found < len(self.pieces)).any():
                    out[n] = found
        return out

    def _forward(self, cells: dict[int, np.ndarray], n: int, size: int) -> list[np.ndarray]:
        alpha = [np.zeros(n)]
        for j in range(1, size + 1):
            total = np.full(n, -np.inf)
            for length, found in cells.items():
                if length <= j:
                    total = np.logaddexp(total, alpha[j - length] + self.logs[found[:, j - length]])
            alpha.append(total)
        return alpha

    def _expected(self, cells, alpha, n: int, size: int, counts: np.ndarray, into: np.ndarray) -> None:
        beta = [np.full(n, -np.inf) for _ in range(size)] + [np.zeros(n)]
        for i in range(size - 1, -1, -1):
            for length, found in cells.items():
                if i + length <= size:
                    through = self.logs[found[:, i]] + beta[i + length]
                    beta[i] = np.logaddexp(beta[i], through)
                    weight = np.exp(alpha[i] + through - alpha[size]) * counts
                    into += np.bincount(found[:, i], weight, len(into))

    def _long(self, word: bytes, count: float | None, into: np.ndarray | None) -> float:
        """The same recursion, a match after the other, for one long word."""
        if self.found is None:
            self.found = ahocorasick.Automaton()
            for i, p in enumerate(self.pieces):
                self.found.add_word(p.decode("latin-1"), (i, len(p)))
            self.found.make_automaton()
        text, logs, n = word.decode("latin-1"), self.logs, len(word)
        alpha = [0.0] + [-math.inf] * n
        matches = [(end + 1, end + 1 - size, i) for end, (i, size) in self.found.iter(text)]
        for end, start, i in matches:
            a, b = alpha[end], alpha[start] + logs[i]
            if b > a:
                a, b = b, a
            alpha[end] = a + math.log1p(math.exp(b - a)) if b > -math.inf else a
        if into is not None:
            beta = [-math.inf] * n + [0.0]
            for end, start, i in reversed(matches):
                through = logs[i] + beta[end]
                into[i] += math.exp(alpha[start] + through - alpha[n]) * count
                a, b = max(beta[start], through), min(beta[start], through)
                beta[start] = a + math.log1p(math.exp(b - a)) if b > -math.inf else a
        return alpha[n]

    def scores(self, words: list[bytes], counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The words' log probabilities (natural), each with a space before it; with counts also how often each piece is
        expected in so many words."""
        out, into = np.zeros(len(words)), np.zeros(len(self.pieces) + 1)
        lengths = np.array([len(w) + 1 for w in words], np.int64)
        for size in np.unique(lengths).tolist():
            rows = np.flatnonzero(lengths == size)
            if size > TOGETHER:
                for r in rows:
                    out[r] = self._long(b" " + words[r], None, None)
                    if counts is not None:
                        self._long(b" " + words[r], counts[r], into)
                continue
            step = max(1, CELLS // (size * 8))
            for k in range(0, len(rows), step):
                some = rows[k : k + step]
                raw = np.frombuffer(b"".join(b" " + words[r] for r in some), np.uint8).reshape(-1, size)
                cells = self._cells(raw)
                alpha = self._forward(cells, len(some), size)
                out[some] = alpha[size]
                if counts is not None:
                    self._expected(cells, alpha, len(some), size, counts[some], into)
        return out, into[:-1]


def tokens(text: bytes) -> list[bytes]:
    """Words, lower-cased A to Z, without space and \\x09 to \\x0D."""
    return text.lower().split()


def _join(words: Iterable[bytes]) -> bytes:
    sink = pa.BufferOutputStream()
    table = pa.table({"w": pa.array([b"\n".join(words)], pa.binary())})
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _split(blob: bytes) -> list[bytes]:
    return unpack(blob).column(0)[0].as_py().split(b"\n")


def _numbers(x: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(x).tobytes(), "zstd", asbytes=True)


def _from_numbers(x: bytes, n: int, kind: str) -> np.ndarray:
    return np.frombuffer(pa.decompress(x, n * np.dtype(kind).itemsize, "zstd"), kind)


def _by_share(words: list[bytes], shares: int) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        out.setdefault(xxhash.xxh3_64_intdigest(w) % shares, []).append(i)
    return out


def _ask(shares: int):
    def run(batches):
        for batch in batches:
            for number, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = unpack(blob)
                learned, met = Counter(), set()
                for t, learn in zip(text_bytes(rows.column(0).combine_chunks()), rows.column(2).to_pylist(), strict=True):
                    ws = tokens(t)
                    if learn:
                        learned.update(ws)
                        learned[END] += 1
                    else:
                        met.update(ws)
                met.add(END)
                words = sorted(met | learned.keys())
                out = []
                for share, at in sorted(_by_share(words, shares).items()):
                    out.append((share, number, _join(words[i] for i in at), _numbers(np.array([learned[words[i]] for i in at], "<i8")), len(at)))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int32()))], ["share", "chunk", "words", "counts", "n"])

    return run


def _count(table: pa.Table) -> pa.Table:
    """One share's words with their training counts."""
    total: Counter = Counter()
    for words, counts, n in zip(table.column("words"), table.column("counts"), table.column("n").to_pylist(), strict=True):
        for w, c in zip(_split(words.as_py()), _from_numbers(counts.as_py(), n, "<i8").tolist(), strict=True):
            total[w] += c
    words = sorted(total)
    counts = np.array([total[w] for w in words], "<i8")
    return pa.table({"share": table.column("share")[:1], "words": pa.array([_join(words)], pa.binary()), "counts": pa.array([_numbers(counts)], pa.binary()), "n": pa.array([len(words)], pa.int32()), "tokens": pa.array([int(counts.sum())], pa.int64()), "kinds": pa.array([int((counts > 0).sum())], pa.int64()), "ends": pa.array([total.get(END, 0)], pa.int64())})


def _expect(lattice):
    def run(batches):
        """One task's expected counts of all pieces, packed in parts of PART pieces."""
        model = lattice.value
        total = np.zeros(len(model.pieces))
        for batch in batches:
            for words, counts, n in zip(batch.column(0), batch.column(1), batch.column(2).to_pylist(), strict=True):
                words, counts = _split(words.as_py()), _from_numbers(counts.as_py(), n, "<i8")
                some = [i for i, w in enumerate(words) if w and counts[i] > 0]
                total += model.scores([words[i] for i in some], counts[some].astype(np.float64))[1]
        if total.any():
            parts = [total[i : i + PART].tobytes() for i in range(0, len(total), PART)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], ["part", "sums"])

    return run


def _add(table: pa.Table) -> pa.Table:
    """The sum of one part over all tasks."""
    total = sum(np.frombuffer(x.as_buffer(), "<f8") for x in table.column("sums"))
    return pa.table({"part": table.column("part")[:1], "sums": pa.array([total.tobytes()], pa.binary())})


def _reply(lattice, end: float):
    def run(asked: pa.Table, known: pa.Table) -> pa.Table:
        n = known.column("n")[0].as_py()
        words, counts = _split(known.column("words")[0].as_py()), _from_numbers(known.column("counts")[0].as_py(), n, "<i8")
        scores = lattice.value.scores(words)[0]
        at = {w: i for i, w in enumerate(words)}
        if END in at:
            scores[at[END]] = end
        out = []
        for chunk, share, blob in zip(asked.column("chunk").to_pylist(), asked.column("share").to_pylist(), asked.column("words"), strict=True):
            rows = np.array([at[w] for w in _split(blob.as_py())])
            out.append((chunk, share, _numbers(counts[rows]), _numbers(scores[rows]), len(rows)))
        return pa.table({c: pa.array([r[i] for r in out], t) for i, (c, t) in enumerate((("chunk", pa.int64()), ("share", pa.int32()), ("counts", pa.binary()), ("logs", pa.binary()), ("n", pa.int32())))})

    return run


def _score(shares: int, total: int, kinds: int):
    names = ("doc_id", "n_tokens", "n_known", "base_score", "score")
    types = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        told = {s: (c.as_py(), x.as_py(), n) for s, c, x, n in zip(right.column("share").to_pylist(), right.column("counts"), right.column("logs"), right.column("n").to_pylist(), strict=True)}
        out = []
        for blob in left.column("blob").to_pylist():
            rows = unpack(blob)
            texts = [tokens(t) for t in text_bytes(rows.column(0).combine_chunks())]
            words = sorted({END}.union(*texts))
            counts, logs = np.zeros(len(words), np.int64), np.zeros(len(words))
            for share, at in _by_share(words, shares).items():
                c, x, n = told[share]
                counts[at], logs[at] = _from_numbers(c, n, "<i8"), _from_numbers(x, n, "<f8")
            base = np.log10((counts + BASE_PRIOR) / (total + BASE_PRIOR * (kinds + 1)))
            logs = logs / math.log(10)
            number = {w: i for i, w in enumerate(words)}
            for doc, ws in zip(rows.column(1).to_pylist(), texts, strict=True):
                at = np.fromiter(map(number.__getitem__, ws), np.int64, len(ws))
                at = np.append(at, number[END])
                out.append((doc, len(at), int((counts[at] > 0).sum()), float(base[at].sum()), float(logs[at].sum())))
        return pa.table({c: pa.array([r[i] for r in out], t) for i, (c, t) in enumerate(zip(names, types, strict=True))})

    return run


def lattice_scores(docs: DataFrame, learn: Column, pieces: dict[bytes, float], text: str = "text", doc: str = "doc_id", rounds: int = ROUNDS) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row of docs.

    Tokens are the words and one end. ``learn`` says which rows are learned from (null: no). base_score is the log10
    probability by the training counts of whole words, score that of the lattices. Null and empty texts are an end
    alone. Without rows to learn from, the pieces keep their first weights and the end has that of the first piece. Texts
    of any length are scored whole, words of any length too. Repeated rows count, and are scored, each time. An empty
    table stays empty; columns of docs not used are not read.
    """
    spark = docs.sparkSession
    slim = docs.select(docs[text].cast("string").alias("text"), docs[doc].cast("long").alias("doc_id"), F.coalesce(learn, F.lit(False)).alias("learn"))
    chunks = materialize(pack(slim, "text", ["doc_id", "learn"]), "none")
    size = chunks.agg(F.sum("n_bytes")).first()[0] or 0
    shares = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARE_BYTES))
    blobs = chunks.select("chunk", "blob")
    asked = materialize(blobs.mapInArrow(_ask(shares), spark_schema(share="int", chunk="long", words="binary", counts="binary", n="int")), "none")
    known = materialize(asked.groupBy("share").applyInArrow(_count, spark_schema(share="int", words="binary", counts="binary", n="int", tokens="long", kinds="long", ends="long")), "none")
    total, kinds, ends = (x or 0 for x in known.agg(*[F.sum(c) for c in ("tokens", "kinds", "ends")]).first())

    names = sorted(pieces)
    weights = np.append([pieces[p] for p in names], max(pieces.values(), default=1.0))  # the last: the end of a text
    for left in range(rounds if total else 0, -1, -1):
        logs = np.log(weights / weights.sum())
        lattice, end = spark.sparkContext.broadcast(Lattice(names, logs[:-1])), float(logs[-1])
        if not left:
            break
        packed = spark_schema(part="int", sums="binary")
        sums = known.select("words", "counts", "n").mapInArrow(_expect(lattice), packed).groupBy("part").applyInArrow(_add, packed)
        weights = np.full(len(names) + 1, PRIOR)
        weights[-1] += ends
        for r in sums.collect():  # a number for each piece of the vocabulary
            found = np.frombuffer(r["sums"], "<f8")
            weights[r["part"] * PART : r["part"] * PART + len(found)] += found
    told = asked.select("share", "chunk", "words").groupBy("share").cogroup(known.select("share", "words", "counts", "n").groupBy("share")).applyInArrow(_reply(lattice, end), spark_schema(chunk="long", share="int", counts="binary", logs="binary", n="int"))
    scored = blobs.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(_score(shares, total, kinds), spark_schema(doc_id="long", n_tokens="long", n_known="long", base_score="double", score="double"))
    return scored.withColumn("train_tokens", F.lit(total).cast("long"))
