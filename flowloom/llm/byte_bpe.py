"""Byte-level BPE by backtracking over longest matches.

A vocabulary of ranks defines the merges: of all neighbouring parts whose bytes together are a token, those with the
lowest rank merge first. The same ids come out without a merge loop. Read left to right, take the longest token that
starts here; it may follow the token before it only if merging the two spellings would keep the border between them;
if no prefix of it may, the position is a dead end and the token before it gets shorter. Whether two tokens may stand
side by side depends on those two alone and is memoised, and a dead end is never entered again, so the time is linear
in the text.
"""

from __future__ import annotations

import base64
import re
import struct

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .shared import small_batches, spark_schema, text_bytes

#: Bytes of the longest word whose ids are kept; the number of words after which a worker begins anew, keeping the last
#: time's too, and of token pairs for each of these words. Fewer take less memory and more time, with the same ids.
CACHED_BYTES, CACHED_WORDS, CACHED_PAIRS = 48, 600_000, 3


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


#: Below this code point the pattern is spelled out with plain character ranges, which the faster ``re`` can run.
PLAIN = 0x250


def _plain(pattern: str) -> re.Pattern | None:
    """The pattern for texts with code points below PLAIN only; None if it has classes other than letters, numbers and white space."""
    for name, inner in ((r"\p{L}", r"\p{L}"), (r"\p{N}", r"\p{N}"), (r"\s", r"\p{White_Space}")):
        one = regex.compile(inner)
        spans: list[list[int]] = []
        for c in filter(lambda c: one.match(chr(c)), range(PLAIN)):
            if spans and spans[-1][1] == c - 1:
                spans[-1][1] = c
            else:
                spans.append([c, c])
        ranges = "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in spans)
        pattern = re.sub(r"\[[^\]]*\]", lambda m: m[0].replace(name, ranges), pattern).replace(name, f"[{ranges}]")  # noqa: B023
        if name == r"\s":
            pattern = pattern.replace(r"\S", f"[^{ranges}]")
    return None if re.search(r"\\[a-tv-zA-Z]", pattern) else re.compile(pattern)


class _Words(dict):
    """The ids of words met of late, packed; a new word is encoded when it is asked for. Full, it begins anew, and words
    of the last time come over when they are asked for, so that frequent ones are not encoded again."""

    def __init__(self, encode, most: int):
        super().__init__()
        self.encode, self.most, self.last = encode, most, {}

    def __missing__(self, piece: str) -> bytes:
        packed = self.last.pop(piece, None)
        if packed is None:
            ids = self.encode(piece.encode())
            packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= CACHED_BYTES:
            if len(self) >= self.most:
                self.last = dict(self)
                self.clear()
            self[piece] = packed
        return packed


class ByteBPE:
    """An encoder and decoder for one vocabulary; built on the driver and sent to the workers, its size is the vocabulary's."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, cached: int = CACHED_WORDS):
        self.ranks, self.pattern, self.cached = ranks, pattern, cached
        self.token = {r: t for t, r in ranks.items()}
        self.halves = {}  # token -> the two it is merged from, or itself twice
        order = sorted(ranks.items(), key=lambda x: x[1])
        for word, rank in order:
            parts = self._spelling(word, rank)
            if len(parts) <= 2:
                self.halves[rank] = (parts[0], parts[-1])
        self.merged = {(a, b): r for r, (a, b) in self.halves.items() if len(self.token[r]) > 1}
        self.shorter = {}
        for rank in self.halves:
            word = self.token[rank]
            self.shorter[rank] = next((r for n in range(len(word) - 1, 0, -1) if (r := ranks.get(word[:n])) in self.halves), -1)
        self._ready()

    def _spelling(self, word: bytes, below: int) -> list[int]:
        """The parts of a word when only ranks under ``below`` merge."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 2:
            best, at = below, -1
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1], below)
                if r < best:
                    best, at = r, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _ready(self) -> None:
        self.length = {r: len(self.token[r]) for r in self.halves}
        self.words, self.pairs = _Words(self.word, self.cached), {}
        self.plain, self.odd = _plain(self.pattern), re.compile(f"[^\x00-{chr(PLAIN - 1)}]")
        self.split = regex.compile(self.pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.find = ahocorasick.Automaton()
        for r in self.halves:
            self.find.add_word(self.token[r].decode("latin-1"), r)
        self.find.make_automaton()

    def __getstate__(self):
        return {k: self.__dict__[k] for k in ("ranks", "pattern", "cached", "token", "halves", "merged", "shorter")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._ready()

    def _may_follow(self, a: int, b: int) -> bool:
        """Whether a and b stay two tokens: undo the later merge of the two, again and again, and see that no merge across the border would have come before it."""
        merged, halves, limit = self.merged, self.halves, 1 << 62
        while True:
            if merged.get((a, b), limit) < limit:
                return False
            if a > b:
                limit, a = a, halves[a][1]
                if a != limit:
                    continue
                limit, b = b + 1, halves[b][0]
                if b + 1 == limit:
                    return True
            else:
                limit, b = b + 1, halves[b][0]
                if b + 1 != limit:
                    continue
                limit, a = a, halves[a][1]
                if a == limit:
                    return True

    def word(self, word: bytes) -> tuple[int, ...]:
        """The ids of one match of the pattern."""
        whole = self.ranks.get(word)
        if whole is not None:
            return (whole,)
        n = len(word)
        longest = [-1] * n
        length, pairs, shorter = self.length, self.pairs, self.shorter
        for end, r in self.find.iter(word.decode("latin-1")):
            longest[end + 1 - length[r]] = r
        alive = bytearray(b"\1") * (n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            last = out[-1] if out else -1
            while token >= 0:
                end = at + length[token]
                if alive[end]:
                    if last < 0:
                        break
                    fits = pairs.get((last, token))
                    if fits is None:
                        if len(pairs) >= CACHED_PAIRS * self.cached:
                            pairs.clear()
                        fits = pairs[last, token] = self._may_follow(last, token)
                    if fits:
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at = end
                token = longest[at] if at < n else -1
            else:
                if not out:
                    raise ValueError(f"the vocabulary cannot spell {word[:40]!r}")
                alive[at] = 0
                token = out.pop()
                at -= length[token]
        return tuple(out)

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        split = self.split if self.plain is None or self.odd.search(text) else self.plain
        return b"".join(map(self.words.__getitem__, split.findall(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def byte_bpe(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), cached: int = CACHED_WORDS) -> DataFrame:
    """Per row of docs: the columns of ``keep``, ids (binary, little-endian unsigned 32-bit integers) and decoded (binary).

    Null counts as an empty text, which has no ids. Rows are independent: one pass, no shuffle, and repeated rows give
    repeated rows. An empty table stays empty. Columns of docs outside ``keep`` are not read. A text is held whole; a
    worker keeps the ids of at most twice ``cached`` words.
    """
    spark = docs.sparkSession
    small_batches(spark)
    coder = spark.sparkContext.broadcast(ByteBPE(ranks, pattern, cached))
    schema = docs.select(*keep).schema.add("ids", "binary").add("decoded", "binary")

    def run(batches):
        own = coder.value
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                some = batch.slice(start, 64)
                ids = [own.encode(t.decode("utf-8", "replace")) for t in text_bytes(some.column(0))]
                columns = [*some.columns[1:], pa.array(ids, pa.binary()), pa.array([own.decode(x) for x in ids], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, [*keep, "ids", "decoded"])

    return docs.select(docs[text].cast("string").alias("_text"), *keep).mapInArrow(run, schema)
