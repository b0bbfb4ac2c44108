"""Exact Jaccard join of texts on word n-grams, by vertical partitioning.

N-grams have one global order, that of their hashes; it is cut into fragments, ranges of hashes. Whatever is counted, for
texts or for pairs of texts, is counted fragment by fragment, each on its own, and the partial counts are summed.

Texts. A text that a similar one exists for has most of its n-grams from texts it shares them with; if more n-grams than
a similar set may miss are in no other text, it has no partner. The first fragments of the order, as many as tell, get
every text's n-grams in them and count those that only one set has; summed for each text, these counts leave the few texts
that may have partners. What is not counted only keeps a text in.

Candidates. The sets of those texts are put in order again, those n-grams last that many of them have. As many first ones
as a similar set may miss, and one more, are where a set meets others of its interval of sizes and the next. Of those that
meet, each is grouped with the meeting's smallest class, its pivot, never all with all; two that meet stand in that
pivot's group both.

Pairs. First a group's members are compared with the pivot. Those linked to it are one component, and need not be compared
with each other; the rest is compared with all of the group, in blocks of MEMBERS by MEMBERS. For either, a set falls into
VERTICAL segments, one for each fragment; a block's fragments go to tasks of their own, each counts its part of every
pair's overlap, and the parts are summed. A fragment leaves out pairs that differ too much in it alone. Links come back as
a tree over what a block linked, so no pair becomes a row of a table.
"""

from __future__ import annotations

import struct
from bisect import bisect_right

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import Forest, connected_components, materialize, small_batches, spark_schema, stamps, text_bytes

#: Bytes of text for which there is one share of the order's first fragments, and the least number of shares.
SHARE_BYTES, LEAST_SHARES = 64 << 20, 16
#: Slots of hashes that sets are counted in (as a power of two), and the parts that their counters are sent in.
COUNTER_BITS, COUNTER_PARTS = 22, 64
#: A slot is common if it counts more than so many times the average, and so many sets more.
COMMON_TIMES, COMMON_TEXTS = 3, 50
#: Fragments that sets are cut into to be compared, and classes on one side of a block.
VERTICAL, MEMBERS = 4, 1024
#: From so many classes on, those that have an n-gram are a column of a matrix product, not pairs one by one.
COMMON = 24
#: Bits of the filter that says whose sets are wanted: 4 MB, broadcast.
FILTER_BITS = 1 << 25
#: Word hashes, and sets that were sent, that a worker remembers.
CACHED_WORDS, CACHED_CLASSES = 400_000, 1_000_000
#: In place of a text's number in its batch: several texts of the batch have the n-gram.
SEVERAL = 0xFFFF

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31 = (np.uint64(x) for x in (30, 27, 31))
_S16, _LOW16 = np.uint64(16), np.uint64(SEVERAL)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits (the finalizer of SplitMix64)."""
    x = (x ^ (x >> _S30)) * _M1
    x = (x ^ (x >> _S27)) * _M2
    return x ^ (x >> _S31)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


class Shingler:
    """The sorted distinct hashes of a text's n-grams of words; a shorter text is one n-gram, one without words has none."""

    def __init__(self, n: int):
        self.n, self.hashes = n, _WordHashes()

    def __call__(self, text: bytes) -> np.ndarray:
        words = text.lower().split()  # of bytes: A to Z, and ASCII white space
        if not words:
            return np.empty(0, np.uint64)
        w = np.fromiter(map(self.hashes.__getitem__, words), np.uint64, len(words))
        k = min(self.n, len(w))
        count = len(w) - k + 1
        h = mix(w[:count] + np.uint64(k))
        for j in range(1, k):
            h = mix(h ^ w[j : j + count])
        h.sort()
        return h[np.concatenate([[True], h[1:] != h[:-1]])]


def digest_of(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that a set is known by: two longs."""
    return struct.unpack(">qq", xxhash.xxh3_128_digest(shingles.tobytes(), seed=len(shingles)))


def may_miss(n: np.ndarray | int, share: int):
    """How many of n n-grams a set may have that a similar one has not."""
    return n + (-share * n // 100)


# texts: which may have partners


def _examined(share: int) -> int:
    """The end of the first fragments: a text whose n-grams are mostly its own has twice as many in them as it may miss."""
    return min(1 << 64, (2 * (100 - share) + 5) * (1 << 64) // 100)


def _message(v: np.ndarray) -> bytes:
    """Sorted n-grams of 48 bits with their texts' numbers below: differences byte by byte, then the numbers."""
    gram = v >> _S16
    steps = np.diff(gram, prepend=np.uint64(0)).astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].T
    return pa.compress(np.ascontiguousarray(steps).tobytes() + (v & _LOW16).astype("<u2").tobytes(), "zstd", asbytes=True)


def _read_message(blob: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(pa.decompress(blob, 8 * n, "zstd"), np.uint8)
    steps = np.zeros((n, 8), np.uint8)
    steps[:, 2:] = raw[: 6 * n].reshape(6, n).T
    return np.cumsum(steps.view(">u8").ravel().astype(np.uint64)), raw[6 * n :].view("<u2")


_SENT = {"share": "int", "batch": "long", "n": "int", "blob": "binary"}


def _survey(n: int, shares: int, end: int):
    """Of each batch of texts: its n-grams in each share of the first fragments, and (for a share under 0, which only
    passes it on) a table of its rows. A set goes out once for each task; an n-gram that several texts of the batch have
    goes out once."""
    edges = np.array([end * s // shares for s in range(1, shares)], np.uint64)
    last = np.uint64(end - 1)

    def run(batches):
        shingles, numbers, sent = Shingler(n), stamps(), set()
        for whole in batches:
            for at in range(0, whole.num_rows, SEVERAL):
                batch, number = whole.slice(at, SEVERAL), next(numbers)
                held, sizes, digests, places = [], [], [], []
                for i, t in enumerate(text_bytes(batch.column(0))):
                    s = shingles(t)
                    d = digest_of(s) if len(s) else (None, None)
                    first = len(s) > 0 and d not in sent
                    if first:
                        if len(sent) >= CACHED_CLASSES:
                            sent.clear()
                        sent.add(d)
                        held.append((s[: np.searchsorted(s, last, "right")] & ~_LOW16) | np.uint64(i))
                    sizes.append(len(s))
                    digests.append(d)
                    places.append(first)
                rows = pa.table([*batch.columns[1:], pa.array(sizes, pa.int64()), pa.array([d[0] for d in digests], pa.int64()), pa.array([d[1] for d in digests], pa.int64()), pa.array(places)], [*batch.schema.names[1:], "_n", "_d1", "_d2", "_sent"])
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_table(rows)
                shares_out, counts_out, blobs = [-1 - number % shares], [0], [sink.getvalue().to_pybytes()]
                if held:
                    v = np.sort(np.concatenate(held))
                    gram = v >> _S16
                    again = np.concatenate([[False], gram[1:] == gram[:-1]])
                    v[np.concatenate([again[1:], [False]])] |= _LOW16
                    v = v[~again]
                    cuts = [0, *np.searchsorted(v, edges & ~_LOW16).tolist(), len(v)]
                    for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                        if b > a:
                            shares_out.append(s)
                            counts_out.append(b - a)
                            blobs.append(_message(v[a:b]))
                yield pa.RecordBatch.from_arrays([pa.array(shares_out, pa.int32()), pa.array([number] * len(blobs), pa.int64()), pa.array(counts_out, pa.int32()), pa.array(blobs, pa.binary())], list(_SENT))

    return run


def _only_here(table: pa.Table) -> pa.Table:
    """Of one share: for each batch, how many n-grams of each of its texts no other set has."""
    batch, n, blobs = table.column("batch"), table.column("n").to_pylist(), table.column("blob")
    if table.column("share")[0].as_py() < 0:
        return pa.table({"batch": batch, "rows": blobs, "counts": pa.nulls(len(n), pa.binary())})
    read = [_read_message(x.as_py(), k) for x, k in zip(blobs, n, strict=True)]
    grams = np.sort(np.concatenate([g for g, _ in read]))
    shared = np.unique(grams[1:][grams[1:] == grams[:-1]])
    out = []
    for gram, text in read:
        at = np.minimum(np.searchsorted(shared, gram), max(0, len(shared) - 1))
        alone = text[(shared[at] != gram) & (text != SEVERAL)] if len(shared) else text[text != SEVERAL]
        which, many = np.unique(alone, return_counts=True)
        out.append(pa.compress(which.astype("<u2").tobytes() + many.astype("<u4").tobytes(), "zstd", asbytes=True) + len(which).to_bytes(4, "little") if len(which) else None)
    return pa.table({"batch": batch, "rows": pa.nulls(len(n), pa.binary()), "counts": pa.array(out, pa.binary())})


def _partners(share: int):
    def run(table: pa.Table) -> pa.Table:
        """A batch's rows, with whether each one's set may have partners; null where it was sent by another row."""
        alone = np.zeros(1 << 16, np.int64)
        for x in table.column("counts").drop_null():
            raw = x.as_py()
            k = int.from_bytes(raw[-4:], "little")
            both = pa.decompress(raw[:-4], 6 * k, "zstd", asbytes=True)
            alone[np.frombuffer(both, "<u2", k)] += np.frombuffer(both, "<u4", k, 2 * k)
        rows = pa.ipc.open_stream(table.column("rows").drop_null()[0].as_py()).read_all()
        n = rows.column("_n").to_numpy()
        alive = alone[: len(n)] <= may_miss(n, share)
        found = pa.array(alive, mask=~rows.column("_sent").to_numpy())
        return rows.drop_columns(["_sent"]).append_column("_alive", found)

    return run


# candidates


def first_fragment(shingles: np.ndarray, share: int, common: np.ndarray) -> np.ndarray:
    """A set's first n-grams, common ones last: if all were missing from another, too few would be left."""
    last = common[shingles >> np.uint64(64 - COUNTER_BITS)]
    return np.concatenate([shingles[~last], shingles[last]])[: may_miss(len(shingles), share) + 1]


class Meetings:
    """Hashes of the places where a set meets those that may be similar: in its interval of sizes and in the next, the
    n-grams of its first fragment."""

    def __init__(self, share: int, common: np.ndarray):
        self.share, self.common, self.starts = share, common, [1]

    def interval(self, n: int) -> int:
        """The interval of sizes that n is in: sets that can be similar are in one or in neighbouring intervals."""
        while self.starts[-1] <= n:
            self.starts.append(self.starts[-1] * 100 // self.share + 1)
        return bisect_right(self.starts, n) - 1

    def __call__(self, shingles: np.ndarray) -> np.ndarray:
        own, first = self.interval(len(shingles)), mix(first_fragment(shingles, self.share, self.common) ^ _M1)
        return np.concatenate([mix(first + np.uint64(i)) for i in (own, own + 1)])


def segments_of(shingles: np.ndarray) -> list[bytes]:
    """The set's parts in each of VERTICAL fragments of the order."""
    cuts = [0, *np.searchsorted(shingles, np.array([(v << 64) // VERTICAL for v in range(1, VERTICAL)], np.uint64)).tolist(), len(shingles)]
    return [shingles[a:b].astype("<u8").tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _joined(segments: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(b"".join(x), "<u8") for x in segments.to_pylist()]


def _counters(sets: DataFrame) -> np.ndarray:
    """Whether each of 2**COUNTER_BITS slots of hashes counts far more sets than the slots do on average. A task sends
    its counters in packed parts, parts are summed, and a bit for each slot reaches the driver."""
    size = (1 << COUNTER_BITS) // COUNTER_PARTS

    def run(batches):
        counts = None
        for batch in batches:
            if batch.num_rows:
                slots = np.concatenate(_joined(batch.column(0))) >> np.uint64(64 - COUNTER_BITS)
                counts = np.zeros(1 << COUNTER_BITS, np.uint32) if counts is None else counts
                np.add.at(counts, slots.astype(np.int64), 1)
        if counts is not None:
            parts = [pa.compress(counts[i : i + size].tobytes(), "zstd", asbytes=True) for i in range(0, len(counts), size)]
            yield pa.RecordBatch.from_arrays([pa.array(range(COUNTER_PARTS), pa.int32()), pa.array(parts, pa.binary())], ["part", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(size, np.int64)
        for x in table.column("counts"):
            total += np.frombuffer(pa.decompress(x.as_py(), 4 * size, "zstd"), np.uint32)
        many = total > COMMON_TIMES * total.mean() + COMMON_TEXTS
        return pa.table({"part": table.column("part")[:1], "common": pa.array([np.packbits(many).tobytes()], pa.binary())})

    sums = sets.select("segments").mapInArrow(run, spark_schema(part="int", counts="binary")).groupBy("part").applyInArrow(add, spark_schema(part="int", common="binary"))
    out = np.zeros((COUNTER_PARTS, size // 8), np.uint8)
    for r in sums.collect():
        out[r["part"]] = np.frombuffer(r["common"], np.uint8)
    return out.ravel()


def _stars(sets: DataFrame, share: int) -> DataFrame:
    """pivot (the smallest class of a meeting), cls: every other class of the meeting. Partial sums find the pivots; the
    join that brings them back to the meetings can be split where many sets meet."""
    bits = sets.sparkSession.sparkContext.broadcast(_counters(sets))

    def run(batches):
        places = Meetings(share, np.unpackbits(bits.value).astype(bool))
        for batch in batches:
            if batch.num_rows:
                keys = [places(s) for s in _joined(batch.column(1))]
                owners = np.repeat(batch.column(0).to_numpy(), [len(k) for k in keys])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(owners)], ["meeting", "cls"])

    meetings = sets.select("cls", "segments").mapInArrow(run, spark_schema(meeting="long", cls="long"))
    pivots = materialize(meetings.groupBy("meeting").agg(F.min("cls").alias("pivot"), F.max("cls").alias("_last")).where("pivot < _last").drop("_last"))
    return materialize(meetings.join(pivots, "meeting").where("cls <> pivot").select("pivot", "cls").distinct())


# pairs


def _positions(d: int) -> tuple[int, int]:
    return d % FILTER_BITS, (d >> 24) * 0x9E3779B1 % FILTER_BITS


def _filter(digests: DataFrame) -> np.ndarray:
    """A Bloom filter of digests' first halves: FILTER_BITS bits whatever their number, made of words that partial sums
    have united. Where there are too many for it, more sets move than are wanted, and the join drops them."""

    def run(batches):
        for batch in batches:
            at = np.array([p for d in batch.column(0).to_pylist() for p in _positions(d)], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at // 32), pa.array(np.left_shift(1, at % 32))], ["word", "bits"])

    words = digests.mapInArrow(run, spark_schema(word="long", bits="long")).groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 32, np.uint32)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out.view(np.uint8)


def _sets(docs: DataFrame, text: str, rows: DataFrame, n: int) -> DataFrame:
    """cls (a number of its own), d1, d2, segments of every set that may have partners, each once."""
    alive = rows.where("_alive").groupBy("_d1", "_d2").agg(F.lit(1).alias("_one")).drop("_one")
    wanted = docs.sparkSession.sparkContext.broadcast(_filter(alive.select("_d1")))

    def collect(batches):
        shingles, sent, bits = Shingler(n), set(), np.unpackbits(wanted.value, bitorder="little")
        for batch in batches:
            out = []
            for t in text_bytes(batch.column(0)):
                s = shingles(t)
                d = digest_of(s) if len(s) else None
                if d is not None and d not in sent and all(bits[p] for p in _positions(d[0])):
                    if len(sent) >= CACHED_CLASSES:
                        sent.clear()
                    sent.add(d)
                    out.append((*d, segments_of(s)))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.list_(pa.binary())))], ["_d1", "_d2", "segments"])

    sent = docs.select(docs[text].cast("string").alias("_text")).mapInArrow(collect, spark_schema(_d1="long", _d2="long", segments="array<binary>"))
    once = sent.groupBy("_d1", "_d2").agg(F.first("segments").alias("segments")).join(alive, ["_d1", "_d2"], "left_semi")
    return materialize(once.withColumn("cls", F.monotonically_increasing_id()))


def overlaps(sets: list[np.ndarray], part: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(flat index i * m + j with i < j, count) of the pairs of sets that share n-grams; of two parts, pairs across."""
    m = len(sets)
    if not sum(map(len, sets)):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    owner, gram = np.repeat(np.arange(m), [len(s) for s in sets]), np.concatenate(sets)
    total = np.zeros((m, m), np.float32)
    few = np.flatnonzero(part == np.argmin(np.bincount(part, minlength=2))) if part is not None and part.any() and not part.all() else None
    if few is not None and len(few) <= 16:  # one side of a few: each looked up in all
        order = np.argsort(gram, kind="stable")
        gram, owner = gram[order], owner[order]
        for i in few:
            low, high = np.searchsorted(gram, sets[i]), np.searchsorted(gram, sets[i], "right")
            many = high - low
            hit = np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            counts = np.bincount(owner[hit], minlength=m)
            total[np.minimum(i, np.arange(m)), np.maximum(i, np.arange(m))] = counts
    else:
        order = np.argsort(gram, kind="stable")
        gram, owner = gram[order], owner[order]
        starts = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
        count = np.diff(np.concatenate([starts, [len(gram)]]))
        for k in np.unique(count[(count > 1) & (count < COMMON)]).tolist():  # n-grams of k sets, side by side
            rows = owner[starts[count == k][:, None] + np.arange(k)]
            for i in range(k - 1):
                pair = (rows[:, i, None] * m + rows[:, i + 1 :]).ravel()
                if len(pair) * 8 > m * m:
                    total += np.bincount(pair, minlength=m * m).reshape(m, m)
                else:
                    np.add.at(total.reshape(-1), pair, 1)
        common = np.flatnonzero(count >= COMMON)
        for c in range(0, len(common), 512):
            some = common[c : c + 512]
            has = np.zeros((m, len(some)), np.float32)
            for k, g in enumerate(some):
                has[owner[starts[g] : starts[g] + count[g]], k] = 1
            total += np.triu(has @ has.T, 1)
    if part is not None and part.any() and not part.all():
        total *= part[:, None] != part
    np.fill_diagonal(total, 0)
    at = np.flatnonzero(total)
    return at, total.ravel()[at].astype(np.int64)


_BLOCK = ["bin", "i", "j"]


def _members(pivot: np.ndarray, part: np.ndarray, cls: np.ndarray):
    """The order of a block's rows, the same in all its fragments, and where each group begins and ends in it."""
    order = np.lexsort((cls, part, pivot))
    p = pivot[order]
    starts = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
    return order, starts, np.concatenate([starts[1:], [len(order)]])


def _partial(share: int):
    def run(table: pa.Table) -> pa.Table:
        """Of one fragment of a block: each pair's part of its overlap, left out if the pair differs too much already."""
        pivot, part, cls, n = (table.column(c).to_numpy() for c in ("pivot", "part", "cls", "n"))
        order, starts, ends = _members(pivot, part, cls)
        segments = table.column("segment")
        pairs, counts, base = [], [], 0
        for a, b in zip(starts, ends, strict=True):
            rows = order[a:b]
            sets = [np.frombuffer(segments[int(r)].as_buffer(), "<u8") for r in rows]
            at, c = overlaps(sets, (part[rows] != part[rows][0]).astype(np.int64))
            x, y = at // len(rows), at % len(rows)
            size, here = n[rows], np.array([len(s) for s in sets])
            both = size[x] + size[y]
            fits = (here[x] + here[y] - 2 * c <= (100 - share) * both // (100 + share)) & (100 * np.minimum(size[x], size[y]) >= share * np.maximum(size[x], size[y]))
            pairs.append(base + at[fits])
            counts.append(c[fits])
            base += len(rows) ** 2
        pairs, counts = np.concatenate(pairs), np.concatenate(counts)
        head = cls[order], n[order], ends - starts
        first = table.column("v")[0].as_py() == 0
        pack = lambda x: pa.compress(x.astype("<i8").tobytes(), "zstd", asbytes=True) if len(x) else b""
        one = {"k": [len(pairs)], "pairs": [pack(np.diff(pairs, prepend=0))], "counts": [pack(counts)], "members": [len(order) if first else 0], "heads": [pack(np.concatenate([*head[:2], head[2]])) if first else None], "groups": [len(starts) if first else 0]}
        return pa.table({c: table.column(c)[:1] for c in _BLOCK} | {c: pa.array(x, t) for (c, x), t in zip(one.items(), (pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.int64()), strict=True)})

    return run


_PARTIAL = {"bin": "long", "i": "int", "j": "int", "k": "long", "pairs": "binary", "counts": "binary", "members": "long", "heads": "binary", "groups": "long"}


def _sum(share: int):
    def run(table: pa.Table) -> pa.Table:
        """Of one block: the sums of its fragments' counts, and a tree over what they link."""
        unpack = lambda x, k: np.frombuffer(pa.decompress(x.as_py(), 8 * k, "zstd"), "<i8") if k else np.empty(0, np.int64)
        k, m, g = (table.column(c).to_pylist() for c in ("k", "members", "groups"))
        where = int(np.argmax(m))
        heads = unpack(table.column("heads")[where], 2 * m[where] + g[where])
        cls, n, sizes = heads[: m[where]], heads[m[where] : 2 * m[where]], heads[2 * m[where] :]
        pairs = np.concatenate([np.cumsum(unpack(x, c)) for x, c in zip(table.column("pairs"), k, strict=True)])
        counts = np.concatenate([unpack(x, c) for x, c in zip(table.column("counts"), k, strict=True)])
        pairs, inverse = np.unique(pairs, return_inverse=True)
        shared = np.bincount(inverse, counts, len(pairs)).astype(np.int64)
        base, first = np.concatenate([[0], np.cumsum(sizes**2)]), np.concatenate([[0], np.cumsum(sizes)])
        group = np.searchsorted(base, pairs, "right") - 1
        x, y = np.divmod(pairs - base[group], sizes[group])
        x, y = x + first[group], y + first[group]
        good = 100 * shared >= share * (n[x] + n[y] - shared)
        tree = Forest(len(cls))
        tree.link(x[good], y[good])
        moved = np.flatnonzero(tree.root != np.arange(len(cls)))
        return pa.table({"pivot": pa.array(cls[first[np.searchsorted(first, moved, "right") - 1]]), "a": pa.array(cls[moved]), "b": pa.array(cls[tree.root[moved]])})

    return run


def _compared(blocks: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """a, b: a tree over what is linked in each group of each block (pivot, cls, bin, i, j, part)."""
    dealt = blocks.join(sets.select("cls", "n", "segments"), "cls").select(*_BLOCK, "pivot", "part", "cls", "n", F.posexplode("segments").alias("v", "segment"))
    return materialize(dealt.groupBy(*_BLOCK, "v").applyInArrow(_partial(share), spark_schema(**_PARTIAL)).groupBy(*_BLOCK).applyInArrow(_sum(share), spark_schema(pivot="long", a="long", b="long")).select("a", "b"))


def _links(stars: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    spark = stars.sparkSession
    bins = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), stars.count() // 4096)
    some = lambda c: F.pmod(F.xxhash64(c), F.lit(bins))
    sizes = materialize(stars.groupBy("pivot").agg(F.count("*").alias("_size")))

    # the pivots with their members, MEMBERS at a time
    chunk = stars.join(sizes, "pivot").withColumn("j", F.expr(f"cast(pmod(xxhash64(cls, 7), ceil(_size / {MEMBERS})) as int)")).select("pivot", "cls", "j", F.lit(1).alias("part"))
    lead = sizes.select("pivot", F.col("pivot").alias("cls"), F.explode(F.expr(f"sequence(0, cast(ceil(_size / {MEMBERS}) as int) - 1)")).alias("j"), F.lit(0).alias("part"))
    near = _compared(chunk.union(lead).select("cls", "pivot", some("pivot").alias("bin"), F.lit(-1).alias("i"), "j", "part"), sets, share)

    # what is not linked to the pivot, with all of its group
    settled = near.select(F.least("a", "b").alias("pivot"), F.greatest("a", "b").alias("cls")).distinct()
    rest = materialize(stars.join(settled, ["pivot", "cls"], "left_anti"))
    left = materialize(rest.groupBy("pivot").agg(F.count("*").alias("_left")).join(sizes, "pivot").select("pivot", F.expr(f"cast(ceil(_left / {MEMBERS}) as int)").alias("_u"), F.expr(f"cast(ceil((_size + 1 - _left) / {MEMBERS}) as int)").alias("_s")))
    near_ones = stars.join(settled, ["pivot", "cls"], "left_semi").union(left.select("pivot", F.col("pivot").alias("cls")))
    unsettled = rest.join(left, "pivot").withColumn("part", F.expr("cast(pmod(xxhash64(cls, 7), _u) as int)")).withColumn("_k", F.explode(F.expr("sequence(0, _u + _s - 1)")))
    others = near_ones.join(left, "pivot").withColumn("part", F.expr("cast(_u + pmod(xxhash64(cls, 7), _s) as int)")).withColumn("_k", F.explode(F.expr("sequence(0, _u - 1)")))
    both = unsettled.unionByName(others).select("cls", "pivot", F.when(F.expr("_u = 1 and _s = 1"), some("pivot")).otherwise(F.xxhash64("pivot")).alias("bin"), F.least("_k", "part").alias("i"), F.greatest("_k", "part").alias("j"), "part")
    return near.union(_compared(both, sets, share))


def ngram_join(docs: DataFrame, n: int, share: int, text: str = "text", doc: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns of keep, n_shingles, component_id, component of every row of docs: texts are linked where 100 *
    intersection >= share * union of their sets of n-grams; component_id is the smallest id that links lead to, the
    row's own included; component (a struct) tells groups apart, null without words.

    Null and wordless texts have n_shingles 0, are linked with nothing and keep their own id. Repeated rows and equal
    sets are linked with each other; sets are told apart by 128 bits, n-grams by 64. Null ids stay null unless a linked
    row has an id. A text of any length is one set, held by one task. An empty table stays empty. Columns of docs other
    than those named are not read. The rows of docs are read twice and have to be the same ones.
    """
    spark = docs.sparkSession
    small_batches(spark)
    slim = docs.select(docs[text].cast("string").alias("_text"), docs[doc].cast("long").alias("doc_id"), *keep)
    size = slim.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    shares = max(LEAST_SHARES, -(-size // SHARE_BYTES))
    sent = slim.mapInArrow(_survey(n, shares, _examined(share)), spark_schema(**_SENT))
    counted = sent.groupBy("share").applyInArrow(_only_here, spark_schema(batch="long", rows="binary", counts="binary"))
    schema = T.StructType(slim.drop("_text").schema.fields + spark_schema(_n="long", _d1="long", _d2="long", _alive="boolean").fields)
    rows = materialize(counted.groupBy("batch").applyInArrow(_partners(share), schema))

    sets = _sets(docs, text, rows, n)
    numbered = sets.select("cls", "_d1", "_d2")
    sets = sets.withColumn("n", F.expr("aggregate(segments, 0L, (s, x) -> s + octet_length(x) div 8)"))
    whole = connected_components(_links(_stars(sets, share), sets, share))

    linked = numbered.join(whole.withColumnRenamed("node", "cls"), "cls").select("_d1", "_d2", F.col("component").alias("_linked"))
    apart = [F.when(F.col("_linked").isNull(), F.col(c)).otherwise(0).alias(k) for c, k in (("_d1", "d1"), ("_d2", "d2"))]
    own = rows.join(linked, ["_d1", "_d2"], "left").withColumn("component", F.when(F.col("_n") > 0, F.struct(F.coalesce("_linked", F.lit(-1)).alias("linked"), *apart)))
    least = own.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("_least"))
    return own.join(least, "component", "left").select("doc_id", *keep, F.col("_n").alias("n_shingles"), F.coalesce("_least", "doc_id").alias("component_id"), "component")
