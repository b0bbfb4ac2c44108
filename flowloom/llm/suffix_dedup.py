"""Removing repeated passages: every byte of a later document that a long enough earlier match covers.

The text of all documents is never sorted as one. A window of LENGTH bytes is filed under its anchor, the smallest
hash of the ANCHOR-byte strings in it, so equal windows are filed together wherever they stand. Neighbouring windows of
one anchor make a segment. A chunk of documents asks about each of its different segments once, with the smallest
document that has it, so what many documents share is summed up before it moves:

1. Files that hold one segment from several documents: all windows of the later ones are removed, by 48 bits of the
   anchor and 64 of the content.
2. Files that hold different segments from several documents: their windows may still be equal in part (a passage
   begins or ends, a word was changed). The segments' first owners send their bytes; the windows are put in suffix
   order, and the longest previous factor of each is taken with its nearest neighbours, before and after in that order,
   that are in smaller documents. A window whose factor is LENGTH bytes long is removed.

Chunks are read by their number each time, so no task holds more than a chunk or one share of the files.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ngram_join import mix
from .shared import CHUNK_LEVEL, materialize, pack, spark_schema, text_bytes, unpack

#: Bytes of a match, and of the strings whose hashes choose the anchor.
LENGTH, ANCHOR = 50, 20
#: Bytes of text for which there is one share of the files.
SHARE_BYTES = 16 << 20
#: Windows that are sorted at once.
SORTED_WINDOWS = 1 << 19
#: A file of more different segments goes to so many tasks, each for the windows whose first bytes are its own.
SPLIT_FROM, SPLIT_INTO = 4096, 16

_U = np.uint64
_B = 0x9E3779B97F4A7C15 | 1
_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0xD6E8FEB86659FD93))
_NO_ID = (1 << 63) - 1  # documents without an id come last


def _power(n: int) -> np.uint64:
    return _U(pow(_B, n, 1 << 64))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    done, out = 1, x
    while 2 * done <= width:
        out = np.minimum(out[:-done], out[done:])
        done *= 2
    return np.minimum(out[: len(out) - (width - done)], out[width - done :]) if width > done else out


def segments(text: bytes, length: int = LENGTH, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, content hash, first window and number of windows of each segment of a text, in its order."""
    if len(text) < length:
        none = np.empty(0, np.uint64)
        return none, none, none.astype(np.int32), none.astype(np.int32)
    h, hashes = _TABLE[np.frombuffer(text, np.uint8)], {}
    step = 1
    while True:  # hashes of all strings of 1, 2, 4, ... bytes
        hashes[step] = h
        if 2 * step > length:
            break
        h = h[:-step] + _power(step) * h[step:]
        step *= 2

    def strings(n: int) -> np.ndarray:
        out, at = None, 0
        for size in sorted(hashes, reverse=True):
            if n - at >= size:
                part = hashes[size][at : len(text) - n + 1 + at]
                out = part if out is None else out + _power(at) * part
                at += size
        return out

    chosen = _sliding_min(mix(strings(anchor)), length - anchor + 1)
    starts = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
    counts = np.diff(np.concatenate([starts, [len(chosen)]]))
    if counts.max() > length:  # first and last window have to cover a segment
        pieces = -(-counts // length)
        offset = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        ends = np.repeat(starts + counts, pieces)
        starts = np.repeat(starts, pieces) + offset * length
        counts = np.minimum(ends - starts, length)
    windows = mix(strings(length))
    content = mix(windows[starts] + _U(_B)) ^ (windows[starts + counts - 1] * _U(3) + counts.astype(np.uint64))
    return mix(chosen[starts] + _U(1)), mix(content), starts.astype(np.int32), counts.astype(np.int32)


def _merge(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of intervals; those that touch become one."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    first = np.flatnonzero(np.concatenate([[True], starts[1:] > reach[:-1]]))
    return starts[first], reach[np.concatenate([first[1:] - 1, [len(starts) - 1]])]


class _Chunk:
    """A chunk's documents by id, and their segments by share, anchor, content and document; the same in every pass."""

    def __init__(self, blob: bytes, shares: int):
        rows = unpack(blob)
        ids = rows.column(1).fill_null(_NO_ID).to_numpy()
        self.order = np.argsort(ids, kind="stable")
        self.ids, self.nulls = ids[self.order], rows.column(1).is_null().to_numpy()[self.order]
        texts = text_bytes(rows.column(0).combine_chunks())
        self.texts = [texts[i] for i in self.order]
        found = [segments(t) for t in self.texts]
        self.anchor, self.content, self.start, self.count = (np.concatenate([f[i] for f in found]) if found else np.empty(0) for i in range(4))
        self.doc = np.repeat(np.arange(len(found), dtype=np.int32), [len(f[0]) for f in found])
        self.share = (self.anchor % _U(shares)).astype(np.int32)
        # 48 bits tell anchors apart, 64 the contents under one anchor: a wrong equality needs both to agree by chance
        self.anchor = self.anchor >> _U(16)
        by = np.lexsort((self.content, self.anchor, self.share))
        self.anchor, self.content, self.start, self.count, self.doc, self.share = (x[by] for x in (self.anchor, self.content, self.start, self.count, self.doc, self.share))
        changed = (self.share[1:] != self.share[:-1]) | (self.anchor[1:] != self.anchor[:-1]) | (self.content[1:] != self.content[:-1])
        self.first = np.flatnonzero(np.concatenate([[True], changed])) if len(by) else np.empty(0, np.int64)
        self.size = np.diff(np.concatenate([self.first, [len(by)]])).astype(np.int64)

    def shares(self):
        """(share, from, to) of the different segments."""
        share = self.share[self.first]
        edges = [0, *(np.flatnonzero(share[1:] != share[:-1]) + 1), len(share)] if len(share) else [0]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            yield int(share[a]), int(a), int(b)


def _planes(x: np.ndarray, size: int) -> bytes:
    """The lowest ``size`` bytes of each number, byte by byte: the first ones of sorted numbers repeat and compress."""
    return np.ascontiguousarray(x.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - size :].T).tobytes()


def _from_planes(x: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros((len(x) // size, 8), np.uint8)
    out[:, 8 - size :] = x.reshape(size, -1).T
    return out.view(">u8").ravel().astype(np.uint64)


def _squeeze(*arrays: bytes) -> bytes:
    table = pa.table({"x": pa.array(arrays, pa.binary())})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", CHUNK_LEVEL))) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unsqueeze(blob: bytes) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.uint8) for x in unpack(blob).column(0)]


def previous_smaller(values: np.ndarray, group: np.ndarray) -> np.ndarray:
    """For each place the nearest place before it, in the same group of neighbours, with a smaller value; -1 if none."""
    n = len(values)
    at = np.arange(n) - 1
    at[np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))] = -1
    jump, todo = at.copy(), np.flatnonzero(at >= 0)
    while len(todo):
        todo = todo[values[at[todo]] >= values[todo]]
        at[todo] = jump[at[todo]]  # what is not smaller than it cannot be smaller than this
        todo = todo[at[todo] >= 0]
    return at


def longest_previous(text: np.ndarray, windows: np.ndarray, doc: np.ndarray, length: int) -> np.ndarray:
    """Whether the string of ``length`` bytes at each of ``windows`` also starts at another of them in a smaller doc.

    The windows in suffix order to that depth; neighbours whose common prefix reaches it stand together, and the longest
    previous factor reaches it if the nearest one before or after with a smaller document stands there too.
    """
    strings = np.lib.stride_tricks.sliding_window_view(text, length)[windows]
    order = np.argsort(np.ascontiguousarray(strings).view(f"S{length}").ravel(), kind="stable")
    whole = strings[order]
    differs = (whole[1:] != whole[:-1]).any(axis=1)
    group = np.concatenate([[0], np.cumsum(differs)])
    d = doc[order]
    before = previous_smaller(d, group) >= 0
    after = previous_smaller(d[::-1], group[::-1])[::-1] >= 0
    out = np.empty(len(windows), bool)
    out[order] = before | after
    return out


def lead_hash(text: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Of the first bytes of each window: the same for equal windows."""
    return mix(np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(text, 8)[windows]).view("<u8").ravel())


def in_parts(text: np.ndarray, windows: np.ndarray, doc: np.ndarray, length: int) -> np.ndarray:
    """``longest_previous`` of any number of windows: SORTED_WINDOWS or so are sorted at once, dealt by their first bytes, so
    equal ones stay together."""
    parts = -(-len(windows) // SORTED_WINDOWS)
    if parts <= 1:
        return longest_previous(text, windows, doc, length)
    part, out = lead_hash(text, windows) // _U(SPLIT_INTO) % _U(parts), np.zeros(len(windows), bool)
    for p in range(parts):
        some = np.flatnonzero(part == _U(p))
        if len(some):
            out[some] = longest_previous(text, windows[some], doc[some], length)
    return out


def _request(shares: int):
    def run(batches):
        for batch in batches:
            for number, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                c = _Chunk(blob, shares)
                out = []
                for share, a, b in c.shares():
                    rows = c.first[a:b]
                    docs, which = np.unique(c.doc[rows], return_inverse=True)
                    kind = "<u2" if len(docs) <= 1 << 16 else "<u4"
                    out.append((share, number, _squeeze(_planes(c.anchor[rows], 6), _planes(c.content[rows], 8), which.astype(kind).tobytes(), c.ids[docs].astype("<i8").tobytes())))
                yield _rows(out, (pa.int32(), pa.int64(), pa.binary()), ("share", "chunk", "asked"))

    return run


def _rows(rows: list[tuple], types, names) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], list(names))


#: What a chunk is told of a segment: nothing, that an earlier document has all of it, or to send its bytes, to one task
#: or to all those of a large file.
NOTHING, REMOVED, SEND, SPLIT = 0, 1, 2, 3


def _answer(table: pa.Table) -> pa.Table:
    """Of all chunks' segments in one share of the files."""
    anchors, contents, docs, lengths = [], [], [], []
    for blob in table.column("asked"):
        anchor, content, which, ids = _unsqueeze(blob.as_py())
        n = len(anchor) // 6
        which = which.view("<u2" if len(which) == 2 * n else "<u4")
        anchors.append(_from_planes(anchor, 6))
        contents.append(_from_planes(content, 8))
        docs.append(ids.view("<i8")[which])
        lengths.append(n)
    anchor, content, doc = np.concatenate(anchors), np.concatenate(contents), np.concatenate(docs)
    order = np.lexsort((doc, content, anchor))
    a, c, d = anchor[order], content[order], doc[order]
    new_file = np.concatenate([[True], a[1:] != a[:-1]])
    new_segment = new_file | np.concatenate([[True], c[1:] != c[:-1]])
    files, segs = np.flatnonzero(new_file), np.flatnonzero(new_segment)
    of_file, of_segment = np.cumsum(new_file) - 1, np.cumsum(new_segment) - 1
    least = d[segs][of_segment]
    many = np.add.reduceat(new_segment, files)
    several = many > 1
    several &= np.minimum.reduceat(d, files) < np.maximum.reduceat(d, files)
    told = np.where(d > least, REMOVED, np.where(several[of_file], np.where(many[of_file] > SPLIT_FROM, SPLIT, SEND), NOTHING)).astype(np.uint8)
    back = np.empty(len(told), np.uint8)
    back[order] = told
    edges = np.cumsum(lengths)[:-1]
    return pa.table({"chunk": table.column("chunk"), "share": table.column("share"), "told": pa.array([_squeeze(x.tobytes()) for x in np.split(back, edges)], pa.binary())})


def _mark(shares: int, length: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        """From a chunk and what it was told: its removed intervals so far, and the bytes that it sends."""
        out = []
        told = {s: _unsqueeze(b.as_py())[0] for s, b in zip(right.column("share").to_pylist(), right.column("told"), strict=True)}
        for number, blob in zip(left.column("chunk").to_pylist(), left.column("blob").to_pylist(), strict=True):
            c = _Chunk(blob, shares)
            said = np.concatenate([told[s] for s, _, _ in c.shares()]) if len(c.first) else np.empty(0, np.uint8)
            group = np.repeat(np.arange(len(c.first)), c.size)
            owner = c.doc[c.first][group] if len(c.first) else c.doc
            later = (c.ids[c.doc] > c.ids[owner]) if len(c.doc) else np.empty(0, bool)
            gone = later | (said[group] == REMOVED)
            docs, starts, ends = [], [], []
            by = np.argsort(c.doc[gone], kind="stable")
            d, s, e = c.doc[gone][by], c.start[gone][by], (c.start[gone] + c.count[gone] + length - 1)[by]
            edges = [0, *(np.flatnonzero(d[1:] != d[:-1]) + 1), len(d)] if len(d) else [0]
            for x, y in zip(edges[:-1], edges[1:], strict=True):
                a, b = _merge(s[x:y], e[x:y])
                docs.append(np.full(len(a), d[x], np.int32))
                starts.append(a)
                ends.append(b)
            places = [np.concatenate(x).astype("<i4").tobytes() if x else b"" for x in (docs, starts, ends)]
            # every place of a sent segment in documents that nobody comes before
            sent = np.flatnonzero((said[group] >= SEND) & ~gone)
            out.append((number, -1, _squeeze(*places, group[sent].astype("<i8").tobytes(), c.doc[sent].astype("<i4").tobytes(), c.start[sent].astype("<i4").tobytes()), None))
            for share, a, b in c.shares():
                for word in (SEND, SPLIT):
                    groups = np.arange(a, b)[said[a:b] == word]
                    if not len(groups):
                        continue
                    rows = c.first[groups]
                    sizes = c.count[rows] + length - 1
                    text = b"".join(c.texts[d][s : s + n] for d, s, n in zip(c.doc[rows], c.start[rows], sizes, strict=True))
                    packed = _squeeze(_planes(c.anchor[rows], 6), c.ids[c.doc[rows]].astype("<i8").tobytes(), sizes.astype("<i4").tobytes(), groups.astype("<i8").tobytes(), text)
                    places = [share] if word == SEND else [share + shares * (p + 1) for p in range(SPLIT_INTO)]
                    out += [(number, place, None, packed) for place in places]
        return pa.Table.from_batches([_rows(out, (pa.int64(), pa.int32(), pa.binary(), pa.binary()), ("chunk", "share", "state", "sent"))])

    return run


def _factors(length: int, shares: int):
    def run(table: pa.Table) -> pa.Table:
        """Of the segments sent for one share of the files: which windows of each are in a smaller document. A share's
        numbers beyond the first ``shares`` are the parts of its large files."""
        own = table.column("share")[0].as_py() // shares - 1
        anchors, ids, sizes, groups, texts, source = [], [], [], [], [], []
        for k, blob in enumerate(table.column("sent")):
            a, d, s, g, t = _unsqueeze(blob.as_py())
            anchors.append(_from_planes(a, 6))
            ids.append(d.view("<i8"))
            sizes.append(s.view("<i4").astype(np.int64))
            groups.append(g.view("<i8"))
            texts.append(t)
            source.append(np.full(len(groups[-1]), k))
        anchor, doc, size, group, source, text = (np.concatenate(x) for x in (anchors, ids, sizes, groups, source, texts))
        at = np.cumsum(size) - size
        order = np.lexsort((doc, anchor))  # files one after another
        answers: list[list[tuple]] = [[] for _ in range(table.num_rows)]
        windows = (size - (length - 1))[order]
        files = np.flatnonzero(np.concatenate([[True], anchor[order][1:] != anchor[order][:-1]]))
        reach = np.concatenate([np.cumsum(windows)[files[1:] - 1], [windows.sum()]])
        begin = 0
        while begin < len(files):  # whole files, about SORTED_WINDOWS windows at once
            done = reach[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(reach, done + SORTED_WINDOWS, "right")))
            rows = order[files[begin] : files[end] if end < len(files) else len(order)]
            n = (size - (length - 1))[rows]
            first = np.cumsum(n) - n
            row = np.repeat(np.arange(len(rows)), n)
            inside = np.arange(len(row)) - first[row]
            where = at[rows][row] + inside
            if own >= 0:
                mine = np.flatnonzero(lead_hash(text, where) % _U(SPLIT_INTO) == _U(own))
                row, inside, where = row[mine], inside[mine], where[mine]
            hit = np.flatnonzero(in_parts(text, where, doc[rows][row], length)) if len(where) else np.empty(0, np.int64)
            if len(hit):  # runs of neighbouring windows
                new = np.flatnonzero(np.concatenate([[True], (np.diff(inside[hit]) != 1) | (row[hit][1:] != row[hit][:-1])]))
                last = np.concatenate([new[1:] - 1, [len(hit) - 1]])
                for r, a, b in zip(rows[row[hit[new]]], inside[hit[new]], inside[hit[last]], strict=True):
                    answers[source[r]].append((group[r], a, b + length))
            begin = end
        packed = [_squeeze(np.asarray(x, "<i8").tobytes()) if x else None for x in answers]
        return pa.table({"chunk": table.column("chunk"), "state": pa.array([None] * len(packed), pa.binary()), "found": pa.array(packed, pa.binary())})

    return run


def _finish(keep: list[str], characters: bool):
    names = ("n_bytes", "n_removed", "n_spans", "kept")
    types = (pa.int64(), pa.int64(), pa.int64(), pa.binary())

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        tables = []
        for blob in left.column("blob").to_pylist():
            rows = unpack(blob)
            order = np.argsort(rows.column(1).fill_null(_NO_ID).to_numpy(), kind="stable")
            docs, starts, ends, out = [], [], [], []
            group = place = begin = np.empty(0, np.int64)
            for state in right.column("state").drop_null():
                d, s, e, group, place, begin = _unsqueeze(state.as_py())
                for column, x in zip((docs, starts, ends), (d, s, e), strict=True):
                    column.append(x.view("<i4").astype(np.int64))
                group, place, begin = group.view("<i8"), place.view("<i4").astype(np.int64), begin.view("<i4").astype(np.int64)
            by = np.argsort(group, kind="stable")
            for found in right.column("found").drop_null():
                g, a, b = _unsqueeze(found.as_py())[0].view("<i8").reshape(-1, 3).T
                low, high = np.searchsorted(group[by], g), np.searchsorted(group[by], g, "right")
                many = high - low
                which = by[np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
                docs.append(place[which])
                starts.append(begin[which] + np.repeat(a, many))
                ends.append(begin[which] + np.repeat(b, many))
            docs, starts, ends = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (docs, starts, ends))
            by = np.argsort(docs, kind="stable")
            docs, starts, ends = docs[by], starts[by], ends[by]
            edges = np.searchsorted(docs, np.arange(len(order) + 1))
            for k, text in enumerate(text_bytes(rows.column(0).combine_chunks().take(pa.array(order)))):
                a, b = _merge(starts[edges[k] : edges[k + 1]], ends[edges[k] : edges[k + 1]])
                kept = b"".join(text[x:y] for x, y in zip([0, *b], [*a, len(text)], strict=True))
                removed = len(text) - len(kept)
                if characters and removed:
                    kept = kept.decode("utf-8", "ignore").encode()
                out.append((len(text), removed, len(a), kept))
            same = rows.select(keep).take(pa.array(order)).combine_chunks()
            tables.append(pa.table([*same.columns, *[pa.array([r[i] for r in out], t) for i, t in enumerate(types)]], [*keep, *names]))
        return pa.concat_tables(tables)

    return run


def suffix_dedup(docs: DataFrame, text: str = "text", doc: str = "doc_id", keep: tuple[str, ...] = (), length: int = LENGTH, characters: bool = False) -> DataFrame:
    """doc_id, the columns of keep, n_bytes, n_removed, n_spans, kept (binary: the bytes that stay) of every row of docs.

    A byte goes if a string of ``length`` bytes covers it that also starts in a row with a smaller id. Rows with the
    same id do not remove from each other; null ids come last. Null texts count as empty; texts shorter than ``length``
    stay whole. What stays need not be valid UTF-8 at the cuts, unless ``characters`` asks for characters cut in two to go. An empty table stays empty; columns of docs other than
    those named are not read. Chunks with one text longer than their size hold that text alone.
    """
    if length != LENGTH:
        raise ValueError(f"anchors are chosen for {LENGTH} bytes")
    slim = docs.select(docs[text].cast("string").alias("_text"), docs[doc].cast("long").alias("doc_id"), *keep)
    others = ["doc_id", *keep]
    chunks = materialize(pack(slim, "_text", others), "none")
    total = chunks.agg(F.sum("n_bytes")).first()[0] or 0
    spark = docs.sparkSession
    shares = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // SHARE_BYTES))
    blobs = chunks.select("chunk", "blob")
    asked = blobs.mapInArrow(_request(shares), spark_schema(share="int", chunk="long", asked="binary"))
    told = asked.groupBy("share").applyInArrow(_answer, spark_schema(chunk="long", share="int", told="binary"))
    marked = materialize(blobs.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(_mark(shares, length), spark_schema(chunk="long", share="int", state="binary", sent="binary")), "none")
    sent = marked.where("sent is not null").select("chunk", "share", "sent")
    found = sent.groupBy("share").applyInArrow(_factors(length, shares), spark_schema(chunk="long", state="binary", found="binary"))
    known = marked.where("state is not null").select("chunk", "state", F.lit(None).cast("binary").alias("found")).union(found)
    schema = T.StructType(slim.select(*others).schema.fields + spark_schema(n_bytes="long", n_removed="long", n_spans="long", kept="binary").fields)
    return blobs.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(_finish(others, characters), schema)
