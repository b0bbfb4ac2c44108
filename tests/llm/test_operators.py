"""Each operator against a plain, slow version of itself, with odd rows: nulls, empty and very long texts, ties, repeats,
empty tables and columns whose names clash with the operators' own."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from flowloom.llm import byte_bpe, embedding_join, histogram_sort, lattice_lm, license_scan, maxscore, ngram_join, registry, shared, source_mix, suffix_dedup, toxicity
from tests.oracle import differs

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, shard string, score string, _x int"
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def documents(spark, texts, sources=None, ids=None):
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, "en", (sources or ["a", "b", None])[k % len(sources or [1, 2, 3])], 1, "x", "y", "z", 0) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    words = ["".join(r.choice(["th", "on", "er", "é", "ß", "日本", "x"]) for _ in range(r.randint(1, 4))) for _ in range(300)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    base, passage = [text(r.randint(1, 120)) for _ in range(60)], text(60)
    out = [*base, None, "", " \t\n", "A\x00b", "one two", "ONE two", passage, passage + " " + text(30), text(20) + "\n" + passage, text(30000), "a" * 5000, "z" * 90 + "z" * 40]
    for b in base[:15]:
        w = b.split()
        if len(w) > 3:
            w[r.randrange(len(w))] = "changed"
        out.append(" ".join(w))
    return out + base[:6] + [out[67]] * 8


def test_registered_queries_agree_with_sql(spark):
    for name, sql in registry.ORACLES.items():
        assert differs(spark, registry.QUERIES[name], sql, SF) == "", name
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in registry.QUERIES) == list(range(1, 11))


# byte-level BPE


def test_byte_bpe_as_tiktoken(spark, texts):
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(3)
    odd = ["".join(r.choice("ab \n\t\u0085　éßЖ漢🙂0١½'s!<|endoftext|>") for _ in range(r.randint(0, 60))) for _ in range(300)]
    every = texts + odd
    got = byte_bpe.byte_bpe(documents(spark, every), ranks, public_tokenizers.PATTERN, keep=("doc_id", "size", "_x")).collect()
    assert len(got) == len(every)
    for row in got:
        t = every[row["doc_id"]] or ""
        assert np.frombuffer(row["ids"], "<u4").tolist() == library.encode_ordinary(t)
        assert bytes(row["decoded"]) == t.encode()
    assert byte_bpe.byte_bpe(documents(spark, []), ranks, public_tokenizers.PATTERN).count() == 0


def test_byte_bpe_with_full_caches():
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    coder, r = byte_bpe.ByteBPE(ranks, public_tokenizers.PATTERN, cached=7), random.Random(5)
    words = ["".join(r.choice("abcdeÉ漢") for _ in range(r.randint(1, 9))) for _ in range(20)]
    for _ in range(200):
        t = " ".join(r.choice(words) for _ in range(12))
        assert np.frombuffer(coder.encode(t), "<u4").tolist() == library.encode_ordinary(t)
        assert len(coder.words) <= 7 and len(coder.words.last) <= 7 and len(coder.pairs) <= 21


# histogram sort


def test_histogram_shards(spark, texts):
    every = texts * 3
    docs = documents(spark, every).withColumn("slot", F.lit("s")).withColumn("more", F.create_map(F.lit("k"), F.col("doc_id")))
    t = F.coalesce("text", F.lit(""))
    rows = histogram_sort.histogram_shards(docs, histogram_sort.even_key(F.col("doc_id"), t), F.octet_length(t) + 16, 5).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(len(every)))
    total, largest = sum(r["size"] for r in rows), max(r["size"] for r in rows)
    for s in range(5):
        own = [r for r in rows if r["shard"] == s]
        assert abs(sum(r["size"] for r in own) - total / 5) <= largest + 1
        assert sorted(r["slot"] for r in own) == list(range(len(own)))


def test_histogram_borders_are_exact(spark):
    df = spark.range(1, 2001).select((F.col("id") * F.col("id")).alias("k"), (F.col("id") % 7 + 1).alias("z"))
    borders = histogram_sort.find_borders(df, "k", "z", 8, tolerance=0.0)
    sizes = [(i * i, i % 7 + 1) for i in range(1, 2001)]
    total = sum(z for _, z in sizes)
    for i, b in enumerate(borders, 1):
        assert abs(sum(z for k, z in sizes if k < b) - total * i / 8) <= 4
    assert histogram_sort.find_borders(df.limit(0), "k", "z", 3) is not None
    same = df.select(F.lit(5).cast("long").alias("k"), F.lit(1).cast("long").alias("z"))
    assert len(histogram_sort.find_borders(same, "k", "z", 4)) == 3


def test_shards_of_empty_and_written(spark, tmp_path):
    empty = documents(spark, [])
    assert histogram_sort.histogram_shards(empty, histogram_sort.even_key(F.col("doc_id")), F.lit(1), 4).count() == 0
    docs = documents(spark, ["a"] * 20).select("doc_id", "text")
    sharded = histogram_sort.histogram_shards(docs, histogram_sort.even_key(F.col("doc_id")), F.lit(16), 2)
    histogram_sort.write_shards(sharded, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == 20


# source mix


def brute_targets(sizes, most=3.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight, out, total = {s: i % 3 + 1 for i, s in enumerate(names)}, {}, float(sum(sizes.values()))
    free, rest = set(names), total
    while free:
        level = rest / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > most * sizes[s]}
        if not over:
            return out | {s: level * weight[s] for s in free}
        for s in over:
            out[s] = most * sizes[s]
            rest -= out[s]
        free -= over
    return out


def test_source_mix(spark, texts):
    every = texts * 2
    sources = ["big", "big", "big", "Z", "é", None, "tiny"]
    docs = documents(spark, every, sources)
    rows, parts, slots = source_mix.source_mix(docs, block_words=64)
    got = rows.collect()
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((i, words(t)) for i, t in enumerate(every))
    size, taken, target = Counter(), Counter(), {}
    for r in got:
        s = None if r["src_null"] else r["src"]
        size[s] += r["size"]
        taken[s] += r["taken"]
        target[s] = r["target"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    want = brute_targets(size)
    for s in size:
        assert target[s] == pytest.approx(want[s])
        assert abs(taken[s] - target[s]) <= max(64, 0.01 * target[s])
    again = source_mix.source_mix(docs.repartition(7), block_words=64)[0].select("doc_id", "taken").collect()
    assert sorted(map(tuple, again)) == sorted((r["doc_id"], r["taken"]) for r in got)
    whole = Counter()
    for r in parts.collect():
        whole[r["doc_id"], r["src"]] += r["words"]
        assert 0 < r["words"] <= r["size"]
    assert {k: n for k, n in whole.items() if n} == {(r["doc_id"], r["src"]): r["taken"] for r in got if r["taken"]}
    # each point of the sequence falls into one source's stretch; ranks follow the order of the sequence
    mix = sorted(slots.collect(), key=lambda r: r["position"])
    stretches = [k for k, n in sorted(Counter((r["src_null"], r["src"]) for r in mix).items()) for _ in range(n)]
    bits, ranks, brute = (len(mix) - 1).bit_length(), Counter(), []
    for i in range(1 << bits):
        point = int(f"{i:0{bits}b}"[::-1], 2)
        if point < len(stretches):
            brute.append((*stretches[point], i, ranks[stretches[point]]))
            ranks[stretches[point]] += 1
    assert [(r["src_null"], r["src"], r["position"], r["rank"]) for r in mix] == brute
    # any stretch of the mix holds the sources near their shares
    order = [r["src"] for r in mix]
    half = Counter(order[: len(order) // 2])
    assert all(abs(half[s] - n / 2) <= 2 + 0.02 * len(order) for s, n in Counter(order).items())


def test_the_sequence_says_when_documents_are_met(spark, texts, monkeypatch):
    docs, real = documents(spark, texts, ["big", "big", "Z", None]), source_mix.schedule
    columns = ["doc_id", "taken", "first_position", "epochs"]
    rows = lambda: sorted(map(tuple, source_mix.source_mix(docs, block_words=64)[0].select(columns).collect()))
    mine = rows()

    def plain(plan, slots):
        order = source_mix.W.orderBy("src_null", "src", "rank")
        return real(plan, slots).withColumn("position", F.row_number().over(order).cast("long"))

    monkeypatch.setattr(source_mix, "schedule", plain)
    assert sum(a != b for a, b in zip(mine, rows(), strict=True)) > len(texts) / 2


def test_source_mix_of_nothing(spark):
    assert source_mix.source_mix(documents(spark, []))[0].count() == 0
    rows = source_mix.source_mix(documents(spark, [None, "", "\t"], ["a"]))[0].collect()
    assert [(r["size"], r["taken"], r["target"]) for r in rows] == [(0, 0, 0.0)] * 3


# license scan


def test_license_places(spark, texts):
    line = "Licensed under the Apache License, Version 2.0."
    every = [*texts, line, "Under the MIT license under the mit license", "cc by nc cc-by-nc", "under the mit", "Mit Under", " ".join(w.upper() for w in license_scan.NOTICES[0][0].split()), license_scan.NOTICES[1][0].replace("forms", "FORMS, of any kind,"), (line + "\n") * 3000]
    got = {r["_row"]: [] for r in license_scan.license_spans(documents(spark, every), keep=("doc_id", "score")).collect()}
    rows = license_scan.license_spans(documents(spark, every), keep=("doc_id", "score")).collect()
    assert len(got) == len(every)
    for i, t in enumerate(every):
        ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        want = []
        for phrase, label in license_scan.PHRASES:
            p = phrase.split()
            want += [(label, j) for j in range(len(ws)) if ws[j : j + len(p)] == p]
        own = [r for r in rows if r["doc_id"] == i]
        assert {r["n_words"] for r in own} == {len(ws)}
        assert sorted((r["label"], r["first_word"]) for r in own if r["exact"]) == sorted(want)
    loose = {(r["doc_id"] - len(texts), r["label"]) for r in rows if r["exact"] is False}
    assert loose == {(5, "mit"), (6, "bsd")}
    assert license_scan.license_spans(documents(spark, [])).count() == 0


def test_licenses_that_differ_by_a_word(spark, monkeypatch):
    creative = "This work is licensed under a Creative Commons Attribution{} 4.0 International License."
    gnu = "under the terms of the GNU{} General Public License as published by the Free Software Foundation"
    want = {0: "cc-by", 1: "cc-by-sa", 3: "gpl", 4: "lgpl", 5: "agpl", 6: "bsd-3"}
    every = [creative.format(""), creative.format("-ShareAlike"), creative.format("-NonCommercial"), gnu.format(""), gnu.format(" Lesser"), gnu.format(" Affero"), next(t for t, label in license_scan.NOTICES if label == "bsd-3")]
    spans = lambda: sorted(map(tuple, license_scan.license_spans(documents(spark, every)).where("label is not null").select("doc_id", "label", "first_word", "last_word").collect()))
    got = spans()
    assert {(i, label) for i, label, _, _ in got} == set(want.items())
    monkeypatch.setattr(license_scan, "MOST_POSITIONS", 10)  # joined by a shuffle
    assert spans() == got



# n-gram join


def brute_components(texts, ids, n, share):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= share * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i in range(len(sets)):
        least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return [(ids[i], len(sets[i]), least[find(i)]) for i in range(len(sets))]


@pytest.mark.parametrize("n,share", [(4, 85), (5, 80), (1, 60)])
def test_ngram_join(spark, texts, n, share):
    r = random.Random(n)
    every = list(texts)
    long = texts[69].split()[:400]
    for k in range(40):  # a family of near copies, some near the border
        w = list(long)
        for _ in range(r.randint(0, 14)):
            w[r.randrange(len(w))] = f"new{k}"
        every.append(" ".join(w))
    ids = list(range(100, 100 + len(every)))
    r.shuffle(ids)
    got = ngram_join.ngram_join(documents(spark, every, ids=ids), n, share).select("doc_id", "n_shingles", "component_id")
    assert sorted(map(tuple, got.collect())) == sorted(brute_components(every, ids, n, share))


def test_ngram_join_large_family(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "MEMBERS", 16)
    monkeypatch.setattr(ngram_join, "COMMON", 8)
    r = random.Random(8)
    base = [f"w{r.randrange(500)}" for _ in range(120)]
    every = []
    for k in range(70):
        w = list(base)
        for _ in range(r.randint(0, 5)):
            w[r.randrange(len(w))] = f"v{r.randrange(40)}"
        every.append(" ".join(w))
    got = ngram_join.ngram_join(documents(spark, every), 4, 85).select("doc_id", "n_shingles", "component_id")
    assert sorted(map(tuple, got.collect())) == sorted(brute_components(every, list(range(70)), 4, 85))


def test_first_fragments_of_similar_sets_meet():
    r = np.random.default_rng(1)
    common = r.random(1 << ngram_join.COUNTER_BITS) < 0.3
    for share in (60, 80, 85, 90):
        for n in [1, 2, 6, 7, 8, 13, 50, 101, 700]:
            for _ in range(25):
                a = np.unique(r.integers(0, 1 << 63, n, np.int64)).astype(np.uint64) * np.uint64(2)
                m = len(a)
                swap = max(0, m * (100 - share) // (100 + share))
                for other in (np.sort(r.permutation(a)[: math.ceil(share * m / 100)]), np.unique(np.concatenate([r.permutation(a)[: m - swap], r.integers(0, 1 << 63, swap, np.int64).astype(np.uint64)]))):
                    both = len(np.intersect1d(a, other))
                    if 100 * both >= share * (m + len(other) - both):
                        assert len(np.intersect1d(ngram_join.first_fragment(a, share, common), ngram_join.first_fragment(other, share, common)))
                        places = ngram_join.Meetings(share, common)
                        assert len(np.intersect1d(places(a), places(other)))


def test_ngram_join_with_common_ngrams(spark, texts, monkeypatch):
    monkeypatch.setattr(ngram_join, "COMMON_TEXTS", 1)
    monkeypatch.setattr(ngram_join, "COMMON_TIMES", 0)
    got = ngram_join.ngram_join(documents(spark, texts), 4, 85).select("doc_id", "n_shingles", "component_id")
    assert sorted(map(tuple, got.collect())) == sorted(brute_components(texts, list(range(len(texts))), 4, 85))


# suffix dedup


def brute_repeats(texts, ids, length=50):
    seen, out = {}, {}
    raw = [(t or "").encode() for t in texts]
    for i, b in zip(ids, raw, strict=True):
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            seen[w] = min(seen.get(w, i), i)
    for i, b in zip(ids, raw, strict=True):
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] < i:
                gone[p : p + length] = b"\1" * length
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out[i] = (len(b), sum(gone), spans, bytes(c for c, g in zip(b, gone, strict=True) if not g))
    return out


def test_suffix_dedup(spark, texts, monkeypatch):
    r = random.Random(2)
    every = [t if t is None or len(t) < 40000 else t[:40000] for t in texts]
    every += ["ab" * 200, "ba" * 120, "x" + "ab" * 60, "".join(r.choice("ab") for _ in range(3000))]
    every += [every[-1][500:1700] + "c" + every[-1][100:151] + "d" + every[-1][10:59]]
    ids = list(range(len(every)))
    r.shuffle(ids)
    monkeypatch.setattr(shared, "CHUNK_BYTES", 4000)
    got = suffix_dedup.suffix_dedup(documents(spark, every, ids=ids).repartition(3), keep=("lang", "size")).collect()
    want = brute_repeats(every, ids)
    assert {x["doc_id"]: (x["n_bytes"], x["n_removed"], x["n_spans"], bytes(x["kept"])) for x in got} == want
    assert len(got) == len(every) and {x["size"] for x in got} == {"x"}


def test_suffix_dedup_odd_ids(spark):
    t = "once more with feeling, " * 3
    rows = suffix_dedup.suffix_dedup(documents(spark, [t, t, t, t], ids=[5, 5, None, None])).collect()
    assert sorted((x["doc_id"] is None, x["n_removed"]) for x in rows) == [(False, 0), (False, 0), (True, len(t)), (True, len(t))]
    assert suffix_dedup.suffix_dedup(documents(spark, [])).count() == 0
    cut = suffix_dedup.suffix_dedup(documents(spark, ["é" * 40, "x" + "é" * 40]), characters=True).collect()
    assert [bytes(x["kept"]).decode() for x in sorted(cut, key=lambda x: x["doc_id"])] == ["é" * 40, "x"]


def test_previous_smaller():
    r = np.random.default_rng(0)
    for _ in range(50):
        n = r.integers(1, 60)
        v, g = r.integers(0, 6, n), np.sort(r.integers(0, 4, n))
        want = [max([j for j in range(i) if g[j] == g[i] and v[j] < v[i]], default=-1) for i in range(n)]
        assert suffix_dedup.previous_smaller(v, g).tolist() == want


def test_windows_in_parts(monkeypatch):
    r = np.random.default_rng(2)
    text = r.integers(97, 99, 4000).astype(np.uint8)
    windows, doc = r.integers(0, 3900, 900), r.integers(0, 30, 900)
    whole = suffix_dedup.longest_previous(text, windows, doc, 10)
    strings = [bytes(text[w : w + 10]) for w in windows]
    least = {}
    for t, d in zip(strings, doc, strict=True):
        least[t] = min(least.get(t, d), d)
    assert whole.tolist() == [least[t] < d for t, d in zip(strings, doc, strict=True)]
    monkeypatch.setattr(suffix_dedup, "SORTED_WINDOWS", 100)
    assert suffix_dedup.in_parts(text, windows, doc, 10).tolist() == whole.tolist()


def test_large_files_in_parts():
    import pyarrow as pa

    r = np.random.default_rng(5)
    text = r.integers(97, 99, 4000).astype(np.uint8).tobytes()
    starts, sizes = r.integers(0, 3800, 40), r.integers(60, 99, 40)
    packed = suffix_dedup._squeeze(suffix_dedup._planes(np.zeros(40, np.uint64), 6), np.arange(40).astype("<i8").tobytes(), sizes.astype("<i4").tobytes(), np.arange(40).astype("<i8").tobytes(), b"".join(text[a : a + n] for a, n in zip(starts, sizes, strict=True)))
    run = suffix_dedup._factors(50, 7)

    def covered(share):
        (found,) = run(pa.table({"share": pa.array([share], pa.int32()), "chunk": pa.array([0], pa.int64()), "sent": pa.array([packed], pa.binary())})).column("found").to_pylist()
        triples = suffix_dedup._unsqueeze(found)[0].view("<i8").reshape(-1, 3).tolist() if found else []
        return {(g, x) for g, a, b in triples for x in range(a, b)}

    whole = covered(3)
    assert whole and set.union(*(covered(3 + 7 * (p + 1)) for p in range(suffix_dedup.SPLIT_INTO))) == whole


# embeddings


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, 2, "c") for i, v in rows], "vec_id bigint, embedding array<float>, label int, links int, cls string")


def odd_vectors(dims=20):
    r = np.random.default_rng(4)
    rows = [r.standard_normal(dims) for _ in range(150)]
    for k in range(30):
        rows.append(rows[k % 5] * r.uniform(0.1, 9) + r.standard_normal(dims) * r.uniform(0, 0.4))
    rows += [rows[3]] * 6 + [None, [0.0] * dims, [float("nan")] * dims, [float("inf")] + [1.0] * (dims - 1), [None] + [1.0] * (dims - 1), [], rows[3][:7], rows[3][:7] * 2]
    return list(enumerate(rows))


def test_embedding_join(spark, monkeypatch):
    monkeypatch.setattr(embedding_join, "SIDE_ROWS", 20)
    rows = odd_vectors()
    got = {r["vec_id"]: r for r in embedding_join.embedding_join(vectors(spark, rows), 0.95).collect()}
    assert len(got) == len(rows)
    unit = {}
    for i, v in rows:
        if v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v):
            x = np.asarray(v, np.float32).astype(float)
            unit[i] = x / np.linalg.norm(x)
    links = {i: {j for j in unit if j != i and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.95} for i in unit}
    for i, _ in rows:
        reach, todo = {i}, [i]
        while todo:
            for j in links.get(todo.pop(), ()):
                if j not in reach:
                    reach.add(j)
                    todo.append(j)
        assert got[i]["n_links"] == len(links.get(i, ())) and got[i]["component_id"] == min(reach)
        assert got[i]["kept"] == (min(reach) == i)
    assert embedding_join.embedding_join(vectors(spark, []), 0.95).count() == 0


def test_maxscore(spark, monkeypatch):
    monkeypatch.setattr(maxscore, "SHARD_ROWS", 32)
    monkeypatch.setattr(maxscore, "BLOCK_QUERIES", 5)
    rows = odd_vectors(40) + [(None, [1.0] * 40), (500, [3.0e30] + [1.0] * 39)]
    got = maxscore.maxscore(vectors(spark, rows), F.col("vec_id") % 20 == 0, 20).collect()
    whole = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            whole[i] = [math.floor(64 * float(np.float32(x))) for x in v]
    want = []
    clip = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
    for q in whole:
        if q % 20 == 0:
            all_ = sorted((-clip(sum(a * b for a, b in zip(whole[q], whole[c], strict=True))), c) for c in whole if c != q and len(whole[c]) == len(whole[q]))
            want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(all_[:20])]
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == sorted(want)
    assert maxscore.maxscore(vectors(spark, []), F.col("vec_id") % 20 == 0, 20).count() == 0


# language model


def test_lattice_against_all_segmentations():
    pieces = [bytes([b]) for b in range(256)] + [b" a", b"ab", b"b ", b"abc", b" ab", b"ca"]
    r = np.random.default_rng(0)
    logs = np.log(r.dirichlet(np.ones(len(pieces))))
    model, number = lattice_lm.Lattice(pieces, logs), {p: i for i, p in enumerate(pieces)}

    def ways(t):
        if not t:
            yield []
        for n in range(1, len(t) + 1):
            if t[:n] in number:
                for rest in ways(t[n:]):
                    yield [number[t[:n]], *rest]

    words = [b"abcab", b"a", b"", b"cab", b"abcabcab"]
    counts = np.array([1.0, 2.0, 1.0, 3.0, 1.0])
    got, expected = model.scores(words, counts)
    want_expected = np.zeros(len(pieces))
    for w, g, c in zip(words, got, counts, strict=True):
        each = [(math.exp(sum(logs[i] for i in way)), way) for way in ways(b" " + w)]
        total = sum(p for p, _ in each)
        assert g == pytest.approx(math.log(total))
        for p, way in each:
            for i in way:
                want_expected[i] += c * p / total
    assert expected == pytest.approx(want_expected)
    one_by_one = [model._long(b" " + w, None, None) for w in words]
    assert one_by_one == pytest.approx(got.tolist())
    into = np.zeros(len(pieces) + 1)
    for w, c in zip(words, counts, strict=True):
        model._long(b" " + w, c, into)
    assert into[:-1] == pytest.approx(want_expected)


def brute_marginals(texts, counts, pieces, rounds=lattice_lm.ROUNDS):
    """log10 probabilities over all segmentations, of texts as lists of words that None ends; a word at a time, by plain
    sums of probabilities, after the same rounds over the counted words."""
    weights, end = dict(pieces), max(pieces.values())
    longest = max(map(len, pieces))

    def forward(t, p):
        alpha = [1.0] + [0.0] * len(t)
        for j in range(1, len(t) + 1):
            alpha[j] = sum(alpha[i] * p.get(t[i:j], 0.0) for i in range(max(0, j - longest), j))
        return alpha

    for left in range(rounds if counts else 0, -1, -1):
        total = sum(weights.values()) + end
        p = {k: v / total for k, v in weights.items()}
        if not left:
            break
        got = Counter()
        for w, c in counts.items():
            if w is None:
                continue
            t = b" " + w
            alpha, beta = forward(t, p), [0.0] * len(t) + [1.0]
            for i in range(len(t) - 1, -1, -1):
                beta[i] = sum(p.get(t[i:j], 0.0) * beta[j] for j in range(i + 1, min(len(t), i + longest) + 1))
            for i in range(len(t)):
                for j in range(i + 1, min(len(t), i + longest) + 1):
                    if t[i:j] in p:
                        got[t[i:j]] += c * alpha[i] * p[t[i:j]] * beta[j] / beta[0]
        weights = {k: lattice_lm.PRIOR + got[k] for k in weights}
        end = lattice_lm.PRIOR + counts[None]
    of = {}
    for w in {w for ws in texts for w in ws if w is not None}:
        of[w] = math.log10(forward(b" " + w, p)[-1])
    return [sum(of[w] if w is not None else math.log10(end / total) for w in ws) for ws in texts]


def test_lattice_scores(spark, texts):
    pieces = lattice_lm.read_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    texts = [t if t is None or max(map(len, t.split()), default=0) < 150 else "short" for t in texts]  # plain doubles do not reach farther
    docs = documents(spark, texts)
    learn = toxicity.doc_bucket(F.col("doc_id"), 10) != 0
    got = {r["doc_id"]: r for r in lattice_lm.lattice_scores(docs, learn, pieces).collect()}
    split = lambda t: re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()) + [None]
    counts = Counter()
    for i, t in enumerate(texts):
        if zlib.crc32(str(i).encode()) % 10:
            counts.update(split(t))
    total, kinds = sum(counts.values()), len(counts)
    want = brute_marginals([split(t) for t in texts], counts, pieces)
    for i, t in enumerate(texts):
        ws = split(t)
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(counts[w] > 0 for w in ws), total)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in ws))
        assert math.isfinite(r["score"]) and r["score"] < 0
        assert r["score"] == pytest.approx(want[i], rel=1e-6)
    assert lattice_lm.lattice_scores(documents(spark, []), learn, pieces).count() == 0
    untaught = lattice_lm.lattice_scores(docs.limit(3), F.lit(False), pieces).collect()
    assert all(math.isfinite(r["score"]) and r["n_known"] == 0 for r in untaught)


# toxicity


def test_toxicity_held_out(spark):
    r = random.Random(6)
    words = [f"w{k}" for k in range(400)]
    rows, labels = [], []
    for i in range(900):
        ws = [r.choice(words) for _ in range(40)]
        bad = r.random() < 0.2
        if bad:
            ws[5], ws[9] = r.choice(["slimeball", "numbskull"]), r.choice(["slimeballs", "numbskulls"])
        if r.random() < (0.8 if bad else 0.1):
            ws[0] = "women"
        rows.append(" ".join(ws))
        labels.append((i, 1, int(bad)))
    docs = documents(spark, rows)
    marks = spark.createDataFrame(labels + [(None, 1, 1), (7, 1, None)], "doc_id bigint, quality int, toxic int")
    model = toxicity.train(docs, marks, toxicity.doc_bucket(F.col("doc_id"), 3) != 1)
    got = {x["doc_id"]: x["score"] for x in toxicity.toxicity(docs, model).collect()}
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all((got[i] >= toxicity.THRESHOLD) == bool(labels[i][2]) for i in held)
    neutral = ["men", "women"]
    a, b = (model.score(f"w1 w2 {g} w3".encode()) for g in neutral)
    assert abs(a - b) < 0.1
    bags = [toxicity.text_words(t.encode()) for t in rows]
    free = toxicity.fit(bags, [x[2] for x in labels], swap_penalty=0.0)
    gap = lambda m: abs(m.logit({b"women"}) - m.logit({b"men"}))
    assert gap(toxicity.fit(bags, [x[2] for x in labels])) < 0.5 * gap(free)


def test_toxicity_odd_rows(spark, texts):
    model = toxicity.fit([], [])
    assert {x["score"] for x in toxicity.toxicity(documents(spark, texts), model).collect()} == {0.5}
    docs = documents(spark, texts)
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert toxicity.train(docs, none, F.lit(True)).weights == {}
    assert toxicity.toxicity(documents(spark, []), model).count() == 0


# components


def test_connected_components(spark):
    r = random.Random(9)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(260)] + [(k, k + 1) for k in range(1000, 1200)] + [(5000, k) for k in range(5001, 5100)] + [(7, 7), (-3, -9)]
    got = dict(map(tuple, shared.connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()))
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    for n in near:
        reach, todo = {n}, [n]
        while todo:
            for j in near[todo.pop()] - reach:
                reach.add(j)
                todo.append(j)
        assert got[n] == min(reach)
    assert set(got) == set(near)
    assert shared.connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_digests_of_the_queries(spark):
    row = registry.op8_suffix_dedup(spark, SF).first()
    assert len(row["kept_sha256"]) == len(hashlib.sha256(b"").hexdigest())
