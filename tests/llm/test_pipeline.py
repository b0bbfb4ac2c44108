"""The stages of the pipeline, the pipeline itself and the queries without SQL, against plain, slow versions of them."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline as pipe
from flowloom.llm import byte_bpe, license_scan, registry, source_mix, toxicity
from tests.llm.test_operators import SF, brute_components, brute_repeats, brute_targets

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def key(row):
    return repr(tuple(row))


@pytest.fixture(scope="module")
def library():
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def corpus():
    """Rows of documents and labels: toxic words, near copies, shared passages, nulls, wordless texts, rows twice."""
    r = random.Random(11)
    known = ["".join(r.choice(["ka", "lo", "mé", "日本", "t", "ri"]) for _ in range(r.randint(1, 4))) for _ in range(500)]
    text = lambda n: " ".join(r.choice(known) for _ in range(n))
    passage, texts, labels = text(40), [], []
    for i in range(160):
        ws, bad = text(r.randint(20, 90)).split(), r.random() < 0.3
        if bad:
            ws[3], ws[7] = "slimeball", "numbskull"
        texts.append(" ".join(ws))
        labels.append((i, 1, int(bad)))
    for i in range(0, 30, 3):
        ws = texts[i].split()
        ws[len(ws) // 2] = "changed"
        texts += [" ".join(ws), text(5) + "  " + passage + "\n" + text(6)]
    texts += [None, "", " \t", None, "two words", "日" * 40]
    rows = [(i, t, "en", ["a", "b", None, "a", "c"][i % 5], len(t or "")) for i, t in enumerate(texts)]
    r.shuffle(rows)
    return [*rows, rows[4], rows[9]], labels


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def brute_toxic(rows, labels):
    used = [(d, y) for d, _, y in labels if zlib.crc32(str(d).encode()) % 3 != 1]
    bags = [(toxicity.text_words((t or "").encode()), y) for d, y in used for i, t, *_ in rows if i == d]
    model = toxicity.fit([b for b, _ in bags], [y for _, y in bags])
    scores = [model.score((x[1] or "").encode()) for x in rows]
    assert all(abs(s - toxicity.THRESHOLD) > 0.01 for s in scores)
    return [x for x, s in zip(rows, scores, strict=True) if s < toxicity.THRESHOLD]


def brute_near_copies(rows):
    groups, out = {}, []
    for k, n, least in brute_components([x[1] for x in rows], list(range(len(rows))), pipe.SHINGLE, pipe.SIMILAR):
        groups.setdefault(least, []).append(rows[k]) if n else out.append(rows[k])
    return out + [min(g, key=lambda x: x[0]) for g in groups.values()]


def brute_without_repeats(rows, length=50):
    first = {}
    for d, t, *_ in rows:
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            first[b[p : p + length]] = min(first.get(b[p : p + length], d), d)
    out = []
    for d, t, lang, source, n_chars in rows:
        b = (t or "").encode()
        gone = {q for p in range(len(b) - length + 1) if first[b[p : p + length]] < d for q in range(p, p + length)}
        if t is None or not gone:
            out.append((d, t, lang, source, n_chars))
            continue
        kept, at = [], 0
        for c in t:
            n = len(c.encode())
            if gone.isdisjoint(range(at, at + n)):
                kept.append(c)
            at += n
        out.append((d, "".join(kept), lang, source, len(kept)))
    return out


def brute_mix(spark, rows):
    taken = Counter()
    for x in source_mix.source_mix(frame(spark, rows))[0].collect():
        taken[x["doc_id"]] += x["taken"]
    out = []
    for d, t, lang, source, _ in {x[0]: x for x in rows}.values():
        ws = words(t)
        whole, part = divmod(taken[d], len(ws)) if ws else (0, 0)
        out += [(d, t, lang, source, len(t or ""))] * whole
        if part:
            some = "".join(re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+", t)[:part])
            out.append((d, some, lang, source, len(some)))
    return out


def brute_encode(rows, library):
    out = []
    for d, t, lang, source, _ in rows:
        ids = np.asarray(library.encode_ordinary(t or ""), "<u4").tobytes()
        out.append((d, lang, source, len(ids) // 4, base64.b64encode(ids).decode(), hashlib.sha256(ids).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    return out


def same(df, want):
    # base64() of Spark breaks lines
    got = [tuple(re.sub(r"\r\n", "", v) if c == "ids" else v for c, v in x.asDict().items()) for x in df.collect()]
    assert sorted(got, key=key) == sorted(map(tuple, want), key=key)


@pytest.fixture(scope="module")
def tables(spark, corpus, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sf"))
    frame(spark, corpus[0]).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(corpus[1], "doc_id bigint, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def test_drop_toxic(spark, corpus, tables):
    want = brute_toxic(*corpus)
    assert 0 < len(want) < len(corpus[0])
    same(pipe.drop_toxic(spark, frame(spark, corpus[0]), tables), want)


def test_drop_near_copies(spark, corpus):
    want = brute_near_copies(corpus[0])
    assert len(want) < len(corpus[0]) - 5
    same(pipe.drop_near_copies(spark, frame(spark, corpus[0]), ""), want)


def test_drop_repeats(spark, corpus):
    want = brute_without_repeats(corpus[0])
    assert sum(a[1] != b[1] for a, b in zip(corpus[0], want, strict=True)) > 10
    same(pipe.drop_repeats(spark, frame(spark, corpus[0]), ""), want)


def test_mix_sources(spark, corpus):
    rows = corpus[0]
    want = brute_mix(spark, rows)
    by_id = {x[0]: x[1] for x in rows}
    assert any(n > 1 for n in Counter(map(tuple, want)).values()) and any(t != by_id[d] for d, t, *_ in want)
    mixed = pipe.mix_sources(spark, frame(spark, rows), "")
    same(mixed, want)
    places = [(x["position"], x["doc_id"]) for x in source_mix.source_mix(frame(spark, rows))[1].collect()]
    assert [x["doc_id"] for x in mixed.collect()] == [d for _, d in sorted(places, key=lambda x: (x[0], x[1] is None, x[1]))]


def test_encode(spark, corpus, library):
    same(pipe.encode(spark, frame(spark, corpus[0]), ""), brute_encode(corpus[0], library))


def test_run(spark, corpus, tables, library):
    kept = brute_without_repeats(brute_near_copies(brute_toxic(*corpus)))
    same(pipe.run(spark, tables), brute_encode(brute_mix(spark, kept), library))


# queries without SQL


@pytest.fixture(scope="module")
def documents(spark):
    return {x["doc_id"]: x for x in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def rows_of(spark, name):
    rows = registry.QUERIES[name](spark, SF).collect()
    return {x["doc_id"]: x for x in rows}, len(rows)


def test_op1_rows(spark, documents):
    got, n = rows_of(spark, "op1_lattice_lm")
    split = lambda t: re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()) + [None]
    held = lambda d: zlib.crc32(str(d).encode()) % 10 == 0
    counts = Counter(w for d, x in documents.items() if not held(d) for w in split(x["text"]))
    total, kinds = sum(counts.values()), len(counts)
    assert n == len(documents) == len(got)
    for d, x in documents.items():
        ws, r = split(x["text"]), got[d]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(d), len(ws), sum(counts[w] > 0 for w in ws), total)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in ws))
        assert math.isfinite(r["score"]) and r["score"] < 0


def test_op3_rows(spark, documents):
    got, n = rows_of(spark, "op3_toxicity")
    held = lambda d: zlib.crc32(str(d).encode()) % 3 == 1
    toxic = {}
    for x in spark.read.parquet(f"{SF}/labels.parquet").where("toxic is not null").collect():
        toxic[x["doc_id"]] = max(toxic.get(x["doc_id"], 0), x["toxic"])
    used = [d for d in toxic if d in documents and not held(d)]
    model = toxicity.fit([toxicity.text_words((documents[d]["text"] or "").encode()) for d in used], [int(toxic[d]) for d in used])
    assert n == len(documents) == len(got)
    for d, x in documents.items():
        assert got[d]["held_out"] == held(d)
        assert got[d]["score"] == pytest.approx(model.score((x["text"] or "").encode()), abs=0.005)
        assert got[d]["predicted"] == int(got[d]["score"] >= toxicity.THRESHOLD)


def test_op4_rows(spark, documents):
    got, n = rows_of(spark, "op4_license_scan")
    assert n == len(documents) == len(got)
    for d, x in documents.items():
        ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), x["text"] or ""))
        met = []
        for phrase, label in license_scan.PHRASES:
            p = phrase.split()
            met += [(label, j) for j in range(len(ws)) if ws[j : j + len(p)] == p]
        r = got[d]
        # last_word is where the last phrase begins
        first, last = min((j for _, j in met), default=None), max((j for _, j in met), default=None)
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (len(ws), len(met), first, last, ",".join(sorted({m[0] for m in met})))
        assert {m[0] for m in met} <= set(r["labels"].split(",")) and (r["score"] == 1 or not met)


def test_op6_rows(spark, documents):
    got, n = rows_of(spark, "op6_histogram_sort")
    raw = {d: (x["text"] or "").encode() for d, x in documents.items()}
    assert n == len(documents) and {(d, r["size"], r["text_crc32"], r["law"], r["grown_shard"]) for d, r in got.items()} == {(d, len(b) + 16, zlib.crc32(b), "bytes", None) for d, b in raw.items()}
    total, largest = sum(r["size"] for r in got.values()), max(r["size"] for r in got.values())
    for s in range(40):
        own = [r for r in got.values() if r["shard"] == s]
        assert abs(sum(r["size"] for r in own) - total / 40) <= largest + 1
        assert sorted(r["slot"] for r in own) == list(range(len(own)))


def test_op7_rows(spark, documents, library):
    got, n = rows_of(spark, "op7_byte_bpe")
    want = brute_encode([(d, x["text"], None, None, 0) for d, x in documents.items()], library)
    assert n == len(want) and {(d, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for d, r in got.items()} == {(x[0], x[3], x[5], x[6]) for x in want}


def test_op8_rows(spark, documents):
    got, n = rows_of(spark, "op8_suffix_dedup")
    want = brute_repeats([x["text"] for x in documents.values()], list(documents))
    assert n == len(want) and {d: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for d, r in got.items()} == {d: (*w[:3], hashlib.sha256(w[3]).hexdigest()) for d, w in want.items()}


def test_op10_rows(spark, documents):
    got, n = rows_of(spark, "op10_source_mix")
    size, taken = Counter(), Counter()
    for d, x in documents.items():
        size[x["source"]] += len(words(x["text"]))
        taken[x["source"]] += got[d]["taken"]
    want = brute_targets(size)
    assert n == len(documents)
    for d, x in documents.items():
        r = got[d]
        assert (r["size"], r["source_size"]) == (len(words(x["text"])), size[x["source"]])
        assert r["target"] == pytest.approx(want[x["source"]]) and 0 <= r["taken"] <= 3 * r["size"]
    for s, n_words in size.items():
        # half a block and the remainders of the blocks
        assert abs(taken[s] - want[s]) <= max(2048, 0.01 * n_words)
