"""Importance resampling: the numpy table against plain Python, and defined results for odd rows."""

import math
import re
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import xxhash

from lectern.llm import resample
from tests.llm.conftest import ODD

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def brute(rows, target, percent=25, min_words=20, seed=7, buckets=10_000):
    """[(id, n_features, weight, score)] of the rows and the ranks by (score, id)."""
    def bucket(g):
        return zlib.crc32(g.encode()) % buckets
    s, t = Counter(), Counter()
    for _, x in rows:
        s.update(map(bucket, features(x)[1]))
    for x in target:
        t.update(map(bucket, features(x)[1]))
    all_s, all_t = s.total() + buckets, t.total() + buckets
    out = []
    for i, x in rows:
        words, grams = features(x)
        gains = [math.floor(1000 * math.log((t[b] + 1) * all_s / ((s[b] + 1) * all_t))) for b in map(bucket, grams)]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(grams), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words) >= min_words))
    fit = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = fit[:percent * len(fit) // 100]
    return [r[:4] for r in out], [r[0] for r in drawn]


def test_xxhash64_of_spans():
    buf = bytes(np.random.default_rng(3).integers(0, 256, 400, dtype=np.uint8)) + bytes(8)
    lanes = np.ascontiguousarray(np.ndarray(len(buf) - 7, "<u8", buffer=buf, strides=(1,)))
    start, length = (x.ravel() for x in np.meshgrid(np.arange(0, 300, 7), np.arange(0, 90), indexing="ij"))
    got = resample.xxhash64_spans(buf, lanes, start.copy(), length.copy())
    assert got.tolist() == [xxhash.xxh64_intdigest(buf[a:a + n]) for a, n in zip(start, length)]


def test_equal_hashes_stay_apart(monkeypatch):
    monkeypatch.setattr(resample, "xxhash64_spans", lambda buf, lanes, start, length: np.zeros(len(start), np.uint64))
    words = [b"aa", b"bb", b"aa", b"aaaaaaaaX", b"aaaaaaaaY", b"a", b"aaaaaaaaX"]
    t = resample.GramTable([b" ".join(words)], np.zeros(1, np.int64), max_n=1)
    assert sorted(t.count[t.count > 0].tolist()) == [1, 1, 1, 2, 2]
    assert t.bucket[t.slot].tolist() == [zlib.crc32(w) % 10_000 for w in words]


def test_pieces_of_a_long_text(monkeypatch):
    words = [f"w{i % 7}" for i in range(50)]
    monkeypatch.setattr(resample, "PIECE", 8)
    seen = Counter()
    for table, _ in resample._tables([" ".join(words), None, "x"], 2, 10_000):
        for b, n in zip(table.bucket, table.count):
            seen[int(b)] += int(n)
    want = Counter(zlib.crc32(g.encode()) % 10_000 for t in (" ".join(words), "x") for g in features(t)[1])
    assert +seen == want


def test_resample_against_brute_force(spark, docs):
    rng = np.random.default_rng(11)
    vocabulary = ["Alpha", "beta", "É", "été", "x1", "don't", "a-b", "漢字", "𝄞", "LONGWORDthatispastthirtytwobytesinall" * 2]
    rows = [(int(i), " ".join(rng.choice(vocabulary, rng.integers(0, 60)))) for i in rng.permutation(160)] + [(7, "beta " * 25), (7, "beta " * 25)]
    target = ["beta été " * 9, None, "", "x1 A-B"]
    scored = resample.score_documents(docs(rows), docs(list(enumerate(target))).select("text"))
    got = resample.draw(scored).collect()
    want, drawn = brute(rows, target)
    assert sorted((r.doc_id, r.n_features, r.weight, r.score) for r in got) == sorted(want)
    assert [r.doc_id for r in sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])] == drawn
    kept = resample.resample(docs(rows), docs(list(enumerate(target))).select("text"))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(drawn)
    assert kept.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]


def test_resample_odd_rows(spark, docs, clash):
    got = resample.draw(resample.score_documents(clash(ODD), docs([(1, "one x"), (2, None)])), percent=100, min_words=1).collect()
    want, drawn = brute([r[:2] for r in ODD], ["one x", None], 100, 1)
    assert sorted(((r.doc_id is None, r.doc_id or 0), r.n_features, r.weight, r.score) for r in got) == sorted(((i is None, i or 0), n, w, s) for i, n, w, s in want)
    assert [r.doc_id for r in sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])] == drawn
    assert resample.draw(resample.score_documents(docs(ODD).where("false"), docs([(1, "x")]))).count() == 0
    assert resample.resample(docs(ODD).where("doc_id = 0"), docs([(1, "x")]).where("false")).count() == 0
