"""Fingerprints and language ID against plain Python written from their definitions, with no function of the modules inside."""

import base64
import itertools
import math
import random
import struct
from collections import Counter

import numpy as np

from lectern.llm import fingerprints, language, plans
from lectern.session import read_table

SF = "/root/testdata/sf0.001"
MASK = (1 << 64) - 1
K, S, KEPT = 12, 6, 64


def mix(x):
    x = ((x ^ (x >> 31)) * 0xBF58476D1CE4E5B9) & MASK
    return x ^ (x >> 29)


def smer(text):
    acc = 0
    for i, c in enumerate(text):
        acc = (acc * 0x9E3779B97F4A7C15 + ord(c)) & MASK if i else ord(c)
    return mix(acc)


def anchors(text):
    """[(position, hash)]: k-mers whose smallest s-mer is the first or the last one."""
    if not text:
        return []
    if len(text) < K:
        acc = len(text)
        for c in text:
            acc = (acc * 0x9E3779B97F4A7C15 + ord(c)) & MASK
        return [(0, mix(acc) >> 32)]
    h = [smer(text[i:i + S]) for i in range(len(text) - S + 1)]
    out = []
    for i in range(len(text) - K + 1):
        own = h[i:i + K - S + 1]
        if min(own) in (own[0], own[-1]):
            acc = (own[0] * 0x9E3779B97F4A7C15) & MASK
            for j in range(S, K, S):
                acc = mix(((acc + own[min(j, K - S)]) * 0x9E3779B97F4A7C15) & MASK)
            out.append((i, mix(acc) >> 32))
    return out


def sketch(text):
    first = {}
    for at, h in anchors(text):
        first.setdefault(h, at)
    return sorted(first.items())[:KEPT]


def same_order(a, b):
    """Longest run of shared anchors that lie in one order in both texts, over the lowest anchors of the union."""
    if not a or not b:
        return float(len(a) == len(b))
    union = sorted({h for h, _ in a} | {h for h, _ in b})[:KEPT]
    pa, pb = dict(a), dict(b)
    both = sorted((h for h in union if h in pa and h in pb), key=lambda h: pa[h])
    longest = [1] * len(both)
    for i, j in itertools.combinations(range(len(both)), 2):
        if pb[both[i]] < pb[both[j]]:
            longest[j] = max(longest[j], longest[i] + 1)
    return max(longest, default=0) / len(union)


def test_minimum_rule_of_the_syncmers():
    rnd = random.Random(1)
    for text in ["", "a", "abc", "x" * 11, "x" * 12, "x" * 40, *("".join(rnd.choice("abé𝄞漢 \n") for _ in range(n)) for n in (12, 13, 50, 300))]:
        at, h = fingerprints.syncmers(text)
        assert list(zip(at.tolist(), h.tolist())) == anchors(text)


def test_op3_columns(spark):
    rows = sorted(((r.doc_id, r.text or "") for r in read_table(spark, SF, "documents").collect()), reverse=True)
    got = {r.doc_id: r for r in plans.op3_fingerprints(spark, SF).collect()}
    for i in range(0, len(rows), 9):
        d, t = rows[i]
        nxt = rows[(i + 1) % len(rows)][1]
        cut = len(t) // 3
        a, e, n = sketch(t), sketch(t[:len(t) - cut] + nxt[:cut]), sketch(nxt)
        assert base64.b64decode(got[d].fingerprint) == b"".join(struct.pack("<II", h, at) for h, at in a)
        assert base64.b64decode(got[d].edited_fingerprint) == b"".join(struct.pack("<II", h, at) for h, at in e)
        assert math.isclose(got[d].near_edited, same_order(a, e)) and math.isclose(got[d].near_next, same_order(a, n))


# -- language ID ------------------------------------------------------------

BUCKETS = 65_536


def grams(text):
    text = text.lower()
    return [text[i:i + n] for n in (1, 2, 3) for i in range(len(text) - n + 1)]


def test_naive_bayes_against_counters(spark, docs):
    rnd = random.Random(3)
    letters = {"en": "theandofing ", "fr": "leéàdeseau ", "de": "derßundöüch "}
    rows, n = [], 0
    for lang, size in (("en", 30), ("fr", 20), ("de", 12)):
        for _ in range(size):
            rows.append((n, "".join(rnd.choice(letters[lang]) for _ in range(rnd.randint(5, 200))).title(), lang))
            n += 1
    unseen = ["".join(rnd.choice(letters[rnd.choice(list(letters))] + "xyz") for _ in range(rnd.randint(1, 120))) for _ in range(60)]
    counts, priors = {}, Counter(lang for _, _, lang in rows)
    for lang in letters:
        counts[lang] = Counter(g for _, t, x in rows if x == lang for g in grams(t))
    every = {g for c in counts.values() for g in c} | {g for t in unseen for g in grams(t)}
    # by hash, so that n-grams which share a bucket share their counts
    place = {g: int(language.gram_buckets([g])[0][len(g) - 1, 0]) for g in every}
    shared = {lang: Counter() for lang in letters}
    for lang, c in counts.items():
        for g, k in c.items():
            shared[lang][place[g]] += k
    model = language.LanguageModel.fit(docs(rows))
    got = {r.doc_id: r for r in language.identify(docs([(i, t) for i, t in enumerate(unseen)]), model).collect()}
    for i, t in enumerate(unseen):
        if not any(c.isalpha() for c in t):
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        total = {lang: math.log(priors[lang] / len(rows)) + sum(math.log((shared[lang][place[g]] + 1) / (shared[lang].total() + BUCKETS)) for g in grams(t))
                 for lang in letters}
        share = min(1.0, 50 / len(grams(t)))
        best = max(total.values())
        weights = {lang: math.exp((x - best) * share) for lang, x in total.items()}
        ranked = sorted(total.values(), reverse=True)
        if ranked[0] - ranked[1] > 1e-2:
            assert got[i].lang_pred == max(total, key=total.get)
        assert math.isclose(got[i].score, max(weights.values()) / sum(weights.values()), rel_tol=1e-3)
    assert np.mean([r.score for r in got.values()]) > 0.5


def test_language_memory_is_bounded():
    """Arrays hold a slice at a time, of many texts and of one long text, whose parts hold each n-gram once."""
    import tracemalloc
    rng = np.random.default_rng(5)
    logp = rng.standard_normal((language.BUCKETS + 1, 4)).astype(np.float32)
    logp[language.BUCKETS] = 0
    model = language.LanguageModel(["a", "b", "c", "d"], logp, np.zeros(4))
    many = ["".join(map(chr, rng.integers(97, 123, 2000))) for _ in range(600)]
    long = "".join(many)
    for texts in (many, [long]):
        tracemalloc.start()
        model.predict(texts)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 24e6, peak
    for text in (long[:300_001], "Q" * (1 << 17), "\u0130" * (1 << 17) + "z", "ab", ""):
        whole = language.gram_buckets([text])[0]
        parts = np.concatenate([b.ravel() for _, b, _ in language._slices([text])])
        n = language.BUCKETS
        assert (np.bincount(whole.ravel(), minlength=n + 1)[:n] == np.bincount(parts, minlength=n + 1)[:n]).all()
