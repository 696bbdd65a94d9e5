"""Quality rules against brute force: counts, the Kneser-Ney model in plain Python, both ways of scoring, bands."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from lectern.llm import plans, quality
from lectern.session import read_table
from tests.llm.conftest import ODD

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) by the definitions."""
    text = text or ""
    words = WORD.findall(text)
    at = defaultdict(list)
    for i in range(len(words) - 4):
        at[tuple(words[i:i + 5])].append(i)
    inside = {i + k for x in at.values() if len(x) > 1 for i in x for k in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        dup += bool(WORD.search(line)) and line in seen
        seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(inside)


class PlainModel:
    """Interpolated modified Kneser-Ney with dictionaries."""

    def __init__(self, texts, order):
        self.order = order
        c = {order: Counter(t[i:i + order] for t in texts for i in range(len(t) - order + 1))}
        for k in range(order - 1, 0, -1):
            c[k] = Counter(g[1:] for g in c[k + 1])
        self.p, self.free = [None] * (order + 1), [None] * (order + 1)
        for k in range(1, order + 1):
            t = [sum(v == i for v in c[k].values()) for i in range(5)]
            d = [0.0, 0.5, 1.0, 1.5]
            if all(t[1:]):
                y = t[1] / (t[1] + 2 * t[2])
                for i in (1, 2, 3):
                    got = i - (i + 1) * y * t[i + 1] / t[i]
                    d[i] = got if 0 < got < i else d[i]
            total, mass = Counter(), Counter()
            for g, n in c[k].items():
                total[g[:-1]] += n
                mass[g[:-1]] += d[min(n, 3)]
            self.free[k] = {x: mass[x] / total[x] for x in total}
            self.p[k] = {g: (n - d[min(n, 3)]) / total[g[:-1]] + self.free[k][g[:-1]] * (self.p[k - 1][g[1:]] if k > 1 else 1 / (len(c[1]) + 1))
                         for g, n in c[k].items()}
        self.unseen = self.free[1][""] / (len(c[1]) + 1) if c[1] else None

    def cost(self, gram):
        def units(p):
            return math.floor(-1e6 * math.log(p) + 0.5)
        total = 0
        for k in range(self.order, 0, -1):
            if gram in self.p[k]:
                return total + units(self.p[k][gram])
            total += units(self.free[k][gram[:-1]]) if k > 1 and gram[:-1] in self.free[k] else 0
            gram = gram[1:]
        return total + units(self.unseen)


def brute(rows, order):
    """(cost, n_grams) per (lang, text, half) row."""
    def seen(text):
        return "\x02" * (order - 1) + " ".join(WORD.findall(text)) + "\x03"
    models = {}
    for lang in {r[0] for r in rows}:
        for h in (0, 1):
            own = [t for x, t, g in rows if x == lang and g == h and 10 * counts(t)[2] <= counts(t)[0]]
            if own:
                models[lang, h] = PlainModel([seen(t) for t in own], order)
    out = []
    for lang, t, h in rows:
        m, s = models.get((lang, 1 - h)), seen(t)
        grams = [s[i:i + order] for i in range(len(s) - order + 1)] if m and WORD.search(t) else []
        out.append((sum(map(m.cost, grams)) if grams else 0, len(grams)))
    return out


def corpus(seed=4, n=90):
    rng = np.random.default_rng(seed)
    parts = ["the", "and", "of", "Ring", "x", "été", "漢字", "𝄞", "**", "a|b", "\n", "\n\n", "  ", "word\n"]
    return [(int(i), " ".join(rng.choice(parts, rng.integers(0, 40))), ["en", "fr", None][i % 3]) for i in range(n)]


def test_counts_against_brute_force(spark, docs):
    rows = corpus() + [(500, "a b c d e f a b c d e f a", "en"), (501, "q " * 7, "en"), (502, "a b c d e f g h i j k a b c d e", "en"), (503, "z\nz\n z\n\n\n", "en")]
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    got = {r.doc_id: tuple(r[c] for c in names) for r in quality.score_documents(docs(rows)).collect()}
    assert got == {i: counts(t) for i, t, _ in rows}


def test_repeated_words_many_texts_at_once():
    rng = np.random.default_rng(8)
    texts = [[bytes([97 + int(c)]) for c in rng.integers(0, 3, rng.integers(0, 60))] for _ in range(50)]
    assert quality.repeated_words(texts).tolist() == [counts(b" ".join(t).decode())[4] for t in texts]


def test_costs_against_a_plain_model_both_ways(spark, docs):
    rows = corpus()
    d = docs(rows)
    halves = {r.doc_id: r.h for r in d.select("doc_id", quality.half(F.col("text")).alias("h")).collect()}
    for order in (2, 4):
        want = dict(zip([i for i, *_ in rows], brute([(x or "", t, halves[i]) for i, t, x in rows], order)))
        shipped = {r.doc_id: (r.cost, r.n_grams) for r in quality.score_documents(d, order).collect()}
        assert shipped.keys() == want.keys()
        # costs are rounded once per entry: the last bit of a logarithm may move a single one
        assert all(shipped[i][1] == want[i][1] and abs(shipped[i][0] - want[i][0]) <= shipped[i][1] for i in want)
        sizes = [r["count"] for r in quality.estimate(d, order).groupBy("lang").count().collect()]
        for most in (0, min(sizes), max(sizes)):  # all joined; one language shipped and the others joined; shipped in lots
            other = {r.doc_id: (r.cost, r.n_grams) for r in quality.score_documents(d, order, max_shipped=most, keep=["doc_id"]).collect()}
            assert other == shipped


def test_probabilities_add_up(spark, docs):
    model = [r for r in quality.estimate(docs(corpus()), 3).collect() if r.lang == "en" and r.half == 0]
    free = {r.k: r.cost for r in model if r.k == 0}[0]
    letters = [r for r in model if r.k == 1 and r.cost != quality.NONE]
    assert abs(sum(math.exp(-r.cost / 1e6) for r in letters) + math.exp(-free / 1e6) - 1) < 1e-4
    arrays = quality.Arrays.build(np.array([r.k for r in model]), [r.gram for r in model], np.array([r.cost for r in model]), np.array([r.back for r in model]), 3)
    for ctx in sorted({r.gram[:2] for r in model if r.k == 3})[:5] + ["zq"]:
        codes = np.array([ord(c) for r in letters for c in ctx + r.gram] + [ord(c) for c in ctx] + [0x10FFFF], np.uint32)
        last = np.arange(2, len(codes), 3)
        assert abs(np.exp(-arrays.costs(codes, last) / 1e6).sum() - 1) < 1e-3


def test_bands_and_verdicts(spark, docs):
    rng = np.random.default_rng(1)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta"]
    sound = [(i, " ".join(rng.choice(words, 60)), "en") for i in range(80)]
    noise = [(900 + i, " ".join("".join(chr(97 + int(c)) for c in rng.integers(0, 26, 7)) for _ in range(60)), "en") for i in range(4)]
    few = [(950, "short text", "en"), (951, " ".join(["same words again and again"] * 20), "en"), (960, " ".join(rng.choice(words, 60)), "xx")]
    d = docs(sound + noise + few)
    scored = quality.score_documents(d)
    rows = {r.doc_id: r for r in quality.judge(scored, quality.bands(scored)).collect()}
    assert [i for i, r in rows.items() if not r.kept] and sorted(i for i, r in rows.items() if not r.kept) == [900, 901, 902, 903, 950, 951]
    assert rows[950].base_failed and rows[951].base_failed and not rows[900].base_failed and rows[900].perplexity > rows[900].high
    assert rows[960].kept and rows[960].low is None  # a language with too few documents has no band
    kept = quality.filter_documents(d)
    assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i, r in rows.items() if r.kept)


def test_median_of_bins(spark):
    rng = np.random.default_rng(2)
    rows = [(lang, float(x)) for lang, n in (("a", 7), ("b", 8), ("c", 1)) for x in rng.integers(0, 20, n) / 1000 + 0.0005]
    got = {r.lang: (round(r.m, 3), r.n) for r in quality._median(spark.createDataFrame(rows, "lang string, x double"), F.col("x")).collect()}
    for lang in "abc":
        own = sorted(x for k, x in rows if k == lang)
        assert got[lang] == (round(own[(len(own) - 1) // 2] - 0.0005, 3), len(own))


def test_quality_odd_rows(spark, docs, clash):
    rows = {(r.doc_id, r.text): r for r in quality.score_documents(clash(ODD)).collect()}
    assert len(rows) == len(ODD) - 1
    for i, t, *_ in ODD:
        r = rows[i, t]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts(t)
    empty = docs(ODD).where("false")
    scored = quality.score_documents(empty)
    assert quality.judge(scored, quality.bands(scored)).count() == 0
    nothing = quality.score_documents(docs([(1, None), (2, "")]))
    assert [(r.cost, r.n_grams) for r in nothing.collect()] == [(0, 0)] * 2


def test_op13_on_documents(spark):
    texts = {r.doc_id: r.text for r in read_table(spark, SF, "documents").collect()}
    for r in plans.op13_quality(spark, SF).collect():
        want = counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r.base_failed and r.kept)
