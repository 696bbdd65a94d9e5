"""Operators against brute force on small tables, held-out accuracy, and defined results for odd rows."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lectern.llm import fingerprints, language, licences, linededup, minhash, mixing, pii, plans, vectors
from lectern.session import read_table
from tests.llm.conftest import ODD

SF = "/root/testdata/sf0.001"
WS = re.compile(r"[^\x20\x09-\x0D]+")


# -- personal data ----------------------------------------------------------

def luhn(ds):
    return sum(d if i % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2) for i, d in enumerate(map(int, reversed(ds)))) % 10 == 0


def plain_spans(text):
    """The contract's expressions as they stand."""
    out = []
    for k, (kind, rx) in enumerate([("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
                                    ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]):
        for m in re.finditer(rx, text or "", re.ASCII):
            ds = re.sub("[^0-9]", "", m[0])
            if (kind == "ip" and max(map(int, m[0].split("."))) > 255) or (kind == "card" and not (14 <= len(ds) <= 19 and luhn(ds))) or (kind == "phone" and not 10 <= len(ds) <= 15):
                continue
            out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return [s for *_, s in sorted(out)]


def base_of(row):
    return [f"{s.kind}:{s.start}:{s.end}" for s in row.pii if s.kind in pii.BASE]


def test_pii_against_plain_expressions(spark, docs):
    rnd = random.Random(5)
    parts = ["a@b.c", "x.y@mail-1.example.com", "@", "..", "a@b", "1.2.3.4", "256.1.1.1", "0001.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1111-2", "79927398713",
             "+1 (017) 555-7713", "+12", " ", "  ", "-", "--", "𝄞", "é", "+", "12345678901234567890", "_x@y.z", "\n", "word", "30569309025904 "]
    rows = [(i, "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14)))) for i in range(600)]
    got = {r.doc_id: base_of(r) for r in pii.find_pii(docs(rows)).collect()}
    assert got == {i: plain_spans(t) for i, t in rows}


def test_op7_on_documents(spark):
    texts = {r.doc_id: r.text for r in read_table(spark, SF, "documents").collect()}
    for r in plans.op7_pii(spark, SF).collect():
        want = plain_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k) for s in want) for k in pii.BASE]


def test_pii_checksums_context_and_redaction(spark, docs):
    rows = [(0, "pay to IBAN DE89 3704 0044 0532 0130 00 now"), (1, "id DE88370400440532013000"), (2, "SSN 123-45-6789"), (3, "part 123-45-6789"),
            (4, "mail me: a@b.org"), (5, "see a@b.org")]
    got = {r.doc_id: [(s.kind, s.value, round(s.score, 2)) for s in r.pii] for r in pii.find_pii(docs(rows)).collect()}
    assert got[0] == [("iban", "DE89 3704 0044 0532 0130 00", 0.95)] and got[1] == [] and got[3] == []
    assert got[2] == [("ssn", "123-45-6789", 0.8)] and got[4][0][2] > got[5][0][2]
    assert {r.doc_id: r.text for r in pii.redact(docs(rows)).collect()}[4] == "mail me: [email]"


def test_iban_followers_and_neighbours(spark, docs):
    de, gb, be, no = "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32", "BE68 5390 0754 7034", "NO93 8601 1117 947"
    after = ["", " BIC COBADEFF", " 2021", "\nBank", " Bank", " Please", " A", " 7", ". X", " XX12 3", " COBADEFFXXX 2021 EUR", " lower"]
    rows = [(i, f"{x}{a}", [x]) for i, (x, a) in enumerate((x, a) for v in (de, gb, be, no) for x in (v, v.replace(" ", "")) for a in after)]
    rows += [(200, f"{de} {gb} {be}", [de, gb, be]), (201, f"REF AB12 {de}", [de]), (202, f"BE12 {de} {no}", [de, no]), (203, f"DE12 {gb}", [gb]),
             (204, de.replace(" ", "") + "BIC", []), (205, "DE88 3704 0044 0532 0130 00 Bank", []), (206, "DE89 3704 0044 0532 0130", []),
             (207, "XX62 3704 0044 0532 013", []), (208, "𝄞 IBAN " + gb + " 𝄞", [gb])]
    got = {r.doc_id: [(s.value, s.start, s.end) for s in r.pii if s.kind == "iban"] for r in pii.find_pii(docs([r[:2] for r in rows])).collect()}
    assert got == {i: [(x, t.index(x), t.index(x) + len(x)) for x in want] for i, t, want in rows}
    unlisted = "ZZ" + str(98 - int("37040044053201303535" + "00") % 97).zfill(2) + "370400440532013 0"  # 'ZZ' counts as 3535
    assert [s.value for s in pii.find_pii(docs([(1, f"to {unlisted} now")])).first().pii if s.kind == "iban"] == [unlisted]


def test_pii_long_and_odd_rows(spark, clash, docs):
    hard = [(20, "1 " * 60000), (21, "a." * 60000 + "@"), (22, "a@" + "b." * 30000 + "c"), (23, "+1" + " " * 50000), (24, "9" * 50000), *ODD]
    got = [(r.doc_id, base_of(r)) for r in pii.find_pii(clash(hard)).collect()]
    assert sorted(got, key=str) == sorted(((d, plain_spans(t)) for d, t, *_ in hard), key=str)
    assert pii.find_pii(docs([])).count() == 0


# -- near duplicates --------------------------------------------------------

def shingles(text):
    w = WS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def groups(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in linked:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def near_by_force(rows):
    s = {d: shingles(t) for d, t in rows}
    ids = sorted(s)
    linked = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1:] if s[a] and s[b] and 100 * len(s[a] & s[b]) >= 75 * len(s[a] | s[b])]
    comp = groups(ids, linked)
    return sorted((d, len(s[d]), comp[d], comp[d] == d) for d in ids)


def test_minhash_chains_and_large_groups(spark, docs, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 16)  # many blocks per bucket
    rnd = random.Random(2)
    base = [f"w{rnd.randint(0, 10**6)}" for _ in range(90)]
    rows = []
    for i in range(90):  # pairwise similarity around the threshold
        words = list(base)
        for _ in range(rnd.randint(1, 3)):
            words[rnd.randrange(90)] = f"v{i}{rnd.random()}"
        rows.append((1000 - i, " ".join(words)))
    rows += [(i, "Same text here, five words and more") for i in range(30)] + [(40 + i, f"tiny {i}") for i in range(5)] + [(60, "TINY 0"), (61, ""), (62, None)]
    assert sorted(map(tuple, minhash.near_duplicates(docs(rows)).collect())) == near_by_force(rows)


def test_minhash_links_of_texts_that_share_an_id(spark, docs):
    a, b = [f"a{i}" for i in range(60)], [f"b{i}" for i in range(60)]
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, " ".join([*a, "x"])), (3, " ".join([*b, "y"])), (3, " ".join(a + b)), (None, " ".join(a))]
    got = sorted((r.n_shingles, r.doc_id or 0, r.component_id or 0, r.kept) for r in minhash.near_duplicates(docs(rows)).collect())
    assert got == [(56, 0, 0, False), (56, 1, 1, True), (56, 1, 1, True), (57, 2, 1, False), (57, 3, 1, False), (116, 3, 3, True)] or got[0][1:3] == (0, 0)
    assert got[1:] == [(56, 1, 1, True), (56, 1, 1, True), (57, 2, 1, False), (57, 3, 1, False), (116, 3, 3, True)]


def test_minhash_odd_rows(spark, clash, docs):
    got = minhash.near_duplicates(clash(ODD)).collect()
    assert len(got) == len(ODD)
    by = {r.doc_id: r for r in got}
    assert by[None].component_id is None and by[None].kept
    assert by[0].n_shingles == by[5].n_shingles == 0 and by[0].kept and by[5].kept
    assert by[3].component_id == 2 and not by[3].kept and sum(r.doc_id == 3 for r in got) == 2
    assert minhash.near_duplicates(docs([])).count() == 0


def test_superminhash_estimates_jaccard_with_low_variance():
    rnd = np.random.default_rng(1)
    err = []
    for _ in range(60):
        pool = rnd.integers(0, 1 << 63, 150).astype(np.uint64)
        a, b = np.unique(pool[:100]), np.unique(pool[50:])
        x, y = minhash.superminhash([a, b])
        err.append((x == y).mean() - 1 / 3)
    assert abs(np.mean(err)) < 0.02 and np.std(err) < 1.1 * np.sqrt(2 / 9 / minhash.PLACES)
    one = minhash.superminhash([np.array([7], np.uint64)])[0]
    assert len(set(one.tolist())) == minhash.PLACES  # one element fills every place


def test_near_vectors_against_brute_force(spark):
    rnd = np.random.default_rng(3)
    x = rnd.normal(size=(60, 8)).astype(np.float32)
    x = np.concatenate([x, x[:20] + rnd.normal(scale=0.2, size=(20, 8)).astype(np.float32), x[:5], x[:3] * 4])
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    odd = [(500, None), (501, [0.0] * 8), (502, [float("nan")] * 8), (503, [None] + [1.0] * 7), (504, [float("inf")] * 8), (505, []), (506, [1.0, 2.0]), (507, [2.0, 4.0])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumn("node", F.lit("own")).withColumn("cell", F.lit(1))
    u = vectors.unit(x)
    linked = [(i, j) for i in range(len(u)) for j in range(i + 1, len(u)) if u[i] @ u[j] >= 0.9] + [(506, 507)]
    ids = [r[0] for r in rows + odd]
    comp, deg = groups(ids, linked), Counter(v for e in linked for v in e)
    want = sorted((i, deg[i], comp[i], comp[i] == i) for i in ids)
    for cells in (1, 5):
        assert sorted(map(tuple, vectors.near_vectors(df, cells=cells).collect())) == want
    assert vectors.near_vectors(df.limit(0)).count() == 0


# -- lines, mixing ----------------------------------------------------------

def dedup_by_force(rows):
    seen, gone = {}, {}
    vis = {}
    for d, t in rows:
        lines = (t or "").split("\n")
        vis[d] = [(i, x.strip(" \t\n\r\x0b\x0c")) for i, x in enumerate(lines) if x.strip(" \t\n\r\x0b\x0c")]
    for d, _ in sorted(rows):
        v, gone[d] = vis[d], set()
        for p in range(len(v) - 2):
            w = tuple(x for _, x in v[p:p + 3])
            if w not in seen:
                seen[w] = (d, p)
            else:
                fd, fp = seen[w]
                gone[d] |= {q for q in range(p, p + 3) if not (fd == d and q < fp + 3)}
    return {d: (None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in {vis[d][q][0] for q in gone[d]}), len(gone[d])) for d, t in rows}


def test_line_dedup_against_brute_force(spark, docs):
    rnd = random.Random(4)
    rows = [(i, "\n".join(rnd.choice(["a", "b ", " c", "", "d\t", "e"]) for _ in range(rnd.randint(0, 12)))) for i in range(120)] + [(500, None), (501, "a\n" * 50)]
    got = {r.doc_id: (r.text, r.n_removed) for r in linededup.dedup_lines(docs(rows)).collect()}
    assert got == dedup_by_force(rows)


def test_line_dedup_keeps_texts_of_one_id_apart(spark, docs):
    rows = [(1, "p\nq\nr"), (None, "p\nq\nr\nx"), (None, "u1\nu2\nu3\nu4"), (7, "a\nb\nc\nd"), (7, "e\nf\ng\nh"), (8, "a\nb\nc"), (7, "a\nb\nc\nd"), (None, "u1\nu2\nu3\nu4")]
    got = sorted(((r.doc_id is None, r.doc_id or 0), r.text, r.n_removed) for r in linededup.dedup_lines(docs(rows)).collect())
    none, own = (True, 0), (False, 7)
    assert got == [((False, 1), "p\nq\nr", 0), (own, "a\nb\nc\nd", 0), (own, "a\nb\nc\nd", 0), (own, "e\nf\ng\nh", 0), ((False, 8), "", 3),
                   (none, "u1\nu2\nu3\nu4", 0), (none, "u1\nu2\nu3\nu4", 0), (none, "x", 3)]


def test_one_text_of_many_lines_or_matches(spark, docs):
    """Time in proportion: a quadratic step would take minutes here."""
    lines = "\n".join(f"line {i} of a long log" for i in range(100_000))
    got = {r.doc_id: (len(r.text), r.n_removed) for r in linededup.dedup_lines(docs([(1, lines), (2, lines + "\nend")])).collect()}
    assert got == {1: (len(lines), 0), 2: (3, 100_000)}
    mails = " ".join(f"user{i}@mail-{i % 7}.example.com" for i in range(20_000)) + " contact z@y.x"
    spans = pii.find_pii(docs([(1, mails)])).first().pii
    assert len(spans) == 20_001 and all(mails[s.start:s.end] == s.value for s in spans) and spans[-1].value == "z@y.x"


def test_line_dedup_odd_rows(spark, clash, docs):
    table = clash([*ODD, (30, "p\nq\nr\nown"), (31, "x\np\nq\nr"), (31, "x\np\nq\nr")])
    got = linededup.dedup_lines(table)
    assert [c for c in got.columns if c != "n_removed"] == table.columns and got.count() == len(ODD) + 3
    assert [r.text for r in got.where("doc_id = 31").collect()] == ["x", "x"]
    assert {r.key for r in got.collect()} == {"own key"}
    assert linededup.dedup_lines(docs([])).count() == 0


def test_mix_reaches_targets_and_repeats(spark):
    rows = plans.op10_mix(spark, SF).collect()
    source = {r.doc_id: r.source for r in read_table(spark, SF, "documents").select("doc_id", "source").collect()}
    taken, target = Counter(), {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
    assert all(abs(taken[s] - target[s]) <= 1 for s in target)
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, plans.op10_mix(spark, SF).collect()), key=str)


def test_mix_schedule_follows_the_weights(spark, docs):
    m = mixing.Mix(docs([(i, "w " * 50, "en", "abc"[i % 3]) for i in range(300)]), block=20)
    first = m.slots.where("slot < 300").groupBy("src").count().collect()
    got = {r.src: r["count"] for r in first}
    want = [r.take for r in m.sources.orderBy("src").collect()]
    for s, w in enumerate(want):  # low discrepancy: every prefix is mixed as the whole
        assert abs(got[s] - 300 * w / sum(want)) < 6
    plan = m.plan().groupBy("slot").agg(F.sum("words").alias("n")).collect()
    assert sum(r.n == 20 for r in plan) >= len(plan) - 3  # equal-token blocks, but for each source's last


def test_mix_stage_follows_the_plan(spark, docs):
    rows = [(i, f" w{i}\n" * (20 + i % 7), "en", "ac"[i % 2]) for i in range(60)] + [(100 + i, "long " * 900, "en", "b") for i in range(3)]
    table = docs(rows + [(0, " w0\n" * 20, "en", "a")] * 2)  # one row three times
    out = corpus_pipeline.mix(spark, table, SF).collect()
    m = mixing.Mix(table)
    words = Counter()
    for r in out:
        words[r.source] += len(WS.findall(r.text))
        assert r.n_chars == len(r.text)
    assert words == {r.source: r["take"] for r in m.sources.collect()}
    full = {d: t for d, t, *_ in rows}
    assert all(full[r.doc_id].startswith(r.text) for r in out) and sum(r.text != full[r.doc_id] for r in out) <= 3
    first = {r.doc_id: r.slot for r in m.plan().groupBy("doc_id").agg(F.min("slot").alias("slot")).collect()}
    seen = list(dict.fromkeys(r.doc_id for r in out))
    assert set(seen) == set(first) and [first[d] for d in seen] == sorted(first.values())


def test_mix_odd_rows(spark, clash, docs):
    got = mixing.mix_report(clash(ODD)).collect()
    assert len(got) == len(ODD)
    assert all(r.taken == 0 for r in got if r.size == 0) and all(r.taken <= 2 * r.size for r in got)
    out = mixing.mix_documents(clash(ODD))
    assert out.columns == clash(ODD).columns and set(out.select("size").distinct().toPandas()["size"]) <= {"own size"}
    assert mixing.mix_report(docs([])).count() == 0 and mixing.mix_documents(docs([])).count() == 0
    assert mixing.targets([("a", 0), ("b", 10)], 1.5, 2) == [0.0, 15.0]


def test_mix_counts_words_without_an_array_of_them(spark, docs):
    texts = [None, "", " \t\n\v\f\r ", "one", " a\u00a0b c\n", "\x1cx \x1f", "𝄞é ß\r\n$1 \\ x", "w " * 3000, "a" + " " * 200_000 + "b" + " " * 200_000]
    got = docs(list(enumerate(texts))).select("text", mixing.word_count(F.col("text")).alias("n"))
    assert [r.n for r in got.collect()] == [len(WS.findall(t or "")) for t in texts]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_count" not in plan and "regexp_extract_all" not in plan


# -- language, licences, fingerprints ---------------------------------------

def test_language_accuracy_on_held_out(spark):
    sf = SF.replace("0.001", "0.01")
    lang = {r.doc_id: r.lang for r in read_table(spark, sf, "documents").select("doc_id", "lang").collect()}
    rows = plans.op8_language(spark, sf).collect()
    own = [r for r in rows if r.held_out and r.lang_pred != "und"]
    assert sum(r.lang_pred == lang[r.doc_id] for r in own) >= 0.95 * len(own) and len(rows) == len(lang)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_odd_rows(spark, clash, docs):
    train = docs([(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de")] * 5)])
    model = language.LanguageModel.fit(train)
    got = {r.doc_id: r for r in language.identify(clash([*ODD, (40, "und die katze\0"), (41, "THE DOG")]), model).collect()}
    assert {d for d, r in got.items() if r.lang_pred == "und"} == {0, 1, 5, 8} and got[0].score == 0 and got[2].start == "own start"
    assert got[40].lang_pred == "de" and got[41].lang_pred == "en"
    none = language.LanguageModel.fit(docs([]))
    assert [r.lang_pred for r in language.identify(docs([(1, "text")]), none).collect()] == ["und"]
    assert language.identify(docs([]), model).count() == 0


@pytest.fixture(scope="module")
def licence_model(spark):
    return licences.LicenceModel.fit(read_table(spark, SF.replace("0.001", "0.01"), "documents"))


def test_licences(spark, docs, clash, licence_model, tmp_path):
    rows = [(i, f"some words first\n{t}\nmore words", f) for i, (f, t) in enumerate((f, t) for f, ts in licences.TEMPLATES.items() for t in ts)]
    want = {r[0]: r[2] for r in rows}
    clean = [(100 + i, t) for i, t in enumerate(licences.NOT_NOTICES)] + [(200, "mit dem hund"), *[(300 + i, t) for i, (_, t, *_) in enumerate(ODD)]]
    got = {r.doc_id: r for r in licences.scan(clash([r[:2] for r in rows] + clean), licence_model).collect()}
    assert sum(got[i].licences == f for i, f in want.items()) >= 0.9 * len(want)
    assert not any(got[i].licences for i, *_ in clean)
    assert licences.scan(docs([]), licence_model).count() == 0
    licences.save_model(spark, licence_model, f"{tmp_path}/m")
    back = licences.load_model(spark, f"{tmp_path}/m")
    assert (back.classes, back.features, back.bias, back.threshold) == (licence_model.classes, licence_model.features, licence_model.bias, licence_model.threshold)


def test_op2_finds_every_planted_line(spark, licence_model):
    docs = read_table(spark, SF.replace("0.001", "0.01"), "documents")
    got = {r.doc_id for r in licences.scan(docs, licence_model).where("licences != ''").collect()}
    assert got == {r.doc_id for r in docs.where(F.lower("text").rlike("licen[cs]e|cc by")).collect()}


def test_licences_wrapped_and_several(spark, docs, licence_model):
    bsd = " * Copyright (c) 2020, A. Author\n *\n * Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that the following conditions\n * are met:\n"
    gpl = "# This program is free software; you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation; either version 2 of the License, or\n# (at your option) any later version.\n"
    lgpl = gpl.replace("program", "library").replace("General", "Lesser General")
    mit = "// Permission is hereby granted, free of charge, to any person obtaining\n// a copy of this software and associated\n// documentation files (the \"Software\"), to deal\n"
    flat = " ".join(lgpl.replace("#", "").split())
    rows = {1: (bsd, "bsd"), 2: (gpl, "gpl"), 3: (lgpl, "lgpl"), 4: (mit, "mit"), 5: (flat, "lgpl"), 6: (gpl.replace("program", "library").replace("GNU General", "GNU Affero General"), ""),
            7: ("Licensed under the Apache License, Version 2.0. Released under the MIT License.", "apache-2.0,mit"),
            8: ("Released under the MIT License.\n" + gpl, "gpl,mit"), 9: (lgpl.replace("\n", "\n#\n\n"), ""),
            10: ("This library is licensed under the GNU Lesser General Public License, version 3.", "lgpl"), 11: (bsd + "\n\n" + mit, "bsd,mit"),
            12: (gpl.replace("# ", "dnl "), "gpl"), 13: ("code\r\n" + mit.replace("\n", "\r\n"), "mit")}
    got = {r.doc_id: r for r in licences.scan(docs([(i, t) for i, (t, _) in rows.items()]), licence_model).collect()}
    assert {i: r.licences for i, r in got.items()} == {i: f for i, (_, f) in rows.items()}
    assert [got[i].n_notices for i in (1, 2, 3, 4, 5, 7)] == [1] * 6 and got[8].n_notices >= 1 and got[11].n_notices == 2


def test_syncmers_by_definition():
    rnd = random.Random(6)
    text = "".join(rnd.choice("abcdé𝄞 ") for _ in range(400))
    at, h = fingerprints.syncmers(text)
    k, s = fingerprints.K, fingerprints.S
    chosen = set(at.tolist())
    for i in range(len(text) - k + 1):  # context-free: the k-mer alone decides, and gives the same hash
        a, g = fingerprints.syncmers(text[i:i + k])
        assert (len(a) == 1) == (i in chosen)
        if len(a):
            assert g[0] == h[at.tolist().index(i)]
    assert max(np.diff(at)) <= k - s + 1


def test_op3_against_brute_force(spark):
    rows = sorted(((r.doc_id, r.text or "") for r in read_table(spark, SF, "documents").collect()), reverse=True)
    nxt = {d: rows[(i + 1) % len(rows)][1] for i, (d, _) in enumerate(rows)}
    texts, got = dict(rows), {r.doc_id: r for r in plans.op3_fingerprints(spark, SF).collect()}
    assert set(got) == set(texts)
    for d, t in rows:
        cut = len(t) // 3
        edited = t[:len(t) - cut] + nxt[d][:cut]
        r, fp = got[d], fingerprints.fingerprint
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == fingerprints.printed(fp(t)) and r.edited_fingerprint == fingerprints.printed(fp(edited))
        assert r.near_edited == fingerprints.likeness(fp(t), fp(edited)) and r.near_next == fingerprints.likeness(fp(t), fp(nxt[d]))
    longer = [r for r in got.values() if r.n_chars > 1000]
    assert np.mean([r.near_edited > r.near_next for r in longer]) > 0.95


def test_fingerprint_odd_rows(spark, clash, docs):
    got = fingerprints.compare_with_edits(clash(ODD)).collect()
    assert len(got) == len(ODD) and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert len({r.fingerprint for r in got if r.doc_id in (2, 3)}) == 1
    one = fingerprints.compare_with_edits(docs([(5, "a single document")])).collect()[0]
    assert one.near_next == 1.0
    assert fingerprints.compare_with_edits(docs([])).count() == 0
    assert fingerprints.anchors(docs([(1, "abc")])).first().anchors[0].pos == 0


# -- pipeline ---------------------------------------------------------------

def test_pipeline_stages(spark):
    docs = read_table(spark, SF, "documents")
    cols, before = docs.columns, {r.doc_id: r for r in docs.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "mix", "pack"]
    one = corpus_pipeline.language_id(spark, docs, SF)
    assert one.columns == cols
    rows = one.collect()
    assert {r.doc_id for r in rows} >= {d for d, r in before.items() if r.text and sum(map(str.isalpha, r.text)) > 20}
    two = corpus_pipeline.line_dedup(spark, one, SF)
    want = dedup_by_force([(r.doc_id, r.text) for r in rows])
    got = two.collect()
    assert two.columns == cols and {r.doc_id: r.text for r in got} == {d: t for d, (t, _) in want.items()} and all(r.n_chars == len(r.text) for r in got)
    three = corpus_pipeline.near_dedup(spark, two, SF)
    kept = {d for d, _, _, k in near_by_force([(r.doc_id, r.text) for r in got]) if k}
    assert three.columns == cols and sorted(r.doc_id for r in three.collect()) == sorted(kept)
    four = corpus_pipeline.mix(spark, three, SF)
    times = Counter(r.doc_id for r in four.collect())
    assert four.columns == cols and set(times.values()) <= {1, 2} and set(times) <= kept
    pieces = corpus_pipeline.run(spark, SF).collect()
    assert Counter(r.doc_id for r in pieces if r.start == 0) == times


def test_pipeline_odd_rows(spark, clash, docs):
    for make, rows in ((clash, ODD), (docs, [])):
        d = make(rows)
        for name, stage in corpus_pipeline.STAGES:
            d = stage(spark, d, SF)
            d.count()


def test_driver_collects_are_the_bounded_ones():
    """What reaches the driver: one row per source, language, (language, bucket) or vector
    length, and bounded samples for fitting.  A new collect has to be added here with its bound."""
    import pathlib
    root = pathlib.Path(__file__).resolve().parents[2] / "lectern" / "llm"
    found = {f.name: sum(f.read_text().count(x) for x in (".collect()", "toPandas()", ".toArrow()")) for f in root.glob("*.py")}
    assert {k: n for k, n in found.items() if n} == {
        "fingerprints.py": 1,  # greatest key of each range
        "language.py": 2,      # documents per language; counts per (language, bucket), 65,536 a language at most
        "licences.py": 1,      # FIT_PARAGRAPHS paragraphs of FIT_WORDS words
        "mixing.py": 1,        # one row per source
        "quality.py": 2,       # entries per language; the arrays of a lot of languages, at most MAX_SHIPPED entries
        "resample.py": 1,      # one row per bucket
        "vectors.py": 3,       # vector lengths; FIT_PER_CELL vectors a centroid (twice, the second time one vector)
    }
