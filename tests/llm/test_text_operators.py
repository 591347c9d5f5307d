"""op5, op6, op7, op8, op9: against brute force on small fixtures, and the edge cases of their docstrings."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from carelake.llm import licenses, minhash, mixing, quality, sentencepiece_codec, substring, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, sig string, key long, __spans2 string"


def make(spark, rows):
    return spark.createDataFrame([(i, t, "en", "src1", len(t or ""), "x", 7, "y") for i, t in rows], DOCS)


def corpus(seed=3, n=60):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)]
    passage = [r.choice(vocabulary) for _ in range(70)]
    rows = []
    for k in range(n):
        w = [r.choice(vocabulary) for _ in range(r.choice([0, 1, 3, 40, 120, 200]))]
        if k % 4 == 0:
            at = r.randrange(len(w) + 1)
            w[at:at] = passage[r.randrange(10) : 60 + r.randrange(10)]
        rows.append((k, " ".join(w)))
    for k in range(n, n + 30):  # near copies with some words changed
        w = rows[r.randrange(n)][1].split()
        for _ in range(len(w) // r.choice([10, 15, 40])):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        rows.append((k, " ".join(w)))
    rows += [(n + 30 + k, rows[4][1]) for k in range(5)]
    rows += [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "é" * 40000), (1004, "Ünï\x85word"), (None, rows[8][1]), (2000, rows[8][1]), (2000, rows[9][1]), (2001, rows[12][1]), (2001, rows[12][1])]
    return rows


def shingles(text, size):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(zip(*[w[k:] for k in range(size)])) if len(w) >= size else frozenset([tuple(w)]) if w else frozenset()


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(spark, size):
    rows = [r for r in corpus() if r[0] is not None and r[0] < 2000]
    got = {r["doc_id"]: r for r in minhash.near_duplicates(make(spark, rows), size).collect()}
    sets = {i: shingles(t, size) for i, t in rows}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    assert len(got) == len(rows)
    for i in sets:
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (len(sets[i]), find(i), find(i) == i), i


def test_large_group_of_near_copies_is_compared_in_blocks(spark):
    r = random.Random(5)
    base = [f"b{k}" for k in range(100)]
    rows = []
    for k in range(1500):
        w = list(base)
        for _ in range(r.choice([3, 9, 12])):
            w[r.randrange(100)] = f"x{r.randrange(10**6)}"
        rows.append((k, " ".join(w)))
    got = {x["doc_id"]: x["component_id"] for x in minhash.near_duplicates(make(spark, rows), 2).collect()}
    sets = [shingles(t, 2) for _, t in rows]
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a in range(len(sets)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    assert got == {k: find(k) for k in range(len(sets))}


def test_near_duplicates_odd_rows(spark):
    got = minhash.near_duplicates(make(spark, corpus())).collect()
    assert len(got) == len(corpus())
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    assert len(by[2000]) == 2 and len(by[2001]) == 2 and {r["component_id"] for r in by[2001]} == {by[12][0]["component_id"]}
    assert by[1000][0]["n_shingles"] == 0 and by[1000][0]["kept"]
    assert minhash.near_duplicates(make(spark, [])).collect() == []
    kept = minhash.dedup(make(spark, corpus()))
    assert kept.columns == [c.split()[0] for c in DOCS.split(", ")] and kept.count() < len(corpus())


def test_dedup_judges_rows_by_their_text(spark):
    r = random.Random(9)
    t, u = (" ".join(r.choice("abcdefgh") + str(r.randrange(40)) for _ in range(90)) for _ in range(2))
    names = ["__gone", "keep", "node", "nid", "component_id"]
    rows = [(i, x, *["z"] * 5) for i, x in [(1, t), (2, t), (2, u), (3, u + " end"), (4, None), (4, None), (None, t), (1, t)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    got = minhash.dedup(docs)
    assert got.columns == docs.columns
    want = [(1, t), (1, t), (2, u), (4, None), (4, None), (None, t)]
    assert sorted((str(x["doc_id"]), str(x["text"])) for x in got.collect()) == sorted((str(a), str(b)) for a, b in want)


def test_substrings(spark):
    rows = corpus()
    got = {}
    for r in substring.digest(make(spark, rows), 50).collect():
        got.setdefault(r["doc_id"], []).append((r["n_words"], r["n_removed"], r["kept_sha256"]))
    texts = [(i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in texts:
        for k in range(len(w) - 49):
            key = tuple(w[k : k + 50])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    want = {}
    for i, w in texts:
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if i is not None and first[tuple(w[k : k + 50])] < i:
                gone[k : k + 50] = [True] * 50
        want.setdefault(i, []).append((len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert substring.digest(make(spark, [])).collect() == []
    out = substring.strip(make(spark, rows))
    assert out.columns == [c.split()[0] for c in DOCS.split(", ")] and out.count() == len(rows)
    assert out.where("doc_id = 1000").first()["text"] is None


def test_strip_keeps_columns_of_any_name(spark):
    names = ["__key", "__spans", "__id", "__name", "__of", "keep", "key", "name", "spans", "a b", "none"]
    rows = [r for r in corpus() if r[0] is not None]
    docs = spark.createDataFrame([(i, *[f"{n}{i}" for n in names], t) for i, t in rows], "doc_id long, " + ", ".join(f"`{n}` string" for n in names) + ", text string")
    plain = {}
    for r in substring.strip(make(spark, rows)).collect():
        plain.setdefault(r["doc_id"], []).append(str(r["text"]))
    out = substring.strip(docs)
    assert out.schema.simpleString() == docs.schema.simpleString()
    got = {}
    for r in out.collect():
        assert all(r[n] == f"{n}{r['doc_id']}" for n in names)
        got.setdefault(r["doc_id"], []).append(str(r["text"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in plain.items()}
    assert any("".join(v) != "".join(str(t) for j, t in rows if j == i) for i, v in got.items())


def test_substrings_over_many_ranges_and_a_common_passage(spark, monkeypatch):
    monkeypatch.setattr(substring, "RANGE", 200)
    monkeypatch.setattr(substring, "PACK", 500)
    monkeypatch.setattr(substring, "HOT", 3)
    r = random.Random(8)
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [(k, " ".join(r.choice("abcdefghij") * r.randrange(1, 9) for _ in range(r.randrange(0, 90))) + (f" {passage} tail{k}" if k % 3 else "")) for k in range(120)]
    got = {x["doc_id"]: (x["n_removed"], x["kept_sha256"]) for x in substring.digest(make(spark, rows), 50).collect()}
    first, want = {}, {}
    for i, t in rows:
        w = t.encode().split()
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), i)
    for i, t in rows:
        w = t.encode().split()
        gone = {k + j for k in range(len(w) - 49) if first[tuple(w[k : k + 50])] < i for j in range(50)}
        want[i] = (len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest())
    assert got == want


def test_quality_statistics_and_rules(spark):
    rows = corpus() + [(3000 + k, "bad $$$ " * 60 + f"t{k}") for k in range(40)] + [(4000, "a\nb\n\na\nb \na"), (4001, "x y z x y z x y")]
    labels = spark.createDataFrame([(i, int(i < 3000), 0) for i, _ in rows if i is not None], "doc_id long, quality int, toxic int")
    got = {}
    for r in quality.judge(make(spark, rows), labels, "doc_id", "lang").collect():
        got.setdefault(r["doc_id"], []).append(r)
    for i, t in rows:
        t = t or ""
        w = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        three = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        covered = {k + j for k, x in enumerate(three) if three.count(x) > 1 for j in range(3)} if len(three) < 2000 else set()
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))
        assert want in [(r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got[i]], i
        for r in got[i]:
            assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
            assert not (r["base_failed"] and r["kept"])
    assert not any(r["kept"] for i in range(3000, 3040) for r in got[i])
    assert quality.judge(make(spark, []), labels, "doc_id").collect() == []
    assert quality.good(make(spark, rows), labels.where("false")).columns == [c.split()[0] for c in DOCS.split(", ")]


def test_decision_list_learns_conjunctions():
    import numpy as np

    r = np.random.default_rng(1)
    x = r.random((3000, len(quality.FEATURES)))
    bad = (x[:, 2] > 0.7) & (x[:, 4] <= 0.3)
    rules = quality.learn(x, bad)
    met = np.zeros(len(x), bool)
    for rule in rules:
        met |= rule.meets(x)
    assert rules and bad[met].mean() > 0.95 and met[bad].mean() > 0.8


def brute_licenses(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    at, labels = [], set()
    for phrase, label in licenses.BASE:
        p = phrase.split()
        hits = [k for k in range(len(w) - len(p) + 1) if w[k : k + len(p)] == p]
        at += hits
        labels |= {label} if hits else set()
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def test_licenses(spark):
    texts = ["Released under the MIT License.", "cc by cc-by CC  BY!", None, "", "omit license mit", "the GNU General Public License, version 3", "Apache License, Version 2.0 and é mit license mit license", "All rights reserved. Copyright (c) 2020", "é" * 50000, "SPDX-License-Identifier: Apache-2.0", "cc by-nc-sa 4.0 license", "nothing here"]
    got = {r["doc_id"]: r for r in licenses.scan(make(spark, list(enumerate(texts))), "doc_id").collect()}
    for k, t in enumerate(texts):
        r = got[k]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute_licenses(t), t
        assert 0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
    assert "gpl-3" in got[5]["labels"] and "apache-2.0" in got[6]["labels"] and "all-rights-reserved" in got[7]["labels"] and "apache-2.0" in got[9]["labels"] and got[11]["labels"] == ""
    assert "apache" not in [h["label"] for h in got[9]["hits"]]  # inside the identifier's hit
    assert len(licenses.signatures()) > 200
    assert licenses.scan(make(spark, []), "doc_id").collect() == []


def spelled(parsed):
    """Texts of a rule's pattern with every branch taken, each repeat at its least and once more."""
    out = [""]
    for op, arg in parsed:
        if str(op) == "LITERAL":
            got = [chr(arg)]
        elif str(op) == "IN":
            got = [chr(x) for kind, x in arg if str(kind) == "LITERAL"] or ["7" if "DIGIT" in str(arg) else "q"]
        elif str(op) == "BRANCH":
            got = [t for b in arg[1] for t in spelled(b)]
        elif str(op) == "SUBPATTERN":
            got = spelled(arg[-1])
        elif str(op) == "MAX_REPEAT":
            got = [t * n for n in {arg[0], min(arg[0] + 1, arg[1])} for t in spelled(arg[2])]
        else:
            raise AssertionError(op)
        out = [a + b for a in out for b in got]
    return out


def test_license_keywords_are_part_of_every_match():
    for r in licenses.signatures():
        for t in spelled(re._parser.parse(r.pattern)):
            assert re.fullmatch(r.pattern, t) and r.gate in f" {t} " and r.keyword in f" {t} ", (r, t)


def test_license_wordings_without_other_keywords(spark):
    want = {
        "Apache License v2.0": "apache-2.0", "GNU General Public License v3": "gpl-3", "Mozilla Public License v2.0": "mpl-2.0", "Eclipse Public License v2.0": "epl-2.0",
        "provided as is, with all faults": "as-is-disclaimer", "The author disclaims copyright to this source code.": "blessing", "Unauthorized copying of this file": "proprietary",
        "Permission is hereby granted, free of charge, to any person obtaining a copy": "mit", "Permission to use, copy, modify, and/or distribute this software for any purpose": "isc", "Creative Commons Attribution-ShareAlike 4.0": "cc-by-sa-4.0", "the curl license": "curl",
    }
    got = {r["doc_id"]: r["labels"].split(",") for r in licenses.scan(make(spark, list(enumerate(want))), "doc_id").collect()}
    for k, (text, label) in enumerate(want.items()):
        assert label in got[k], text


def plain_licenses(text):
    """Labels, score and hits by the same rules without gates, in plain Python."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    norm = f" {' '.join(w)} "
    hits = [(m.start(), m.end(), r.priority, r.label, r.confidence) for r in licenses.signatures() for m in re.finditer(f"(?<= )(?:{r.pattern})(?= )", norm, re.A)]
    outer = lambda g, h: g[0] <= h[0] and g[1] >= h[1] and (g[1] - g[0] > h[1] - h[0] and g[2] >= h[2] or g[2] > h[2])
    left = [h for h in hits if not any(outer(g, h) for g in hits)]
    base = brute_licenses(text)[4]
    labels = {h[3] for h in left} | set(filter(None, base.split(",")))
    return ",".join(sorted(labels)), max([h[4] for h in left] + [0.8 if base else 0.0]), sorted((h[3], h[0], h[1]) for h in left)


def test_licenses_as_in_plain_python(spark):
    r = random.Random(12)
    forms = []
    for s in licenses.signatures():
        forms += spelled(re._parser.parse(s.pattern))[:6]
    bits = [*forms, "and", "some other words", "license", "gnu", "the", "Copyright (c) 2020, 2021", "MIT", "cc-by", "2.0"]
    texts = [", ".join(r.choice(bits) for _ in range(r.randrange(0, 14))) for _ in range(250)] + forms[::9] + [" ".join(["gnu lesser general public license v3"] * 300)]
    got = {x["doc_id"]: x for x in licenses.scan(make(spark, list(enumerate(texts))), "doc_id").collect()}
    for k, t in enumerate(texts):
        labels, score, hits = plain_licenses(t)
        assert (got[k]["labels"], got[k]["score"]) == (labels, score), t
        assert sorted(map(tuple, got[k]["hits"])) == hits, t


def test_license_scan_of_a_text_full_of_hits(spark):
    import time

    rows = [(1, "mit license " * 10_000), (2, "the mit license")]
    licenses.scan(make(spark, rows[1:]), "doc_id").collect()
    began = time.time()
    got = licenses.scan(make(spark, rows), "doc_id").collect()
    assert {x["doc_id"]: (x["n_words"], x["n_base"], x["last_word"], x["labels"]) for x in got} == {1: (20_000, 10_000, 19_998, "mit"), 2: (3, 1, 1, "mit")}
    assert time.time() - began < 20


def test_toxicity(spark):
    r = random.Random(2)
    words = [f"t{k}" for k in range(200)]
    rows, toxic = [], {}
    for k in range(900):
        w = [r.choice(words) for _ in range(60)]
        toxic[k] = int(k % 6 == 0)
        if toxic[k]:
            w[r.randrange(60)] = r.choice(["idiot", "gr0bbl", "GROBBL!", "moron"])
        rows.append((k, " ".join(w)))
    rows += [(5000, None), (5001, ""), (None, "idiot"), (5002, "you stup1d"), (5002, "you stup1d")]
    labels = spark.createDataFrame([(k, 1, t) for k, t in toxic.items()], "doc_id long, quality int, toxic int")
    got = toxicity.classify(make(spark, rows), labels).collect()
    assert len(got) == len(rows) and all(0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.3) for x in got)
    held = [x for x in got if x["held_out"] and x["doc_id"] in toxic]
    assert held and sum(x["predicted"] == toxic[x["doc_id"]] for x in held) / len(held) > 0.97
    flags = make(spark, rows).select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 4 == 2).alias("h")).where("h").count()
    assert flags == sum(x["held_out"] for x in got)
    assert {x["score"] for x in toxicity.classify(make(spark, rows), labels.where("false")).collect()} == {0.0}
    assert toxicity.classify(make(spark, []), labels).collect() == []


def plain_toxic_features(text, weights):
    """FEATURES of a text, word by word."""
    keep = set("@$*'")
    tokens, word = [], b""
    for ch in (text or "").encode() + b" ":
        if chr(ch) in keep or 48 <= ch < 58 or 65 <= ch < 91 or 97 <= ch < 123 or ch >= 128:
            word += bytes([ch])
        elif word:
            tokens.append(word)
            word = b""
    low = [bytes(c + 32 if 65 <= c < 91 else c for c in w) for w in tokens]
    read = [b"".join(toxicity.STANDS_FOR.get(chr(c), "").encode() if chr(c) in toxicity.STANDS_FOR else bytes([c]) for c in w) for w in low]
    person = {p.encode() for p in toxicity.PERSON}
    plain, hidden = [weights.get(w, 0.0) for w in low], [weights.get(w, 0.0) for w in read]
    value = [max(a, b) for a, b in zip(plain, hidden)]
    n, hits = len(tokens), [v > 0 for v in value]
    near = sum(h and any(low[j] in person for j in range(max(0, k - 4), min(n, k + 5))) for k, h in enumerate(hits))
    letter = lambda c: 65 <= c < 91 or 97 <= c < 123 or c >= 128
    signs = set(map(ord, toxicity.STANDS_FOR))
    mixed = sum(any(map(letter, w)) and any(c in signs for c in w) for w in tokens)
    shouted = sum(len(w) > 2 and all(65 <= c < 91 for c in w) for w in tokens)
    raw, base = (text or "").encode(), max(n, 1)
    veiled = sum(b > 0 and a == 0 for a, b in zip(plain, hidden))
    seeds = {s.encode() for s in toxicity.SEED}
    size = max(len(raw), 1)
    return [n, sum(hits), sum(hits) / base, sum(value), sum(value) / base, near, sum(w in person for w in low) / base, veiled, veiled / base, mixed / base, sum(65 <= c < 91 for c in raw) / size, shouted / base, sum(c in b"!?" for c in raw) / size, sum(w in seeds for w in low), max(value, default=0.0)]


def test_toxic_features_as_word_by_word():
    import numpy as np
    import pyarrow as pa

    r = random.Random(3)
    bits = ["you", "IDIOT", "st*pid", "m0ron", "tu", "word", "Hello!", "what?", "d'accord", "él", "$cum", "123", "!!!", "YOUR", "gr0bbl", "a", "*"]
    texts = ["", " ", None, "x"] + [r.choice([" ", ", ", "\n"]).join(r.choice(bits) for _ in range(r.randrange(1, 60))) for _ in range(80)]
    weights = {s.encode(): 0.5 for s in toxicity.SEED} | {b"grobbl": 0.9, b"word": 0.1}
    h = toxicity.word_hash([w.decode() for w in weights])
    order = np.argsort(h)
    got = toxicity.features(pa.array([t or "" for t in texts]), h[order], np.array(list(weights.values()))[order])
    for k, t in enumerate(texts):
        assert np.allclose(got[k], plain_toxic_features(t, weights)), t


def test_first_split_and_calibration_as_by_search():
    import numpy as np

    r = np.random.default_rng(5)
    x = np.round(r.random((300, 3)), 2)
    y = (r.random(300) < np.where(x[:, 1] > 0.6, 0.8, 0.1)).astype(float)
    start, trees = toxicity.boost(x, y, trees=1, depth=1)
    p = y.mean()
    g, hess, best = p - y, p * (1 - p), (0.0, None)
    assert abs(start - np.log(p / (1 - p))) < 1e-12
    for f in range(3):
        cuts = np.unique(np.quantile(x[:, f], np.linspace(0, 1, 49)[1:-1]))[:-1]
        for c in cuts:
            left = x[:, f] <= c
            if min(left.sum(), (~left).sum()) >= 8:
                gain = g[left].sum() ** 2 / (hess * left.sum() + 1) + g[~left].sum() ** 2 / (hess * (~left).sum() + 1) - g.sum() ** 2 / (hess * 300 + 1)
                best = max(best, (gain, (f, c, -g[left].sum() / (hess * left.sum() + 1) * 0.15, -g[~left].sum() / (hess * (~left).sum() + 1) * 0.15)), key=lambda b: b[0])
    assert np.allclose(trees[0], best[1])
    margin = np.round(r.random(60), 1)
    z = (r.random(60) < margin).astype(float)
    at, prob = toxicity.isotonic(margin, z)
    # the least-squares monotone fit by its min-max form, with the pseudo-row of each block
    values = np.unique(margin)
    total, count = (np.array([f(z[margin == v]) for v in values]) for f in (np.sum, len))
    mean = lambda a, b: total[a : b + 1].sum() / count[a : b + 1].sum()
    fit = np.array([max(min(mean(a, b) for b in range(k, len(values))) for a in range(k + 1)) for k in range(len(values))])
    want = []
    for k, v in enumerate(fit):
        block = np.isclose(fit, v)
        want.append((total[block].sum() + z.mean()) / (count[block].sum() + 1))
    assert np.allclose(np.interp(values, at, prob), np.maximum.accumulate(want))
    assert (np.diff(prob) >= 0).all()


def test_quality_stage_keeps_columns_of_any_name(spark):
    names = ["__id", "__quality", "id", "quality", "h", "three", "rule", "kept", "__keep", "n_words"]
    rows = corpus() + [(3000 + k, "bad $$$ " * 60 + f"t{k}") for k in range(40)]
    labels = spark.createDataFrame([(i, int(i < 3000), 0) for i, _ in rows if i is not None], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(i, t, *names) for i, t in rows], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    want = sorted((str(r["doc_id"]), r["text"]) for r in quality.good(make(spark, rows), labels).collect())
    got = quality.good(docs, labels)
    assert got.columns == docs.columns and sorted((str(r["doc_id"]), r["text"]) for r in got.collect()) == want
    assert all(r[n] == n for r in got.collect() for n in names)


def test_pruned_rules_hold_one_bound_a_feature():
    import numpy as np

    x = np.random.default_rng(2).random((2000, len(quality.FEATURES)))
    bad = x[:, 3] > 0.8
    rule = quality.Rule((("symbol_share", True, 0.0), ("dup_line_share", True, 0.3), ("dup_line_share", True, 0.8), ("n_words", False, 0.99999)))
    assert quality._prune(rule, x, bad) == quality.Rule((("dup_line_share", True, 0.8),))


def brute_features(text):
    t = text or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    three, places = [tuple(w[k : k + 3]) for k in range(len(w) - 2)], {}
    for k, x in enumerate(three):
        places.setdefault(x, []).append(k)
    repeat = len({k + j for at in places.values() if len(at) > 1 for k in at for j in range(3)})
    chars = sum(map(len, w))
    share = lambda a, b: a / b if b else 0.0
    count = lambda of: sum(c in of for c in t)
    upper = count("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    return [len(w), share(chars, len(w)), share(count("#*$%&|<>"), chars), share(len(lines) - len(set(lines)), len(lines)), share(repeat, len(w)), share(upper, chars), share(count("!?"), chars)], repeat


def brute_quality(docs, labels):
    import numpy as np

    marks = {}
    for i, q, _ in labels:
        if i is not None and q is not None:
            marks[i] = min(marks.get(i, q), q)
    seen = {i: brute_features(t) for i, t, *_ in docs}
    base = lambda i: seen[i][0][0] < 50 or 100 * seen[i][1] > 50 * seen[i][0][0]
    known = sorted((i, marks[i], *seen[i][0]) for i in seen if i in marks and not base(i))
    rules = quality.learn(np.array([r[2:] for r in known], float), np.array([r[1] == 0 for r in known]))
    bad = lambda i: base(i) or any(r.meets(np.array([seen[i][0]], float))[0] for r in rules)
    return [d for d in docs if not bad(d[0])]


def brute_near(docs):
    sets = {d[0]: shingles(d[1], 5) for d in docs}
    top = {i: i for i in sets}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                top[y] = x
    return [d for d in docs if find(d[0]) == d[0]]


def brute_strip(docs):
    first, out = {}, []
    words = {d[0]: WORD.findall(d[1] or "") for d in docs}
    for i in sorted(words):
        for k in range(len(words[i]) - 49):
            first.setdefault(tuple(words[i][k : k + 50]), i)
    for i, t, *rest in docs:
        w, gone = words[i], set()
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < i:
                gone |= set(range(k, k + 50))
        out.append((i, " ".join(x for k, x in enumerate(w) if k not in gone) if gone else t, *rest))
    return out


def brute_mixing(spark, docs):
    """Of each leaf the prefix of its seeded order; the hash is taken from Spark, one row at a time."""
    hashed = spark.createDataFrame([d[:2] for d in docs], "i long, t string").select("i", F.xxhash64("t").alias("t"))
    place = {r["i"]: tuple(r) for r in hashed.select("i", F.xxhash64(F.lit(17), F.lit(0), "i", "t").alias("o"), "t").collect()}
    n, leaves = {d[0]: len(WORD.findall(d[1] or "")) for d in docs}, {}
    for d in docs:
        number = re.search(r"\d{1,15}$", d[3] or "")
        leaves.setdefault((("web", "books", "code")[int(number[0]) % 3] if number else "other", d[2], d[3]), []).append(d[0])
    have = {k: float(sum(n[i] for i in v)) for k, v in leaves.items()}
    have = {k: v for k, v in have.items() if v}
    dealt = mixing.budgets(0.9 * sum(have.values()), have, lambda p: float(mixing.WEIGHTS.get(p, mixing.WEIGHTS.get(p[-1], 1.0))))
    kept = set()
    for leaf, budget in dealt.items():
        before = 0
        for i in sorted(leaves[leaf], key=lambda i: (place[i][1], i, place[i][2])):
            if n[i] and before < budget:
                kept.add(i)
            before += n[i]
    return [d for d in docs if d[0] in kept]


def test_pipeline_keeps_what_brute_force_keeps(spark):
    import corpus_pipeline as p

    where = "/root/testdata/sf0.001"
    docs = sorted(map(tuple, spark.read.parquet(f"{where}/documents.parquet").collect()))
    labels = [tuple(r) for r in spark.read.parquet(f"{where}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    table = spark.read.parquet(f"{where}/documents.parquet")
    brute = {"quality_rules": lambda d: brute_quality(d, labels), "near_dedup": brute_near, "substring_dedup": brute_strip, "source_mixing": lambda d: brute_mixing(spark, d)}
    for name, stage in p.STAGES[:-1]:
        want = brute[name](docs)
        assert want and want != docs, f"{name} has nothing to do"
        table = p.written(stage(spark, table, where), name)
        assert sorted(map(tuple, table.collect())) == want, name
        docs = want
    texts = {d[0]: d[1] for d in docs}
    for out in (p.STAGES[-1][1](spark, table, where), p.run(spark, where)):
        got = sentencepiece_codec.decode(out).collect()
        assert len(got) == len(texts) and {r["doc_id"]: r["text"] for r in got} == texts
