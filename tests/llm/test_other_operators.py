"""op1, op2, op3, op4, op10 and the pipeline: exact round trips, brute force, edge cases."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from carelake.llm import ann, mixing, sentencepiece_codec, urlfilter, warc
from carelake.llm.queries import URL_RULES

PAGES = "page_id long, url string, html string, digest string, n int, keys string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 1, "k") for i, u, h in rows], PAGES)


def test_archives(spark):
    r = random.Random(1)
    big = "".join(r.choice("aé😀\r\n ") for _ in range(90_000))
    rows = [(1, "http://a/ü b", "x" * 200), (2, None, None), (3, "u", ""), (4, "u", big), (5, "u", "x" * 200), (6, "u", big), (7, "u", "short"), (8, "u", "short"), (0, "u", "y" * 100), (9, "u", "y" * 100), (9, "u", "y" * 100), (None, "u", "x" * 200)]
    got = sorted(map(tuple, warc.round_trip(pages(spark, rows), segment=1000).collect()), key=str)
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        least = min(j for j, _, g in rows if g == h and j is not None) if len(raw) >= 100 else None
        again = i is not None and least is not None and i > least
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", least if again else None, True))
    assert got == sorted(want, key=str)
    assert warc.round_trip(pages(spark, [])).collect() == []


def test_broken_segments_and_framing(spark, tmp_path):
    block = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + warc.chunked(b"abcdefgh" * 100, 7)
    digest = hashlib.sha256(b"abcdefgh" * 100).hexdigest()

    def records(name, cuts, total, numbers=None):
        edges = [0, *cuts, len(block)]
        parts = [block[a:b] for a, b in zip(edges, edges[1:])]
        out = []
        for k, p in enumerate(parts, 1):
            f = [("WARC-Type", "response" if k == 1 else "continuation"), ("WARC-Record-ID", f"<{name}>" if k == 1 else f"<{name}:{k}>"), ("Row-ID", name), ("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Segment-Number", numbers[k - 1] if numbers else k)]
            f += [("WARC-Segment-Origin-ID", f"<{name}>")] if k > 1 else []
            f += [("WARC-Segment-Total-Length", total)] if k == len(parts) else []
            out.append(warc.record(f, p) + b"\r\n")
        return out

    good = records(1, [100, 300], len(block))
    short, gap = records(2, [100], len(block) - 1), records(3, [100, 200], len(block), [1, 3, 4])
    mixed = good + short + gap
    random.Random(0).shuffle(mixed)
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.warc").write_bytes(b"".join(mixed[:4]))
    (tmp_path / "a" / "y.warc").write_bytes(b"".join(mixed[4:]))
    got = {r["id"]: (r["ok"], r["payload"]) for r in warc.read(spark, f"file://{tmp_path}/a").collect()}
    assert got == {1: (True, bytearray(b"abcdefgh" * 100)), 2: (False, None), 3: (False, None)}
    with pytest.raises(ValueError):
        warc.unchunked(b"5\r\nabc\r\n0\r\n\r\n")


def test_odd_archives(spark, tmp_path):
    import gzip

    body = b"HTTP/1.1 200 OK\r\n\r\nhello"
    digest = hashlib.sha256(b"hello").hexdigest()
    lower = b"WARC/1.0\r\nwarc-type: response\r\nWARC-RECORD-ID: <a>\r\nrow-id: 1\r\nwarc-target-uri: http://x/\r\n  folded\r\nwarc-payload-digest: sha256:" + digest.encode() + b"\r\ncontent-length:%d\r\n\r\n" % len(body) + body + b"\r\n\r\n"
    unlengthed = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <b>\r\nRow-ID: 2\r\n\r\n" + body + b"\r\n\r\n"
    fields = next(warc.records(iter([lower])))[0]
    assert fields["warc-target-uri"] == "http://x/ folded"
    members = gzip.compress(lower) + gzip.compress(lower.replace(b"row-id: 1", b"row-id: 3"))
    (tmp_path / "f").mkdir()
    for name, data in {"a.warc": lower + unlengthed, "b.warc.gz": members, "c.warc.gz": gzip.compress(lower.replace(b"row-id: 1", b"row-id: 4") * 3)[:-30], "d.warc": b"no archive at all", "e.warc": b"", "g.warc": b"\r\n\r\n"}.items():
        (tmp_path / "f" / name).write_bytes(data)
    got = [(r["id"], r["record_type"], r["ok"]) for r in warc.read(spark, f"file://{tmp_path}/f").collect()]
    good = [x for x in got if x[1] == "response"]
    assert {x[0] for x in good} >= {1, 3} and all(ok for _, _, ok in good)
    assert [x for x in got if x[1] == "broken"] == [(None, "broken", False)] * 3  # of a, c and d
    pieces = lower * 5
    for step in (1, 7, 1000):  # however the file is given
        assert len(list(warc.records(iter([pieces[k : k + step] for k in range(0, len(pieces), step)])))) == 5


def test_neighbours(spark):
    r = np.random.default_rng(3)
    v = r.standard_normal((1500, 16)) * r.uniform(0.5, 2, (1500, 1))
    v[100:400] = v[100]  # a common vector
    rows = [(k, x.tolist(), "e") for k, x in enumerate(v)]
    rows += [(9000, None, "e"), (9001, [0.0] * 16, "e"), (9002, [float("nan")] * 16, "e"), (9003, [1.0] * 3, "e"), (9004, [None] + [1.0] * 15, "e"), (None, [1.0] * 16, "e"), (9020, [], "e")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, p string")
    got = {}
    for x in ann.search(df, F.col("id") % 20 == 0, k=20).collect():
        got.setdefault(x["query_id"], []).append((x["rank"], x["vec_id"], x["score"]))
    assert sorted(got) == list(range(0, 1500, 20))
    hit = 0
    for q, found in got.items():
        s = v @ v[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(1500), -np.round(s, 9)))[:20]
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21)) and all(abs(s[f[1]] - f[2]) < 1e-9 for f in found)
        hit += len({f[1] for f in found} & set(best.tolist()))
    assert hit / (20 * len(got)) >= 0.9
    assert ann.search(df.where("false"), F.col("id") % 20 == 0).collect() == []
    few = ann.search(df.where("vec_id < 3"), F.col("id") % 20 == 0).collect()
    assert [(x["rank"], x["query_id"]) for x in sorted(few)] == [(1, 0), (2, 0)]


def test_verified_share_falls_with_rows_and_recall_holds(spark):
    shares = []
    for n in (1000, 8000):
        v = np.random.default_rng(n).standard_normal((n, 24)) * np.where(np.arange(n) % 10 == 0, 8.0, 1.0)[:, None]  # two bands of norms
        df = spark.createDataFrame([(k, x.tolist(), 0, 0) for k, x in enumerate(v)], "vec_id long, embedding array<float>, row int, band int")
        got = {}
        for x in ann.search(df, F.col("id") % 50 == 0, k=20).collect():
            got.setdefault(x["query_id"], (set(), x["n_verified"]))[0].add(x["vec_id"])
        v = v.astype(np.float32).astype(float)
        hit = 0
        for q, (found, _) in got.items():
            s = v @ v[q]
            s[q] = -np.inf
            hit += len(found & set(np.argsort(-s)[:20].tolist()))
        assert len(got) == n // 50 and hit / (20 * len(got)) >= 0.9
        shares.append(np.mean([seen for _, seen in got.values()]) / n)
    assert shares[1] < shares[0] < 0.8, shares


def test_block_search_matches_a_plain_one():
    r = np.random.default_rng(4)
    v, q = r.standard_normal((900, 12)), r.standard_normal((40, 12))
    v[200:260] = v[200]  # ties
    ids = r.permutation(900)
    plane = r.standard_normal((12, 8))
    top = float((v * v).sum(axis=1).max())
    i, s, seen = ann.search_block(v, ids, np.arange(900), v @ plane, top, q, np.full(40, -1), q @ plane, np.full(40, -np.inf), 15, 1e9)
    for k in range(40):
        want = (q[k] * v).sum(axis=1)
        best = np.lexsort((ids, -want))[:15]
        assert i[k].tolist() == ids[best].tolist() and np.array_equal(s[k], want[best])
    assert (seen == 900).all()


def test_chi_square():
    assert abs(ann.chi_square_quantile(0.95, 8) - 15.507) < 1e-2 and abs(ann.chi_square_quantile(0.95, 5) - 11.070) < 1e-2


def test_url_filter(spark):
    urls = [None, "", "no scheme", "https://WWW.Example.com/en/x?q", "https://example.com/en/", "https://a.example.com/en", "http://b.net/es/1#f", "http://b.net", "http://net/fr/", "http://xnet/fr/", "http://com/", "x://é.com/ü?/", "http://a.com:80/", "http://a.com/en//://x"]
    got = {r["page_id"]: r for r in urlfilter.judge(pages(spark, [(k, u, "") for k, u in enumerate(urls)]), URL_RULES, "page_id").collect()}
    for k, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = rest
        for c in "/?#":
            host = host.split(c)[0]
        path = rest[len(host) :].split("?")[0].split("#")[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [(len(r.host + r.path), r) for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        rule = max(fits)[1] if fits else None
        want = (host, path, rule and rule.host + rule.path, rule.verdict if rule else "allow")
        assert tuple(got[k])[1:] == want, u
    assert urlfilter.judge(pages(spark, []), URL_RULES, "page_id").collect() == []
    assert {r["verdict"] for r in urlfilter.judge(pages(spark, [(1, "http://a.com/", "")]), [], "page_id").collect()} == {"allow"}


def test_cascade_is_exact_over_its_universe(spark):
    keys = [f"k{n}" for n in range(5000)]
    listed = keys[::7]
    levels = urlfilter.cascade(spark.createDataFrame([(k,) for k in keys * 2], "key string"), listed)
    got = {r["key"] for r in spark.createDataFrame([(k,) for k in keys], "key string").where(urlfilter.member(F.col("key"), levels)).collect()}
    assert got == set(listed) and len(levels) > 1


TEXTS = ["", "a", " ", "  lead  and trail  ", "\n\nx\ty", "▁ odd ▁▁", "日本語 テキスト 😀 end", "x" * 3000, " " * 100, "é" * 70, "The quick brown fox jumps over the lazy dog, again and again."]


def test_pieces():
    import sentencepiece

    model = sentencepiece_codec.default_model()
    c, lib = sentencepiece_codec.Codec(model), sentencepiece.SentencePieceProcessor(model_proto=model)
    ids, off = c.encode(TEXTS, np.zeros(len(TEXTS), np.int64), 5, 0.0)
    for k, t in enumerate(TEXTS):
        if "▁" not in t:
            assert ids[off[k] : off[k + 1]].tolist() == lib.encode(t), t
    seen = set()
    for seed in range(5):
        ids, off = c.encode(TEXTS, np.arange(len(TEXTS)), seed, 0.3)
        assert c.decode(ids, off) == [t.encode() for t in TEXTS]
        seen.add(tuple(ids[off[-2] :]))
    assert len(seen) == 5
    word = np.array([c.single[sentencepiece_codec.BLANK]] + [c.single[ord(x)] for x in "international"], np.int32)
    for v in range(20):
        together, _ = c.together(word, np.zeros(len(word), np.int64), np.arange(len(word)), np.array([v]), 5, 0.3)
        assert together.tolist() == c.agenda(word, v, 5, 0.3)


def test_each_occurrence_is_cut_by_itself():
    c = sentencepiece_codec.Codec(sentencepiece_codec.default_model())
    r = random.Random(6)
    words = ["international", "the", "a", "understanding", "z" * 60, "réunion"]
    texts = ["", "international " * 300] + [" ".join(r.choice(words) for _ in range(80)) for _ in range(6)]
    docs = np.array([3, 3, 11, 19, 27, -5, 2**62, 11])
    for dropout in (0.0, 0.1, 0.4):
        ids, off = c.encode(texts, docs, 5, dropout)
        assert c.decode(ids, off) == [t.encode() for t in texts]
        cuts = set()
        for k, t in enumerate(texts):  # every unit at its place through the agenda, none reused
            want = []
            for m in re.finditer(" +[^ ]*", " " + t if t else ""):
                symbols = np.array([c.single[sentencepiece_codec.BLANK if x == " " else ord(x)] for x in m[0]], np.int32)
                got = c.agenda(symbols, int(docs[k]), 5, dropout, m.start())
                want += got
                if k == 1 and m[0] == " international":
                    cuts.add(tuple(got))
            assert ids[off[k] : off[k + 1]].tolist() == want, (dropout, k)
        assert len(cuts) == 1 if not dropout else len(cuts) > 8


def test_agenda_of_unspaced_text():
    import time

    c = sentencepiece_codec.Codec(sentencepiece_codec.default_model())
    r = random.Random(2)
    for text in ("".join(r.choice("international") for _ in range(40_000)), "".join(r.choice("日本語テキスト中国人") for _ in range(40_000))):
        began = time.process_time()
        ids, off = c.encode([text], np.array([7]), 5, 0.1)
        assert time.process_time() - began < 3
        assert c.decode(ids, off) == [text.encode()]
    key = int(c.keyed(np.array([9]), 5)[0])
    places, pieces = np.arange(500) * 7919, np.arange(500) % 300
    many = c.skipped(places, pieces, np.full(500, key, np.uint64), 0.3).tolist()
    assert many == [sentencepiece_codec._skips(int(a), int(b), key, 0.3) for a, b in zip(places, pieces)] and 100 < sum(many) < 200


def test_documents_with_one_text_are_cut_differently(spark):
    df = spark.createDataFrame([(k, "international understanding") for k in range(400)], "doc_id long, text string")
    assert len({tuple(r["ids"]) for r in sentencepiece_codec.encode(df).collect()}) > 8


def test_piece_queries(spark):
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(None, "x y"), (50, None), (50, None)]
    df = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, ids string")
    out = sentencepiece_codec.encode(df)
    got = out.collect()
    assert len(got) == len(rows) and all(r["lossless"] and r["n_tokens"] == len(r["ids"]) for r in got)
    back = sorted((str(r["doc_id"]), r["text"]) for r in sentencepiece_codec.decode(out).collect())
    assert back == sorted((str(i), t or "") for i, t in rows)
    assert sentencepiece_codec.encode(df.where("false")).collect() == []


def test_shares_go_to_siblings_before_ancestors():
    leaves = {("a", "x", "1"): 100.0, ("a", "x", "2"): 10.0, ("b", "y", "1"): 1000.0}
    got = mixing.budgets(150, leaves, lambda p: 1.0)
    assert got == {("a", "x", "1"): 65.0, ("a", "x", "2"): 10.0, ("b", "y", "1"): 75.0}
    got = mixing.budgets(300, leaves, lambda p: 1.0)
    assert got == {("a", "x", "1"): 100.0, ("a", "x", "2"): 10.0, ("b", "y", "1"): 190.0}
    assert mixing.budgets(50, leaves, lambda p: 0.0 if p == ("a",) else 1.0)[("a", "x", "1")] == 0.0


def test_mixing_against_sorted_lists(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SLICES", 1 << 16)
    r = random.Random(14)
    rows = [(k, " ".join("w" * r.randrange(1, 4) for _ in range(r.randrange(0, 40))), r.choice(["en", "de", None]), r.choice(["src1", "src2", "src3", None, "abc"])) for k in range(900)]
    rows += [(5, rows[5][1], "en", "src1"), (None, "a b c", "de", "src2"), (901, None, "en", "src1")]
    names = ["__leaf", "copies", "domain", "__keep", "place", "n", "slice"]
    df = spark.createDataFrame([(*x, *names) for x in rows], "doc_id long, text string, lang string, source string, " + ", ".join(f"{n} string" for n in names))
    for fraction, epochs in ((0.3, 1), (0.9, 1), (1.7, 2)):
        hashed = spark.createDataFrame([(k, x[0], x[1]) for k, x in enumerate(rows)], "k int, i long, t string")
        leaf_of = lambda x: ((("web", "books", "code")[int(re.search(r"\d+$", x[3])[0]) % 3] if re.search(r"\d+$", x[3] or "") else "other"), x[2], x[3])
        size = [len((x[1] or "").split()) for x in rows]
        leaves = {}
        for k, x in enumerate(rows):
            leaves.setdefault(leaf_of(x), []).append(k)
        have = {leaf: float(sum(size[k] for k in ks)) for leaf, ks in leaves.items()}
        have = {leaf: v for leaf, v in have.items() if v}
        dealt = mixing.budgets(fraction * sum(have.values()), {leaf: v * epochs for leaf, v in have.items()}, lambda p: float(mixing.WEIGHTS.get(p, mixing.WEIGHTS.get(p[-1], 1.0))))
        want = [0] * len(rows)
        for leaf, v in have.items():
            whole, rest = int(dealt[leaf] // v), dealt[leaf] % v
            order = {q["k"]: tuple(q)[1:] for q in hashed.select("k", F.xxhash64(F.lit(17), F.lit(whole), "i", F.xxhash64("t")).alias("o"), "i", F.xxhash64("t").alias("h")).collect()}
            before = 0
            for k in sorted(leaves[leaf], key=lambda k: tuple((y is not None, y) for y in order[k])):
                if size[k]:
                    want[k] = whole + (before < rest)
                before += size[k]
        got = mixing.plan(df, "doc_id", "text", fraction=fraction, max_epochs=epochs).collect()
        assert sorted((str(x["doc_id"]), str(x["text"]), x["copies"]) for x in got) == sorted((str(x[0]), str(x[1]), w) for x, w in zip(rows, want)), (fraction, epochs)
        taken = mixing.take(df, fraction=fraction, max_epochs=epochs)
        assert taken.columns == df.columns and taken.count() == sum(want)


def test_mixing_takes_prefixes(spark):
    r = random.Random(4)
    rows = [(k, "w " * r.randrange(30), r.choice(["en", "de", None]), r.choice(["src1", "src2", None, "abc"])) for k in range(600)] + [(7000, None, "en", "src1"), (None, "a b", "en", "src1"), (8, "a b c", "en", "src1"), (8, "a b c", "en", "src1")]
    df = spark.createDataFrame([(*x, 1, "q") for x in rows], "doc_id long, text string, lang string, source string, copies int, __leaf string")
    out = mixing.plan(df, "doc_id", fraction=1.4, max_epochs=2).collect()
    assert len(out) == len(rows) and {x["copies"] for x in out} <= {0, 1, 2}
    total = sum(x["n_tokens"] for x in out)
    have = {}
    for x in out:
        leaf = (x["domain"], x["lang"], x["source"])
        have[leaf] = have.get(leaf, 0) + x["n_tokens"]
    weight = lambda p: float(mixing.WEIGHTS.get(p[-1], 1.0))
    want = mixing.budgets(1.4 * total, {k: 2 * v for k, v in have.items() if v}, weight)
    for leaf, budget in want.items():
        rest = [x for x in out if (x["domain"], x["lang"], x["source"]) == leaf]
        got = sum(x["copies"] * x["n_tokens"] for x in rest)
        assert budget - 1e-6 <= got < budget + 2 * max(x["n_tokens"] for x in rest) + 1, leaf
    assert all(x["copies"] == 0 for x in out if not x["n_tokens"])
    assert mixing.plan(df.where("false"), "doc_id").collect() == []
    taken = mixing.take(df, fraction=0.5)
    assert taken.columns == df.columns and 0 < taken.count() < len(rows)


def test_pipeline(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels_dir = "/root/testdata/sf0.001"
    counts = []
    for name, stage in p.STAGES:
        docs = p.written(stage(spark, docs, labels_dir), name)
        counts.append(docs.count())
        if name != "piece_encoding":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    assert [n for n, _ in p.STAGES] == ["quality_rules", "near_dedup", "substring_dedup", "source_mixing", "piece_encoding"]
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0 and docs.where("not lossless").isEmpty()
    for name, stage in p.STAGES:  # an empty table passes through
        empty = stage(spark, spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("false"), labels_dir)
        assert empty.collect() == []
