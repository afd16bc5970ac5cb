"""Corpus operators against brute force on small inputs: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import functools
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import jaccard, merkle, mixing, packing, queries, shared, substrings, topk, toxicity, url_filter, warc, wrappers, words

EXTRA = ", id string, n string, bucket string, score string, host string, k string, kept string, topic string, fingerprint string"
CLASH = ("x",) * 9


def documents(spark, rows):
    """rows (doc_id, text) with columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, "en", f"s{i % 2}" if i % 3 else None, len(r[1] or ""), *CLASH) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long" + EXTRA)


def words_of(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())


def vocabulary(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(rng.randint(2, 9))) for _ in range(n)]


@pytest.fixture(scope="module")
def corpus():
    """Copies, near copies, shared passages, blanks, nulls, a very long text, repeated rows."""
    rng, vocab = random.Random(3), vocabulary(4000, 1)
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passage, line = prose(80), prose(12)
    rows = [(i, prose(rng.randint(5, 200))) for i in range(40)]
    base = prose(150).split(" ")
    for i in range(40, 60):  # near copies of one text
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        rows.append((i, " ".join(w)))
    rows += [(i, rows[3][1]) for i in (60, 61, 62)]
    rows += [(i, f"{prose(30)} {passage}\n{line}\n{prose(20)}") for i in range(63, 70)]
    rows += [(i, line + "\n" + prose(40)) for i in range(70, 80)]
    rows += [(80, None), (81, ""), (82, " \t\n\x0b\x0c\r "), (83, "One"), (84, "one"), (85, "a b c"), (86, "A B C"), (87, "a b c d"), (88, "\u00a0\u3000x \u2003y"), (89, prose(9000)), (None, prose(70)), (None, None)]
    rows += [(i, " ".join(vocab[:n])) for i, n in zip(range(90, 96), (14, 15, 16, 13, 30, 29))]
    rows += [rows[5], rows[5], rows[64]]
    return rows


def test_words_agree_with_bytes_split(corpus):
    texts = [t for _, t in corpus]
    w = words.Words(pa.array(texts, pa.large_string()))
    got = [w.data[a:b].tobytes() for a, b in zip(w.starts, w.ends, strict=True)]
    assert got == [x for t in texts for x in words_of(t)]
    assert w.counts.tolist() == [len(words_of(t)) for t in texts]
    assert all(a.split() == words_of(a.decode()) for a in ["\x1c \x85 a\x0bb".encode(), "x\u2028y z".encode()])


def brute_components(rows, k, percent):
    sets = []
    for _, t in rows:
        w = [x.lower() for x in words_of(t)]
        sets.append(frozenset() if not w else frozenset([tuple(w)]) if len(w) < k else frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[find(i)] = min(d, ids.get(find(i), d))
    return sorted(((d, len(sets[i]), d if not sets[i] else ids.get(find(i))) for i, (d, _) in enumerate(rows)), key=repr)


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80), (2, 60)])
def test_jaccard_components(spark, corpus, k, percent):
    got = jaccard.components(documents(spark, corpus), k=k, percent=percent)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_components(corpus, k, percent)


def test_jaccard_light_sets_and_tiles(spark, monkeypatch):
    rng = random.Random(8)
    pool = [f"w{i}" for i in range(30)]
    rows = [(i, " ".join(sorted(rng.sample(pool, rng.randint(1, 28)), key=pool.index))) for i in range(150)]
    rows += [(200 + i, " ".join(w if rng.random() > 0.02 else "zz" for w in (pool * 6))) for i in range(40)]
    got = sorted((tuple(r) for r in jaccard.components(documents(spark, rows), k=1, percent=80).collect()), key=repr)
    assert got == brute_components(rows, 1, 80)
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", 4)
    monkeypatch.setattr(jaccard, "FEW_TEXTS", 0)
    monkeypatch.setattr(shared, "FEW_EDGES", 0)
    got = sorted((tuple(r) for r in jaccard.components(documents(spark, rows), k=2, percent=60).collect()), key=repr)
    assert got == brute_components(rows, 2, 60)


@pytest.mark.parametrize("few", [0, 1 << 20])
def test_connected(spark, monkeypatch, few):
    monkeypatch.setattr(shared, "FEW_EDGES", few)
    rng = random.Random(12)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(70)] + [(1000 + i, 1001 + i) for i in range(40)] + [(7, 7), (-(2**60), 5), (5, -(2**60))]
    root = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in range(200):
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    got = shared.connected(spark.createDataFrame(edges, "u long, v long")).collect()
    assert sorted((r.node, r.root) for r in got) == sorted(root.items())
    assert shared.connected(spark.createDataFrame([], "u long, v long")).count() == 0


def test_boundary_and_thresholds():
    for p in (60, 80, 85, 95):
        for a in range(1, 60):
            for b in range(a, 60):
                o = min(i for i in range(b + 2) if 100 * i >= p * (a + b - i))
                assert jaccard.overlap(a, b, p) == o
    assert 0 <= jaccard.boundary({5: 100, 20: 10, 32: 1}, 85) <= jaccard.LIGHT_MOST


def test_keep_first(spark, corpus):
    kept = jaccard.keep_first(documents(spark, corpus))
    assert kept.columns == documents(spark, corpus[:1]).columns
    want = {d for d, _, c in brute_components(corpus, 5, 80) if d == c and d is not None}
    ids = [r.doc_id for r in kept.collect()]
    assert set(ids) - {None} == want and ids.count(None) == 2 and ids.count(5) == 1


def brute_dedup(rows, window):
    first = {}
    for d, t in rows:
        w = words_of(t)
        for i in range(len(w) - window + 1):
            if d is not None:
                key = tuple(w[i : i + window])
                first[key] = min(d, first.get(key, d))
    out = []
    for d, t in rows:
        w = words_of(t)
        gone = set()
        for i in range(len(w) - window + 1):
            if d is not None and first[tuple(w[i : i + window])] < d:
                gone |= set(range(i, i + window))
        out.append((d, len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("window", "seed"), [(50, 8), (10, 3), (8, 8)])
def test_substring_dedup(spark, corpus, window, seed):
    got = substrings.dedup(documents(spark, corpus), window=window, seed=seed, carry=("lang", "id"), texts_too=True)
    rows = got.collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in rows), key=repr) == brute_dedup(corpus, window)
    assert all(r.lang == "en" and r.id == "x" for r in rows)
    assert all(hashlib.sha256(b" ".join(r.kept.encode().split())).hexdigest() == r.kept_sha256 and sum(s.end - s.start for s in r.spans) == r.n_removed for r in rows)


def test_spans():
    pairs = lambda *p: np.array(p, np.int32).reshape(-1, 2)
    assert substrings.spans(pairs()) == []
    assert substrings.spans(pairs((3, 53), (1, 51), (2, 52), (52, 102), (200, 250))) == [(1, 102), (200, 250)]
    assert substrings.spans(pairs((0, 50), (51, 101))) == [(0, 50), (51, 101)]


def brute_fingerprint(text):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    sections = []
    for section in text.split("\n\n"):
        below, digests = "", []
        for paragraph in section.split("\n"):
            phrases, rest = [], paragraph
            while rest:
                n = next((i for i in range(2, 65) if i <= len(rest) and rest[i - 1] in " \t\n\x0b\x0c\r" and rest[i - 2] in "enrst.,;:!?|"), min(64, len(rest)))
                phrases.append(sha(rest[:n]))
                rest = rest[n:]
            digests.append(sha(".".join(phrases)))
            below += "," + digests[-1][:16] + "".join("." + p[:12] for p in phrases)
        sections.append((sha(",".join(digests)), below))
    return sha(";".join(d for d, _ in sections)) + "".join(";" + d[:16] + b for d, b in sections)


def brute_likeness(a, b):
    if a[:64] == b[:64]:
        return 1.0
    common, sides = 0, [{*x.split(";")[1:]} for x in (a, b)]
    for cut in (",", "."):
        common += sum(x.count(".") for x in sides[0] & sides[1])
        sides = [{p for x in own - other for p in x.split(cut)[1:]} for own, other in (sides, sides[::-1])]
    total = 2 * common + len(sides[0]) + len(sides[1])
    return min(0.9999, 2.0 * (common + len(sides[0] & sides[1])) / total) if total else 0.0


def brute_differing(a, b):
    if a[:64] == b[:64]:
        return []
    out, one, two = [], a.split(";")[1:], b.split(";")[1:]
    for i in range(max(len(one), len(two))):
        x, y = (s[i] if i < len(s) else "" for s in (one, two))
        if x[:16] != y[:16]:
            p, q = x.split(",")[1:], y.split(",")[1:]
            out += [(i, j) for j in range(max(len(p), len(q))) if p[j : j + 1] == [] or q[j : j + 1] == [] or p[j][:16] != q[j][:16]]
    return out


def test_fingerprints(spark, corpus):
    rows = [r for r in corpus if r[0] is not None and corpus.count(r) == 1] + [(500, "x\n\ny\n"), (501, "x\n\ny"), (502, "x\ny\n\n"), (503, "\U0001f600" * 90)]
    got = {r.doc_id: r for r in merkle.edited(documents(spark, rows)).collect()}
    order = sorted(rows, reverse=True, key=lambda r: r[0])
    for i, (d, t) in enumerate(order):
        t, following = t or "", order[(i + 1) % len(order)][1] or ""
        third = len(t) // 3
        assert (got[d].n_chars, got[d].edited_sha256) == (len(t), hashlib.sha256((t[: len(t) - third] + following[:third]).encode()).hexdigest())
    texts = {d: t or "" for d, t in rows}
    for a in texts:
        assert got[a].fingerprint == brute_fingerprint(texts[a])
        for b in texts:
            assert (texts[a] == texts[b]) == (got[a].fingerprint == got[b].fingerprint)
    for i, (d, t) in enumerate(order):
        following, third = texts[order[(i + 1) % len(order)][0]], len(texts[d]) // 3
        own, other = got[d].fingerprint, brute_fingerprint(texts[d][: len(texts[d]) - third] + following[:third])
        assert got[d].edited_fingerprint == other
        assert got[d].near_edited == brute_likeness(own, other) and got[d].near_next == brute_likeness(own, brute_fingerprint(following))
        assert [tuple(e) for e in got[d].edits] == brute_differing(own, other)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got.values())
    long_ = [r for d, r in got.items() if len(texts[d]) > 300]
    assert np.mean([r.near_edited for r in long_]) > 0.55 and np.median([r.near_next for r in long_]) < 0.1


def test_fingerprint_edits_are_located(spark):
    df = spark.createDataFrame([("one\ntwo\n\nthree\nfour", "one\ntwo\n\nthree\nfive\nsix")], "a string, b string").select(merkle.fingerprint_of(F.col("a")).alias("a"), merkle.fingerprint_of(F.col("b")).alias("b"))
    r = df.select(merkle.edits(F.col("a"), F.col("b")).alias("e"), merkle.edits(F.col("a"), F.col("a")).alias("none"), merkle.likeness(F.col("a"), F.col("a")).alias("same")).first()
    assert [tuple(x) for x in r["e"]] == [(1, 1), (1, 2)] and r["none"] == [] and r["same"] == 1


def test_fingerprints_of_repeated_and_null_ids(spark):
    rows = [(1, "a"), (1, "b"), (None, "c"), (2, "dddddd"), (2, "dddddd")]
    assert merkle.edited(documents(spark, rows)).count() == 5
    one = merkle.edited(documents(spark, [(7, "abcdef")])).first()
    assert one.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest()


@pytest.mark.parametrize("scale", [1024.0, 1e12, 1e200])
def test_top_k(spark, scale):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 4) / (1 if i % 2 else 3)], "x") for i in range(230)]
    rows += [(300, [1.0, 2.0], "x"), (301, [3.0, 4.0], "x"), (400, None, "x"), (401, [float("nan")] * 4, "x"), (402, [1.0, None, 1.0, 1.0], "x"), (403, [float("inf")] * 4, "x"), (404, [], "x"), (None, [1.0] * 4, "x"), (5, [2.0] * 4, "x"), (100, rows[100][1], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    got = {}
    for r in topk.top_k(df, F.col("vec_id") % 100 == 0, scale=scale).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    valid = [(i, [math.floor(scale * x) for x in v]) for i, v, _ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    want = {}
    for q, v in {q: v for q, v in valid if q % 100 == 0}.items():
        scored = sorted((-min(max(sum(a * b for a, b in zip(v, w, strict=True)), -(2**63)), 2**63 - 1), i) for i, w in valid if i != q and len(w) == len(v))
        want[q] = [(n, i, -s) for n, (s, i) in enumerate(scored[:10], 1)]
    assert {q: sorted(x) for q, x in got.items()} == {q: x for q, x in want.items() if x}


def test_top_k_selects_per_tile(spark, monkeypatch):
    rng = np.random.default_rng(2)
    a = rng.integers(-5, 6, (900, 8)).astype(float)
    ids = np.arange(900)
    q, i, s = topk._tile(ids[::100], a[::100], ids, a, 10)
    for query in ids[::100]:
        want = sorted((-int(a[query] @ a[j]), j) for j in ids if j != query)[:10]
        assert sorted((-int(x), int(j)) for x, j in zip(s[q == query], i[q == query], strict=True)) == want


def test_top_k_in_cells(spark, monkeypatch):
    # one dense shard of candidates met 300 blocks of queries in one Arrow batch, which no executor could hold
    assert topk._grid(14_600_000, 146_000, 64, 1200) == (100, 2)
    assert topk._grid(0, 0, 1, 24) == (24, 1) and topk._grid(1000, 1000, 1 << 20, 24)[1] == 125
    rng = np.random.default_rng(3)
    a = rng.integers(-2, 3, (700, 5))
    a[::3] = [2, 2, 2, 2, 2]  # copies: ties go to the smaller id
    df = spark.createDataFrame([(i, [float(x) / 1024 for x in v]) for i, v in enumerate(a)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(topk, "HELD_BYTES", 80 * 5)
    monkeypatch.setattr(topk, "FEW_BYTES", 40 * 1000)
    monkeypatch.setattr(topk, "BLOCK_ROWS", 7)
    want = [(q, n, j, -s) for q in range(0, 700, 10) for n, (s, j) in enumerate(sorted((-int(a[q] @ a[j]), j) for j in range(700) if j != q)[:10], 1)]
    for parts, many in ((8, 1 << 20), (30, 20)):
        monkeypatch.setattr(topk, "MANY", many)
        monkeypatch.setattr(topk, "partitions", lambda _, n=parts: 4 * n)  # seven stripes of queries
        got = topk.top_k(df, F.col("vec_id") % 10 == 0).collect()
        assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == want


def test_packing(spark, corpus):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    rows = corpus + [(900, "it's  two   spaces \n\n and. more!! \u00a0end "), (901, "x" * 5000)]
    pieces = packing.pack(documents(spark, rows).coalesce(2), path, group_rows=50).collect()
    tokenizer = Tokenizer.from_file(path)
    want = {}
    for d, t in rows:
        want.setdefault(d, []).append(tokenizer.encode(t or "", add_special_tokens=False).ids + [0])
    by_sequence, by_doc = {}, {}
    for p in pieces:
        by_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length))
        by_doc.setdefault(p.doc_id, []).append(p)
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= 1024
    for d, texts in want.items():
        found = sorted((p.start, p.length, p.ids_crc32, p.doc_tokens) for p in by_doc[d])
        if len(texts) == 1:
            at, ids = 0, texts[0]
            for start, length, crc, tokens in found:
                assert (start, tokens, crc) == (at, len(ids), zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes()))
                at += length
            assert at == len(ids)
        else:
            assert sum(x[1] for x in found) == sum(map(len, texts))


def test_packing_plans():
    rng = np.random.default_rng(4)
    for lengths in ([], [5], [700] * 50, rng.integers(1, 1024, 3000).tolist(), [512] * 9 + [1] * 20):
        plan = packing.plan(lengths)
        used = {}
        for sequence in plan:
            assert 0 < sum(n for _, _, n in sequence) <= 1024
            for i, start, n in sequence:
                used.setdefault(i, []).append((start, n))
        for i, n in enumerate(lengths):
            at = 0
            for start, size in sorted(used[i]):
                assert start == at
                at += size
            assert at == n
        padding = sum(0 if (s := sum(n for _, _, n in q)) & (s - 1) == 0 else 1024 - s for q in plan)
        assert padding <= 0.02 * sum(lengths) + 1
    x = packing.nnls(np.array([[1.0, 0], [1, 1], [0, 1]]), np.array([2.0, 1, -1]))
    assert (x >= 0).all() and abs(x[0] - 1.5) < 1e-6 and x[1] == 0


def test_mixing(spark):
    rng = random.Random(2)
    rows = [(i, "w " * rng.randint(0, 3000), rng.choice(["a", "a", "a", "b", None]), rng.choice(["en", "de"]), "mine", True, "l", 7) for i in range(3000)]
    rows += [(None, None, "a", "en", "mine", True, "l", 7), rows[0], rows[0]]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, topic string, kept boolean, _lang string, N_Tokens int")
    topic, tokens, probability, kept = mixing.added(df)
    assert (topic, tokens, probability, kept) == ("topic_", "n_tokens_", "probability", "kept_")
    targets = {"source": {"b": 0.3, "a": 0.6}, "lang": 1.0, "topic": 1.0}
    got = mixing.mix(df, targets, keep=0.4)
    assert got.columns == [*df.columns, topic, tokens, probability, kept] and got.count() == len(rows)
    assert got.where("topic = 'mine' and kept and _lang = 'l' and N_Tokens = 7").count() == len(rows)
    n = F.col(tokens)
    r = got.agg(F.min(probability).alias("low"), F.max(probability).alias("high"), F.sum(n).alias("total"), F.sum(n * F.col(probability)).alias("kept"), F.sum(F.when(F.col("source") == "b", n * F.col(probability))).alias("b"), F.sum(F.when(F.col(kept), n)).alias("drawn")).first()
    assert r.total == sum(max(1, len((t or "").split())) for _, t, *_ in rows)
    assert r.low >= 0 and r.high <= 1 and abs(r.kept / r.total - 0.4) < 0.02 and abs(r.b / r.kept - 0.3) < 0.02 and abs(r.drawn / r.kept - 1) < 0.1
    by = {r.doc_id: r for r in got.collect()}
    for i, t, *_ in rows[::7]:
        draw = int(hashlib.sha256(f"1:{'' if i is None else i}:{t or ''}".encode()).hexdigest()[:13], 16) / 2**52
        assert by[i][kept] == (draw < by[i][probability])
    sample = mixing.sample(df, targets=targets, keep=0.4)
    assert sample.columns == df.columns and sorted((r.doc_id is None, r.doc_id) for r in sample.collect()) == sorted((r.doc_id is None, r.doc_id) for r in got.collect() if r[kept])


def test_all_words_may_name_topics(spark):
    # 24 words, each in 2 % of the documents: one in sixteen words was looked at before
    named = [f"topic{n:02}" for n in range(24)]
    df = documents(spark, [(i, f"word{i} is here {named[i // 4] if i < 96 else 'once%d' % i}") for i in range(200)])
    assert mixing.topic_words(df) == named
    got = {r.doc_id: r[mixing.added(df)[0]] for r in mixing.mix(df).collect()}
    assert got == {i: named[i // 4] if i < 96 else "other" for i in range(200)}


def test_topics_come_from_the_words(spark, monkeypatch):
    monkeypatch.setattr(mixing, "TOPIC_SHARE", 1)
    monkeypatch.setattr(mixing, "TOPIC_MOST", 0.5)
    rows = [(i, f"{'common ' * 3} {['Whale', 'RIVER', 'x'][i % 3]} {['whale', 'river', 'y'][i % 3]}! {'whale' if i == 1 else ''}") for i in range(30)] + [(30, "whale river"), (31, None), (32, ""), (33, "river whale river")]
    docs = documents(spark, rows).drop("topic")
    names = mixing.topic_words(docs, topics=2)
    assert names == ["whale", "river"]  # common is in more than half of all, the others are too short
    got = {r.doc_id: (r.t, r.n) for r in mixing.described(docs, names, "text", "t", "n").collect()}
    assert [got[i][0] for i in (0, 1, 2, 30, 31, 32, 33)] == ["whale", "river", "other", "whale", "other", "other", "river"]
    assert got[0][1] == 5 and got[31][1] == got[32][1] == 1
    assert mixing.described(docs.limit(1), [], "text", "t", "n").first().t == "other"


def test_marginals_tell_what_is_reached(spark):
    rows = [("=a", "=x", "=other", 100), ("=a", "=y", "=t", 300), ("=b", "=x", "=t", 50), ("null", "=y", "=other", 10)]
    cells = spark.createDataFrame(rows, "_source string, _lang string, _topic string, tokens long")
    for small in (True, False):
        raked = mixing.rake(cells, {"source": 1.0, "lang": {"x": 0.5}, "topic": 1.0}, keep=0.5, small=small)
        told = {(r.dimension, r.value): r for r in mixing.marginals(raked).collect()}
        assert told["lang", "=x"].target == 0.5 * 460 * 0.5 and told["topic", "=other"].target is None
        assert abs(told["topic", "=t"].achieved - told["topic", "=t"].target) < 1
        assert sum(r.tokens for (d, _), r in told.items() if d == "lang") == 460
    assert mixing.rake(cells.limit(0)).count() == 0


def test_raking_agrees_with_plain_loops(spark):
    rng = np.random.default_rng(5)
    tokens = rng.integers(50, 5000, (3, 2, 4))
    rows = [(f"={i}", f"={j}", f"={k}", int(tokens[i, j, k])) for i in range(3) for j in range(2) for k in range(4)]
    cells = spark.createDataFrame(rows, "_source string, _lang string, _topic string, tokens long").coalesce(1)
    got = {(r._source, r._lang, r._topic): r.weight for r in mixing.rake(cells, {"source": 0.0, "lang": 0.5, "topic": {"0": 0.5}}, keep=0.3).collect()}
    total, w = tokens.sum() * 0.3, tokens * 0.3
    own = [tokens.sum((1, 2)) / tokens.sum(), tokens.sum((0, 2)) / tokens.sum(), tokens.sum((0, 1)) / tokens.sum()]
    target = [np.ones(3) / 3, own[1] ** 0.5 / (own[1] ** 0.5).sum(), np.r_[0.5, 0.5 * own[2][1:] / own[2][1:].sum()]]
    for _ in range(200):
        for axis, t in enumerate(target):
            held = w.sum(tuple(a for a in range(3) if a != axis), keepdims=True)
            w = np.minimum(tokens, w * t.reshape([-1 if a == axis else 1 for a in range(3)]) * total / held)
    for i in range(3):
        for j in range(2):
            for k in range(4):
                assert abs(got[f"={i}", f"={j}", f"={k}"] - w[i, j, k]) < 0.01 * w[i, j, k] + 0.5


def test_toxicity_held_out(spark):
    rng, vocab = random.Random(6), vocabulary(800, 9)
    bad = ["grolk", "vashtir", "nubbex"]
    rows, labels = [], []
    for i in range(900):
        w = [rng.choice(vocab) for _ in range(rng.randint(1, 120))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(1 + len(w) // 40):
                w.insert(rng.randrange(len(w) + 1), rng.choice(bad) + rng.choice(["", ".", "ish", "!!"]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic), int(toxic)))
    rows += [(2000, None), (2001, ""), (2002, " \n"), (None, "grolk"), rows[3], (2003, "word " * 30000 + "grolk " + "word " * 30000)]
    labels += [(5000, 1, 1), (7, None, None), (None, 1, 1)]
    docs = documents(spark, rows)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.score(docs, lab).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 900]
    assert np.mean([r.predicted == (r.doc_id % 4 == 0) for r in held]) > 0.9
    by = {r.doc_id: r.score for r in got}
    assert by[2003] > by[2000] and by[2000] == by[2001] == by[2002]
    none = toxicity.score(docs.limit(3), lab.where("toxic = 0"))
    assert {(r.score, r.predicted) for r in none.collect()} == {(0.0, 0)}


def test_toxicity_gradients():
    texts = pa.array(["one two three two", "four", "two five six seven eight nine"], pa.large_string())
    x, net = toxicity.Inputs(texts), toxicity.Network(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    windows, text = x.windows(5, 2)
    y = np.array([1.0, 0, 1, 1])[: len(windows)]
    weight = np.ones(len(windows))

    def loss():
        z = net.logits(net.vectors(x).astype(np.float64), windows)
        return float((np.logaddexp(0, z) - y * z).mean())

    g = net.gradients(x, net.vectors(x), windows, y, weight)
    for name in ("wo", "va", "wa", "ba", "hf", "hb", "xf", "xb", "cf", "cb"):
        at = tuple(0 for _ in net.p[name].shape)
        eps, keep = 1e-3, net.p[name][at]
        net.p[name][at] = keep + eps
        up = loss()
        net.p[name][at] = keep - eps
        down = loss()
        net.p[name][at] = keep
        assert abs((up - down) / (2 * eps) - g[name][at]) < 2e-3, name


def test_windows_cover_all_words():
    for n in (0, 1, 31, 32, 33, 48, 49, 1000):
        x = toxicity.Inputs(pa.array([" ".join(f"w{i}" for i in range(n))], pa.large_string()))
        windows, _ = x.windows()
        assert set(windows.ravel().tolist()) - {n} == set(range(n))
        assert n <= 48 or len(windows) > n / 32 * 1.2


RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def test_url_filters(spark):
    urls = ["http://a.example.net/en/1", "HTTPS://A.Example.NET/EN/1", "http://example.com/de/x?y#z", "http://notexample.com/de/", "http://x.org/fr/", "http://x.org/fr", "http://org/fr/a", "http://foo.net", "http://foo.net/", "http://foo.net?x=/", "no scheme", None, "", "http://", "x://my-casino.example.com/a", "http://example.com/casinoroyal", "http://example.com/de//casino", "http://b\u00c9.net/", "a://b://net/", "http://example.com\n/de/"]
    df = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)] + [(0, urls[0], "x", "y"), (None, urls[2], "x", "y")], "page_id long, url string, html string, host string")
    got = url_filter.filter_urls(df).collect()
    assert len(got) == len(urls) + 2
    for r in got:
        u = urls[r.page_id] if r.page_id is not None else urls[2]
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            host = re.split(r"[/?#]", rest, maxsplit=1)[0]
            path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
            host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [x for x in RULES if (host == x[0].split("/", 1)[0] or host.endswith("." + x[0].split("/", 1)[0])) and path.startswith("/" + x[0].split("/", 1)[1])]
        best = max(fits, key=lambda x: len(x[0]), default=(None, None))
        assert (r["host"], r["path"], r["rule"]) == (host, path, best[0]), u
        if best[0]:
            assert r["verdict"] == best[1]
    by = {r.page_id: r.verdict for r in got}
    assert by[14] == "block" and by[15] == "allow" and by[16] == "block" and by[11] == "allow"


def random_rules(rng, names, n):
    rules = [url_filter.host_rule(".".join(rng.choices(names, k=rng.randint(1, 3))) + "/" + "/".join(rng.choices(names, k=rng.randint(0, 2))) + rng.choice(["", "/"]), rng.choice(["block", "allow"])) for _ in range(n)]
    for _ in range(n):
        middle = "".join(rng.choice([*names, "*", "^", "/", ".", "="]) for _ in range(rng.randint(1, 5)))
        rules.append(url_filter.pattern_rule(rng.choice(["", "@@"]) + rng.choice(["", "|", "||"]) + middle + rng.choice(["", "|"])))
    return [*rules, url_filter.pattern_rule("/zz+/"), url_filter.word_rule("dd")]


def random_urls(rng, names, n):
    return ["x://" + ".".join(rng.choices(names, k=rng.randint(1, 4))) + "/" + "/".join(rng.choices([*names, "ddx", "zzz"], k=rng.randint(0, 3))) + rng.choice(["", "?a=bb", "?dd", "?c1=e&bb=", "#dd"]) for _ in range(n)]


@functools.cache
def compiled(pattern):
    return re.compile(pattern, re.S)


def best_of_all(rules, url):
    host, path, whole = url_filter.split_url(url)
    found = [r for r in rules if compiled(r.pattern).search(host + path if r.listed else whole)] if whole else []
    return min(found, key=lambda r: (not r.listed, -len(r.name), r.name), default=None)


def test_url_index_finds_what_all_rules_find():
    rng = random.Random(7)
    names = ["a", "bb", "c1", "dd", "e"]
    for _ in range(20):
        rules = random_rules(rng, names, 60)
        index = url_filter.Index(rules, {"a": 5, "bb": 1})
        for u in random_urls(rng, names, 150):
            want, got = best_of_all(rules, u), index.judge(*url_filter.split_url(u))
            assert (got and got.name) == (want and want.name), u


def test_rules_of_filter_lists():
    hits = lambda line, url: best_of_all([url_filter.pattern_rule(line)], url) is not None
    assert hits("||ads.com^", "http://x.ads.com/y") and not hits("||ads.com^", "http://bads.com/") and not hits("||ads.com^", "http://ads.com.org/")
    assert hits("/a/*.cgi|", "http://h/a/b.cgi") and not hits("/a/*.cgi|", "http://h/a/b.cgi?x") and hits("^id=", "http://h/?id=1") and not hits("^id=", "http://h/?sid=1")
    assert hits("|login.", "http://Login.com/") and not hits("|login.", "http://x.login.com/") and hits("/[/]p[/][0-9]+/", "http://h/p/12")
    assert url_filter.pattern_rule("@@x").verdict == "allow" and url_filter.pattern_rule("||ads.com^").tokens == ("ads", "com") and url_filter.pattern_rule("ab*cd.ef").tokens == ()
    assert url_filter.pattern_rule("/wp-login.php^").tokens == ("wp", "login", "php")


@pytest.mark.parametrize("most", [200_000, 0])
def test_thousands_of_rules(spark, monkeypatch, most):
    monkeypatch.setattr(url_filter, "MAX_RULES", most)
    rng = random.Random(9)
    names = ["a", "bb", "c1", "dd", "e", *(f"n{i}" for i in range(400))]
    rules = random_rules(rng, names, 1500)
    urls = [*random_urls(rng, names, 150), None, "", "no scheme", "x://" + "/bb" * 2000, "x://dd/"] + ["x://a.bb/"] * 50
    got = url_filter.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).collect()
    assert len(got) == len(urls)
    for r in got:
        want = best_of_all(rules, urls[r.page_id])
        assert (r.rule or r.pattern, r.verdict) == ((want.name, want.verdict) if want else (None, "allow"))
        assert (r.host, r.path) == url_filter.split_url(urls[r.page_id])[:2]


PAGE = '<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var x="</p>";</script></head><body><nav><ul><li><a href="/a">m</a></li></ul></nav><header class="site">H</header><div class="ad">buy</div><article><h1>Title &amp; {n}</h1><p>One  two<br>three {n}</p><p><b>open<br><p>Four&nbsp;five</p><div class="comments"><p>nice</p></div></article><aside class="sidebar">s</aside><form><input>f</form><footer>&copy; f</footer></body></html>'


@pytest.mark.parametrize("few", [20_000, 0])
def test_html_extraction(spark, monkeypatch, few):
    monkeypatch.setattr(wrappers, "FEW_HOSTS", few)
    pages = [(i, f"http://h{i % 2}.com/x{i}", PAGE.replace("{n}", str(i))) for i in range(12)]
    pages += [(20, None, "<p>alone</p>"), (21, "http://h0.com/", None), (22, "http://h0.com/", ""), (23, "http://other.com/", "plain <b>te</b>xt"), (24, "http://deep.com/", "<div>" * 3000 + "deep" + "</div>" * 3000), (25, "http://cut.com/", "<article><p>a<!-- open"), (26, "http://big.com/", "<article>" + "<p>w x</p>" * 5000 + "</article>"), (None, "http://h1.com/", PAGE)]
    df = spark.createDataFrame([(*p, "x", "y") for p in pages] + [(*pages[0], "x", "y")], "page_id long, url string, html string, host string, text string")
    got = wrappers.extract(df).collect()
    assert len(got) == len(pages) + 1
    by = {r.page_id: r.text for r in got}
    for i in range(12):
        assert by[i] == f"Title & {i}\n\nOne two three {i}\n\nopen\n\nFour five"
    assert (by[20], by[21], by[22], by[23], by[24], by[25]) == ("alone", "", "", "plain text", "deep", "a")
    assert by[26] == "\n\n".join(["w x"] * 5000)
    assert all(r.n_chars == len(r.text) for r in got)


def test_wrappers_generalise(spark):
    a = "<html><body><div id='c'><h1>x</h1><p>1</p></div><div class='foot'>same words</div></body></html>"
    b = "<html><body><div id='c'><h1>y</h1><p>2</p><p>3</p><ul><li>4</li></ul></div><div class='foot'>same words</div></body></html>"
    df = spark.createDataFrame([(i, "http://w.com/", x) for i, x in enumerate([a, b, a.replace(">1<", ">5<")])], "page_id long, url string, html string")
    r = wrappers.wrappers(df).first()
    assert r.wrapper == "<html><body><div c><h1>#</>(<p>#</>)+(<ul><li>=</></>)?</><div foot>=</></></>"
    texts = {x.page_id: x.text for x in wrappers.extract(df).collect()}
    assert texts == {0: "x\n\n1", 1: "y\n\n2\n\n3\n\n4", 2: "x\n\n5"}


@pytest.mark.parametrize("few", [50_000, 0])
def test_warc_round_trip(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(warc, "FEW_GROUPS", few)
    long_ = "".join(random.Random(1).choice("abé\U0001f600\r\n<") for _ in range(300_000))
    pages = [(5, "http://a/", "x" * 200), (3, "http://b/\r\nInjected: 1", "x" * 200), (9, None, "x" * 200), (1, "u", "short"), (2, "u", "short"), (4, "u", None), (6, "u", ""), (7, "u", long_), (8, "u", long_), (10, "u", "WARC/1.1\r\nContent-Length: 3\r\n\r\n0\r\n\r\n" * 9), (None, "u", "y" * 150), (11, "u", "z" * 64000)]
    df = spark.createDataFrame([(*p, "q") for p in pages] + [(*pages[7], "q"), (*pages[0], "q")], "page_id long, url string, html string, digest string")
    got = warc.round_trip(df, (tmp_path / "w").as_uri(), payloads=True).collect()
    assert len(got) == len(pages) + 2 and all(r.intact for r in got)
    for r in got:
        body = next((h or "").encode() for i, _, h in pages if i == r.page_id)
        same = [i for i, _, h in pages if i is not None and (h or "").encode() == body]
        first = min(same) if len(body) >= 100 and same and r.page_id is not None else None
        refers = first if first is not None and first < r.page_id else None
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(body), hashlib.sha256(body).hexdigest(), "response" if refers is None else "revisit", refers)
        assert r.record_type == "revisit" or bytes(r.payload) == body


def test_warc_broken_segments(spark, tmp_path):
    records = list(warc.records_of(1, "u", b"a" * 3000, hashlib.sha256(b"a" * 3000).hexdigest(), None, 1000))
    assert len(records) == 4
    whole = b"".join(r + b"\r\n\r\n" for r in records)
    for name, data in (("whole", whole), ("shuffled", b"".join(r + b"\r\n\r\n" for r in records[::-1])), ("gap", b"".join(r + b"\r\n\r\n" for r in (records[0], records[2], records[3])))):
        (tmp_path / name).mkdir()
        (tmp_path / name / "part-0").write_bytes(data)
    intact = {n: warc.read_archives(spark, str(tmp_path / n)).first().intact for n in ("whole", "shuffled", "gap")}
    assert intact == {"whole": True, "shuffled": True, "gap": False}
    assert warc.unchunked(warc.chunked(b"abc" * 9000)) == b"abc" * 9000 and warc.unchunked(b"5\r\nab") is None and warc.unchunked(b"zz") is None


def test_empty_tables(spark, tmp_path):
    docs = documents(spark, [(1, "x")]).limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    for df in (jaccard.components(docs), jaccard.keep_first(docs), substrings.dedup(docs), merkle.edited(docs), packing.pack(docs, queries.tokenizer_path()), mixing.mix(docs), toxicity.score(docs, labels), url_filter.filter_urls(pages), wrappers.extract(pages), topk.top_k(vectors, F.col("vec_id") % 100 == 0), warc.round_trip(pages, (tmp_path / "none").as_uri())):
        assert df.count() == 0
