"""Source divergence, quality rules and fill-in-middle against plain Python: nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_corpus_operators import vocabulary

from sparkloom.llm import divergence, fim, quality_forest, queries

NAMES = "n string, form string, output string, kept string, reason string, n_words string, item string, value string, rank string, part string, range string, `a.b` string"


def table(spark, rows):
    """rows (doc_id, text, lang, source) with columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, *("x",) * 12) for r in rows], "doc_id long, text string, lang string, source string, " + NAMES)


@pytest.fixture(scope="module")
def rows():
    rng, vocab = random.Random(21), vocabulary(60, 9)
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    out = [(i, prose(rng.randint(1, 60)), rng.choice(["en", "en", "de", None]), rng.choice(["a", "a", "a", "b", "c", "d", None])) for i in range(120)]
    out += [(200, None, None, None), (201, "", "en", "e"), (202, " \t\n\x0b\x0c\r ", "en", "f"), (203, prose(20_000), "de", "b"), (None, prose(30), "en", "a"), (None, None, "xx", "y")]
    out += [(210, "ÄÖ äö Ünïcode x y z w 漢字 \U0001f600ab", "en", "a"), (211, "a1b2 A_b [c] {d}", "de", "g"), (212, "12 34 !?", "zz", "only"), (213, "lone", "zz", "other"), (214, "\x00a\x00 b", "en", "a")]
    out += [(220, "text with <P> in it", "en", "a"), (221, "a < b <P d S> e <M", "en", "a"), (222, "  lead", "en", "a"), (223, "trail \n", "en", "a"), (224, "x" * 5000, "en", "a"), (225, " " * 3000, "en", "a")]
    return [*out, out[3], out[3], out[123]]


UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain_fim(key, text):
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    h = hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()
    h = [int(h[i : i + 8], 16) for i in (0, 8, 16, 24)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return key, n, "plain", None, None, text
    if h[3] % 100 < 80:
        return key, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return key, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fim_is_the_plain_definition(spark, rows):
    many = [(1000 * k + (i or 0), *r[1:]) for k in range(3) for i, r in enumerate(rows)] + rows
    df = fim.fim(table(spark, many))
    got = [tuple(r) for r in df.withColumn("back", fim.restored(F.col("form"), F.col("output"))).collect()]
    assert sorted(map(repr, got)) == sorted(repr((*plain_fim(k, t), t or "")) for k, t, *_ in many)
    assert {r[2] for r in got} == {"plain", "spm", "psm"}


def test_fim_with_other_ids_and_shares(spark):
    df = spark.createDataFrame([(f"k{i}", "one two three") for i in range(40)], "name string, body string")
    got = fim.fim(df, "name", "body", rate=100, spm=0, sentinels=("[p]", "[s]", "[m]"))
    assert {r.form for r in got.collect()} == {"psm"} and got.columns[0] == "name"
    back = got.select(fim.restored(F.col("form"), F.col("output"), ("[p]", "[s]", "[m]")).alias("t")).distinct().collect()
    assert [r.t for r in back] == ["one two three"]


def test_events_agree_with_the_pattern():
    rng, events = random.Random(5), fim.Events()
    for _ in range(500):
        t = "".join(rng.choice(" \n\t\x0babé \U0001f600<P>S") for _ in range(rng.randint(0, 40)))
        ends, sentinel = events(t)
        assert ends.tolist() == [m.end() for m in UNIT.finditer(t)], t
        assert sentinel == any(x in t for x in fim.SENTINELS)


def plain_statistics(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    runs = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if runs[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    ascii_ = lambda low, high: sum(low <= c <= high for c in text)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), len(lines), sum(a == b for a, b in zip(w, w[1:], strict=False)), len(set(w)), ascii_("A", "Z"), ascii_("0", "9")


def test_statistics_are_the_plain_ones(rows):
    rng = random.Random(2)
    texts = [t for _, t, *_ in rows]
    texts += ["".join(rng.choice(["a ", "b ", "c\n", "#", "é|", "\n", "\r\n", "X1 "]) for _ in range(rng.randint(0, 120))) for _ in range(200)]
    texts += ["a b c d e f g h " * 3, "a a a a a a a a a", "x\nx\r\nx\nx", "\n\n", "x\n\nx"]
    got = quality_forest.statistics(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        assert tuple(int(got[k][i]) for k in quality_forest.COUNTS) == plain_statistics(t), repr(t)


def test_forest_steps_are_path_lengths():
    """The steps against trees walked split by split, drawn in the same order."""
    values = np.round(np.random.default_rng(4).exponential(size=300), 2)
    forest = quality_forest.grown(values, np.random.default_rng(7), trees=5, drawn=64)
    rng, trees = np.random.default_rng(7), []

    def tree(held, depth):
        if depth < 6 and len(held) > 1 and held[-1] > held[0]:
            place = rng.uniform(held[0], held[-1])
            left = [x for x in held if x < place]
            if 0 < len(left) < len(held):
                low = tree(left, depth + 1)
                return place, low, tree(held[len(left) :], depth + 1)
        n = len(held)
        return depth + (0 if n < 2 else 1 if n == 2 else 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n)

    def path(t, x):
        return path(t[1] if x < t[0] else t[2], x) if isinstance(t, tuple) else t

    for _ in range(5):
        trees.append(tree(sorted(rng.choice(values, 64, replace=False)), 0))
    look = np.r_[values, -1.0, 99.0]
    assert np.allclose(forest.paths(look), [np.mean([path(t, x) for t in trees]) for x in look])


def test_quality_rules_on_odd_input(spark, rows):
    rng, vocab = random.Random(3), vocabulary(300, 4)
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    good = [(i, prose(rng.randint(25, 200)), "en", "a") for i in range(1000, 1200)]
    junk = [(i, prose(60).replace(" ", "### ", 30), "en", "a") for i in range(1200, 1230)]
    every = rows + good + junk
    labels = [(i, int(i < 1200)) for i, *_ in good + junk if i % 2] + [(None, 1), (9999, 0), (1001, None), (1003, 7), (3, 1)]
    labels = spark.createDataFrame(labels, "doc_id long, quality int")
    got = sorted((tuple(r) for r in quality_forest.judged(table(spark, every), labels).collect()), key=repr)
    assert [r[:11] for r in got] == sorted(((i, *plain_statistics(t)) for i, t, *_ in every), key=repr)
    for r in got:
        failed = r[1] < 20 or 100 * r[5] > 30 * r[1]
        assert r[11] == failed and (not failed or (not r[12] and r[13] == "base")) and r[12] == (r[13] is None)
    assert not any(r[12] for r in got if r[0] in range(1200, 1230)) and all(r[12] for r in got if r[0] in range(1000, 1200))
    again = sorted((tuple(r) for r in quality_forest.judged(table(spark, every).repartition(7), labels.repartition(5)).collect()), key=repr)
    assert again == got
    without = quality_forest.judged(table(spark, every), labels.where("quality = 1")).collect()
    assert all(r.kept != r.base_failed for r in without)


def test_quality_rules_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("the test tables aren't here")
    docs, labels = (queries.table(spark, folder, n) for n in ("documents", "labels"))
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    label = {r.doc_id: r.quality for r in labels.collect()}
    learnt = labels.where(~F.col("doc_id").isin([i for i in label if held(i)]))
    kept = {r.doc_id: r.kept for r in quality_forest.judged(docs, learnt).collect() if not r.base_failed and held(r.doc_id)}
    good, bad = ([kept[i] for i in kept if label.get(i) == q] for q in (1, 0))
    assert good and bad and sum(good) >= 0.98 * len(good) and sum(bad) <= 0.1 * len(bad)


def plain_audit(rows, least, top):
    rows = [(i, t or "", lang or "", source or "") for i, (_, t, lang, source) in enumerate(rows)]
    n, docs, by_lang = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, t, lang, source in rows:
        by_lang[lang].add(source)
        terms = [x.translate({i: i + 32 for i in range(65, 91)}) for x in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t)]
        n[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang, sources in by_lang.items():
        kept = sorted(t for t, k in docs[lang].items() if k >= least)
        v = len(kept)
        whole = Counter()
        for s in sources:
            whole.update({t: n[lang, s][t] for t in kept})
        share = lambda c: {t: 1 + 1_000_000_000 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * v) for t in kept}
        p, q = {s: share(n[lang, s]) for s in sources}, share(whole)
        for s in sources:
            pairs = sorted(((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in sources if o != s))
            terms = sorted((q[t] - p[s][t], t.encode()) for t in kept if n[lang, s][t] and p[s][t] > q[t])[:top]
            for part, found in (("pair", pairs), ("term", terms)):
                out += [(lang, s, part, x.decode(), -value, k) for k, (value, x) in enumerate(found, 1)]
    return sorted(out)


def test_audit_is_the_plain_one(spark, rows):
    got = sorted(tuple(r) for r in divergence.audit(table(spark, rows), least=5, top=7).collect())
    assert got == plain_audit(rows, 5, 7)
    assert any(r[2] == "term" for r in got) and any(r[:2] == ("zz", "only") for r in got)


def test_audit_in_small_pieces(spark, rows, monkeypatch):
    """Many ranges, blocks, pieces and flushes; hot sources; equal values."""
    for name, x in {"BLOCK": 2, "PIECE": 3, "COUNTERS": 50, "HELD_SUMS": 1, "SLICE": 300, "SAMPLE": 1.0, "RANGE_TERMS": 4, "PIECES_AT_ONCE": 2}.items():
        monkeypatch.setattr(divergence, name, x)
    df = table(spark, rows).repartition(5)
    assert len(divergence.limits(divergence._rows(df, "text", "lang", "source"))) > 10
    got = sorted(tuple(r) for r in divergence.audit(df, least=2, top=4).collect())
    assert got == plain_audit(rows, 2, 4)


def test_tries_merge_and_keep_their_order():
    rng = random.Random(6)
    terms = sorted({"".join(rng.choice("abé漢") for _ in range(rng.randint(1, 6))).encode() for _ in range(400)} | {b"x" * 9000, b"x" * 9001, b"x"})
    parts = []
    for _ in range(3):
        some = rng.sample(terms, 150)
        parts.append((pa.array(some, pa.large_binary()), np.arange(150), np.zeros(150, np.int64), np.ones(150, np.int64)))
    trie = divergence.Trie.merged([parts[0], divergence.Trie.merged(parts[1:])])
    found = Counter(t for p in parts for t in p[0].to_pylist())
    assert trie.terms.to_pylist() == sorted(found) and trie.count.tolist() == [found[t] for t in sorted(found)]
    at = trie.limits([b"ab", b"b", "漢".encode()])
    pieces = [divergence.leaves(*trie.edges(a, b)).to_pylist() for a, b in zip(at, at[1:], strict=False)]
    assert sum(pieces, []) == sorted(found) and all(t < b"ab" for t in pieces[0]) and all(t >= "漢".encode() for t in pieces[-1])


def test_shares_are_exact():
    counts = np.array([0, 1, 7, 10**12, 8 * 10**15], np.int64)
    for total in (7, 10**9 + 7, 9 * 10**15):
        held = counts[counts <= total]  # a share is 1 at most
        assert divergence.divided(held, np.array(total)).tolist() == [1 + 10**9 * int(c) // total for c in held]


def test_empty_tables(spark):
    docs, labels = table(spark, []), spark.createDataFrame([], "doc_id long, quality int")
    assert divergence.audit(docs).count() == quality_forest.judged(docs, labels).count() == fim.fim(docs).count() == 0

