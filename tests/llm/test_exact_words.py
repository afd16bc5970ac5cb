"""Words and their runs are told apart by bytes: texts that cancel out in polynomial hashes, hot passages, rows without ids."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from test_corpus_operators import brute_components, brute_dedup, documents, vocabulary

from sparkloom.llm import jaccard, packing, queries, substrings, toxicity, words


def twins(rounds=10, one="a", other="b"):
    """The two Thue-Morse words of 2**rounds letters: equal under every polynomial hash modulo 2**64."""
    for _ in range(rounds):
        one, other = one + other, other + one
    return one, other


A, B = twins()


def test_run_hashes():
    values = np.random.default_rng(1).integers(0, 1 << 63, 300, dtype=np.uint64)
    for k in (1, 2, 3, 7, 8, 31, 50):
        whole = words.run_hashes(values, k)
        assert len(whole) == 301 - k and len({*whole.tolist()}) == len(whole)
        assert all(whole[i] == words.run_hashes(values[i : i + k], k)[0] for i in range(0, 301 - k, 17))
    assert len(words.run_hashes(values, 301)) == 0
    lane0, lane1 = words.Words(pa.array([f"{A} {B}"])).digests()
    assert lane0[0] != lane0[1] and lane1[0] != lane1[1]
    # the twins as sequences of words, too
    ones = [words.run_hashes(words.Words(pa.array([" ".join(x)])).digests()[0], 1024)[0] for x in twins(10, "ab", "cd") if True]
    assert len({*map(int, ones)}) == 2


def test_distinct():
    code, known = words.Words(pa.array(["b a", None, "", "a\tc a"])).coded()
    assert [known[i] for i in code] == [b"b", b"a", b"a", b"c", b"a"] and sorted(known) == [b"a", b"b", b"c"]
    assert words.Words(pa.array([], pa.string())).coded()[1] == []


def test_jaccard_tells_twins_apart(spark):
    rows = [(1, f"one {A} two three four"), (2, f"one {B} two three four"), (3, f"{A} " * 3), (4, f"{B} " * 3), (5, A), (6, B), (7, A)]
    rows += [(10 + i, " ".join([*(f"w{j}" for j in range(200)), x])) for i, x in enumerate((A, B))]
    for k, percent in ((4, 85), (1, 60)):
        got = sorted((tuple(r) for r in jaccard.components(documents(spark, rows), k=k, percent=percent).collect()), key=repr)
        assert got == brute_components(rows, k, percent)


def test_packing_tells_twins_apart(spark):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    tokenizer = Tokenizer.from_file(path)
    texts = [A, B, f"x {A}! {B}, {A}", f"x {B}! {A}, {B}"]
    want = [np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes() for t in texts]
    assert packing.Encoder(path).encode(texts) == want


def rows_of(result):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in result.collect()), key=repr)


@pytest.mark.parametrize("most", [substrings.MOST_SUFFIXES, 1])
def test_substrings_tell_twins_apart(spark, most):
    rng = random.Random(4)
    line = [f"w{i}" for i in range(49)]
    rows = [(1, " ".join([*line, A])), (2, " ".join([*line, B])), (3, " ".join(["x", *line, B, "y"])), (4, " ".join(rng.choice((A, B)) for _ in range(200))), (5, " ".join([A] * 60)), (6, " ".join([B] * 60)), (7, " ".join([A] * 120))]
    assert rows_of(substrings.dedup(documents(spark, rows), most_suffixes=most)) == brute_dedup(rows, 50)


@pytest.mark.parametrize(("most", "window", "seed"), [(1 << 14, 50, 8), (3, 50, 8), (3, 12, 4), (1, 5, 5)])
def test_a_passage_in_all_documents(spark, monkeypatch, most, window, seed):
    monkeypatch.setattr(substrings, "HELD", 500)
    monkeypatch.setattr(substrings, "GROUP", 64)
    rng, vocab = random.Random(5), vocabulary(300, 2)
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passage, short = prose(70), prose(30)
    rows = [(i, f"{prose(rng.randint(0, 30))} {passage} {prose(rng.randint(0, 20))} {short} {prose(9)}") for i in range(60)]
    rows += [(None, rows[0][1])] * 4 + [(None, None), (None, "")] + [(7, rows[3][1]), (60, passage), (61, passage), (-5, passage)]
    assert rows_of(substrings.dedup(documents(spark, rows), window=window, seed=seed, most_suffixes=most)) == brute_dedup(rows, window)


def test_substring_ids_have_to_be_integers(spark):
    with pytest.raises(TypeError):
        substrings.dedup(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def brute_logit(net, x, window):
    """A forward pass of one window in plain loops."""
    h, p = toxicity.HIDDEN, {k: v.astype(float) for k, v in net.p.items()}
    s = lambda z: 1 / (1 + np.exp(-z))
    inputs = []
    for w in window:
        if w < len(x.word):
            rows = x.chars[x.limits[w] : x.limits[w + 1]]
            inputs.append(np.r_[p["word"][x.word[w]], sum(p["char"][r] for r in rows) / len(rows)])
    states = []
    for way in "fb":
        state, found = np.zeros(h), []
        for v in inputs if way == "f" else inputs[::-1]:
            a, g = v @ p["x" + way] + p["c" + way], state @ p["h" + way]
            z, r = s(a[:h] + g[:h]), s(a[h : 2 * h] + g[h : 2 * h])
            n = np.tanh(a[2 * h :] + r * g[2 * h :])
            state = (1 - z) * n + z * state
            found.append(state)
        states.append(found if way == "f" else found[::-1])
    both = [np.r_[a, b] for a, b in zip(*states, strict=True)]
    e = np.array([np.tanh(b @ p["wa"] + p["ba"]) @ p["va"] for b in both])
    a = np.exp(e - e.max())
    return sum(w * b for w, b in zip(a / a.sum(), both, strict=True)) @ p["wo"] + p["bo"][0]


def test_network_against_plain_loops():
    texts = ["One two,three! two", "x" * 40 + " \u00e9t\u00e9 fin", "a b c d e f g h i j k", "...", ""]
    x, net = toxicity.Inputs(pa.array(texts)), toxicity.Network(3)
    assert [x.known[i] for i in x.word_of[: x.counts[0]]] == [b"one", b"two", b"three", b"two"]
    windows, text = x.windows(6, 3)
    got = net.logits(net.vectors(x), windows)
    assert np.allclose(got, [brute_logit(net, x, w) for w in windows], atol=1e-4)
    found = toxicity.evidence(got, text, len(texts))
    for i in range(len(texts)):
        own = sorted(got[text == i].tolist(), reverse=True)
        want = [own[0], np.mean(own[: toxicity.TOP]), np.mean(own)] if own else [toxicity.FLOOR] * 3
        assert np.allclose(found[i], want, atol=1e-5)
    assert {*text.tolist()} == {0, 1, 2}


def test_inputs_of_many_texts_are_those_of_all():
    rng, vocab = random.Random(1), vocabulary(50, 3)
    texts = [" ".join(rng.choice(vocab) for _ in range(rng.randint(0, 40))) for _ in range(30)]
    a, b = toxicity.Inputs(pa.array(texts, pa.large_string())), toxicity.Inputs.of(texts, 100)
    assert [a.known[i] for i in a.word_of] == [b.known[i] for i in b.word_of]
    net = toxicity.Network(1)
    assert np.allclose(net.vectors(a)[a.word_of], net.vectors(b)[b.word_of])


def test_sample_is_bounded_by_whole_documents(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 1000)
    rows = [(i, "w" * (10 if i % 3 else 900)) for i in range(1, 200)] + [(1, "v"), (2, None)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 300)], "doc_id long, toxic int")
    got = toxicity.training_rows(documents(spark, rows), labels)
    assert {y for _, _, y, _ in got} == {0, 1} and len({k for k, *_ in got}) == len(got)
    for kind in (0, 1):
        assert 0 < sum(len(t) for _, t, y, _ in got if y == kind) <= 1000
    assert all(t == ("v" if k == 1 else "" if k == 2 else "w" * len(t)) and len(t) in (0, 1, 10, 900) for k, t, _, _ in got)
    assert hashlib.sha256(repr(got).encode()).digest() == hashlib.sha256(repr(toxicity.training_rows(documents(spark, rows), labels)).encode()).digest()
