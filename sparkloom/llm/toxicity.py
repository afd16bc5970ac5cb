"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A word is a run of letters, digits and bytes beyond ASCII. It enters as two
vectors, one by the whole word and one by the mean over its characters' rows (its
beginnings of several lengths, its ending, all its inner runs of ``INNER`` bytes),
both from hashed tables. Windows of ``WINDOW`` words start every ``STRIDE`` words and
cover all of a text; in each, a GRU runs both ways, attention weighs its states, and
the weighted state gives a logit. A document's evidence (the highest logit, the mean
of the ``TOP`` highest, the mean of all) becomes a score by a logistic curve.

The network is fitted in one task, on a bounded sample of labelled documents:
``MAX_TOXIC`` and ``MAX_CLEAN`` of them, by order of a hash of their ids, and of each
kind no more than ``SAMPLE_BYTES``; a document that doesn't fit any more is passed
over whole. Documents with crc32(doc_id as text) mod 5 = 0 are never learned from.
The curve is cross-fitted: two networks learn from a half each, and the evidence they
give for the other half sets the curve of the network that learned from both. Of a
toxic document, its ``TOXIC_WINDOWS`` most suspect windows count as toxic (fewer of a
short one); of a clean one the ``CLEAN_WINDOWS`` most suspect and a share
``CLEAN_SHARE`` of the others are learned. Scoring covers every document and window.

Results for odd input: null and empty texts have no window and take the lowest
logit; a null id is not held out and has no label; labels that are null, or that
differ among repeated rows of an id, are left out; of an id with several texts the
shortest is learned from; without labels of both kinds every score is 0; repeated
rows have equal scores; extra columns are left out (:func:`with_score` keeps them,
and takes a free name where they hold a ``score``).
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import released, unused
from .words import U, Words, mix, ranges, slices

WINDOW, STRIDE = 32, 16
MAX_TOXIC, MAX_CLEAN, SAMPLE_BYTES = 1500, 2500, 16 << 20
TOXIC_WINDOWS, CLEAN_WINDOWS, CLEAN_SHARE = 3, 3, 0.03
ROWS = 1 << 16
WIDTH, HIDDEN, ATTENTION = 6, 8, 8
PREFIXES, INNER = (2, 3, 4, 5, 6, 8), 5
EPOCHS, BATCH, RATE, TABLE_RATE = 2, 128, 0.005, 0.05
#: The logit of a text without windows; how many windows count besides the highest and all; what holds the curve's weights small.
FLOOR, TOP, RIDGE = -12.0, 4, 1.0
#: Bytes of words: digits, letters and all beyond ASCII.
_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def _char_rows(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of words by their beginnings, their ending and all their runs of INNER bytes, word by word; and how many each has."""
    size = np.array(list(map(len, words)), np.int64)
    end = np.cumsum(size)
    start = end - size
    data = np.frombuffer(b"".join(words) + bytes(8), np.uint8).astype(np.uint64)
    run = data[: len(data) - 7].copy()  # eight bytes from each place, then fewer
    for j in range(1, 8):
        run |= data[j : len(data) - 7 + j] << U(8 * j)
    row = lambda at, n, kind: (mix((run[at] & U((1 << 8 * n) - 1)) * U(257) + U(1000 * kind + n)) % U(ROWS)).astype(np.int32)
    word, rows = [], []
    for n in PREFIXES:
        there = np.flatnonzero(size >= n)
        word.append(there)
        rows.append(row(start[there], n, 1))
    tail = np.minimum(size, 4)
    word.append(np.arange(len(size)))
    rows.append(np.where(tail == 4, row(end - tail, 4, 2), row(start, 3, 2)).astype(np.int32))
    many = np.maximum(size - INNER, 0)
    word.append(np.repeat(np.arange(len(size)), many))
    rows.append(row(ranges(start + 1, many), INNER, 3))
    word = np.concatenate(word)
    return np.concatenate(rows)[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(size))


class Inputs:
    """Words of texts as indices into two tables: one row by word, several by its characters (those of word i: chars[limits[i] : limits[i + 1]])."""

    def __init__(self, texts: pa.Array):
        w = Words(texts, lower=True, letters=_LETTERS)
        self.word_of, self.known = w.coded()
        self.counts, self.first = w.counts, w.first
        self._rows()

    def _rows(self, block: int = 1 << 15) -> None:
        """Table rows of the distinct words, a block of them at a time."""
        parts = [_char_rows(self.known[i : i + block]) for i in range(0, len(self.known), block)]
        self.chars = np.concatenate([np.zeros(0, np.int32), *(p[0] for p in parts)])
        self.limits = np.r_[0, np.cumsum(np.concatenate([np.zeros(0, np.int64), *(p[1] for p in parts)]))]
        self.word = (np.fromiter(map(zlib.crc32, self.known), np.int64, len(self.known)) % ROWS).astype(np.int32)

    @classmethod
    def of(cls, texts: list[str], chars: int = 1 << 19) -> Inputs:
        """The same for many texts, with the memory of a part of them."""
        words, first, total = [], 0, 0
        numbers: dict[bytes, int] = {}
        counts = []
        for i, t in enumerate(texts):
            total += len(t)
            if total > chars or i == len(texts) - 1:
                w = Words(pa.array(texts[first : i + 1], pa.large_string()), lower=True, letters=_LETTERS)
                code, known = w.coded()
                words.append(np.array([numbers.setdefault(k, len(numbers)) for k in known], np.int64)[code])
                counts.append(w.counts)
                first, total = i + 1, 0
        out = cls.__new__(cls)
        out.word_of, out.known, out.counts = np.concatenate(words), list(numbers), np.concatenate(counts)
        out.first = np.r_[0, np.cumsum(out.counts)]
        out._rows()
        return out

    def part(self, words: np.ndarray) -> Inputs:
        """The table rows of some of the distinct words."""
        out = Inputs.__new__(Inputs)
        size = np.diff(self.limits)[words]
        out.word, out.chars, out.limits = self.word[words], self.chars[ranges(self.limits[words], size)], np.r_[0, np.cumsum(size)]
        return out

    def mean(self, table: np.ndarray, block: int = 1 << 14) -> Iterator[tuple[slice, np.ndarray]]:
        """The mean of each word's rows of a table, a block of words at a time; every word has a row at least."""
        for i in range(0, len(self.word), block):
            limits = self.limits[i : i + block + 1]
            values = table[self.chars[limits[0] : limits[-1]]]
            yield slice(i, i + len(limits) - 1), np.add.reduceat(values, limits[:-1] - limits[0]) / np.diff(limits)[:, None]

    def windows(self, size: int = WINDOW, stride: int = STRIDE, block: int = 8192) -> tuple[np.ndarray, np.ndarray]:
        """Indices into the distinct words, (windows, size), padded by their number; and the text of each window."""
        n = self.counts
        many = np.where(n == 0, 0, np.where(n <= size, 1, 1 + -(-(n - size) // stride)))
        text = np.repeat(np.arange(len(n)), many)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
        start = self.first[:-1][text] + np.minimum(nth * stride, np.maximum(n[text] - size, 0))
        words = np.append(self.word_of, len(self.word)).astype(np.int32)
        out = np.empty((len(text), size), np.int32)
        for i in range(0, len(text), block):
            at = start[i : i + block, None] + np.arange(size)
            inside = at < self.first[1:][text[i : i + block]][:, None]
            out[i : i + block] = np.where(inside, words[np.where(inside, at, len(self.word_of))], len(self.word))
        return out, text


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


class Network:
    """Parameters p: word and char tables, GRU matrices for both ways (x: inputs, h: states, order z r n), attention and output."""

    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)
        f = lambda *s, scale=0.3: (r.standard_normal(s) * scale).astype(np.float32)
        self.p = {"word": f(ROWS, WIDTH, scale=0.05), "char": f(ROWS, WIDTH, scale=0.05)}
        for way in "fb":
            self.p |= {f"x{way}": f(2 * WIDTH, 3 * HIDDEN), f"h{way}": f(HIDDEN, 3 * HIDDEN), f"c{way}": np.zeros(3 * HIDDEN, np.float32)}
        self.p |= {"wa": f(2 * HIDDEN, ATTENTION), "ba": np.zeros(ATTENTION, np.float32), "va": f(ATTENTION), "wo": f(2 * HIDDEN), "bo": np.zeros(1, np.float32)}
        #: weights of a document's evidence, and the shift
        self.curve = np.array([1.0, 0.0, 0.0, 0.0])

    def vectors(self, x: Inputs) -> np.ndarray:
        """Input vectors of distinct words."""
        out = np.empty((len(x.word), 2 * WIDTH), np.float32)
        out[:, :WIDTH] = self.p["word"][x.word]
        for at, mean in x.mean(self.p["char"]):
            out[at, WIDTH:] = mean
        return out

    def _run(self, proj: np.ndarray, mask: np.ndarray, way: str, keep: list | None) -> np.ndarray:
        """States of one way; proj (steps, batch, 3 hidden) in that way's order."""
        h = np.zeros((proj.shape[1], HIDDEN), np.float32)
        u, out = self.p["h" + way], np.empty((*proj.shape[:2], HIDDEN), np.float32)
        for t in range(len(proj)):
            g = h @ u
            a = sigmoid(proj[t, :, : 2 * HIDDEN] + g[:, : 2 * HIDDEN])
            z, r = a[:, :HIDDEN], a[:, HIDDEN:]
            n = np.tanh(proj[t, :, 2 * HIDDEN :] + r * g[:, 2 * HIDDEN :])
            new = np.where(mask[t][:, None], n + z * (h - n), h)
            if keep is not None:
                keep.append((h, z, r, n, g[:, 2 * HIDDEN :]))
            out[t] = h = new
        return out

    def tables(self, vectors: np.ndarray) -> dict[str, np.ndarray]:
        """What each distinct word adds to the gates, by way, and a row of zeros for no word."""
        out = {}
        for way in "fb":
            out[way] = np.zeros((len(vectors) + 1, 3 * HIDDEN), vectors.dtype)
            out[way][:-1] = vectors @ self.p["x" + way] + self.p["c" + way]
        return out

    def logits(self, vectors: np.ndarray, windows: np.ndarray, keep: dict | None = None, tables: dict | None = None) -> np.ndarray:
        """Logit of each window; vectors of distinct words, windows of indices into them (their number: no word)."""
        p, none = self.p, len(vectors)
        tables = tables or self.tables(vectors)
        index = windows.T  # steps first
        mask = index < none
        states = []
        for way in "fb":
            order = slice(None) if way == "f" else slice(None, None, -1)
            cells = [] if keep is not None else None
            states.append(self._run(tables[way][index[order]], mask[order], way, cells)[order])
            if keep is not None:
                keep[way] = cells
        s = np.concatenate(states, 2)
        q = np.tanh(s @ p["wa"] + p["ba"])
        e = np.where(mask, q @ p["va"], -1e9)
        a = np.exp(e - e.max(0))
        a /= a.sum(0)
        c = (a[..., None] * s).sum(0)
        if keep is not None:
            keep |= {"s": s, "q": q, "a": a, "c": c, "mask": mask}
        return c @ p["wo"] + p["bo"][0]

    def gradients(self, x: Inputs, vectors: np.ndarray, windows: np.ndarray, wanted: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Of the weighted logistic loss, by parameter; tables as (rows, gradients)."""
        p, keep = self.p, {}
        out = self.logits(vectors, windows, keep)
        d = ((sigmoid(out) - wanted) * weight / weight.sum()).astype(np.float32)
        g = {"bo": np.array([d.sum()]), "wo": keep["c"].T @ d}
        dc = d[:, None] * p["wo"]
        s, q, a, mask = keep["s"], keep["q"], keep["a"], keep["mask"]
        ds = a[..., None] * dc
        da = (s * dc).sum(2)
        de = a * (da - (a * da).sum(0))
        dq = de[..., None] * p["va"] * (1 - q * q)
        g |= {"va": (q * de[..., None]).sum((0, 1)), "ba": dq.sum((0, 1)), "wa": np.einsum("tbi,tbj->ij", s, dq)}
        ds = ds + dq @ p["wa"].T
        index = windows.T
        dv = np.zeros((len(vectors) + 1, 2 * WIDTH), np.float32)
        padded = np.vstack([vectors, np.zeros((1, 2 * WIDTH), np.float32)])
        for k, way in enumerate("fb"):
            order = slice(None) if way == "f" else slice(None, None, -1)
            dstate, at, m = ds[..., k * HIDDEN : (k + 1) * HIDDEN][order], index[order], mask[order]
            du, dx, dbias = np.zeros_like(p["h" + way]), np.zeros_like(p["x" + way]), np.zeros(3 * HIDDEN, np.float32)
            dh = np.zeros_like(dstate[0])
            for t in range(len(at) - 1, -1, -1):
                h, z, r, n, gn = keep[way][t]
                total = dh + dstate[t]
                live = total * m[t][:, None]
                dn = live * (1 - z) * (1 - n * n)
                dz = live * (h - n) * z * (1 - z)
                dr = dn * gn * r * (1 - r)
                pre = np.concatenate([dz, dr, dn], 1)
                rec = np.concatenate([dz, dr, dn * r], 1)
                du += h.T @ rec
                dh = total - live + live * z + rec @ p["h" + way].T
                dx += padded[at[t]].T @ pre
                dbias += pre.sum(0)
                np.add.at(dv, at[t], pre @ p["x" + way].T)
            g |= {"h" + way: du, "x" + way: dx, "c" + way: dbias}
        used = np.flatnonzero(np.abs(dv[:-1]).sum(1))
        dv = dv[used]
        g["word"] = (x.word[used], dv[:, :WIDTH])
        size = np.diff(x.limits)[used]
        g["char"] = (x.chars[ranges(x.limits[used], size)], np.repeat(dv[:, WIDTH:] / size[:, None], size, axis=0))
        return g


def _unique(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x


def _odds(word_of: np.ndarray, text_of_word: np.ndarray, toxic: np.ndarray, rows: np.ndarray, limits: np.ndarray, block: int = 1 << 17) -> np.ndarray:
    """Shrunk log-odds of toxic documents by table row; the rows of distinct word i are rows[limits[i] : limits[i + 1]].

    A row counts once in a text; texts come in order, about ``block`` words at a time.
    """
    words = len(limits) - 1
    seen, bad = np.zeros(ROWS), np.zeros(ROWS)
    start = 0
    while start < len(word_of):
        end = int(np.searchsorted(text_of_word, text_of_word[min(start + block, len(word_of)) - 1], "right"))
        text, word = np.divmod(_unique(text_of_word[start:end] * words + word_of[start:end]), words)
        size = np.diff(limits)[word]
        text, row = np.divmod(_unique(np.repeat(text, size) * ROWS + rows[ranges(limits[word], size)]), ROWS)
        seen += np.bincount(row, minlength=ROWS)
        bad += np.bincount(row, toxic[text], ROWS)
        start = end
    rate = toxic[np.unique(text_of_word)].mean()
    odds = np.log((bad + 4 * rate) / (seen + 4) / rate) - np.log((seen - bad + 4 * (1 - rate)) / (seen + 4) / (1 - rate))
    return np.clip(odds * seen / (seen + 3), -2, 4).astype(np.float32)


def fit(texts: list[str], toxic: list[int], half: list[bool], seed: int = 5) -> Network | None:
    """A network that learned from all texts, with a curve set by networks that learned from the other half; None without both kinds of text."""
    y, half = np.array(toxic, np.float32), np.array(half, bool)
    if len({*y}) < 2:
        return None
    x = Inputs.of(texts)
    x.known = []  # the words' bytes are needed no more
    windows, text = x.windows()
    net = learn(x, windows, text, y, np.ones(len(y), bool), seed)
    own = np.zeros((len(y), 3))
    for side in (False, True):
        others, here = half != side, half == side
        # where a half holds one kind only, the network itself has to do
        judge = learn(x, windows, text, y, others, seed) if len({*y[others]}) == 2 else net
        use = here[text]
        number = np.cumsum(here) - 1
        own[here] = evidence(_scored_apart(judge, x, windows[use]), number[text[use]], int(here.sum()))
    net.curve = _curve(own, y)
    return net


def learn(x: Inputs, windows: np.ndarray, text: np.ndarray, y: np.ndarray, of: np.ndarray, seed: int = 5) -> Network:
    """A network that learned from the texts in ``of``."""
    net, rng = Network(seed), np.random.default_rng(seed)
    text_of_word = np.repeat(np.arange(len(y)), x.counts)
    known = of[text_of_word]
    # a first guess in one column of each table; the rest is learned
    word_odds = _odds(x.word_of[known], text_of_word[known], y, x.word, np.arange(len(x.word) + 1))
    char_odds = _odds(x.word_of[known], text_of_word[known], y, x.chars, x.limits)
    net.p["word"][:, 0], net.p["char"][:, 0] = word_odds / 2, char_odds / 2
    of_word = np.append(word_odds[x.word] + np.maximum.reduceat(char_odds[x.chars], x.limits[:-1]), -9).astype(np.float32)
    suspicion = np.concatenate([of_word[windows[i : i + 4096]].max(1) for i in range(0, len(windows), 4096)])
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    step = 0
    usable = of[text]
    for epoch in range(EPOCHS):
        if epoch:
            suspicion = np.full(len(windows), -99.0)
            suspicion[usable] = _scored_apart(net, x, windows[usable])
        order = np.lexsort((-suspicion, text))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order)) - np.searchsorted(text[order], text[order])
        size = np.bincount(text, minlength=len(y))
        bad = usable & (y[text] == 1) & (rank < np.maximum(1, np.minimum(TOXIC_WINDOWS, size[text] // 6)))
        clean = usable & (y[text] == 0) & ((rank < CLEAN_WINDOWS) | (rng.random(len(text)) < CLEAN_SHARE))
        chosen = rng.permutation(np.flatnonzero(bad | clean))
        balance = max(1.0, clean.sum() / max(1, bad.sum()) / 3)
        for i in range(0, len(chosen), BATCH):
            at = chosen[i : i + BATCH]
            local, inverse = np.unique(windows[at], return_inverse=True)
            part = x.part(local[local < len(x.word)])
            g = net.gradients(part, net.vectors(part), inverse.reshape(len(at), -1), y[text[at]], np.where(y[text[at]] == 1, balance, 1.0))
            step += 1
            for k, d in g.items():
                first, second = moments[k]
                if isinstance(d, tuple):
                    order = np.argsort(d[0], kind="stable")
                    first_of = np.flatnonzero(np.r_[True, np.diff(d[0][order]) != 0])
                    rows, total = d[0][order][first_of], np.add.reduceat(d[1][order], first_of)
                    second[rows] += total**2
                    net.p[k][rows] -= TABLE_RATE * total / (np.sqrt(second[rows]) + 1e-6)
                else:
                    first[:] = 0.9 * first + 0.1 * d
                    second[:] = 0.999 * second + 0.001 * d * d
                    net.p[k] -= (RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def _curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights and shift of a logistic curve by Newton steps, with targets drawn in a little and weights held small (so that they stay finite)."""
    good, bad = (y == 0).sum(), (y == 1).sum()
    t = np.where(y == 1, (bad + 1) / (bad + 2), 1 / (good + 2))
    x = np.column_stack([x, np.ones(len(x))]).astype(np.float64)
    w = np.zeros(x.shape[1])
    w[0] = 0.5
    ridge = np.r_[np.full(len(w) - 1, RIDGE), 1e-4]
    for _ in range(60):
        s = sigmoid(x @ w)
        hess = x.T @ (x * (s * (1 - s))[:, None]) + np.diag(ridge)
        w -= np.clip(np.linalg.solve(hess, x.T @ (s - t) + ridge * w), -0.5, 0.5)
    return w


def _scored(net: Network, vectors: np.ndarray, windows: np.ndarray, block: int = 2048) -> np.ndarray:
    tables = net.tables(vectors)
    parts = [net.logits(vectors, windows[i : i + block], tables=tables) for i in range(0, len(windows), block)]
    return np.concatenate(parts) if parts else np.zeros(0, np.float32)


def _scored_apart(net: Network, x: Inputs, windows: np.ndarray, block: int = 2048) -> np.ndarray:
    """The same for many texts, with vectors of one block's words at a time."""
    parts = [np.zeros(0, np.float32)]
    for i in range(0, len(windows), block):
        local, inverse = np.unique(windows[i : i + block], return_inverse=True)
        part = x.part(local[local < len(x.word)])
        parts.append(net.logits(net.vectors(part), inverse.reshape(-1, windows.shape[1])))
    return np.concatenate(parts)


def evidence(logit: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """Of each text: its highest window's logit, the mean of its TOP highest, and the mean of all; FLOOR without windows."""
    out = np.full((n, 3), FLOOR)
    if not len(logit):
        return out
    order = np.lexsort((-logit, text))  # text ascends already
    logit = logit[order].astype(np.float64)
    first = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
    size = np.diff(np.r_[first, len(text)])
    rank = np.arange(len(text)) - np.repeat(first, size)
    at = text[first]
    out[at, 0] = logit[first]
    out[at, 1] = np.add.reduceat(np.where(rank < TOP, logit, 0), first) / np.minimum(size, TOP)
    out[at, 2] = np.add.reduceat(logit, first) / size
    return out


def score_texts(net: Network | None, texts: pa.Array) -> np.ndarray:
    if net is None:
        return np.zeros(len(texts))
    x = Inputs(texts)
    windows, text = x.windows()
    found = evidence(_scored(net, net.vectors(x), windows), text, len(texts))
    return sigmoid(found @ net.curve[:-1] + net.curve[-1])


def training_sample(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame | None:
    """The labelled sample (key, text, label, half), bounded by MAX_TOXIC, MAX_CLEAN and SAMPLE_BYTES of each kind; None if there is none."""
    known = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(key).alias("k")).agg(F.min(label).alias("y"), F.max(label).alias("y2")).where("y = y2")
    part = F.pmod(F.crc32(F.col("k").cast("string")), F.lit(5))
    known = known.withColumn("part", part).where("part <> 0").select("k", "y", "part", F.xxhash64("k").alias("h"))
    body = F.coalesce(F.col(text), F.lit(""))
    docs = documents.select(F.col(key).alias("k"), F.octet_length(body).alias("size"), F.xxhash64(body).alias("mark"))
    sizes = docs.groupBy("k").agg(F.min(F.struct("size", "mark")).alias("best")).join(known, "k").select("k", "y", "part", "h", "best.size", "best.mark")
    chosen = []
    for kind, most in ((1, MAX_TOXIC), (0, MAX_CLEAN)):
        held = 0
        for r in sizes.where(F.col("y") == kind).orderBy("h", "k").limit(most).collect():
            if held + r["size"] <= SAMPLE_BYTES:
                held += r["size"]
                chosen.append((r["k"], r["y"], r["part"] % 2 == 0, r["mark"]))
    if not chosen:
        return None
    wanted = documents.sparkSession.createDataFrame(chosen, T.StructType([T.StructField("k", documents.schema[key].dataType), T.StructField("y", T.IntegerType()), T.StructField("half", T.BooleanType()), T.StructField("mark", T.LongType())]))
    rows = documents.select(F.col(key).alias("k"), body.alias("text")).withColumn("mark", F.xxhash64("text")).join(F.broadcast(wanted), ["k", "mark"])
    return rows.select("k", "text", "y", "half").dropDuplicates(["k"])


def training_rows(documents: DataFrame, labels: DataFrame, **names: str) -> list[tuple]:
    """The sample's rows, by key."""
    sample = training_sample(documents, labels, **names)
    return [] if sample is None else sorted(map(tuple, sample.collect()))


def train(documents: DataFrame, labels: DataFrame, **names: str) -> Network | None:
    """The network fitted in a task of its own: the sample's texts never reach the driver, only the parameters come back."""
    sample = training_sample(documents, labels, **names)
    if sample is None:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((tuple(r.values()) for batch in batches for r in batch.to_pylist()), key=lambda r: r[0])
        net = fit([r[1] for r in rows], [r[2] for r in rows], [r[3] for r in rows])
        rows.clear()
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(net and (net.p, net.curve))], pa.binary())], names=["net"])
        released()

    found = pickle.loads(sample.repartition(1).mapInArrow(run, "net binary").first()["net"])
    if found is None:
        return None
    net = Network()
    net.p, net.curve = found
    return net


def with_score(documents: DataFrame, net: Network | None, text: str = "text", name: str = "score") -> DataFrame:
    """documents with one more column, the score; ``name`` must be none of theirs (see :func:`shared.unused`)."""

    fields = documents.schema.fields
    numbered = [T.StructField(f"c{i}", f.dataType) for i, f in enumerate(fields)]  # names may hold dots
    at = [f.name for f in fields].index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, f"c{at}"):
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score_texts(net, batch.column(at)), pa.float64())], names=[*batch.schema.names, "score"])
        released()

    scored = documents.toDF(*(f.name for f in numbered)).mapInArrow(run, T.StructType([*numbered, T.StructField("score", T.DoubleType())]))
    return scored.toDF(*(f.name for f in fields), name)


def score(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: key, held_out, score, predicted."""
    net = train(documents, labels, key=key, text=text)
    held = F.coalesce(F.pmod(F.crc32(F.col(key).cast("string")), F.lit(5)) == 0, F.lit(False))
    return with_score(documents.select(F.col(key).alias(key), F.col(text).alias(text)), net, text, unused("score", key, text)).toDF(key, "text", "score").select(key, held.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
