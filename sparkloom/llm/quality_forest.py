"""Quality rules: statistics of whole texts, hard limits, and isolation forests over the rest.

A text fails the base rules by too few words or too many words in repeated runs.
What passes is judged by isolation forests, one for each statistic of the rules: random
splits of the statistic's range isolate a value after few steps if it is far from
where texts lie. One forest for all statistics at once hides junk that is odd in one of
them behind splits of the others (measured on held-out labels: at most half of the junk
found, see README), so each statistic has its own trees and its own threshold.

Thresholds come from labelled rows: a text is anomalous in a statistic if its mean path
is shorter than that of every labelled good text (or of all but ``loss`` of them), half
way to the longest path of a bad text below that. The statistic that finds most labelled
bad texts comes first, and one that adds fewer than ``LEAST_FOUND`` to those found before
it isn't used. A tree over one
statistic is a step function of it, and so is the mean over a forest: a forest is kept as
its steps, and a path length is looked up among them.

Forests are fitted on at most ``MAX_LABELLED`` labelled rows, chosen by a hash of their
ids; only their statistics reach the driver. Statistics, limits and verdicts cover every
row and whole texts, with no shuffle of the documents.

Results for odd input: null or empty texts have no word and fail the base rules; null
labels, and other than 0 and 1, teach nothing; without labels of both kinds only the base
rules count; ids may be null, repeated or of any type; other columns are left out; empty
tables give empty results. A text is held by itself however long it is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import released
from .words import Words, distinct, slices

LEAST_WORDS, MOST_REPEATED, RUN = 20, 30, 8
SYMBOLS = b"#*$%&|<>"
#: Labelled rows that forests are fitted on, at most.
MAX_LABELLED = 8192
#: Trees in a forest, and values drawn for a tree.
TREES, DRAWN = 100, 256
#: Labelled bad texts that a statistic has to add to those found by others.
LEAST_FOUND = 3

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_same", "n_distinct", "n_upper", "n_digits")


def run_codes(code: np.ndarray, k: int) -> np.ndarray:
    """A number for each k consecutive codes; equal numbers are equal runs (pairs of numbers are numbered anew, no hashes)."""
    n = len(code) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64)

    def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.unique(a * (int(b.max()) + 1) + b, return_inverse=True)[1].astype(np.int64)

    out, used, level, width = None, 0, code.astype(np.int64), 1
    while True:
        if k & width:
            part = level[used : used + n]
            out, used = part if out is None else paired(out, part), used + width
        if 2 * width > k:
            return out
        level, width = paired(level[:-width], level[width:]), 2 * width


def statistics(texts: pa.Array, run: int = RUN) -> dict[str, np.ndarray]:
    """The counts of each text, by name."""
    w = Words(texts)
    n, offsets, data = len(w.counts), w.offsets, w.data
    letter = ~w._separator

    def by_text(flag: np.ndarray) -> np.ndarray:
        total = np.r_[0, np.cumsum(flag)]
        return total[offsets[1:]] - total[offsets[:-1]]

    def marked(values: bytes) -> np.ndarray:
        table = np.zeros(256, bool)
        table[list(values)] = True
        return by_text(table[data])

    code = w.coded()[0].astype(np.int64)
    # lines with a word, and those equal to an earlier one
    cut = np.unique(np.r_[offsets, np.flatnonzero(data == 10) + 1])
    held = np.diff(np.searchsorted(w.starts, cut)) > 0
    line, text_of_line = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if held.any():
        line = distinct(data[data != 10], cut - np.r_[0, np.cumsum(data == 10)][cut])[0].astype(np.int64)[held]
        text_of_line = np.searchsorted(offsets, cut[:-1][held], "right") - 1
    first = np.zeros(len(line), bool)
    if len(line):
        first[np.unique(text_of_line * (int(line.max()) + 1) + line, return_index=True)[1]] = True
    # words in runs that stand twice or more in the text
    runs = run_codes(code, run)
    at = np.arange(len(runs))
    at = at[at + run <= w.first[1:][w.text_of[at]]] if len(at) else at
    covered = np.zeros(len(code) + 1, np.int64)
    if len(at):
        _, which, times = np.unique(w.text_of[at] * (int(runs.max()) + 1) + runs[at], return_inverse=True, return_counts=True)
        again = at[times[which] > 1]
        np.add.at(covered, again, 1)
        np.add.at(covered, again + run, -1)
    repeated = np.cumsum(covered)[:-1] > 0
    same = (code[1:] == code[:-1]) & (w.text_of[1:] == w.text_of[:-1])
    known = np.unique(w.text_of * (int(code.max(initial=0)) + 1) + code) // (int(code.max(initial=0)) + 1)
    of = lambda where: np.bincount(where, minlength=n)[:n].astype(np.int64)
    return dict(zip(COUNTS, (w.counts.astype(np.int64), by_text(letter & ((data & 0xC0) != 0x80)), marked(SYMBOLS), of(text_of_line[~first]), of(w.text_of[repeated]), of(text_of_line), of(w.text_of[1:][same]), of(known), marked(bytes(range(65, 91))), marked(bytes(range(48, 58)))), strict=True))


def shares(c: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The statistics that forests judge, from counts."""
    words, chars, lines = (np.maximum(1, c[k]) for k in ("n_words", "word_chars", "n_lines"))
    return {
        "symbol_share": c["n_symbols"] / chars,
        "word_length": c["word_chars"] / words,
        "dup_line_share": c["n_dup_lines"] / lines,
        "repeat_share": c["n_repeat_words"] / words,
        "same_share": c["n_same"] / words,
        "distinct_share": c["n_distinct"] / words,
        "upper_share": c["n_upper"] / chars,
        "digit_share": c["n_digits"] / chars,
    }


def base_failed(c: dict[str, np.ndarray]) -> np.ndarray:
    return (c["n_words"] < LEAST_WORDS) | (100 * c["n_repeat_words"] > MOST_REPEATED * c["n_words"])


def expected(n: int) -> float:
    """Mean path to a value among n that splits would still have to tell apart."""
    return 0.0 if n < 2 else 1.0 if n == 2 else float(2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n)


@dataclass
class Forest:
    """The mean path length as steps: path[i] holds for values from at[i - 1] (included) to at[i]."""

    at: np.ndarray
    path: np.ndarray
    threshold: float = -1.0

    def paths(self, values: np.ndarray) -> np.ndarray:
        return self.path[np.searchsorted(self.at, values, "right")]


def grown(values: np.ndarray, rng: np.random.Generator, trees: int = TREES, drawn: int = DRAWN) -> Forest:
    """A forest over one statistic: each tree splits a draw of values at random places of their range, down to a bounded depth."""
    size = min(drawn, len(values))
    deepest = int(np.ceil(np.log2(max(2, size))))
    cuts: list[float] = []
    steps: list[float] = []
    start = 0.0
    for _ in range(trees):
        todo = [(np.sort(rng.choice(values, size, replace=False)), 0)]
        before = None
        while todo:  # leaves come from left to right
            held, depth = todo.pop()
            if isinstance(depth, float):
                cuts.append(depth)
                continue
            if depth < deepest and len(held) > 1 and held[-1] > held[0]:
                place = float(rng.uniform(held[0], held[-1]))
                left = int(np.searchsorted(held, place))
                if 0 < left < len(held):
                    todo += [(held[left:], depth + 1), (held, place), (held[:left], depth + 1)]
                    continue
            path = depth + expected(len(held))
            if before is None:
                start += path
            else:
                steps.append(path - before)
            before = path
    order = np.argsort(cuts, kind="stable")
    return Forest(np.array(cuts, float)[order], (start + np.r_[0.0, np.cumsum(np.array(steps, float)[order])]) / trees)


def fitted(values: dict[str, np.ndarray], good: np.ndarray, seed: int = 1, loss: float = 0.0, least: int = LEAST_FOUND) -> dict[str, Forest]:
    """Forests with thresholds, the one that finds most labelled bad rows first; each finds some that those before it don't."""
    told: dict[str, tuple[Forest, np.ndarray]] = {}
    for k, (name, x) in enumerate(values.items()):
        if not good.any() or good.all():
            return {}
        forest = grown(x, np.random.default_rng([seed, k]))
        path = forest.paths(x)
        low = np.sort(path[good])[int(loss * good.sum())]
        found = ~good & (path < low)
        if found.any():
            forest.threshold = float((low + path[found].max()) / 2)
            told[name] = forest, found
    out: dict[str, Forest] = {}
    while told:
        name = max(told, key=lambda k: told[k][1].sum())
        forest, found = told.pop(name)
        if found.sum() < least:
            break
        out[name] = forest
        told = {k: (f, x & ~found) for k, (f, x) in told.items()}
    return out


def _counted(documents: DataFrame, text: str, forests: dict[str, Forest] | None, *carried: str) -> DataFrame:
    """The carried columns, counts, base_failed, and (with forests) kept and reason."""
    kinds = {f.name: f.dataType.simpleString() for f in documents.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                c = statistics(batch.column(0))
                failed = base_failed(c)
                columns = [*batch.columns[1:], *(pa.array(c[k], pa.int64()) for k in COUNTS), pa.array(failed)]
                if forests is not None:
                    reason = np.where(failed, "base", None).astype(object)
                    for name, x in shares(c).items():
                        if name in forests:
                            odd = forests[name].paths(x) < forests[name].threshold
                            reason[odd & (reason == None)] = name  # noqa: E711
                    columns += [pa.array([r is None for r in reason], pa.bool_()), pa.array(reason.tolist(), pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=names)
        released()

    names = [*(f"c{i}" for i in range(len(carried))), *COUNTS, "base_failed", *(("kept", "reason") if forests is not None else ())]
    schema = [*(f"c{i} {kinds[k]}" for i, k in enumerate(carried)), *(f"{k} long" for k in COUNTS), "base_failed boolean", *(("kept boolean", "reason string") if forests is not None else ())]
    rows = documents.select(F.col(text).cast("string").alias("text"), *(F.col(k).alias(f"c{i}") for i, k in enumerate(carried)))
    found = rows.mapInArrow(run, ", ".join(schema))
    return found.toDF(*carried, *names[len(carried) :])


def fit(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", rows: int = MAX_LABELLED, seed: int = 1, loss: float = 0.0) -> dict[str, Forest]:
    """Forests from at most ``rows`` labelled rows: those whose ids have the smallest hashes."""
    of = labels.select(F.col(key).cast("string").alias("_name"), F.col(label).alias("_label")).where("_label IN (0, 1) AND _name IS NOT NULL")
    few = of.orderBy(F.xxhash64("_name"), "_name", "_label").limit(rows)
    docs = documents.select(F.col(key).cast("string").alias("_name"), F.col(text).alias("_text"))
    counted = _counted(docs.join(F.broadcast(few), "_name"), "_text", None, "_name", "_label").where("NOT base_failed")
    # rows of one id are all labelled; the bound holds for them as well
    held = counted.orderBy(F.xxhash64("_name"), *(c for c in counted.columns)).limit(rows).toPandas()
    c = {k: held[k].to_numpy(np.int64) for k in COUNTS}
    return fitted(shares(c), held["_label"].to_numpy() == 1, seed, loss)


def judged(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Per row: key, the counts, base_failed, kept, and reason (base, or the first statistic that is anomalous; null if kept)."""
    return _counted(documents, text, fit(documents, labels, key, text, **options), key)
