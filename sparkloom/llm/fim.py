"""Fill-in-middle documents from an Aho-Corasick scan for sparse events.

One automaton holds the characters at which a text changes between white space and
words, and the sentinels. Its events are all that is needed of a text: a gap of
characters between two white space events is one unit (a word with the white space
before it) and ends where the later event stands; white space at the end of the text
is a unit by itself. The end of the k-th unit is so looked up by rank among the gaps,
and no list of units is made.

Where a text is cut is drawn from SHA-256 of the seed and the row's id, so a result
depends on nothing but its row. Texts that hold a sentinel stay as they are; in all
others the output's sentinels can be told from its text, so ``restored`` undoes it.

Results for odd input: a null text is an empty one; a null id is drawn as an empty
one; rows of one id are drawn alike; repeated rows have repeated results; other columns
are left out, whatever their names; empty tables give empty results. A text is held by
itself however long it is, with eight bytes for each white space character.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import released
from .words import slices

WHITE_SPACE = "\t\n\x0b\x0c\r "
#: Before prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
SEED, RATE, SPM = 42, 50, 80


class Events:
    """The automaton of white space and sentinels."""

    def __init__(self, sentinels: tuple[str, ...] = SENTINELS):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for c in WHITE_SPACE:
            self.automaton.add_word(c, True)
        for s in sentinels:
            self.automaton.add_word(s, False)
        self.automaton.make_automaton()

    def __call__(self, text: str) -> tuple[np.ndarray, bool]:
        """Where units end, in code points, and whether the text holds a sentinel."""
        if not text:
            return np.zeros(0, np.int64), False
        found = np.fromiter((end if space else ~end for end, space in self.automaton.iter(text)), np.int64)
        spaces = found[found >= 0]
        limits = np.r_[spaces, len(text)]
        gap = np.diff(limits, prepend=-1) > 1
        gap[-1] |= len(spaces) > 0 and spaces[-1] == len(text) - 1
        return limits[gap], len(spaces) < len(found)


def drawn(seed: int, key: str) -> list[int]:
    """Four numbers of 32 bits."""
    digest = hashlib.sha256(f"{seed}:{key}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12)]


def fim(documents: DataFrame, key: str = "doc_id", text: str = "text", seed: int = SEED, rate: int = RATE, spm: int = SPM, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """Per row: key, n (units), form (plain, psm or spm), prefix_chars, middle_chars (null if plain), output (the text transformed).

    ``rate`` of a hundred texts are transformed, ``spm`` of a hundred of those with the suffix first.
    """
    kind = documents.schema[key].dataType.simpleString()
    p, s, m = sentinels

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        events = Events(sentinels)
        for whole in batches:
            for batch in slices(whole, whole.schema.names[2]):
                rows: list[tuple] = []
                for name, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    t = t or ""
                    ends, sentinel = events(t)
                    n = len(ends)
                    h = drawn(seed, name or "")
                    if not t or sentinel or h[2] % 100 >= rate:
                        rows.append((n, "plain", None, None, t))
                        continue
                    a, b = (int(ends[k - 1]) if k else 0 for k in sorted((h[0] % (n + 1), h[1] % (n + 1))))
                    if h[3] % 100 < spm:
                        rows.append((n, "spm", a, b - a, f"{s}{t[b:]}{p}{t[:a]}{m}{t[a:b]}"))
                    else:
                        rows.append((n, "psm", a, b - a, f"{p}{t[:a]}{s}{t[b:]}{m}{t[a:b]}"))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
                columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["key", "n", "form", "prefix_chars", "middle_chars", "output"])
        released()

    rows = documents.select(F.col(key).alias("key"), F.col(key).cast("string").alias("name"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"key {kind}, n long, form string, prefix_chars long, middle_chars long, output string").withColumnRenamed("key", key)


def restored(form: Column, output: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text before the transformation: what stands between sentinels, in the order of the form."""
    part = F.split(output, "|".join(re.escape(s) for s in sentinels), 4)
    texts = {"psm": (1, 3, 2), "spm": (2, 3, 1)}
    found = F.when(form == "plain", output)
    for name, order in texts.items():
        found = found.when(form == name, F.concat(*(F.get(part, F.lit(i)) for i in order)))
    return found


#: The same for DuckDB: all units as a list, cut at the drawn ranks.
ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units, sha256('42:' || CAST(doc_id AS VARCHAR)) AS h FROM documents
), r AS (
  SELECT doc_id, text, units, len(units) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(units) + 1) AS a, CAST('0x' || h[9:16] AS BIGINT) % (len(units) + 1) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 50 THEN 'plain' WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM d
), p AS (
  SELECT *, array_to_string(units[1:least(a, b)], '') AS prefix, array_to_string(units[least(a, b) + 1:greatest(a, b)], '') AS middle, array_to_string(units[greatest(a, b) + 1:], '') AS suffix FROM r
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256 FROM p
"""
