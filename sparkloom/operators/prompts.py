"""Prompts for models that are plugged in through ``annotate.annotated``.

A template is plain text with ``{{ name }}`` for values; lines that hold only a value
without content go. Templates of a folder (``<name>.txt``) go before those here; a
name without any template gives an empty text. Values are cut to ``MOST`` characters
at a line's end, so that a wide catalogue can't outgrow a model's context.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST = 60_000
TEMPLATES = {
    "domain": "Tables of a database:\n{{ ddl }}\nName its domain, main concepts and naming patterns as a JSON object.",
    "category": "Column {{ column }} of table {{ table }} holds e.g. {{ samples }}.\nWhich of these is it: {{ categories }}? Answer with one word.",
    "column": "Describe column {{ column }} of table {{ table }} ({{ category }}) in one sentence.\n{{ samples }}",
    "table": "Describe in one sentence what a row of table {{ table }} stands for.\n{{ ddl }}",
    "model": "Tables of a database:\n{{ ddl }}\nGive its entities and their relations as a JSON object.",
    "question": "Ask a question of kind {{ use_case }} (level {{ level }}) that these tables answer:\n{{ evidence }}",
    "sql": "Question: {{ question }}\nWhat is known:\n{{ evidence }}\nAnswer with a JSON object of sql and think.",
    "review": "Question: {{ question }}\nStatement: {{ sql }}\nWhat is known:\n{{ evidence }}\nList what is wrong as a JSON array of issues.",
    "correct": "Question: {{ question }}\nStatement: {{ sql }}\nErrors:\n{{ errors }}\nWhat is known:\n{{ evidence }}\nAnswer with the corrected statement.",
}
VALUE = re.compile(r"\{\{\s*(\w+)\s*\}\}")


class Prompts:
    def __init__(self, folder: str | None = None):
        own = {p.stem: p.read_text() for p in sorted(Path(folder).glob("*.txt"))} if folder else {}
        self.templates = TEMPLATES | own

    def render(self, name: str, **values: object) -> str:
        """The prompt's text; values that aren't given are empty."""
        lines = []
        for line in self.templates.get(name, "").split("\n"):
            names = VALUE.findall(line)
            text = VALUE.sub(lambda m: cut("" if values.get(m[1]) is None else str(values[m[1]])), line)
            if not (names and not text.strip()):
                lines.append(text.rstrip())
        return "\n".join(lines).strip()

    def column(self, rows: DataFrame, name: str) -> Column:
        """The prompt of each row, its values from the columns of those names."""
        parts = re.split(r"\{\{\s*(\w+)\s*\}\}", self.templates.get(name, ""))
        known = {c.lower() for c in rows.columns}
        texts = [F.lit(p) if i % 2 == 0 else F.coalesce(F.substring(F.col(p).cast("string"), 1, MOST), F.lit("")) if p.lower() in known else F.lit("") for i, p in enumerate(parts)]
        return F.trim(F.concat(*texts))


def cut(text: str, most: int = MOST) -> str:
    """At most so many characters, whole lines where there are any."""
    if len(text) <= most:
        return text
    head = text[:most]
    return head[: head.rfind("\n")] if "\n" in head else head
