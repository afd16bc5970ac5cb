"""Forms of other SQL dialects in Spark's terms."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_pattern(glob: str) -> str:
    """A GLOB pattern (*, ?, [set], [^set]) as an anchored regular expression."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        if c in "*?":
            out.append(".*" if c == "*" else ".")
        elif c == "[" and (end := glob.find("]", i + 2)) > 0:
            inner = glob[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("&", "\\&")
            out.append(f"[{inner}]")
            i = end
        else:
            out.append(re.sub(r"([^\w\s])", r"\\\1", c))
        i += 1
    return "(?s)^" + "".join(out) + "$"


def glob_match(text: Column, glob: str) -> Column:
    return text.rlike(glob_pattern(glob))


def group_concat(value: Column, order: Column, separator: str = ",") -> Column:
    """Values of a group in the order of another column, joined; nulls are left out."""
    pairs = F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(order.alias("o"), value.alias("v")))))
    return F.array_join(F.transform(pairs, lambda p: p["v"].cast("string")), separator)


def iif(condition: Column, yes: Column, no: Column) -> Column:
    return F.when(condition, yes).otherwise(no)


def convert(value: Column, kind: str) -> Column:
    """MySQL's CONVERT(x, type): null where the value doesn't fit."""
    kinds = {"signed": "bigint", "unsigned": "bigint", "char": "string", "date": "date", "datetime": "timestamp_ntz", "decimal": "decimal(38,10)"}
    return value.try_cast(kinds.get(kind.lower(), kind))


def json_extract(text: Column, path: str) -> Column:
    return F.get_json_object(text, path)


_SQL_FORMS = (
    (re.compile(r"(?i)\bgroup_concat\s*\(\s*distinct\s+([^()]+?)\s*\)"), r"listagg(DISTINCT \1, ',')"),
    (re.compile(r"(?i)\bgroup_concat\s*\(\s*([^()]+?)\s+separator\s+('[^']*')\s*\)"), r"listagg(\1, \2)"),
    (re.compile(r"(?i)\bgroup_concat\s*\(\s*([^()]+?)\s*\)"), r"listagg(\1, ',')"),
    (re.compile(r"(?i)\bjson_extract\s*\("), "get_json_object("),
    (re.compile(r"(?i)\biif\s*\("), "if("),
    (re.compile(r"(?i)\bdate_(add|sub)\s*\(\s*([^(),]+(?:\([^()]*\))?)\s*,\s*interval\s+(\S+)\s+(\w+)\s*\)"), lambda m: f"({m[2].strip()} {'+' if m[1].lower() == 'add' else '-'} INTERVAL {m[3]} {m[4]})"),
    (re.compile(r"(?i)\bconvert\s*\(\s*([^(),]+?)\s*,\s*(signed|unsigned|char|date|datetime)\s*\)"), lambda m: f"try_cast({m[1]} AS {({'signed': 'BIGINT', 'unsigned': 'BIGINT', 'char': 'STRING', 'date': 'DATE', 'datetime': 'TIMESTAMP_NTZ'})[m[2].lower()]})"),
)
_QUANTIFIED = re.compile(r"(?is)([\w.]+)\s*(<>|!=|<=|>=|=|<|>)\s*(all|any|some)\s*\(\s*select\s+([\w.]+)\s+from\s+([^()]+)\)")


def _quantified(m: re.Match) -> str:
    left, op, kind, column, rest = m[1], m[2], m[3].lower(), m[4], m[5].strip()
    where = re.split(r"(?i)\bwhere\b", rest, maxsplit=1)
    source, condition = where[0].strip(), f"({where[1].strip()}) AND " if len(where) == 2 else ""
    if kind == "all":
        return f"NOT EXISTS (SELECT 1 FROM {source} WHERE {condition}(NOT ({left} {op} {column}) OR ({left} {op} {column}) IS NULL))"
    return f"EXISTS (SELECT 1 FROM {source} WHERE {condition}{left} {op} {column})"


def to_spark_sql(sql: str) -> str:
    """Rewrite the foreign forms of the surface (GROUP_CONCAT, JSON_EXTRACT, IIF, CONVERT, MySQL's date arithmetic, GLOB, ALL, ANY, SOME) outside of string literals and comments."""
    parts = re.split(r"('(?:[^']|'')*'|`[^`]*`|--[^\n]*|/\*.*?\*/)", sql, flags=re.S)
    held = [p for i, p in enumerate(parts) if i % 2]
    text = "".join(p if i % 2 == 0 else f"\x00{i // 2}\x00" for i, p in enumerate(parts))
    mark = re.compile(r"\x00(\d+)\x00")
    text = re.sub(r"(?i)\bglob\s*\x00(\d+)\x00", lambda m: "RLIKE '" + glob_pattern(held[int(m[1])][1:-1]).replace("\\", "\\\\").replace("'", "\\'") + "'", text)
    text = _QUANTIFIED.sub(_quantified, text)
    for pattern, new in _SQL_FORMS:
        # literals inside a call come back before the rewrite of a separator
        text = pattern.sub(new, text) if "separator" not in pattern.pattern else pattern.sub(new, mark.sub(lambda m: held[int(m[1])], text)) if re.search(r"(?i)\bseparator\b", text) else text
    return mark.sub(lambda m: held[int(m[1])], text)
