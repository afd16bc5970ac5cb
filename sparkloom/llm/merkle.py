"""Merkle fingerprints of documents, by DataFrame functions only.

A text is cut into lines (paragraphs); a section is a group of lines between
empty ones, and a paragraph is cut into phrases: a phrase ends after white space
that follows one of a few letters or marks, or after 64 code points; where it ends
depends on the text nearby only. The tree: a phrase's digest is SHA-256 of its
text, a paragraph's of its phrases' digests, a section's of its paragraphs', the
root's of its sections'. Equal roots mean equal texts (line ends are kept by the
cut, so no two texts give one tree); differing branches locate an edit, and the
likeness of two texts is found by descending from the root: sections that both
hold count whole, only the others are opened, then their paragraphs, then phrases.

A fingerprint is a string: root (64 hex digits), then for each section
``;`` + 16 digits of its digest, for each of its paragraphs ``,`` + 16 digits, and for
each phrase of that ``.`` + 12 digits (48 bits).

Results for odd input: a null text counts as empty, an empty one is one section
with one empty paragraph and no phrase; likeness of equal roots is 1, of
differing ones below 1, of a text without phrases to any other 0; repeated rows
have equal fingerprints; extra columns pass through :func:`fingerprint`. Rows of one
key follow each other in the order of texts, in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import partitions

#: Fixed values of the fingerprint format: where a phrase may end.
PHRASE = r"(?s).{0,62}?[enrst.,;:!?|][ \t-\r]|.{1,64}"
#: The next document is found within ranges of ids; at most so many ranges.
MAX_RANGES = 16384


def _let(value: Column, body) -> Column:
    """body(value) with value computed once, also inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _paragraph(text: Column) -> Column:
    def node(phrases: Column) -> Column:
        marks = F.transform(phrases, lambda p: F.concat(F.lit("."), F.substring(p, 1, 12)))
        return F.struct(F.sha2(F.array_join(phrases, "."), 256).alias("digest"), F.array_join(marks, "").alias("marks"))

    return _let(F.transform(F.regexp_extract_all(text, F.lit(PHRASE), F.lit(0)), lambda p: F.sha2(p, 256)), node)


def _section(text: Column) -> Column:
    def node(paragraphs: Column) -> Column:
        below = F.transform(paragraphs, lambda p: F.concat(F.lit(","), F.substring(p["digest"], 1, 16), p["marks"]))
        return F.struct(F.sha2(F.array_join(paragraphs["digest"], ","), 256).alias("digest"), F.array_join(below, "").alias("below"))

    return _let(F.transform(F.split(text, "\n", -1), _paragraph), node)


def fingerprint_of(text: Column) -> Column:
    """The fingerprint of a text column."""

    def root(sections: Column) -> Column:
        below = F.transform(sections, lambda s: F.concat(F.lit(";"), F.substring(s["digest"], 1, 16), s["below"]))
        return F.concat(F.sha2(F.array_join(sections["digest"], ";"), 256), F.array_join(below, ""))

    return _let(F.transform(F.split(F.coalesce(text, F.lit("")), "\n\n", -1), _section), root)


def _below(nodes: Column, mark: str) -> Column:
    """What stands below nodes that are cut at a mark: the first piece of each is its own digest."""
    return F.flatten(F.transform(nodes, lambda x: F.slice(F.split(x, mark, -1), 2, 1 << 30)))


def _phrases(nodes: Column) -> Column:
    """How many phrases stand below nodes."""
    whole = F.array_join(nodes, "")
    return F.length(whole) - F.length(F.replace(whole, F.lit(".")))


def likeness(a: Column, b: Column) -> Column:
    """Share of phrases that two fingerprints have in common, 0 to 1: twice the common ones over all.

    A section that both hold counts with all its phrases, once; what is left is
    opened, and then the same with paragraphs, and with phrases.
    """

    def phrases(p: Column) -> Column:
        one, two = (_below(p[x], "[.]") for x in ("a", "b"))
        return F.struct(p["common"].alias("common"), one.alias("a"), two.alias("b"), F.array_intersect(one, two).alias("both"))

    def paragraphs(s: Column) -> Column:
        one, two = (_below(s[x], ",") for x in ("a", "b"))
        return F.struct((s["common"] + _phrases(F.array_intersect(one, two))).alias("common"), F.array_except(one, two).alias("a"), F.array_except(two, one).alias("b"))

    def sections(x: Column) -> Column:
        return F.struct(_phrases(F.array_intersect(x["a"], x["b"])).alias("common"), F.array_except(x["a"], x["b"]).alias("a"), F.array_except(x["b"], x["a"]).alias("b"))

    def share(p: Column) -> Column:
        both = F.lit(2.0) * (p["common"] + F.size(p["both"]))
        total = 2 * p["common"] + F.size(F.array_distinct(p["a"])) + F.size(F.array_distinct(p["b"]))
        return F.when(total == 0, F.lit(0.0)).otherwise(both / F.greatest(total, F.lit(1)))

    opened = F.struct(*(F.slice(F.split(x, ";", -1), 2, 1 << 30).alias(n) for n, x in (("a", a), ("b", b))))
    found = _let(_let(_let(_let(opened, sections), paragraphs), phrases), share)
    return F.when(F.substring(a, 1, 64) == F.substring(b, 1, 64), F.lit(1.0)).otherwise(F.least(found, F.lit(0.9999)))


def differing(a: Column, b: Column) -> Column:
    """Where b's tree differs from a's at the same place: an array of (section, paragraph) from 0; equal branches aren't opened."""
    none = F.expr("array()").cast("array<struct<section:int,paragraph:int>>")

    def paragraphs(s: Column) -> Column:
        changed = F.zip_with(F.slice(F.split(s["a"], ",", -1), 2, 1 << 30), F.slice(F.split(s["b"], ",", -1), 2, 1 << 30), lambda x, y: ~F.substring(x, 1, 16).eqNullSafe(F.substring(y, 1, 16)))
        places = F.transform(changed, lambda c, j: F.when(c, F.struct(s["i"].alias("section"), j.alias("paragraph"))))
        return F.when(s["same"], none).otherwise(F.filter(places, lambda p: p.isNotNull()))

    both = F.zip_with(F.slice(F.split(a, ";", -1), 2, 1 << 30), F.slice(F.split(b, ";", -1), 2, 1 << 30), lambda x, y: F.struct(F.coalesce(x, F.lit("")).alias("a"), F.coalesce(y, F.lit("")).alias("b"), F.substring(x, 1, 16).eqNullSafe(F.substring(y, 1, 16)).alias("same")))
    numbered = F.transform(both, lambda s, i: F.struct(s["a"].alias("a"), s["b"].alias("b"), s["same"].alias("same"), i.alias("i")))
    return F.when(F.substring(a, 1, 64) == F.substring(b, 1, 64), none).otherwise(F.flatten(F.transform(numbered, paragraphs)))


def edits(a: Column, b: Column) -> Column:
    """Where b differs from a: an array of (section, paragraph) from 0 in b whose paragraph is not under a section of a.

    Sections that occur in a are passed over whole; only differing branches are opened.
    """
    sections = F.slice(F.split(b, ";"), 2, 1 << 30)
    known = F.transform(F.slice(F.split(a, ";"), 2, 1 << 30), lambda s: F.substring(s, 1, 16))
    leaves = F.array_distinct(F.flatten(F.transform(F.slice(F.split(a, ";"), 2, 1 << 30), lambda s: F.transform(F.slice(F.split(s, ","), 2, 1 << 30), lambda p: F.substring(p, 1, 16)))))
    opened = F.transform(sections, lambda s, i: F.when(F.array_contains(known, F.substring(s, 1, 16)), F.expr("array()").cast("array<struct<section:int,paragraph:int>>")).otherwise(F.transform(F.slice(F.split(s, ","), 2, 1 << 30), lambda p, j: F.when(~F.array_contains(leaves, F.substring(p, 1, 16)), F.struct(i.alias("section"), j.alias("paragraph"))))))
    return F.when(F.substring(a, 1, 64) == F.substring(b, 1, 64), F.expr("array()").cast("array<struct<section:int,paragraph:int>>")).otherwise(F.filter(F.flatten(opened), lambda x: x.isNotNull()))


def fingerprint(documents: DataFrame, text: str = "text") -> DataFrame:
    """documents with a column ``fingerprint``."""
    return documents.withColumn("fingerprint", fingerprint_of(F.col(text)))


def with_next(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(k, text, fingerprint, following, next_fingerprint): each row with the text and the fingerprint of the next one by descending key, after the last the first.

    Rows are dealt to ranges of keys with about equal row counts. The first row
    of a range also stands, as a copy, at the end of the range above it (that of
    the topmost at the end of the lowest), so one window a range finds all
    followers with one shuffle of the texts. What reaches the driver is one
    key a range. Nulls come last; rows of one key stand in the order of texts.
    """
    rows = documents.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    n = min(MAX_RANGES, 4 * partitions(documents.sparkSession))
    cuts = rows.agg(F.percentile_approx("k", [i / n for i in range(1, n)], 10 * n).alias("c")).first()["c"]
    cuts = sorted(set(cuts or []))
    place = F.lit(0)
    if cuts:
        table = F.array(*map(F.lit, cuts))
        steps = F.array(*(F.lit(1 << i) for i in reversed(range(len(cuts).bit_length()))))
        # how many cuts lie below the key, by halving
        place = F.aggregate(steps, F.lit(0), lambda low, step: F.when((low + step <= len(cuts)) & (F.get(table, low + step - 1) < F.col("k")), low + step).otherwise(low))
    rows = rows.select("k", "text", place.alias("place"))
    first = {r["place"]: r["k"] for r in rows.groupBy("place").agg(F.max("k").alias("k")).collect()}
    order = sorted(first)
    if not order:
        none = F.lit("")
        return rows.select("k", "text", none.alias("fingerprint"), none.alias("following"), none.alias("next_fingerprint"))
    above = dict(zip(order, order[1:] + order[:1], strict=True))
    kind = documents.schema[key].dataType
    heads = F.array(*(F.lit(first.get(i)).cast(kind) for i in range(order[-1] + 1)))
    ends = F.array(*(F.lit(above.get(i, 0)) for i in range(order[-1] + 1)))
    places = F.array(F.struct(F.lit(False).alias("copy"), F.col("place").alias("at")))
    copies = F.array(F.struct(F.lit(True).alias("copy"), F.get(ends, F.col("place")).alias("at")))
    spread = rows.withColumn("p", F.explode(F.when(F.get(heads, F.col("place")).eqNullSafe(F.col("k")), F.concat(places, copies)).otherwise(places)))
    w = Window.partitionBy("at").orderBy("copy", F.desc_nulls_last("k"), "text")
    # fingerprints are made once a row, after the shuffle of the texts
    found = spread.select("k", "text", "p.copy", "p.at").withColumn("following", F.lead("text").over(w))
    found = found.withColumn("fingerprint", fingerprint_of(F.col("text"))).withColumn("next_fingerprint", F.lead("fingerprint").over(w))
    return found.where(~F.col("copy")).select("k", "text", "fingerprint", "following", "next_fingerprint")


def edited(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document against itself with its last third overwritten by the start of the next one: all columns of op3's contract, and edits, the (section, paragraph) that differ."""
    rows = with_next(documents, key, text).withColumn("n_chars", F.char_length("text").cast("long"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    changed = F.concat(F.expr("substring(text, 1, int(n_chars - floor(n_chars / 3)))"), F.substring(F.col("following"), F.lit(1), third))
    rows = rows.withColumn("edited", changed).withColumn("edited_fingerprint", F.when(F.col("edited") == F.col("text"), F.col("fingerprint")).otherwise(fingerprint_of(F.col("edited"))))
    own, other = F.col("fingerprint"), F.col("edited_fingerprint")
    return rows.select(F.col("k").alias(key), "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", likeness(own, other).alias("near_edited"), likeness(own, F.col("next_fingerprint")).alias("near_next"), differing(own, other).alias("edits"))


def _sql_fingerprint(text: str) -> str:
    phrases = f"list_transform(regexp_extract_all(p, '{PHRASE}'), lambda q: sha256(q))"
    paragraphs = f"list_transform(list_transform(string_split(t, chr(10)), lambda p: {phrases}), lambda h: {{'d': sha256(array_to_string(h, '.')), 'm': array_to_string(list_transform(h, lambda q: '.' || q[:12]), '')}})"
    sections = f"list_transform(list_transform(string_split({text}, chr(10) || chr(10)), lambda t: {paragraphs}), lambda ps: {{'d': sha256(array_to_string(list_transform(ps, lambda p: p.d), ',')), 'b': array_to_string(list_transform(ps, lambda p: ',' || p.d[:16] || p.m), '')}})"
    return f"list_transform([{sections}], lambda ss: sha256(array_to_string(list_transform(ss, lambda s: s.d), ';')) || array_to_string(list_transform(ss, lambda s: ';' || s.d[:16] || s.b), ''))[1]"


def _sql_phrases(nodes: str) -> str:
    return f"coalesce(list_sum(list_transform({nodes}, lambda x: len(x) - len(replace(x, '.', '')))), 0)"


#: The same in DuckDB's SQL.
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, t, length(t) AS n_chars, coalesce(lead(t) OVER (ORDER BY doc_id DESC), first_value(t) OVER (ORDER BY doc_id DESC)) AS f FROM d),
e AS (SELECT *, substr(t, 1, n_chars - n_chars // 3) || substr(f, 1, n_chars // 3) AS ed FROM n),
p AS (SELECT doc_id, n_chars, sha256(ed) AS edited_sha256, {_sql_fingerprint("t")} AS a, {_sql_fingerprint("ed")} AS b, {_sql_fingerprint("f")} AS c FROM e),
pairs AS (SELECT doc_id, 'edited' AS kind, a, b FROM p UNION ALL SELECT doc_id, 'next', a, c FROM p),
s1 AS (SELECT *, string_split(a, ';')[2:] AS sa, string_split(b, ';')[2:] AS sb FROM pairs),
s2 AS (SELECT *, list_intersect(sa, sb) AS sc, flatten(list_transform(list_filter(list_distinct(sa), lambda x: NOT list_contains(sb, x)), lambda x: string_split(x, ',')[2:])) AS pa, flatten(list_transform(list_filter(list_distinct(sb), lambda x: NOT list_contains(sa, x)), lambda x: string_split(x, ',')[2:])) AS pb FROM s1),
s3 AS (SELECT *, list_intersect(pa, pb) AS pc, list_distinct(flatten(list_transform(list_filter(list_distinct(pa), lambda x: NOT list_contains(pb, x)), lambda x: string_split(x, '.')[2:]))) AS ma, list_distinct(flatten(list_transform(list_filter(list_distinct(pb), lambda x: NOT list_contains(pa, x)), lambda x: string_split(x, '.')[2:]))) AS mb FROM s2),
s4 AS (SELECT *, {_sql_phrases("sc")} + {_sql_phrases("pc")} AS common, len(list_intersect(ma, mb)) AS both_ FROM s3),
l AS (SELECT doc_id, kind, CASE WHEN a[:64] = b[:64] THEN 1.0::DOUBLE WHEN 2 * common + len(ma) + len(mb) = 0 THEN 0.0::DOUBLE ELSE least(2.0::DOUBLE * (common + both_)::DOUBLE / (2 * common + len(ma) + len(mb))::DOUBLE, 0.9999::DOUBLE) END AS near FROM s4)
SELECT p.doc_id, CAST(n_chars AS BIGINT) AS n_chars, edited_sha256, p.a AS fingerprint, p.b AS edited_fingerprint, x.near AS near_edited, y.near AS near_next
FROM p JOIN l x ON x.doc_id = p.doc_id AND x.kind = 'edited' JOIN l y ON y.doc_id = p.doc_id AND y.kind = 'next'"""
