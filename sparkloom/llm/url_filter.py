"""URL rules found by their rarest literal token.

A rule is a regular expression with the literal tokens that any url it fits
must hold. Each rule is filed under that one of its tokens that the urls at
hand use least (counted over all of them, for the tokens of rules only; ties
to the smaller token). A url's own tokens fetch the rules filed under them, and
only those run their regular expressions, which are compiled when they are first
fetched. Rules without a token are tried on every url.

Rules are written in the public form of filter lists (:func:`pattern_rule`):
``||host^`` for a host and its subdomains, ``|`` for a start or an end, ``*`` for
anything, ``^`` for a separator or the end, ``/expression/``, ``@@`` before a rule that
allows (A-Z are folded to a-z, no other letters, in patterns as in tokens); besides, whole words (:func:`word_rule`) and a stated list of host and path
prefixes (:func:`host_rule`), which goes before all others.

Up to ``MAX_RULES`` rules are sent to every task; beyond, urls and rules meet in a join by
token, and what decides is found by a minimum over each url's candidates.

Results for odd input: a null url, or one without ``://``, has an empty host
and path, fits no rule and is allowed; an empty table gives an empty result;
columns of the input other than the key and the url are left out; repeated rows
give repeated results.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_RULES = 200_000
TOKEN = re.compile(r"[a-z0-9]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


@dataclass(frozen=True)
class Rule:
    """name: what results show. pattern: searched in host + path. tokens: whole tokens of every url it fits. listed: a rule of a stated list, which goes before any general pattern."""

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    listed: bool = True


def host_rule(name: str, verdict: str) -> Rule:
    """A rule like ``example.net/en/``: the host and its subdomains, and paths that start so."""
    host, _, path = name.partition("/")
    whole = "/" + path
    inner = TOKEN.findall(whole.translate(_LOWER))
    if inner and not re.search(r"[^A-Za-z0-9]$", whole):
        inner = inner[:-1]  # the last token may go on in the url
    return Rule(name, verdict, rf"\A(?:[^/]*\.)?{re.escape(host)}{re.escape(whole)}", (*TOKEN.findall(host), *inner))


def word_rule(word: str, verdict: str = "block") -> Rule:
    """A general pattern: the word as a whole token of host, path or query."""
    return Rule(word, verdict, rf"(?ai)(?:^|[^a-z0-9]){re.escape(word)}(?:[^a-z0-9]|$)", (word,), listed=False)


def pattern_rule(line: str) -> Rule:
    """A rule of a filter list; it is searched, without regard to case, in host, path and query."""
    verdict, body = ("allow", line[2:]) if line.startswith("@@") else ("block", line)
    if len(body) > 2 and body[0] == body[-1] == "/":
        # what an expression demands literally can't be told from its text
        return Rule(line, verdict, f"(?ai){body[1:-1]}", (), listed=False)
    host, start, end = body.startswith("||"), body.startswith("|"), body.endswith("|")
    inner = body.removeprefix("||" if host else "|").removesuffix("|")
    pattern = "".join(".*" if c == "*" else r"(?:[^a-z0-9_.%-]|$)" if c == "^" else re.escape(c) for c in inner)
    pattern = ("^(?:[^/?]*[.])?" if host else "^" if start else "") + pattern + ("$" if end else "")
    low = inner.translate(_LOWER)
    # a token is whole only between characters that the rule names, or at a stated start or end
    tokens = [m[0] for m in TOKEN.finditer(low) if (low[m.start() - 1] != "*" if m.start() else host or start) and (low[m.end()] != "*" if m.end() < len(low) else end)]
    return Rule(line, verdict, f"(?ai){pattern}", tuple(tokens), listed=False)


#: The list's rules.
LISTED = (host_rule("net/", "block"), host_rule("example.net/en/", "allow"), host_rule("example.com/de/", "block"), host_rule("org/fr/", "allow"))
#: Words of hosts and paths that mark pages unfit for a corpus.
UNFIT = ("casino", "poker", "betting", "jackpot", "porn", "xxx", "sex", "escort", "viagra", "pills", "payday", "torrent", "warez", "phishing", "malware")
#: Pages of software, sessions and calendars, which hold no text of their own.
MACHINES = ("/wp-login.php^", "/cgi-bin/*.cgi", "^sessionid=", "^phpsessid=", "||ads.*^", "|login.", "/calendar/*/day^", "@@/cgi-bin/article.cgi", r"/[/]page[/][0-9]{5,}/")
DEFAULT = LISTED + tuple(word_rule(w) for w in UNFIT) + tuple(map(pattern_rule, MACHINES))


def split_url(url: str | None) -> tuple[str, str, str]:
    """Host (A-Z lower-cased), path, and what general patterns are searched in: both with the query. All empty without ``://``."""
    at = -1 if url is None else url.find("://")
    if at < 0:
        return "", "", ""
    rest = re.match(r"([^/?#]*)([^?#]*)([^#]*)", url[at + 3 :])
    host = rest[1].translate(_LOWER)
    return host, rest[2], host + rest[2] + rest[3]


def tokens_of(text: str) -> set[str]:
    return set(TOKEN.findall(text.translate(_LOWER)))


def order(rule: Rule) -> tuple:
    """The smallest decides: listed ones first, then the longest name, then the smallest."""
    return not rule.listed, -len(rule.name), rule.name


def fits(rule: Rule, pattern: re.Pattern, host: str, path: str, whole: str) -> bool:
    return pattern.search(host + path if rule.listed else whole) is not None


class Index:
    """Rules by their rarest token; those without a token are tried on every url."""

    def __init__(self, rules: Iterable[Rule], counts: dict[str, int]):
        self.by_token, self.always, self.compiled = defaultdict(list), [], {}
        for rule in rules:
            (self.by_token[rarest(rule, counts)] if rule.tokens else self.always).append(rule)

    def pattern(self, rule: Rule) -> re.Pattern:
        if rule not in self.compiled:
            self.compiled[rule] = re.compile(rule.pattern, re.S)
        return self.compiled[rule]

    def judge(self, host: str, path: str, whole: str | None = None) -> Rule | None:
        """The rule that decides."""
        whole = host + path if whole is None else whole
        if not whole:
            return None
        found = [r for t in tokens_of(whole) for r in self.by_token.get(t, ())] + self.always
        return min((r for r in found if fits(r, self.pattern(r), host, path, whole)), key=order, default=None)


def rarest(rule: Rule, counts: dict[str, int]) -> str:
    return min(rule.tokens, key=lambda t: (counts.get(t, 0), t))


def token_counts(pages: DataFrame, rules: Iterable[Rule], url: str = "url") -> dict[str, int]:
    """How many urls hold each token of the rules. The result has at most as many rows as the rules have tokens."""
    known = sorted({t for r in rules for t in r.tokens})
    if not known:
        return {}
    tokens = pages.where(F.col(url).isNotNull()).select(F.explode(F.array_distinct(F.split(F.lower(F.col(url)), "[^a-z0-9]+"))).alias("t"))
    names = pages.sparkSession.createDataFrame([(t,) for t in known], "t string")
    found = tokens.join(F.broadcast(names) if len(known) <= 2 * MAX_RULES else names, "t", "left_semi").groupBy("t").count()
    return {r["t"]: r["count"] for r in found.collect()}


def filter_urls(pages: DataFrame, rules: Iterable[Rule] = DEFAULT, key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """Per row: key, host, path, rule (of the stated list, else null), verdict, pattern (the general rule that decided, else null)."""
    rules = tuple(dict.fromkeys(rules))
    counts = token_counts(pages, rules, url)
    if len(rules) > MAX_RULES:
        return joined(pages, rules, counts, key, url, default)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(rules, counts)
        for batch in batches:
            parts = [split_url(u) for u in batch.column(1).to_pylist()]
            found = [index.judge(*p) for p in parts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([p[0] for p in parts], pa.string()),
                    pa.array([p[1] for p in parts], pa.string()),
                    pa.array([r.name if r and r.listed else None for r in found], pa.string()),
                    pa.array([r.verdict if r else default for r in found], pa.string()),
                    pa.array([r.name if r and not r.listed else None for r in found], pa.string()),
                ],
                names=["key", "host", "path", "rule", "verdict", "pattern"],
            )

    kind = pages.schema[key].dataType.simpleString()
    found = pages.select(F.col(key).alias("key"), F.col(url).alias("url")).mapInArrow(run, f"key {kind}, host string, path string, rule string, verdict string, pattern string")
    return found.withColumnRenamed("key", key)


def joined(pages: DataFrame, rules: Iterable[Rule], counts: dict[str, int], key: str, url: str, default: str) -> DataFrame:
    """The same for any number of rules: different urls meet rules by token, in a join that splits skewed tokens."""
    spark = pages.sparkSession
    table = spark.createDataFrame([(rarest(r, counts) if r.tokens else "", r.name, r.verdict, r.pattern, r.listed) for r in rules], "t string, name string, verdict string, pattern string, listed boolean")
    urls = pages.select(F.col(url).alias("url")).distinct()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [split_url(u) for u in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([p[i] for p in parts], pa.string()) for i in range(3)), pa.array([["", *sorted(tokens_of(p[2]))] if p[2] else [] for p in parts], pa.list_(pa.string()))], names=["url", "host", "path", "whole", "tokens"])

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled: dict[str, re.Pattern] = {}
        for batch in batches:
            keep = []
            for r in batch.select(["host", "path", "whole", "pattern", "listed"]).to_pylist():
                if r["pattern"] not in compiled:
                    if len(compiled) > 50_000:
                        compiled.clear()
                    compiled[r["pattern"]] = re.compile(r["pattern"], re.S)
                keep.append(compiled[r["pattern"]].search(r["host"] + r["path"] if r["listed"] else r["whole"]) is not None)
            yield batch.select(["url", "name", "verdict", "listed"]).filter(pa.array(keep, pa.bool_()))

    parts = urls.mapInArrow(cut, "url string, host string, path string, whole string, tokens array<string>")
    met = parts.withColumn("t", F.explode("tokens")).join(table, "t").select("url", "host", "path", "whole", "name", "verdict", "pattern", "listed")
    best = met.mapInArrow(hold, "url string, name string, verdict string, listed boolean").groupBy("url").agg(F.min_by(F.struct("name", "verdict", "listed"), F.struct(~F.col("listed"), -F.length("name"), "name")).alias("r"))
    found = parts.select("url", "host", "path").join(best, "url", "left")
    found = pages.select(F.col(key).alias("key"), F.col(url).alias("url")).join(found.withColumnRenamed("url", "u"), F.col("url").eqNullSafe(F.col("u")), "left")
    listed = F.col("r.listed")
    return found.select(F.col("key").alias(key), "host", "path", F.when(listed, F.col("r.name")).alias("rule"), F.coalesce(F.col("r.verdict"), F.lit(default)).alias("verdict"), F.when(~listed, F.col("r.name")).alias("pattern"))


def _sql_rules() -> str:
    general = [r for r in DEFAULT if not r.listed]
    # DuckDB folds letters beyond A-Z as well; these patterns are in small letters and meet text with A-Z in small letters
    return ", ".join("('{}', '{}', '{}')".format(*(x.replace("'", "''") for x in (r.name, r.verdict, r.pattern.removeprefix("(?ai)")))) for r in general)


#: The same judgement in DuckDB's SQL.
ORACLE_SQL = rf"""
WITH parts AS (
  SELECT page_id,
    CASE WHEN strpos(url, '://') > 0 THEN translate(regexp_extract(substr(url, strpos(url, '://') + 3), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path,
    CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*[^?#]*([^#]*)', 1) ELSE '' END AS query
  FROM pages),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule,
    translate(host || path || query, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS whole
  FROM parts),
judged AS (
  SELECT *, (SELECT [name, verdict] FROM (VALUES {_sql_rules()}) t(name, verdict, pattern) WHERE whole <> '' AND regexp_matches(whole, pattern) ORDER BY length(name) DESC, name LIMIT 1) AS general FROM ruled)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' ELSE coalesce(general[2], 'allow') END AS verdict,
  CASE WHEN rule IS NULL THEN general[1] END AS pattern
FROM judged"""
