"""Mixing sources to target weights by iterative proportional fitting, with DataFrame functions only.

A token is a run of letters or digits. Topics come from the data: of all words of
``TOPIC_LETTERS`` letters or more, counted over all documents, the ``TOPICS`` that most documents
hold, but not more than ``TOPIC_MOST`` of all documents do, name a topic each; a
document's topic is the one it holds most often (ties to the more frequent word), or
``other``. Tokens are summed over all documents by (source, language, topic). The
cells' weights, first a share ``keep`` of their tokens, are raked in turn to
target sums by source, by language and by topic, and cut to a cell's own tokens
after each step, until no weight moves by more than ``TOLERANCE`` of its tokens; a mix
that still moves after ``ROUNDS`` rounds of sweeps raises. What the targets ask for and what the weights
give is told by :func:`marginals`: cells can't give more than their tokens, so some
targets may be out of reach. A document is kept with probability weight / tokens of
its cell. Whether it is kept follows from SHA-256 of seed, key and text: the same on
every run, and apart for copies under other keys.

Targets are shares of each dimension: a dict (values it doesn't name divide what
is left by their tokens; without such values the named ones are scaled to 1), or a
number as exponent: shares in proportion to tokens**exponent, so 1 keeps a dimension as
it is and 0 makes its values equal. Values in ``FREE`` (documents of no topic) have no
target; the others of their dimension keep the share of tokens they have together.

Results for odd input: nulls in source or language are a value of their own; a
null or empty text counts one token and has the topic ``other``; an empty table gives an
empty result; repeated rows count each and are kept or left together; columns of the
input pass through as they are, and columns that are added take a free name
(``topic_`` where the input has a ``topic``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import checkpointed, unused

DIMENSIONS = ("source", "lang", "topic")
TARGETS = {"source": 0.5, "lang": {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1}, "topic": 0.7}
#: Values without a target of their own: no step scales them.
FREE = {"topic": ("other",)}
KEEP = 0.6
TOPICS, TOPIC_LETTERS, TOPIC_MOST = 24, 4, 0.02
#: One in so many words may name a topic: each, whatever it is set to.
TOPIC_SHARE = 1
#: Up to this many, and this many times the values of all dimensions, the cells are raked in one task, and are broadcast to the documents; beyond, sums by value are joined to them.
SMALL_CELLS, SMALL_WORK = 50_000, 10_000_000
#: Sweeps between looks at how far weights move, in one task and in joins; rounds of those; the share of a cell's tokens by which the last sweep may move it.
SWEEPS, SWEEPS_APART, ROUNDS, TOLERANCE = 100, 3, 60, 1e-3
ADDED = ("topic", "n_tokens", "probability", "kept")
WORD = r"[^\p{L}\p{N}]+"


def words_of(text: Column) -> Column:
    return F.split(F.lower(F.coalesce(text, F.lit(""))), WORD)


def named_words(words: Column) -> Column:
    """Those of the words that may name a topic."""
    return F.filter(words, lambda w: F.length(w) >= TOPIC_LETTERS)


def topic_words(documents: DataFrame, text: str = "text", topics: int = TOPICS) -> list[str]:
    """The words that name topics, the most frequent first; at most ``topics`` of them reach the driver."""
    rows = documents.select(F.array_distinct(named_words(words_of(F.col(text)))).alias("w"))
    most = rows.count() * TOPIC_MOST
    found = rows.select(F.explode("w").alias("w")).groupBy("w").count().where(F.col("count") <= most)
    return [r["w"] for r in found.orderBy(F.desc("count"), "w").limit(topics).collect()]


def described(documents: DataFrame, names: list[str], text: str, topic: str, tokens: str) -> DataFrame:
    """documents with their topic and number of tokens."""
    words = unused("_words", *documents.columns, topic, tokens)
    known = F.array(*map(F.lit, names)).cast("array<string>")

    def best(found: Column) -> Column:
        # how often each topic's word stands there; the first of the highest
        times = F.transform(known, lambda t, i: F.struct(F.size(F.filter(found, lambda w: w == t)).alias("n"), (-i).alias("i"), t.alias("t")))
        top = F.array_max(F.filter(times, lambda x: x["n"] > 0))
        return F.coalesce(top["t"], F.lit("other"))

    rows = documents.withColumn(words, words_of(F.col(text)))
    found = F.filter(F.col(words), lambda w: w.isin(names))
    topic_of = F.get(F.transform(F.array(found), best), F.lit(0)) if names else F.lit("other")
    return rows.withColumns({topic: topic_of, tokens: F.greatest(F.lit(1), F.size(F.filter(F.col(words), lambda w: w != ""))).cast("long")}).drop(words)


def _value(column: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit("null"))


def _let(value: Column, body) -> Column:
    """body(value) with value computed once, also inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _swept(cells: DataFrame, sweeps: int) -> DataFrame:
    """cells with weight and before (that of one sweep less) after some sweeps: all cells are one row, and sweeps are folds over its arrays."""
    whole = cells.agg(F.array_sort(F.collect_list(F.struct(*cells.columns))).alias("cells"))
    number = F.sequence(F.lit(0), F.size("cells") - 1)
    # arrays of their own: a field of an array of structs would be drawn out of all of them at each look
    for c in cells.columns:
        whole = whole.withColumn(f"c{c}", F.transform("cells", lambda x: x[c]))  # noqa: B023
    for d in DIMENSIONS:
        whole = whole.withColumn(f"v_{d}", F.array_sort(F.array_distinct(F.col(f"c_{d}")))).withColumn(f"at_{d}", F.transform(f"c_{d}", lambda x: (F.array_position(f"v_{d}", x) - 1).cast("int")))  # noqa: B023
        # the cells of each value
        whole = whole.withColumn(f"of_{d}", F.transform(f"v_{d}", lambda v: F.filter(number, lambda i: F.get(f"c_{d}", i) == v)))  # noqa: B023

    def step(weight: Column, d: str) -> Column:
        held = F.transform(f"of_{d}", lambda cells_: F.aggregate(cells_, F.lit(0.0), lambda sum_, i: sum_ + F.get(weight, i)))

        def scaled(sums: Column) -> Column:
            def one(w: Column, i: Column) -> Column:
                target, sum_ = F.get(f"ct_{d}", i), F.get(sums, F.get(f"at_{d}", i))
                moved = F.when(sum_ > 0, F.least(F.get("ctokens", i).cast("double"), w * target / sum_)).otherwise(0.0)
                return F.when(target.isNull(), w).otherwise(moved)

            return F.transform(weight, one)

        return _let(held, scaled)

    def sweep(state: Column, _: Column) -> Column:
        moved = _let(step(state["now"], "source"), lambda w: _let(step(w, "lang"), lambda x: step(x, "topic")))
        return F.struct(moved.alias("now"), state["now"].alias("before"))

    first = F.col("cweight")
    whole = whole.where(F.size("cells") > 0).withColumn("state", F.aggregate(F.sequence(F.lit(1), F.lit(sweeps)), F.struct(first.alias("now"), first.alias("before")), sweep))
    rows = whole.select(F.explode(F.arrays_zip("cells", "state.now", "state.before")).alias("x"))
    return rows.select(*(F.col(f"x.cells.{c}").alias(c) for c in cells.columns if c != "weight"), F.col("x.now").alias("weight"), F.col("x.before").alias("before"))


def _swept_apart(cells: DataFrame, sweeps: int) -> DataFrame:
    """The same with a sum by value and a join for each step, for any number of cells."""
    df = cells
    for _ in range(sweeps):
        df = df.withColumn("before", F.col("weight"))
        for d in DIMENSIONS:
            df = df.join(df.groupBy(f"_{d}").agg(F.sum("weight").alias("held")), f"_{d}")
            moved = F.when(F.col("held") > 0, F.least(F.col("tokens").cast("double"), F.col("weight") * F.col(f"t_{d}") / F.col("held"))).otherwise(0.0)
            df = df.withColumn("weight", F.when(F.col(f"t_{d}").isNull(), F.col("weight")).otherwise(moved)).drop("held")
    return df


def rake(cells: DataFrame, targets: dict | None = None, keep: float = KEEP, small: bool | None = None, free: dict | None = None) -> DataFrame:
    """cells (_source, _lang, _topic, tokens) with weight: between 0 and tokens, raked to the targets t_source, t_lang and t_topic (null: none)."""
    targets, free = TARGETS | (targets or {}), FREE if free is None else free
    cells = checkpointed(cells)
    size = cells.agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"), *(F.count_distinct(f"_{d}").alias(d) for d in DIMENSIONS)).first()
    small = size["n"] <= SMALL_CELLS and size["n"] * sum(size[d] for d in DIMENSIONS) <= SMALL_WORK if small is None else small
    total = float(size["tokens"] or 0)
    df = cells
    for d in DIMENSIONS:
        wanted = targets[d]
        bound = ~F.col(f"_{d}").isin([f"={x}" for x in free.get(d, ())])
        shares = cells.where(bound).groupBy(f"_{d}").agg(F.sum("tokens").alias("own"))
        named = F.create_map(*(F.lit(x) for k, v in wanted.items() for x in ("=" + str(k), float(v)))) if isinstance(wanted, dict) and wanted else F.lit(None).cast("map<string,double>")
        exponent = 1.0 if isinstance(wanted, dict) else float(wanted)
        shares = shares.select(f"_{d}", "own", F.element_at(named, F.col(f"_{d}")).alias("given"), F.pow(F.col("own") / (total or 1.0), F.lit(exponent)).alias("power"))
        sums = shares.agg(F.sum("own").alias("own"), F.sum("given").alias("given"), F.sum(F.when(F.col("given").isNull(), F.col("power"))).alias("open")).first()
        given = sums["given"] or 0.0
        scale = 1 / given if given > 1 or given and not sums["open"] else 1.0
        share = F.coalesce(F.col("given") * F.lit(scale), F.lit(max(0.0, 1 - given * scale)) * F.col("power") / F.lit(sums["open"] or 1.0))
        df = df.join(shares.select(f"_{d}", (share * F.lit(float(sums["own"] or 0) * keep)).alias(f"t_{d}")), f"_{d}", "left")
    df = checkpointed(df.withColumn("weight", F.col("tokens") * F.lit(keep)))
    sweeps = SWEEPS if small else SWEEPS_APART
    for _ in range(ROUNDS):
        df = checkpointed(_swept(df, sweeps) if small else _swept_apart(df, sweeps))
        if (df.agg(F.max(F.abs(F.col("weight") - F.col("before")) / F.col("tokens")).alias("x")).first()["x"] or 0) < TOLERANCE:
            return df.drop("before")
        df = df.drop("before")
    raise RuntimeError(f"the weights still move after {ROUNDS * sweeps} sweeps")


def marginals(raked: DataFrame) -> DataFrame:
    """(dimension, value, tokens, target, achieved) of raked cells: what each value has, should and will give."""
    parts = [raked.groupBy(F.lit(d).alias("dimension"), F.col(f"_{d}").alias("value")).agg(F.sum("tokens").alias("tokens"), F.first(f"t_{d}").alias("target"), F.sum("weight").alias("achieved")) for d in DIMENSIONS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def mix(documents: DataFrame, targets: dict | None = None, keep: float = KEEP, seed: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """documents with topic, n_tokens, probability and kept (see :func:`added` for their names)."""
    topic, tokens, probability, kept = added(documents)
    taken = [*documents.columns, topic, tokens, probability, kept]
    own = {d: unused(f"_{d}", *taken) for d in DIMENSIONS}
    docs = described(documents, topic_words(documents, text), text, topic, tokens)
    docs = docs.withColumns({own[d]: _value(topic if d == "topic" else d) for d in DIMENSIONS})
    cells = docs.groupBy(*(F.col(own[d]).alias(f"_{d}") for d in DIMENSIONS)).agg(F.sum(tokens).alias("tokens"))
    raked = rake(cells, targets, keep)
    weights = raked.select(*(F.col(f"_{d}").alias(own[d]) for d in DIMENSIONS), (F.col("weight") / F.col("tokens")).alias(probability))
    if raked.count() <= SMALL_CELLS:
        weights = F.broadcast(weights)
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(text), F.lit(""))), 256)
    draw = F.conv(F.substring(drawn, 1, 13), 16, 10).cast("double") * F.lit(2.0**-52)
    docs = docs.join(weights, [own[d] for d in DIMENSIONS]).withColumn(kept, draw < F.col(probability))
    return docs.select(*(f"`{c}`" for c in documents.columns), topic, tokens, probability, kept)


def added(documents: DataFrame) -> list[str]:
    """The names of the columns that :func:`mix` adds."""
    return [unused(x, *documents.columns) for x in ADDED]


def sample(documents: DataFrame, **options) -> DataFrame:
    """The documents that are kept, with their own columns only."""
    return mix(documents, **options).where(F.col(added(documents)[-1])).drop(*added(documents))
