"""Mixing of sources to target weights, with column functions only.

Each row gets a hash-random key; a source takes its rows in key order up to its budget. Keys are
uniform, so their leading bits cut a source into ranges of even size. Sums per range (combined
before the shuffle) and prefix sums over the ranges tell in which range a budget ends; only the
rows of that range are put in order. Every other row compares its key with its source's cut, so
texts are never sorted and a source that holds a third of all rows is no hot key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import all_columns, comparable, kept_aside, n_words, unused, without, words

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
KEY_BITS, RANGE_BITS = 48, 16
#: Sources up to which their plan, one narrow row each, is given to every task; and into how
#: many parts a source's rows are dealt beyond that.
MAX_SOURCES, SALTS = 20_000, 64


def random_key(seed: int = 0, column: str = "doc_id") -> Column:
    """Uniform bits from the row's id, the same in every run; a null id is an id like others."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(column).cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, KEY_BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """(source, source_size, target) from one row per source (source, source_size).

    Sources in code point order, null last, weigh ``weights``, repeating, and share the sum of
    all sizes; a target stops at ``most`` times its source's size, and what is cut off is shared
    again by weight among the others until none is above. That comes to one level for all:
    target = min(most * size, level * weight). Going through the sources in the order of
    limit / weight, the first one that the level of what is left doesn't lift above its limit
    fixes it. The table has a row per source, not per document.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    at = ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")
    weighed = sizes.select(
        "source", "source_size", (F.col("source_size") * most).alias("limit"),
        F.element_at(F.array(*map(F.lit, weights)), at).cast("long").alias("weight"),
    )
    by_limit = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").isNull(), "source")
    earlier = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_limit.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everywhere = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rest = F.sum("source_size").over(everywhere) - F.coalesce(F.sum("limit").over(earlier), F.lit(0))
    steps = weighed.select("*", F.row_number().over(by_limit).alias("step"), rest.alias("rest"), F.sum("weight").over(onward).alias("share"))
    fits = F.col("rest") * F.col("weight") <= F.col("limit") * F.col("share")
    fixed = F.min(F.when(fits, F.struct("step", "rest", "share"))).over(everywhere)
    level = fixed["rest"] * F.col("weight") / fixed["share"]
    return steps.select("source", "source_size", F.least(F.col("limit").cast("double"), level).alias("target"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3, seed: int = 0) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, source, ...) with size, source_size, target, copies,
    part_words and taken.

    size is the number of words (null text: 0). A row is taken whole ``copies`` times, and one
    row per source with its first ``part_words`` words besides, so that the taken words of a
    source with words are exactly floor(target): all rows floor(target / size) times, and once
    more those first in key order until the budget is used up. No row gives more than ``most``
    times its size. Rows of equal key follow by doc_id, then by a hash of the other columns;
    identical rows at the cut share what is left evenly, rounded down. A null source is a
    source, the last one; a null doc_id is an id like others. An empty table gives no rows.
    Columns of ``docs`` named like the new ones are replaced.
    """
    new = ("size", "source_size", "target", "copies", "part_words", "taken")
    docs = without(docs, new)
    at, s, c, cut_at, cut_part, copies_of, salted = unused(docs, "_at", "_s", "_c", "_cut", "_part", "_whole", "_salt")
    ties = F.xxhash64(*[comparable(docs, name) for name in docs.columns if name != "source"])
    place = F.struct(random_key(seed).alias("key"), "doc_id", ties.alias("tie"))
    rows = docs.select(*all_columns(docs), n_words(F.col("text")).alias("size"), place.alias(at))
    narrow = rows.select("source", "size", F.col(at).alias("_at"), F.shiftright(F.col(at)["key"], KEY_BITS - RANGE_BITS).alias("range"))

    ranges = narrow.groupBy("source", "range").agg(F.sum("size").alias("words"))
    sizes = ranges.groupBy("source").agg(F.sum("words").alias("source_size"))
    targets = source_targets(sizes, weights, most)
    budget = F.floor("target")
    whole = F.when(F.col("source_size") > 0, F.expr("floor(target) div source_size")).otherwise(F.lit(0))
    targets = targets.select("*", whole.alias("whole"), (budget - whole * F.col("source_size")).alias("rest"))

    by_range = Window.partitionBy("source").orderBy("range")
    ends = ranges.select("*", F.sum("words").over(by_range).alias("until"))
    t = targets.select(F.col("source").alias(s), "rest")
    own = F.col("source").eqNullSafe(F.col(s))
    ending = ends.join(t, own).where("until - words <= rest and rest < until")
    ending = ending.select(s, F.col("range").alias("_r"), (F.col("rest") - F.col("until") + F.col("words")).alias("rest"))

    last = narrow.join(ending, own & (F.col("range") == F.col("_r"))).groupBy("source", "rest", "_at", "size").agg(F.count(F.lit(1)).alias("same"))
    inside = Window.partitionBy("source").orderBy("_at", "size")
    last = last.select("*", F.sum(F.col("same") * F.col("size")).over(inside).alias("until"))
    before = F.col("until") - F.col("same") * F.col("size")
    cut = last.where((before <= F.col("rest")) & (F.col("rest") < F.col("until")))
    cut = cut.select(F.col("source").alias(c), F.col("_at").alias(cut_at), F.expr("(rest - until + same * size) div same").alias(cut_part))
    plan = targets.withColumnRenamed("whole", copies_of).drop("rest").join(cut, F.col("source").eqNullSafe(F.col(c)), "left").drop(c).withColumnRenamed("source", s)

    # one row per source: every task gets the plan, unless there are very many sources
    plan = kept_aside(plan)
    if plan.count() <= MAX_SOURCES:
        joined = rows.join(F.broadcast(plan), own)
    else:  # a hot source's rows meet copies of its row in several tasks
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias(salted)
        salt = F.pmod(F.col(at)["key"], F.lit(SALTS)).cast("int")
        joined = rows.join(plan.select("*", salts), own & (salt == F.col(salted)))
    first = F.coalesce(F.col(at) < F.col(cut_at), F.lit(False))
    out = joined.select(
        *all_columns(docs), "size", "source_size", "target",
        (F.col(copies_of) + first.cast("int")).cast("long").alias("copies"),
        F.when(F.col(at) == F.col(cut_at), F.least("size", cut_part)).otherwise(F.lit(0)).cast("long").alias("part_words"),
    )
    return out.withColumn("taken", F.col("copies") * F.col("size") + F.col("part_words"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3, seed: int = 0) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row per copy taken; the row that ends a
    budget has its leading words, joined by one space, as text (and their length as n_chars)."""
    # the helpers' names are kept apart from those of the documents, which mixed() would replace
    inner = docs.select(F.col("doc_id"), F.col("text"), F.col("source"), F.struct(all_columns(docs)).alias("row"))
    plan = mixed(inner, weights, most, seed)
    part = F.array_join(F.slice(words(F.col("text")), 1, F.col("part_words").cast("int")), " ")
    copies = F.sequence(F.lit(0), F.col("copies").cast("int"))
    wanted = F.filter(copies, lambda i: (i < F.col("copies")) | (F.col("part_words") > 0))
    rows = plan.select("*", F.explode(wanted).alias("copy"))
    cut = (F.col("copy") == F.col("copies")) & (F.col("part_words") > 0)
    changed = {"text": F.when(cut, part).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(cut, F.length(part).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row")["n_chars"])
    return rows.select(*[(changed[c] if c in changed else F.col("row").getField(c)).alias(c) for c in docs.columns])
