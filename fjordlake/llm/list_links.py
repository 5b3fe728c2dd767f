"""Links between items of inverted lists, without all pairs of a list."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .storage import discard, materialize

Fits = Callable[[Column, Column], Column]

def _pairs(entries: DataFrame, other: DataFrame, possible: Column) -> DataFrame:
    found = entries.join(other, "key").where(possible)
    return found.select(F.least("f.item", "item").alias("a"), F.greatest("f.item", "item").alias("b")).distinct()


def link_lists(
    postings: DataFrame,
    verify: Callable[[DataFrame], DataFrame],
    fits: Fits,
    met: Fits | None = None,
    screen: Callable[[DataFrame], DataFrame] | None = None,
    rounds: int = 6,
    hubs: int = 8,
) -> DataFrame:
    """Verified links ``a, b`` that connect all items of a list that are linked through candidates.

    ``postings`` has a row ``key, item, mark`` for each item of each list.
    ``fits(mark, other)`` says whether two entries of a list may be linked at
    all, ``met(mark, other)`` whether the two are in another list also that
    the pair is left to; ``screen`` drops pairs that cannot be linked before
    ``verify`` keeps the linked ones of some pairs ``a, b``.

    The links do not hold every pair: inside a list all items are verified
    against one, at first the smallest. Components follow from the links, and
    only lists whose items are still in several of them go on, in each round
    against ``hubs`` items drawn by hashes, half of them from the list's
    largest component, and only with items of other components. So a list costs at most ``hubs`` pairs for each of its items
    in a round, and where copies of copies are linked with a part of their
    group alone, a few draws still leave few of them apart. Rounds go on while each
    leaves less than half the pairs of the one before, ``rounds`` of them at
    most. When so few items are apart that pairs come to ``hubs`` times the
    entries of all lists, or when rounds no longer help, those that are not
    in their list's largest component meet all others of the list, so no pair
    is left out whose items are in different components.
    """
    found: DataFrame | None = None
    tried: DataFrame | None = None
    entries = postings.withColumn("part", F.col("item"))
    every, before = False, float("inf")
    for turn in range(rounds + 1):
        apart = (F.col("part") != F.col("f.part")) & fits(F.col("mark"), F.col("f.mark"))
        if every:
            minor = F.col("part") != F.col("main")
            other = entries.where(minor).select("key", F.struct("item", "mark", "part").alias("f"))
            left = ~met(F.col("mark"), F.col("f.mark")) if met else F.lit(True)
            pairs = _pairs(entries, other, apart & (~minor | (F.col("f.item") < F.col("item"))) & left)
        else:
            of_main = lambda j: F.lit(False) if j % 2 else F.col("part") != F.col("main")
            orders = [F.struct(of_main(j), F.xxhash64("item", F.lit(turn), F.lit(j))) for j in range(hubs)] if turn else [F.col("item")]
            drawn = [F.min(F.struct(order.alias("order"), "item", "mark", "part")) for order in orders]
            drawn = [F.struct(*[d[c].alias(c) for c in ("item", "mark", "part")]) for d in drawn]
            first = entries.groupBy("key").agg(F.array(*drawn).alias("drawn"))
            pairs = _pairs(entries, first.select("key", F.explode(F.array_distinct("drawn")).alias("f")), apart)
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = materialize(pairs, "pairs")
        links = verify(screen(pairs) if screen else pairs)
        found = links if found is None else found.unionByName(links)
        tried = pairs if tried is None else tried.unionByName(pairs)
        if every:
            return found
        label = components(found).withColumnRenamed("node", "item")
        labelled = entries.drop("part", "main").join(label, "item", "left").withColumn("part", F.coalesce("component", "item")).drop("component")
        sizes = labelled.groupBy("key", "part").agg(F.count(F.lit(1)).alias("n")).groupBy("key")
        sizes = sizes.agg(F.sum("n").alias("n"), F.max(F.struct("n", "part")).alias("top")).where("n > top.n")
        sizes = materialize(sizes.select("key", "n", F.col("top.part").alias("main"), (F.col("n") - F.col("top.n")).alias("minor")), "sizes")
        total = sizes.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("minor")).alias("pairs")).first()
        if total.n is None:
            return found
        again = materialize(labelled.join(sizes.select("key", "main"), "key"), "apart")
        if turn:
            discard(entries)
        discard(label, sizes)
        entries = again
        every = total.pairs <= hubs * total.n or 2 * total.pairs > before or turn == rounds - 1
        before = total.pairs
    return found


def all_links(
    postings: DataFrame,
    verify: Callable[[DataFrame], DataFrame],
    fits: Fits,
    met: Fits | None = None,
    screen: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Every verified link ``a, b``, a below b: as :func:`link_lists`, but with all pairs of each list."""
    other = postings.select("key", F.struct("item", "mark").alias("f"))
    possible = fits(F.col("mark"), F.col("f.mark")) & (F.col("f.item") < F.col("item"))
    if met:
        possible &= ~met(F.col("mark"), F.col("f.mark"))
    pairs = materialize(_pairs(postings, other, possible), "pairs")
    return verify(screen(pairs) if screen else pairs)
