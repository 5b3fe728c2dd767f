"""Language-model scores of texts by a probabilistic suffix tree over words."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, materialize, shuffled
from .text import SPACE, chunks, hard_hashes, mix, words

#: Stands for the end of a text, as a token and as the context of the first word.
END = np.uint64(0x0E0D0E0D0E0D0E0D)
_MERGE = 3_000_000
_PARTS = 4
#: Of a continuation: its context and token, how often it is met, the token's share and probability by shorter states, its name.
_ROW = ["context", "symbol", "n", "parent", "shorter", "name"]


@dataclass(frozen=True)
class Limits:
    """Least shares of all training tokens; each bounds a table by its inverse.

    A token below ``common`` is counted and scored exactly, alone and after
    every context, but by joins; a context of one token needs ``symbol``, one
    of two tokens needs ``context`` and both tokens ``symbol``: these are the
    least probabilities that a suffix tree asks of its contexts. A
    continuation below ``entry`` has its exact share in its state too, but by
    a join. ``gain`` is the divergence, in
    nats per occurrence times occurrences, that a context must show from the
    next shorter one, beside a nat for each symbol that follows it.
    """

    common: float = 2.0**-20
    symbol: float = 1e-5
    context: float = 4e-6
    entry: float = 5e-7
    gain: float = 10.0
    discount: float = 0.6


def tokens_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's words and then its end; and where each row starts."""
    found = words(column, SPACE, hard_hashes)
    n = len(found.rows) - 1
    out = np.full(len(found.hashes) + n, END, np.uint64)
    out[np.arange(len(found.hashes)) + found.row_of()] = found.hashes
    return out, found.rows + np.arange(n + 1)


def find(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Where each key stands in ``sorted_keys``; -1 if nowhere."""
    if not len(sorted_keys):
        return np.full(len(keys), -1, np.int64)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == keys, at, -1)


def summed(parts: Iterable[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Batches ``key, n`` that count the keys of all parts, combined as far as memory allows."""

    def merge(held: list[tuple[np.ndarray, np.ndarray]]):
        keys, at = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
        return keys, np.bincount(at, np.concatenate([n for _, n in held]), len(keys)).astype(np.int64)

    held: list[tuple[np.ndarray, np.ndarray]] = []
    for part in parts:
        held.append(np.unique(part, return_counts=True))
        if sum(len(k) for k, _ in held) > _MERGE:
            held = [merge(held)]
            if len(held[0][0]) > _MERGE // 2:
                yield _counted(*held[0])
                held = []
    if held:
        yield _counted(*merge(held))


def _counted(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], names=["key", "n"])


class Tree:
    """States of contexts of one and two tokens, and what the scores of single tokens need.

    Contexts and symbols are numbered by ``symbols``, the common tokens, of
    which those that ``lead`` may be parts of contexts. A state has the share
    ``rest`` of its distribution that falls to the next shorter state, and
    for each token met after it a share of its own: frequent ones in
    ``shares``, the others in the table of :func:`grow_all`.
    """

    def __init__(self, common, counts, lead, total: int, distinct: int, singles: int, discount0: float):
        self.common, self.counts, self.symbols, self.lead = common, counts, common, lead
        self.total, self.distinct = total, distinct
        self.discount0 = discount0
        self.contexts: list[np.ndarray] = [np.empty(0, np.int64), np.empty(0, np.int64)]
        self.rest: list[np.ndarray] = [np.empty(0), np.empty(0)]
        self.keys: list[np.ndarray] = [np.empty(0, np.int64), np.empty(0, np.int64)]
        self.shares: list[np.ndarray] = [np.empty(0), np.empty(0)]

    def base(self, c):
        return (c + 1.0) / (self.total + self.distinct + 1.0)

    def order0(self, c):
        """Share of a token counted c times; of all tokens never met together, where c is 0."""
        unseen = max(self.discount0 * self.distinct, 0.5) / (self.total + 1.0)
        seen = np.maximum(c - self.discount0, 1e-9) / (self.total + 1.0)
        return np.where(np.asarray(c) > 0, seen, unseen)

    def numbers(self, tokens: np.ndarray) -> np.ndarray:
        return find(self.symbols, tokens)

    def contexts_at(self, number: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Context of one and of two tokens before each token; -1 where there is none. Texts start after an end."""
        end = int(find(self.symbols, np.array([END]))[0])
        one = np.empty(len(number), np.int64)
        one[1:], one[starts] = number[:-1], end
        if len(self.lead):
            one[~self.lead[one]] = -1  # one of no number, -1, stays so whatever the last says
        two = np.full(len(number), -1, np.int64)
        two[1:] = one[:-1]
        two[starts] = -1
        pair = np.where((one >= 0) & (two >= 0), two * len(self.symbols) + one, -1)
        return one, pair

    def names(self, k: int, context, number):
        """Of each context of k + 1 tokens and number, one long: below 0 for one token, else 0 or above."""
        key = context * len(self.symbols) + number
        return key if k else -1 - key

    def rare_names(self, k: int, context: np.ndarray, token: np.ndarray) -> np.ndarray:
        """As :meth:`names`, of tokens without a number."""
        return mix(token ^ mix((context if k else -1 - context).view(np.uint64))).view(np.int64)

    def multipliers(self, number: np.ndarray, starts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each order, of its state at each token: own share of the token, rest (0 and 1 without a state)."""
        return [(own, rest) for own, rest, *_ in self.looked_up(number, starts)]

    def looked_up(self, number: np.ndarray, starts: np.ndarray, tokens: np.ndarray | None = None) -> list[tuple[np.ndarray, ...]]:
        """As :meth:`multipliers`; and the tokens whose share is not here, with their names, those of ``tokens`` without a number too.

        Until their share is joined they have the rest alone.
        """
        out = []
        for k, context in enumerate(self.contexts_at(number, starts)):
            at = find(self.contexts[k], context)
            own, rest = np.zeros(len(number)), np.ones(len(number))
            has = np.flatnonzero(at >= 0)
            rest[has] = self.rest[k][at[has]]
            known = has[number[has] >= 0]
            spot = find(self.keys[k], at[known] * len(self.symbols) + number[known])
            own[known[spot >= 0]] = self.shares[k][spot[spot >= 0]]
            far = known[spot < 0]
            name = self.names(k, context[far], number[far])
            if tokens is not None:
                rare = has[number[has] < 0]
                far, name = np.append(far, rare), np.append(name, self.rare_names(k, context[rare], tokens[rare]))
            out.append((own, rest, far, name))
        return out


def _held_out(id_column):
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def _count(texts: DataFrame, keys_of) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return summed(keys_of(part.column("text")) for part in chunks(batches, "text", 8 << 20))

    return texts.mapInArrow(work, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _count_rare(texts: DataFrame, keys_of) -> DataFrame:
    """``name, context, token, n`` of continuations whose tokens have no number; ``keys_of`` gives the first three for each place."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text", 4 << 20):
            name, context, token = keys_of(part.column("text"))
            name, at, n = np.unique(name, return_index=True, return_counts=True)
            columns = [name, context[at], token[at].view(np.int64), n.astype(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["name", "context", "token", "n"])

    found = texts.mapInArrow(work, "name long, context long, token long, n long").groupBy("name")
    return found.agg(F.min("context").alias("context"), F.min("token").alias("token"), F.sum("n").alias("n"))


def _arrays(rows: DataFrame, *columns: str) -> list[np.ndarray]:
    found = rows.select(*columns).toArrow()
    return [found.column(c).to_numpy() for c in columns]


def grow(texts: DataFrame, limits: Limits) -> tuple[Tree, DataFrame]:
    """The tree of all training texts (a column ``text``), and the exact count of every token ``key, n``."""
    return grow_all(texts, limits)[:2]


def grow_all(texts: DataFrame, limits: Limits) -> tuple[Tree, DataFrame, DataFrame]:
    """As :func:`grow`, and what a continuation that is not in the tree adds to a score: ``key, more``.

    ``key`` is its name (:meth:`Tree.names`), ``more`` the log10 of its
    probability over the one it has by the rest of its state alone.
    """
    spark = texts.sparkSession
    counts = materialize(_count(texts, lambda column: tokens_of(column)[0]), "token_counts")
    row = counts.agg(F.sum("n"), F.count(F.lit(1)), F.sum((F.col("n") == 1).cast("long")), F.sum((F.col("n") == 2).cast("long"))).first()
    total, distinct, ones, twos = (int(x or 0) for x in row)
    key, n = _arrays(counts.where(F.col("n") >= limits.common * total), "key", "n")
    key = key.astype(np.int64).view(np.uint64)
    order = np.argsort(key)
    key, n = key[order], n[order].astype(np.int64)
    lead = n >= max(2.0, limits.symbol * total)
    tree = Tree(key, n, lead, total, distinct, ones, ones / (ones + 2.0 * twos) if ones + twos else 0.5)
    size, symbol_count = len(key), n

    # order 1: a context, then what follows it
    held = spark.sparkContext.broadcast(tree)

    def pairs(column: pa.Array) -> np.ndarray:
        tokens, at = tokens_of(column)
        number = held.value.numbers(tokens)
        one, _ = held.value.contexts_at(number, at[:-1])
        both = (one >= 0) & (number >= 0)
        return one[both] * size + number[both]

    def rare_pairs(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        tokens, at = tokens_of(column)
        number = held.value.numbers(tokens)
        one, _ = held.value.contexts_at(number, at[:-1])
        rare = (one >= 0) & (number < 0)
        return held.value.rare_names(0, one[rare], tokens[rare]), one[rare], tokens[rare]

    one = materialize(_count(texts, pairs), "pairs")
    rare_one = _count_rare(texts, rare_pairs).join(shuffled(counts.toDF("token", "c")), "token")
    rare_one = materialize(rare_one, "rare_pairs")
    alone = F.greatest(F.col("c") - tree.discount0, F.lit(1e-9)) / F.lit(total + 1.0)  # Tree.order0
    context = F.expr(f"key DIV {max(size, 1)}")
    symbol = F.col("key") % max(size, 1)
    # tables of symbols and of contexts are broadcast: the limits bound them
    of_symbol = F.broadcast(spark.createDataFrame(pa.table({
        "symbol": pa.array(np.arange(size)), "c": pa.array(symbol_count), "alone": pa.array(tree.order0(symbol_count)),
    })))
    joined = one.select(context.alias("context"), symbol.alias("symbol"), "n").join(of_symbol, "symbol")
    joined = joined.withColumns({"parent": F.col("c") / F.lit(float(max(total, 1))), "shorter": F.col("alone")})
    totals = F.broadcast(of_symbol.select(F.col("symbol").alias("context"), F.col("c").alias("all")))
    joined = joined.withColumn("name", tree.names(0, F.col("context"), F.col("symbol"))).select(*_ROW)
    rare = rare_one.withColumns({"symbol": F.lit(-1), "parent": F.col("c") / F.lit(float(max(total, 1))), "shorter": alone})
    states, more_one = _keep_states(tree, 0, joined.unionByName(rare.select(*_ROW)).join(totals, "context"), limits)

    # order 2: contexts that are frequent pairs
    pair_key, pair_n = _arrays(one.where(F.col("n") >= max(2.0, limits.context * total)), "key", "n")
    order = np.argsort(pair_key)
    pair_key, pair_n = pair_key[order].astype(np.int64), pair_n[order].astype(np.int64)
    wide = spark.sparkContext.broadcast((tree, pair_key))

    def triples(column: pa.Array) -> np.ndarray:
        tree_, frequent = wide.value
        tokens, at = tokens_of(column)
        number = tree_.numbers(tokens)
        _, two = tree_.contexts_at(number, at[:-1])
        place = np.where(number >= 0, find(frequent, two), -1)
        return place[place >= 0] * size + number[place >= 0]

    def rare_triples(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        tree_, frequent = wide.value
        tokens, at = tokens_of(column)
        number = tree_.numbers(tokens)
        _, two = tree_.contexts_at(number, at[:-1])
        place = np.where(number < 0, find(frequent, two), -1)
        rare = place >= 0
        return tree_.rare_names(1, two[rare], tokens[rare]), place[rare], tokens[rare]

    two = _count(texts, triples)
    of_pair = F.broadcast(spark.createDataFrame(
        pa.table({"context": pa.array(np.arange(len(pair_key))), "pair": pa.array(pair_key), "all": pa.array(pair_n)})
    ))
    rows = two.select(context.alias("context"), symbol.alias("symbol"), "n").join(of_pair, "context")
    rows = rows.withColumn("short", F.expr(f"(pair % {max(size, 1)}) * {size} + symbol"))
    below = one.select(F.col("key").alias("short"), F.col("n").alias("short_n"))
    triples_ = materialize(rows.join(below, "short").select("context", "symbol", "n", "short_n"), "triples")
    middle = F.col("pair") % max(size, 1)
    rows = triples_.join(of_pair, "context").withColumn("middle", middle).join(of_symbol.drop("c"), "symbol")
    rows = rows.withColumn("name", tree.names(1, F.col("pair"), F.col("symbol")))
    rare = _count_rare(texts, rare_triples).join(of_pair, "context").withColumn("middle", middle)
    below = rare_one.select(F.col("context").alias("middle"), "token", F.col("n").alias("short_n"), alone.alias("alone"))
    rare = rare.join(shuffled(below), ["middle", "token"]).withColumn("symbol", F.lit(-1))
    rare = materialize(rare.select(*rows.columns), "rare_triples")
    rows = rows.unionByName(rare)
    rows = rows.join(F.broadcast(totals.toDF("middle", "middle_all")), "middle")
    rows = rows.join(F.broadcast(states.toDF("middle", "middle_rest")), "middle", "left")
    own = F.greatest(F.col("short_n") - limits.discount, F.lit(0.0)) / F.col("middle_all")
    shorter = F.when(F.col("middle_rest").isNull(), F.col("alone")).otherwise(own + F.col("middle_rest") * F.col("alone"))
    rows = rows.withColumns({"parent": F.col("short_n") / F.col("middle_all"), "shorter": shorter})
    _, more_two = _keep_states(tree, 1, rows, limits)
    tree.contexts[1] = pair_key[tree.contexts[1]]
    more = materialize(more_one.unionByName(more_two), "more")
    discard(one, rare_one, triples_, rare)
    return tree, counts, more


def _keep_states(tree: Tree, k: int, rows: DataFrame, limits: Limits) -> tuple[DataFrame, DataFrame]:
    """Keeps the contexts whose next symbols diverge from the shorter context's by ``limits.gain`` in all.

    The divergence of a context sums over all tokens after it, with or without
    a number (``symbol`` is -1). Returns the
    kept contexts ``context, rest``, and ``key, more`` of all their
    continuations that are below ``limits.entry``; the others go to the tree.
    ``shorter`` is a symbol's probability by the shorter states.
    """
    share = F.col("n") / F.col("all")
    own = F.greatest(F.col("n") - limits.discount, F.lit(0.0))
    test = rows.groupBy("context").agg(
        F.sum(F.col("n") * F.log(share / F.col("parent"))).alias("own"),
        F.count(F.lit(1)).alias("symbols"),
        F.max("all").alias("all"),
        F.sum(own).alias("held"),
    )
    kept = test.where(F.col("own") >= limits.gain + F.col("symbols"))
    context, rest = _arrays(kept.select("context", ((F.col("all") - F.col("held")) / F.col("all")).alias("rest")), "context", "rest")
    order = np.argsort(context)
    tree.contexts[k], tree.rest[k] = context[order].astype(np.int64), rest[order].astype(np.float64)
    table = pa.table({"context": pa.array(tree.contexts[k]), "rest": pa.array(tree.rest[k])})
    states = F.broadcast(rows.sparkSession.createDataFrame(table))
    entries = rows.join(states, "context")
    frequent = (F.col("n") >= limits.entry * tree.total) & (F.col("symbol") >= 0)
    context, symbol, mine = _arrays(entries.where(frequent).select("context", "symbol", (own / F.col("all")).alias("mine")), "context", "symbol", "mine")
    keys = np.searchsorted(tree.contexts[k], context.astype(np.int64)) * len(tree.symbols) + symbol.astype(np.int64)
    order = np.argsort(keys)
    tree.keys[k], tree.shares[k] = keys[order], mine[order].astype(np.float64)
    more = F.log10(1 + own / F.col("all") / (F.col("rest") * F.col("shorter")))
    return states, entries.where(~frequent).select(F.col("name").alias("key"), more.alias("more"))


def _scored(rows: DataFrame, tree: Tree) -> DataFrame:
    """Scores of the common tokens of each row, its other tokens and continuations that the tree does not have, for joins."""
    held = rows.sparkSession.sparkContext.broadcast(tree)
    schema = "doc_id long, n_tokens long, known long, base double, score double, rare array<long>, far array<long>"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree_ = held.value
        for part in chunks(batches, "text", 2 << 20):
            tokens, at = tokens_of(part.column("text"))
            starts, n = at[:-1], np.diff(at)
            place = find(tree_.common, tokens)
            common = place >= 0
            c = np.where(common, tree_.counts[np.maximum(place, 0)] if len(tree_.counts) else 0, 0)
            number = tree_.numbers(tokens)
            p = tree_.order0(c)
            p[~common] = 1.0  # its own share comes by the join
            asked = []
            for own, rest, *far in tree_.looked_up(number, starts, tokens):
                p = own + rest * p
                asked.append(far)
            token, name = (np.concatenate(x) for x in zip(*asked))
            order = np.argsort(token, kind="stable")
            far = pa.ListArray.from_arrays(pa.array(np.searchsorted(token[order], at), pa.int32()), pa.array(name[order]))
            log_base = np.where(common, np.log10(tree_.base(c)), 0.0)
            total = lambda x: np.add.reduceat(x, starts) if len(starts) else x
            row = np.repeat(np.arange(len(n)), n)[~common]
            bounds = np.searchsorted(row, np.arange(len(n) + 1))
            rare = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(tokens[~common].view(np.int64)))
            columns = [
                part.column("doc_id"), pa.array(n), pa.array(total(common.astype(np.int64))),
                pa.array(total(log_base)), pa.array(total(np.log10(p))), rare, far,
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "known", "base", "score", "rare", "far"])

    return rows.mapInArrow(work, schema)


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limits: Limits | None = None) -> DataFrame:
    """log10 probabilities of all whole texts under a tree grown from those that are not held out.

    Words are lower-cased and split at white space; an end follows each text.
    Returns ``id_col, held_out`` (crc32 of the id mod 7 is 2), ``n_tokens,
    n_known, train_tokens, base_score`` (add-one unigram), ``score``.
    Contexts of up to two tokens are kept as states if they are frequent
    enough and their next-symbol distribution diverges from the shorter
    context's; each state's distribution is smoothed by the shorter state's.
    A token is scored by the longest state that its history ends in; a token
    never met takes the share that Good-Turing leaves to those.

    Frequent tokens, states and their frequent continuations are broadcast,
    with a bound for each table (see :class:`Limits`); all other tokens are
    scored by a join with their counts, keyed by the token, and all other
    continuations by a join with what they add, keyed by context and token. Null and empty texts are an end alone. A null
    id counts as not held out. Rows that repeat are scored each for itself.
    Extra columns are ignored; an empty table gives no rows.
    """
    limits = limits or Limits()
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    tree, counts, more = grow_all(rows.where(~_held_out(F.col("doc_id"))).select("text"), limits)
    numbered = materialize(_scored(rows, tree).withColumn("row", F.monotonically_increasing_id()), "scored")
    rare = numbered.select("row", F.explode("rare").alias("key")).groupBy("key", "row").agg(F.count(F.lit(1)).alias("m"))
    found = rare.join(counts, "key", "left").select("row", "m", F.coalesce("n", F.lit(0)).alias("c"))
    found = found.groupBy("row", "c").agg(F.sum("m").alias("m"))
    c, m = F.col("c"), F.col("m")
    share = F.when(c > 0, F.greatest(c - F.lit(tree.discount0), F.lit(1e-9)) / F.lit(tree.total + 1.0))
    share = share.otherwise(F.lit(float(tree.order0(np.array(0)))))
    sums = found.groupBy("row").agg(
        F.sum(F.when(c > 0, m).otherwise(0)).alias("more_known"),
        F.sum(m * F.log10((c + 1) / F.lit(tree.total + tree.distinct + 1.0))).alias("more_base"),
        F.sum(m * F.log10(share)).alias("more_score"),
    )
    asked = numbered.select("row", F.explode("far").alias("key"))
    # one part of the names after the other, as each is shuffled twice
    part = F.pmod("key", F.lit(_PARTS))
    added = [asked.where(part == i).join(shuffled(more.where(part == i)), "key").groupBy("row").agg(F.sum("more").alias("more")) for i in range(_PARTS)]
    added = reduce(DataFrame.unionByName, [materialize(rows, "added") for rows in added])
    added = added.groupBy("row").agg(F.sum("more").alias("more"))
    return numbered.join(sums, "row", "left").join(added, "row", "left").select(
        F.col("doc_id").alias(id_col),
        _held_out(F.col("doc_id")).alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(tree.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("more_score", F.lit(0.0)) + F.coalesce("more", F.lit(0.0))).alias("score"),
    )
