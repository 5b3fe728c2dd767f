"""Jaccard join of documents on word shingles: a size-aware heavy-light join."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .list_links import all_links, link_lists
from .storage import broadcast_if_small, discard, join_groups, materialize
from .text import SPACE, chunks, distinct_by_row, exact, hard_hashes, mix, shingles, words

_SUBSET = 2
_MOST_COMMON = 1 << 20
_LEAST_COMMON = 4
_CHUNK = 2 << 20
#: Sets above this size are large whatever the costs; a boundary there never pays.
_MOST_SUBSET_SIZE = 256
#: Words of 64 bits of a set's bitmap.
_BITMAP = 4


def overlap_needed(n, numerator: int, denominator: int):
    """Fewest common elements of a set of size n with a partner at the threshold."""
    return -(-n * numerator // denominator)


def shingle_sets(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, and where each row starts."""
    return distinct_by_row(*shingles(words(column, SPACE, hard_hashes), width), len(column))


def set_digests(flat: np.ndarray, at: np.ndarray) -> list[bytes]:
    """16 bytes for each set, the same for equal sets: a digest of its sorted elements, which nobody can steer."""
    raw = memoryview(np.ascontiguousarray(flat, "<u8")).cast("B")
    bounds = (np.asarray(at) * 8).tolist()
    return [hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(bounds, bounds[1:])]


def bitmaps(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """``_BITMAP`` words for each set, in which each element turns one bit over.

    Two sets differ in as many elements as their bitmaps in bits, or more.
    """
    out = np.zeros((len(at) - 1, _BITMAP), np.uint64)
    place = mix(flat) % np.uint64(64 * _BITMAP)
    row, bit = np.repeat(np.arange(len(at) - 1), np.diff(at)), np.uint64(1) << (place & np.uint64(63))
    np.bitwise_xor.at(out.ravel(), row * _BITMAP + (place >> np.uint64(6)).astype(np.int64), bit)
    return out.view(np.int64)


def choose_boundary(sizes: dict[int, int], scanned: float, numerator: int, denominator: int) -> int:
    """The largest size that counts as small: where subsets cost less than scanning lists.

    A small set costs one row per subset; a large one costs a row per prefix
    element and the ``scanned`` others found in that element's list. All
    sizes up to the boundary are small, so costs are summed up to each.
    """
    best, at, gain = 0.0, 0, 0.0
    for n in sorted(s for s in sizes if s > 0):
        prefix = n - overlap_needed(n, numerator, denominator)
        subsets = (prefix + 2) * (prefix + 1) / 2 if n > 1 else 1
        gain += sizes[n] * ((prefix + 1) * (1 + scanned) - subsets)
        if gain > best:
            best, at = gain, n
    return at


def _common_shingles(docs: DataFrame, width: int, numerator: int, denominator: int):
    """Shingles that many texts hold (sorted, at most ``_MOST_COMMON``) and the boundary of small sets.

    A task counts, in each run of texts, the shingles that occur in two or
    more of them, equal sets once; the counts are summed over all texts. The
    least count is chosen so that the number of common shingles is bounded:
    there are at most (sum of counts) / (least count).
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text", _CHUNK):
            flat, at = shingle_sets(part.column("text"), width)
            n = np.diff(at)
            _, first = np.unique(set_digests(flat, at), return_index=True)
            once = np.zeros(len(n), bool)
            once[first] = True
            token, df = np.unique(flat[np.repeat(once, n)], return_counts=True)
            token, df = token[df > 1].view(np.int64), df[df > 1]
            size, many = np.unique(n, return_counts=True)
            kind = np.repeat([0, 1], [len(token), len(size)]).astype(np.int32)
            columns = [kind, np.concatenate([token, size]), np.concatenate([df, many])]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["kind", "key", "n"])

    counted = docs.select("text").mapInArrow(count, "kind int, key long, n long")
    counted = materialize(counted.groupBy("kind", "key").agg(F.sum("n").alias("n")), "common")
    by_size = counted.where("kind = 1 AND key > 0")
    sizes = {r.key: r.n for r in by_size.where(F.col("key") <= _MOST_SUBSET_SIZE).collect()}
    total = by_size.agg(F.sum(F.col("key") * F.col("n"))).first()[0] or 1
    row = counted.where("kind = 0").agg(F.sum("n"), F.count(F.lit(1))).first()
    least = max(_LEAST_COMMON, -(-(row[0] or 0) // _MOST_COMMON))
    found = counted.where((F.col("kind") == 0) & (F.col("n") >= least)).select("key").toArrow()
    common = np.sort(found.column("key").to_numpy().astype(np.int64).view(np.uint64))
    rest = counted.where((F.col("kind") == 0) & (F.col("n") < least))
    others = rest.agg(F.sum(F.col("n").cast("double") * (F.col("n") - 1))).first()[0] or 0.0
    return common, choose_boundary(sizes, others / total, numerator, denominator)


def _keys(flat, at, common, boundary: int, numerator: int, denominator: int):
    """Blocking keys of each set, as values and where each set's begin.

    Elements are taken in one global order, common ones last. A set's prefix
    is so long that two sets at the threshold share an element of both
    prefixes, and ``_SUBSET`` elements of prefixes longer by one less. Small
    sets give every ``_SUBSET``-element subset of that longer prefix; large
    ones give each element of theirs. Small sets that a large one may match
    give their elements also, to stand in the lists that large ones scan.
    """
    n = np.diff(at)
    row = np.repeat(np.arange(len(n)), n)
    is_common = np.zeros(len(flat), bool)
    if len(common) and len(flat):
        is_common = common[np.minimum(np.searchsorted(common, flat), len(common) - 1)] == flat
    order = np.argsort(row * 2 + is_common, kind="stable")
    ranked = flat[order]
    place = np.arange(len(flat)) - at[:-1][row]
    spare = n - overlap_needed(n, numerator, denominator)
    listed = n >= overlap_needed(boundary + 1, numerator, denominator)
    kept = (place <= spare[row]) & listed[row]
    values, owners = [ranked[kept]], [row[kept]]
    small = np.flatnonzero((n <= boundary) & (n > 0))
    long_prefix = np.minimum(n[small], spare[small] + _SUBSET)
    for p in np.unique(long_prefix).tolist():
        rows = small[long_prefix == p]
        taken = ranked[at[:-1][rows][:, None] + np.arange(p)]
        size = _SUBSET if p >= _SUBSET else 1
        for chosen in combinations(range(p), size):
            key = np.full(len(rows), np.uint64(0xA5A5A5A5 + size))
            for j in chosen:
                key = mix(key ^ taken[:, j])
            values.append(key)
            owners.append(rows)
    value, owner = np.concatenate(values), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return value[order], np.searchsorted(owner[order], np.arange(len(n) + 1))


def _signed(docs: DataFrame, width: int, common, boundary: int, numerator: int, denominator: int) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(common)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text", _CHUNK):
            flat, at = shingle_sets(part.column("text"), width)
            value, starts = _keys(flat, at, held.value, boundary, numerator, denominator)
            keys = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(value.view(np.int64)))
            bits = pa.ListArray.from_arrays(pa.array(np.arange(len(at)) * _BITMAP, pa.int32()), pa.array(bitmaps(flat, at).ravel()))
            columns = [part.column("doc_id"), pa.array(np.diff(at)), pa.array(set_digests(flat, at)), keys, bits]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "digest", "keys", "bits"])

    return docs.mapInArrow(sign, "doc_id long, n long, digest binary, keys array<long>, bits array<long>")


def _verified(pairs: DataFrame, docs: DataFrame, width: int, numerator: int, denominator: int) -> DataFrame:
    """The pairs ``a, b`` whose texts' shingle sets are at the threshold."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text_a", "text_b", _CHUNK):
            n = part.num_rows
            texts = pa.concat_arrays([part.column("text_a"), part.column("text_b")])
            found = words(texts, SPACE)
            found.hashes = mix(exact(found, texts).astype(np.uint64))  # the words themselves decide which are the same
            flat, at = distinct_by_row(*shingles(found, width), 2 * n)
            linked = []
            for i in range(n):
                x, y = flat[at[i] : at[i + 1]], flat[at[n + i] : at[n + i + 1]]
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(both > 0 and denominator * both >= numerator * (len(x) + len(y) - both))
            yield part.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    wanted = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    wanted = materialize(wanted, "wanted")
    texts = materialize(docs.join(broadcast_if_small(wanted), "doc_id", "left_semi"), "texts")
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b")
    links_ = materialize(both.mapInArrow(verify, "a long, b long").distinct(), "links")
    discard(wanted, texts)
    return links_


def links(docs: DataFrame, width: int, numerator: int, denominator: int, connect=link_lists) -> tuple[DataFrame, DataFrame]:
    """Documents ``doc_id, n, digest, rep`` and verified links ``a, b`` that connect all that are linked.

    ``rep`` is the smallest id with the same set. See :func:`.list_links.link_lists`
    for how the lists of keys are turned into pairs; with :func:`.list_links.all_links`
    as ``connect`` the links are all there are.
    """
    common, boundary = _common_shingles(docs, width, numerator, denominator)
    signed = materialize(_signed(docs, width, common, boundary, numerator, denominator), "signed")
    sets = signed.where("n > 0 AND doc_id IS NOT NULL")
    # most sets have one document; groups of more are looked up without gathering their rows
    groups = sets.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("c")).where("c > 1")
    groups = materialize(groups.select("digest", "least"), "groups")
    rep = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id")).alias("rep")
    members = materialize(join_groups(signed.select("doc_id", "n", "digest"), groups, "digest").select("digest", "doc_id", "n", rep), "members")
    # with each key go the two before it, which tell that two sets have met at an earlier key
    bits = [f"b{i}" for i in range(_BITMAP)]
    linked = F.expr(
        "transform(keys, (k, i) -> named_struct('key', k, 'p', if(i > 0, get(keys, i - 1), NULL), 'q', if(i > 1, get(keys, i - 2), NULL)))"
    )
    listed = sets.select("doc_id", "n", *[F.get("bits", F.lit(i)).alias(b) for i, b in enumerate(bits)], F.posexplode(linked).alias("place", "k"))
    # the smaller set of a pair has a common element even in a shorter prefix: it shares 2t/(1+t) of its elements or more
    early = F.col("place") <= F.col("n") - F.ceil(2 * numerator * F.col("n") / F.lit(numerator + denominator) - 1e-6)
    listed = listed.select("doc_id", "n", *bits, "k.key", "k.p", "k.q", ((F.col("n") <= boundary) | early).alias("early"))
    shared = listed.groupBy("key").agg(F.min("doc_id").alias("x"), F.max("doc_id").alias("y"), F.max("early").alias("early"))
    shared = shared.where("x < y AND early").select("key")
    rep_of = members.where("rep IS NOT NULL").select("doc_id", F.col("rep").alias("item")).distinct()
    postings = listed.join(shared, "key").join(rep_of, "doc_id").groupBy("key", "item")
    only = lambda c: F.when(F.min(c) == F.max(c), F.min(c)).alias(c)  # noqa: E731  texts that share an id may differ
    postings = postings.agg(only("n"), F.max("early").alias("early"), only("p"), only("q"), *[only(b) for b in bits])
    postings = materialize(postings.select("key", "item", F.struct("n", "early", "p", "q", *bits).alias("mark")), "postings")

    def fits(x, y):
        n, m = x["n"], y["n"]
        able = F.when(n < m, x["early"]).when(n > m, y["early"]).otherwise(x["early"] & y["early"])
        able &= F.least(n, m) * denominator >= F.greatest(n, m) * numerator
        # linked sets differ in at most (1 - t) / (1 + t) of the sum of their sizes
        apart = reduce(Column.__add__, [F.bit_count(x[b].bitwiseXOR(y[b])) for b in bits])
        able &= apart * (numerator + denominator) <= (n + m) * (denominator - numerator)
        return n.isNull() | m.isNull() | F.coalesce(able, F.lit(True))

    def met(x, y):  # in an earlier list, whose keys p and q name, both are early if they are in this one
        return F.coalesce(reduce(Column.__or__, [x[i] == y[j] for i in "pq" for j in "pq"]), F.lit(False))

    def screen(pairs):
        # two sets that share s elements of their prefixes share fewer than s + ceil(t * larger size) in all;
        # keys of small sets are subsets and say nothing of the number
        ids = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
        some = signed.select("doc_id", "n", "keys").join(broadcast_if_small(materialize(ids, "wanted")), "doc_id", "left_semi")
        some = materialize(some, "prefixes")
        both = pairs.join(some.toDF("b", "m", "keys_b"), "b").join(some.toDF("a", "n", "keys_a"), "a")
        n, m, s = F.col("n"), F.col("m"), F.size(F.array_intersect("keys_a", "keys_b"))
        need = F.ceil((n + m) * numerator / F.lit(numerator + denominator) - 1e-6)
        most = s + F.ceil(F.greatest(n, m) * numerator / F.lit(denominator) - 1e-6) - 1
        left = materialize(both.where((F.least(n, m) <= boundary) | (most >= need)).select("a", "b").distinct(), "pairs")
        discard(some)
        return left

    found = connect(
        postings, lambda pairs: _verified(pairs, docs, width, numerator, denominator), fits, met, screen
    )
    return members, found


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    numerator: int = 80,
    denominator: int = 100,
) -> DataFrame:
    """Components of documents whose shingle sets have a Jaccard similarity of numerator/denominator or more.

    Returns per row ``id_col, n_shingles, component_id`` (the smallest id
    reachable by links). A document with fewer than ``width`` words has its
    whole sequence as one shingle. Null and empty texts have no shingles and
    are linked with nothing. Rows that repeat an id are one document for
    links, which add up over its texts; rows without an id come back with a
    null component. Extra columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    members, found = links(rows, width, numerator, denominator)
    same = members.where("rep IS NOT NULL AND doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    label = components(reduce(DataFrame.unionByName, [same, found.select("a", "b")]))
    joined = members.join(label.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return joined.select(
        F.col("doc_id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def near_links(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    numerator: int = 80,
    denominator: int = 100,
) -> tuple[DataFrame, DataFrame]:
    """All links, and each row's number of them, at the level of distinct shingle sets.

    A class is the rows with an id and one set, named by the set's digest in
    hexadecimal. Returns the links ``a, b, n_a, n_b`` of different classes at
    the threshold, with their sizes in rows, and per row ``id_col, class_id,
    n_links``: the other rows of its class and all rows of linked classes. No
    row is gone, whether texts that share an id differ or not. Rows without
    shingles or an id have no class and no links.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text", _CHUNK):
            flat, at = shingle_sets(part.column("text"), width)
            able = pa.array(np.diff(at) > 0)
            names = pa.array([d.hex() for d in set_digests(flat, at)], pa.string())
            named = pa.compute.if_else(able, names, pa.scalar(None, pa.string()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text"), named], names=["doc_id", "text", "class_id"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    named = rows.mapInArrow(digest, "doc_id long, text string, class_id string")
    of_class = named.where("doc_id IS NOT NULL AND class_id IS NOT NULL").groupBy("class_id")
    sets = of_class.agg(F.count(F.lit(1)).alias("size"), F.first("text").alias("text"))
    sets = materialize(sets.withColumn("doc_id", F.monotonically_increasing_id()), "sets")
    _, found = links(sets.select("doc_id", "text"), width, numerator, denominator, all_links)
    sizes = sets.select("doc_id", "class_id", "size")
    pairs = found.join(sizes.toDF("a", "class_a", "n_a"), "a").join(sizes.toDF("b", "class_b", "n_b"), "b")
    pairs = pairs.select(F.least("class_a", "class_b").alias("a"), F.greatest("class_a", "class_b").alias("b"),
                         F.when(F.col("class_a") < F.col("class_b"), F.col("n_a")).otherwise(F.col("n_b")).alias("n_a"),
                         F.when(F.col("class_a") < F.col("class_b"), F.col("n_b")).otherwise(F.col("n_a")).alias("n_b"))
    pairs = materialize(pairs, "links")
    ends = pairs.select(F.col("a").alias("class_id"), F.col("n_b").alias("m")).unionByName(
        pairs.select(F.col("b").alias("class_id"), F.col("n_a").alias("m"))
    )
    linked = ends.groupBy("class_id").agg(F.sum("m").alias("m"))
    count = sets.select("class_id", "size").join(linked, "class_id", "left")
    count = count.select("class_id", (F.col("size") - 1 + F.coalesce("m", F.lit(0))).alias("n_links"))
    member = named.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("class_id")).alias("class_id"))
    out = member.join(count, "class_id", "left")
    return pairs, out.select(F.col("doc_id").alias(id_col), "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each component of near-duplicate rows the one of the smallest id, with all its columns.

    Rows without an id stay, and so do those without words. Rows that repeat
    an id are told apart by their texts: of equal or near ones one stays, a
    different text under the same id is a row of its own.
    """
    columns = docs.columns
    plain = docs.toDF(*[f"d{i}" for i in range(len(columns))])
    own, text = F.col(f"d{columns.index(id_col)}").cast("long"), F.col(f"d{columns.index(text_col)}")
    if plain.where(own.isNotNull()).groupBy(own.alias("id")).count().where("count > 1").isEmpty():
        found = materialize(near_duplicates(docs, id_col, text_col).toDF("id", "n", "component"), "near")
        gone = found.where("component <> id").select("id")
    else:
        plain = materialize(plain.withColumn("own", own).withColumn("row", F.monotonically_increasing_id()), "numbered")
        own = F.col("row")
        found = near_duplicates(plain.where("own IS NOT NULL").select("row", text.alias("text")), "row", "text")
        found = materialize(found.toDF("id", "n", "component"), "near")
        by_id = found.join(plain.select(F.col("row").alias("id"), "own"), "id")
        kept = by_id.groupBy("component").agg(F.min(F.struct("own", "id")).alias("k")).select("component", "k.id")
        gone = found.join(kept, ["component", "id"], "left_anti").select("id")
    gone = broadcast_if_small(materialize(gone, "gone"))
    left = plain.join(gone, own == F.col("id"), "left_anti")
    return left.select(*[f"d{i}" for i in range(len(columns))]).toDF(*columns)
