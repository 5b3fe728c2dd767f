"""A Merkle manifest: digests of all rows, of their groups and of the table, with a proof for each row.

A row's leaf is the digest of its fields. The leaves of a group ascend by id;
every ``arity`` consecutive nodes become one until one is left, the group's
subroot, and subroots in order of their groups likewise give the root.

The tree is cut at one height. Below it, blocks of ``arity ** height`` leaves
are reduced by tasks; of each block only its root reaches the driver, which
builds the few levels above and broadcasts for each block the path from its
root to the subroot. Tasks then finish the proof of every row. The height is
taken from the number of rows so that at most ``2 * top_nodes`` block roots
exist, which bounds what the driver holds and what is broadcast.

Digests are sha256 in lowercase hex, of inputs that are concatenated.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterable, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import broadcast_if_small, discard, join_groups, materialize

_STEP = T.StructType([T.StructField("left", T.StringType()), T.StructField("right", T.StringType())])
#: From a node up: what stands left and right of it in its run, once for each level.
PROOF = T.ArrayType(_STEP)
_FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _digest(parts: Iterable[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field_text(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(values: Iterable[Column]) -> Column:
    """The digest of a row's fields."""
    return F.sha2(F.concat(*[field_text(v) for v in values]), 256)


def fold(start: Column, proof: Column) -> Column:
    """The root that a leaf and the digests of its proof lead to."""
    return F.aggregate(proof, start, lambda node, step: F.sha2(F.concat(step["left"], node, step["right"]), 256))


def proof_digest(proof: Column) -> Column:
    """The digest of a proof's siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda step: F.concat(step["left"], step["right"])), ""), 256)


def levels(nodes: list[str], arity: int, height: int | None = None) -> list[list[str]]:
    """Nodes and all that is above them, up to one node or, if given, just as many levels."""
    out = [nodes]
    while len(nodes) > 1 if height is None else len(out) <= height:
        nodes = [_digest(nodes[i : i + arity]) for i in range(0, len(nodes), arity)]
        out.append(nodes)
    return out


def _sides(level: list[str], arity: int) -> tuple[list[str], list[str]]:
    left, right = [], []
    for i in range(len(level)):
        a = i - i % arity
        left.append("".join(level[a:i]))
        right.append("".join(level[i + 1 : a + arity]))
    return left, right


def _paths(tree: list[list[str]], arity: int) -> list[list[tuple[str, str]]]:
    """For each node of the lowest level its steps up to the top."""
    out: list[list[tuple[str, str]]] = [[] for _ in tree[0]]
    for k, level in enumerate(tree[:-1]):
        left, right = _sides(level, arity)
        for i, path in enumerate(out):
            path.append((left[i // arity**k], right[i // arity**k]))
    return out


def _numbered(rows: DataFrame) -> DataFrame:
    """Adds each row's place in its group ``g`` by ``id`` and ``leaf``, and the group's size.

    Sorted ranges are numbered on their own; what stands before a range in a
    group comes from a table of one row for each range and group.
    """
    sorted_rows = rows.repartitionByRange("g", "id", "leaf", "tie").sortWithinPartitions("g", "id", "leaf", "tie")
    at = F.monotonically_increasing_id()
    placed = materialize(sorted_rows.drop("tie").withColumn("at", at).withColumn("range", F.shiftright("at", 33)), "placed")
    counts = placed.groupBy("g", "range").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    whole = Window.partitionBy("g")
    before = whole.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        "g", "range", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.sum("n").over(whole).alias("size")
    )
    found = placed.join(broadcast_if_small(materialize(starts, "starts")), ["g", "range"])
    return found.withColumn("place", F.col("at") - F.col("first") + F.col("before")).drop("at", "first", "before", "range")


def _in_block(arity: int, height: int, suffixes=None):
    """Of one block: its root, or with suffix paths every row's proof within its group."""

    def reduce(key: tuple[pa.Scalar, ...], block: pa.Table) -> pa.Table:
        block = block.sort_by("place")
        group, number = key[0].as_py(), key[1].as_py()
        several = block["size"][0].as_py() > arity**height
        tree = levels(block["leaf"].to_pylist(), arity, height if several else None)
        if suffixes is None:
            return pa.table({"g": [group], "block": [number], "root": tree[-1], "several": [several]})
        left, right, first = [], [], []
        for level in tree[:-1]:
            first.append(len(left))
            for all_, some in zip((left, right), _sides(level, arity)):
                all_.extend(some)
        above = suffixes.value[group, number] if several else []
        first_above = len(left)
        left.extend(a for a, _ in above)
        right.extend(b for _, b in above)
        rows, row = block.num_rows, np.arange(block.num_rows)
        steps = [first[k] + row // arity**k for k in range(len(first))]
        steps += [np.full(rows, first_above + k) for k in range(len(above))]
        flat = pa.array(np.stack(steps, 1).ravel() if steps else np.empty(0, np.int64))
        each = pa.array(np.arange(rows + 1) * len(steps), pa.int32())
        sides = [pa.array(x, pa.string()).take(flat) for x in (left, right)]
        proof = pa.ListArray.from_arrays(each, pa.StructArray.from_arrays(sides, ["left", "right"]))
        return block.drop_columns(["block", "place", "size"]).append_column("within", proof)

    return reduce


def _tree(rows: DataFrame, arity: int, top_nodes: int, least_height: int) -> tuple[DataFrame, DataFrame]:
    """Rows with their proofs up to their group's subroot (``within``), and a table of subroots."""
    spark = rows.sparkSession
    numbered = _numbered(rows)
    count = rows.count()
    height = least_height
    while count > top_nodes * arity**height:
        height += 1
    numbered = materialize(numbered.withColumn("block", F.floor(F.col("place") / F.lit(arity**height)).cast("long")), "numbered")
    blocks = numbered.select("g", "block", "place", "size", "leaf").groupBy("g", "block")
    roots = materialize(
        blocks.applyInArrow(_in_block(arity, height), "g string, block long, root string, several boolean"), "roots"
    )
    upper: dict[str, list[tuple[int, str]]] = defaultdict(list)
    for r in roots.where("several").select("g", "block", "root").toLocalIterator():  # at most 2 * top_nodes
        upper[r.g].append((r.block, r.root))
    suffixes, subroots = {}, []
    for g, found in upper.items():
        tree = levels([root for _, root in sorted(found)], arity)
        subroots.append((g, tree[-1][0]))
        suffixes.update({(g, k): path for k, path in enumerate(_paths(tree, arity))})
    suffix_paths = spark.sparkContext.broadcast(suffixes)
    schema = T.StructType([f for f in numbered.schema if f.name not in ("block", "place", "size")]).add("within", PROOF)
    proved = numbered.groupBy("g", "block").applyInArrow(_in_block(arity, height, suffix_paths), schema)
    tops = spark.createDataFrame(subroots, "g string, subroot string")
    tops = roots.where("NOT several").select("g", F.col("root").alias("subroot")).unionByName(tops)
    return proved, materialize(tops, "subroots")


def _joined_groups(subroots: DataFrame, arity: int, top_nodes: int, least_height: int) -> DataFrame:
    """The root over all groups and the proof of each subroot (``above``)."""
    spark = subroots.sparkSession
    if subroots.count() <= top_nodes:
        found = sorted((r.g, r.subroot) for r in subroots.collect())
        tree = levels([x for _, x in found], arity)
        rows = [(g, x, tree[-1][0], path) for (g, x), path in zip(found, _paths(tree, arity))]
        return materialize(
            spark.createDataFrame(rows, T.StructType.fromDDL("g string, subroot string, root string").add("above", PROOF)), "tops"
        )
    leaves = subroots.select(F.lit("").alias("g"), F.col("g").alias("id"), F.col("subroot").alias("leaf"), F.lit(0).alias("tie"))
    proved, root = _tree(leaves, arity, top_nodes, least_height)
    return materialize(
        proved.crossJoin(F.broadcast(root.select(F.col("subroot").alias("root")))).select(  # one row
            F.col("id").alias("g"), F.col("leaf").alias("subroot"), "root", F.col("within").alias("above")
        ),
        "tops",
    )


def merkle_manifest(
    docs: DataFrame,
    id_col: str = "doc_id",
    group_col: str = "lang",
    fields: Iterable[str] = _FIELDS,
    also: Mapping[str, Column] | None = None,
    arity: int = 2,
    top_nodes: int = 1 << 14,
    least_height: int = 12,
) -> DataFrame:
    """Each row's leaf, its group's subroot, the root and the proof that leads from one to the other.

    Returns ``id_col, leaf, subroot, root, proof`` and the columns of
    ``also``, expressions over the rows of ``docs`` that go along; ``proof``
    is of type :data:`PROOF`, for :func:`fold`. A node without others in its
    run has a step with two empty sides, as it is hashed alone.

    Null ids come first in their group, null groups first of all; fields that
    are null count as such. Rows that repeat an id are in the order of their
    leaves, so rows that are equal in all fields are interchangeable. A group
    of one row has its leaf as subroot. An empty table gives an empty result.
    Columns that are not in ``fields`` are ignored.
    """
    also, fields = dict(also or {}), list(fields)
    group = F.col(f"`{group_col}`").cast("string")
    leaves = materialize(
        docs.select(
            F.coalesce(F.concat(F.lit("="), group), F.lit("")).alias("g"),
            F.col(f"`{id_col}`").alias("id"),
            leaf(F.col(f"`{f}`") for f in fields).alias("leaf"),
            F.monotonically_increasing_id().alias("tie"),
            *[column.alias(f"also{k}") for k, column in enumerate(also.values())],
        ),
        "leaves",
    )
    proved, subroots = _tree(leaves, arity, top_nodes, least_height)
    discard(leaves)
    tops = _joined_groups(subroots, arity, top_nodes, least_height)
    return join_groups(proved, tops, "g").select(
        F.col("id").alias(id_col), "leaf", "subroot", "root", F.concat("within", "above").alias("proof"),
        *[F.col(f"also{k}").alias(name) for k, name in enumerate(also)],
    )


def tampered(docs: DataFrame, id_col: str = "doc_id", count_col: str = "n_chars", fields: Iterable[str] = _FIELDS) -> Column:
    """The leaf of a row whose count was raised by 1 if 7 divides crc32 of its id, else its leaf; nulls stay."""
    more = (F.col(f"`{count_col}`").cast("decimal(20,0)") + 1).cast("string")
    hit = F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 7 == 0
    changed = F.when(hit, more).otherwise(F.col(f"`{count_col}`").cast("string"))
    return leaf(changed if f == count_col else F.col(f"`{f}`") for f in fields)


def verified_manifest(docs: DataFrame) -> DataFrame:
    """Of every document digests of its leaf and proof, and whether its leaf, tampered with for some, still leads to the root."""
    rows = merkle_manifest(docs, also={"other": tampered(docs)})
    folded = rows.withColumn("folded_root", fold(F.col("other"), F.col("proof")))
    return folded.select(
        "doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
