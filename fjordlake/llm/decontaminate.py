"""Benchmark decontamination by suffix arrays over the training texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .text import ALNUM, Words, chunks, exact, hard_hashes, lowered, same_words, words

_KEY_BITS = 63

MATCH_TYPE = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("hit_starts", T.ArrayType(T.LongType())),
        T.StructField("hit_ends", T.ArrayType(T.LongType())),
        T.StructField("longest", T.LongType()),
        T.StructField("longest_item", T.StringType()),
        T.StructField("longest_start", T.LongType()),
    ]
)


class TestSuffixes:
    """One block of the benchmark: every suffix of every item, cut to a window, as word numbers.

    Word numbers start at 1 and follow the hashes of the block's words, which are told apart by their bytes;
    0 stands for any other word and for the end of a text.
    """

    def __init__(self, items: list[tuple[str, str]], window: int):
        texts = pa.array([text for _, text in items], pa.large_string())
        found = words(texts, ALNUM, hard_hashes)
        self.window = window
        _, first, ids = np.unique(exact(found, texts), return_index=True, return_inverse=True)
        order = np.argsort(found.hashes[first], kind="stable")
        self.vocabulary = found.hashes[first[order]]
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(1, len(order) + 1)
        ids = number[ids]
        spans = [lowered(texts, found.starts[i], found.ends[i]) for i in first[order].tolist()]
        self.spelled, self.spell_at = b"".join(spans), np.cumsum([0, *map(len, spans)])
        self.bits = max(1, int(len(self.vocabulary)).bit_length())
        rows, lengths, owner, place = [], [], [], []
        for i, (a, b) in enumerate(zip(found.rows[:-1], found.rows[1:])):
            if b > a:
                width = min(window, b - a)
                for t in range(a, b - width + 1):
                    rows.append(np.pad(ids[t : t + width], (0, window - width)))
                    lengths.append(width)
                    owner.append(i)
                    place.append(t - a)
        self.names = [name for name, _ in items]
        table = np.array(rows, np.int64).reshape(-1, window)
        self.patterns, self.group = np.unique(table, axis=0, return_inverse=True)
        self.group = self.group.ravel()
        self.lengths = (self.patterns > 0).sum(1)
        self.shortest = int(self.lengths.min()) if len(self.lengths) else 0
        order = np.argsort(self.group, kind="stable")
        self.owner, self.place = np.array(owner, np.int64)[order], np.array(place, np.int64)[order]
        self.members = np.searchsorted(self.group[order], np.arange(len(self.patterns) + 1))
        self.keys = pack(self.patterns.T, self.bits)
        full = (1 << self.bits) - 1
        self.masks = pack(np.where(self.patterns > 0, full, 0).T, self.bits)

    def word_ids(self, found: Words, column: pa.Array) -> np.ndarray:
        """The number of each word found: that of a word of one hash and, as hashes may meet, the same bytes."""
        ids = np.zeros(len(found.hashes), np.int64)
        if not len(self.vocabulary):
            return ids
        at = np.minimum(np.searchsorted(self.vocabulary, found.hashes), len(self.vocabulary) - 1)
        todo = np.flatnonzero(self.vocabulary[at] == found.hashes)
        while len(todo):
            same = same_words(found, column, todo, self.spelled, self.spell_at, at[todo])
            ids[todo[same]] = at[todo[same]] + 1
            todo = todo[~same]  # go on to the next word of this hash
            at[todo] += 1
            todo = todo[at[todo] < len(self.vocabulary)]
            todo = todo[self.vocabulary[at[todo]] == found.hashes[todo]]
        return ids


def pack(columns, bits: int) -> list[np.ndarray]:
    """Word numbers side by side in as few integers as hold them; they compare as the words do."""
    per = max(1, _KEY_BITS // bits)
    columns = list(columns)
    out = []
    for a in range(0, len(columns), per):
        part = columns[a : a + per]
        key = np.zeros(len(part[0]), np.int64)
        for column in part:
            key = (key << bits) | column
        out.append(key << bits * (per - len(part)))
    return out


class SuffixArray:
    """Sorted suffixes of one shard of training texts, compared on their first ``window`` words.

    Suffixes that cannot begin a match, as fewer than ``shortest`` words of
    the benchmark's own words follow in their text, are left out.
    """

    def __init__(self, ids: np.ndarray, block: TestSuffixes):
        run = run_lengths(ids > 0)
        start = np.flatnonzero(run >= block.shortest)
        padded = np.concatenate([ids, np.zeros(block.window, ids.dtype)])
        keys = pack((padded[start + j] for j in range(block.window)), block.bits)
        order = np.lexsort(keys[::-1])
        self.suffixes = start[order]
        self.keys = [k[order] for k in keys]

    def bound(self, block: TestSuffixes, after: bool) -> np.ndarray:
        """Binary search for every test suffix at once: first suffix not before it, or past its matches."""
        n = len(block.patterns)
        low, high = np.zeros(n, np.int64), np.full(n, len(self.suffixes), np.int64)
        for _ in range(int(len(self.suffixes)).bit_length()):
            open_ = low < high
            middle = np.where(open_, (low + high) >> 1, 0)
            left = np.zeros(n, bool)
            tied = np.ones(n, bool)
            for key, want, mask in zip(self.keys, block.keys, block.masks):
                have = key[middle] & mask
                left |= tied & (have < want)
                tied &= have == want
            left = open_ & ((left | tied) if after else left)
            low = np.where(left, middle + 1, low)
            high = np.where(open_ & ~left, middle, high)
        return low


def run_lengths(flags: np.ndarray) -> np.ndarray:
    """How many true values follow at each place, itself included."""
    n = len(flags)
    stop = np.where(flags, n, np.arange(n))
    return np.minimum.accumulate(stop[::-1])[::-1] - np.arange(n)


def spread(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All of ``starts[i] .. starts[i] + counts[i] - 1``, and the i of each."""
    owner = np.repeat(np.arange(len(counts)), counts)
    first = np.cumsum(counts) - counts
    return starts[owner] + np.arange(len(owner)) - first[owner], owner


def _search(column: pa.Array, block: TestSuffixes) -> list[dict]:
    """Matches of one shard's texts with the block: a MATCH_TYPE dict per row."""
    found = words(column, ALNUM, hard_hashes)
    n_rows = len(column)
    # a zero after each row keeps suffixes inside their text
    ids = np.zeros(len(found.hashes) + n_rows, np.int64)
    row_of = found.row_of()
    ids[np.arange(len(found.hashes)) + row_of] = block.word_ids(found, column)
    shifted = found.rows[:-1] + np.arange(n_rows)
    out = [
        {"n_words": int(c), "n_hit": 0, "items": [], "hit_starts": [], "hit_ends": [], "longest": 0}
        for c in found.counts()
    ]
    if not len(block.patterns):
        return out
    array = SuffixArray(ids, block)
    if not len(array.suffixes):
        return out
    low, high = array.bound(block, False), array.bound(block, True)
    seen = np.flatnonzero(high > low)
    if not len(seen):
        return out
    at, which = spread(low[seen], (high - low)[seen])
    position, pattern = array.suffixes[at], seen[which]
    cover = np.zeros(len(ids) + 1, np.int64)
    np.add.at(cover, position, 1)
    np.add.at(cover, position + block.lengths[pattern], -1)
    hit = np.cumsum(cover)[:-1] > 0
    edges = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    for r, a, b in zip((np.searchsorted(shifted, starts, "right") - 1).tolist(), starts.tolist(), ends.tolist()):
        out[r]["n_hit"] += b - a
        out[r]["hit_starts"].append(a - int(shifted[r]))
        out[r]["hit_ends"].append(b - int(shifted[r]))
    # every (item, place) that has the window, beside every place in the texts
    member, of = spread(block.members[pattern], np.diff(block.members)[pattern])
    item, place, position, length = block.owner[member], block.place[member], position[of], block.lengths[pattern][of]
    row = np.searchsorted(shifted, position, "right") - 1
    # windows that follow each other in both texts are one longer match
    order = np.lexsort((position, position - place, item))
    item, place, position, length, row = (x[order] for x in (item, place, position, length, row))
    fresh = np.ones(len(item), bool)
    fresh[1:] = (np.diff(item) != 0) | (np.diff(position) != 1) | (np.diff(position - place) != 0)
    first = np.flatnonzero(fresh)
    last = np.concatenate([first[1:], [len(item)]]) - 1
    matched = position[last] + length[last] - position[first]
    pairs = np.unique(np.stack([row[first], item[first]]), axis=1)
    for r, i in pairs.T.tolist():
        out[r]["items"].append(block.names[i])
    for j in np.argsort(-matched, kind="stable")[::-1].tolist():  # the longest is written last
        r = int(row[first[j]])
        out[r] |= {
            "longest": int(matched[j]),
            "longest_item": block.names[int(item[first[j]])],
            "longest_start": int(position[first[j]] - shifted[r]),
        }
    return out


def _join(old: dict | None, new: dict) -> dict:
    """What two blocks of the benchmark found in one text."""
    if not old:
        return new
    if not new["items"]:
        return old
    spans = sorted([*zip(old["hit_starts"], old["hit_ends"]), *zip(new["hit_starts"], new["hit_ends"])])
    merged: list[list[int]] = []
    for a, b in spans:
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    longer = new if new["longest"] > old["longest"] else old
    return {
        "n_words": new["n_words"],
        "n_hit": sum(b - a for a, b in merged),
        "items": [*old["items"], *new["items"]],
        "hit_starts": [a for a, _ in merged],
        "hit_ends": [b for _, b in merged],
        **{k: longer.get(k) for k in ("longest", "longest_item", "longest_start")},
    }


def benchmark_blocks(
    benchmark: DataFrame, item_col: str, text_col: str, most_bytes: int
) -> Iterator[list[tuple[str, str]]]:
    """The items in blocks whose texts come to about ``most_bytes`` at most."""
    rows = benchmark.select(
        F.coalesce(F.col(f"`{item_col}`").cast("string"), F.lit("null")), F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    )
    block: list[tuple[str, str]] = []
    size = 0
    for name, text in rows.toLocalIterator():
        if block and size + len(text) > most_bytes:
            yield block
            block, size = [], 0
        block.append((name, text))
        size += len(text)
    if block:
        yield block


def find_matches(
    docs: DataFrame,
    benchmark: DataFrame,
    keep: list[str],
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 10,
    block_bytes: int = 8 << 20,
    out: str = "matches",
) -> DataFrame:
    """Columns ``keep`` of ``docs`` and a struct ``out`` of verbatim benchmark matches.

    Each task cuts its texts into shards and builds a suffix array of each;
    every suffix of every item, cut to ``window`` words, is binary-searched in
    all of them. Windows that follow each other make the longest matches.
    The benchmark is taken in blocks of ``block_bytes`` of text, each
    broadcast and searched in all texts in one more pass without a shuffle,
    so what is broadcast has a fixed bound whatever the benchmark's size.

    ``out`` has n_words, n_hit (words inside a match), items (those found,
    distinct, sorted as strings), hit_starts and hit_ends (word spans, in order and
    apart), longest, longest_item and longest_start (the longest match, 0 and
    null without one). An item shorter than the window, but not empty, is one
    window. Null and empty texts have no words and no matches; null item ids
    are named "null"; items that share an id count once; rows of ``docs``
    that repeat are answered each for itself; extra columns are ignored
    unless named in ``keep``.
    """
    sc = docs.sparkSession.sparkContext
    carried = list(dict.fromkeys([*keep, text_col]))
    # positions, not names, so that columns may have any names
    names = [f"c{i}" for i in range(len(carried))]
    text = names[carried.index(text_col)]
    current = docs.select(*[F.col(f"`{c}`") for c in carried]).toDF(*names)
    current = current.withColumn("found", F.lit(None).cast(MATCH_TYPE))
    blocks = benchmark_blocks(benchmark, item_col, item_text_col, block_bytes)
    items = next(blocks, [])
    while items is not None:
        after = next(blocks, None)
        last = after is None
        gone = {text} if last and text_col not in keep else set()
        fields = [f for f in current.schema.fields if f.name not in gone]
        current = current.mapInArrow(
            _searcher(sc.broadcast(TestSuffixes(items, window)), text, fields, last), T.StructType(fields)
        )
        items = after
    return current.toDF(*keep, out)


def _searcher(held, text: str, fields: list[T.StructField], last: bool):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = to_arrow_schema(T.StructType(fields))
        for part in chunks(batches, text):
            old = part.column("found").to_pylist()
            both = [_join(o, x) for o, x in zip(old, _search(part.column(text), held.value))]
            if last:
                both = [x | {"items": sorted(set(x["items"]))} for x in both]
            columns = [
                pa.array(both, f.type) if f.name == "found" else part.column(f.name).cast(f.type) for f in kind
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=kind)

    return search


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its words, how many are hit, and by which items. See :func:`find_matches`."""
    found = find_matches(docs, benchmark, [id_col], text_col)
    m = F.col("matches")
    return found.select(
        F.col(f"`{id_col}`"),
        m.n_words.alias("n_words"),
        m.n_hit.alias("n_hit"),
        F.size(m["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(m["items"], ",").cast("binary"), 256).alias("items_sha256"),
        (m.n_hit > 0).alias("contaminated"),
        m.longest.alias("longest_match"),
        m.longest_item.alias("longest_item"),
        m.longest_start.alias("longest_start"),
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that have no benchmark window."""
    columns = docs.columns
    plain = [f"d{i}" for i in range(len(columns))]
    found = find_matches(docs.toDF(*plain), benchmark, plain, plain[columns.index(text_col)], out="__matches")
    return found.where("__matches.n_hit = 0").drop("__matches").toDF(*columns)

