import random

import numpy as np
from pyspark.sql import functions as F

from fjordlake.llm import jaccard_join as J
from fjordlake.llm.components import components
from fjordlake.llm.list_links import link_lists


def test_copies_that_are_linked_with_a_part_of_their_group(spark):
    """In a list of copies a third of all pairs is linked, and so are the pairs of some small groups beside them."""
    n, groups = 500, 20
    key = F.lit(7).cast("long").alias("key")
    postings = spark.range(n + 3 * groups).select(key, F.col("id").alias("item"), F.col("id").alias("mark")).repartition(4)
    asked = []

    def verify(pairs):
        asked.append(pairs.count())
        near = (F.col("b") < n) & (F.pmod(F.xxhash64("a", "b"), F.lit(3)) == 0)
        return pairs.where(near | (F.col("a") >= n) & (F.floor((F.col("a") - n) / 3) == F.floor((F.col("b") - n) / 3)))

    able = lambda x, y: (x < n) == (y < n)
    label = {r.node: r.component for r in components(link_lists(postings, verify, able)).collect()}
    assert label == {i: 0 if i < n else i - (i - n) % 3 for i in range(n + 3 * groups) if 0 < i < n or i >= n and (i - n) % 3}
    assert sum(asked) < 20 * (n + 3 * groups)


def test_texts_of_different_size_that_share_an_id(spark):
    r = random.Random(5)
    short, long = [f"s{i}" for i in range(30)], [f"l{r.randrange(10**6)}" for _ in range(200)]
    rows = [(5, " ".join(short)), (5, " ".join(long)), (7, " ".join([*short[:-1], "other"]))]
    got = {(r.doc_id, r.component_id) for r in J.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(5, 5), (7, 5)}


def test_bitmaps_differ_in_no_more_bits_than_sets_in_elements():
    r = np.random.default_rng(3)
    for size, other in [(0, 5), (40, 3), (300, 60), (2000, 1500)]:
        x = r.integers(0, 1 << 63, size, np.uint64)
        y = np.concatenate([x[: size // 2], r.integers(0, 1 << 63, other, np.uint64)])
        a, b = J.bitmaps(np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)]))
        bits = sum(bin(int(v)).count("1") for v in (a ^ b).view(np.uint64))
        assert bits <= len(np.setxor1d(x, y))
        assert bits > 0
