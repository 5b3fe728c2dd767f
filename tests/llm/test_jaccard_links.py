from collections import Counter

from test_jaccard_join import corpus, shingles

from fjordlake.llm import jaccard_join as J


def test_every_link_is_returned(spark):
    rows = [*corpus(3, 200), (9001, None), (9002, ""), (None, "a b c d e f"), (7001, "q w e r t y"), (7002, "Q w e r t y"), (7001, corpus(3, 3)[2][1])]
    sets = [frozenset(shingles(t)) for _, t in rows]
    linked = lambda x, y: bool(x and y) and 100 * len(x & y) >= 80 * len(x | y)
    able = [k for k, (i, _) in enumerate(rows) if i is not None and sets[k]]
    want = sorted((i or 0, sum(linked(sets[k], sets[j]) for j in able if j != k) if k in able else 0) for k, (i, _) in enumerate(rows))
    distinct = {sets[k] for k in able}
    n_pairs = sum(linked(x, y) for x in distinct for y in distinct if x != y) // 2
    pairs, counts = J.near_links(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert pairs.count() == pairs.select("a", "b").distinct().count() == n_pairs
    got = counts.collect()
    assert sorted((r.doc_id or 0, r.n_links) for r in got) == want
    size = Counter(r.class_id for r in got if r.class_id)
    assert len(size) == len(distinct) and all(r.n_a == size[r.a] and r.n_b == size[r.b] for r in pairs.collect())
