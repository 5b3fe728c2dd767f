import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from fjordlake.llm import suffix_dedup as S

SCHEMA = "doc_id long, text string, spans string, key string"


def brute(rows, width):
    texts = [(i, (t or "").encode()) for i, t in rows]
    found = Counter(b[k : k + width] for _, b in texts for k in range(len(b) - width + 1))
    out = []
    for i, b in texts:
        covered = [False] * len(b)
        for k in range(len(b) - width + 1):
            if found[b[k : k + width]] > 1:
                covered[k : k + width] = [True] * width
        edges = [k for k in range(len(b) + 1) if (k < len(b) and covered[k]) != (k > 0 and covered[k - 1])]
        spans = tuple(zip(edges[::2], edges[1::2]))
        out.append((i, len(b), spans, bytes(c for c, gone in zip(b, covered) if not gone)))
    return sorted(out, key=repr)


def got(frame, **options):
    rows = S.repeated_strings(frame, **options).collect()
    return sorted(((r[0], r[1], tuple((s.start, s.end) for s in r[2]), bytes(r[3])) for r in rows), key=repr)


def segments(rng):
    letters = rng.choice((1, 2, 3, 256))
    parts = [bytes(rng.randrange(letters) for _ in range(rng.choice((0, 1, 6, 7, 8, 30, 90)))) for _ in range(rng.randrange(1, 8))]
    parts += rng.choices(parts, k=rng.randrange(3))
    at = np.cumsum([0, *map(len, parts)])
    return np.frombuffer(b"".join(parts), np.uint8), np.repeat(at[1:], np.diff(at))


@pytest.mark.parametrize("seed", range(60))
def test_suffix_array_and_common_prefixes(seed):
    data, ends = segments(random.Random(seed))
    if not len(data):
        return
    raw = data.tobytes()
    order = S.suffix_array(data, ends)
    assert order.tolist() == sorted(range(len(raw)), key=lambda i: (raw[i : ends[i]], i))
    shared = S.common_prefixes(data, ends, order)
    for a, b in zip(order[:-1].tolist(), order[1:].tolist()):
        x, y = raw[a : ends[a]], raw[b : ends[b]]
        k = next((k for k, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
        assert shared[b] == k
    assert shared[order[0]] == 0


@pytest.mark.parametrize("shard_bytes", [1 << 20, 2000, 400])
@pytest.mark.parametrize("width", [16, 50])
def test_against_brute_force(spark, width, shard_bytes):
    rng = random.Random(width)
    base = ["".join(rng.choice("abcdé ") for _ in range(300)) for _ in range(3)]
    rows = []
    for i in range(250):
        part = rng.choice(base)[rng.randrange(100) :][: rng.randrange(200)]
        rows.append((i, part + "".join(rng.choice("ab") for _ in range(rng.randrange(60))) + "x" * rng.choice((0, 70))))
    rows += [(5, None), (None, ""), (None, "a" * 90), (7, base[0]), (7, base[0]), (8, "short"), (9, "short")]
    frame = spark.createDataFrame([(i, t, "s", "k") for i, t in rows], SCHEMA).repartition(6)
    assert got(frame, width=width, shard_bytes=shard_bytes) == brute(rows, width)


def test_edge_of_200_bytes(spark):
    rng = random.Random(1)
    text = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    exact, below = text(200), text(199)
    rows = [(1, text(80) + exact + text(50)), (2, exact), (3, "-" + below + "!"), (4, "+" + below + "?"), (5, text(5000))]
    found = {r[0]: r[2] for r in got(spark.createDataFrame([(i, t, "", "") for i, t in rows], SCHEMA))}
    assert found == {1: ((80, 280),), 2: ((0, 200),), 3: (), 4: (), 5: ()}


def test_very_long_text_over_segments(spark, monkeypatch):
    rng = random.Random(2)
    passage = "".join(rng.choice("abcdefgh") for _ in range(700))
    long = "".join(rng.choice("ijklmnop") for _ in range(1_500_000))
    rows = [(1, long[:1_048_300] + passage + long[1_048_300:] + "z" * 3000), (2, "y" * 150 + passage + "x" * 150)]
    found = {r[0]: r[2] for r in got(spark.createDataFrame([(i, t, "", "") for i, t in rows], SCHEMA))}
    assert found == {1: ((1_048_300, 1_049_000), (1_500_700, 1_503_700)), 2: ((150, 850),)}


def test_digest_columns_and_empty(spark):
    row = S.suffix_dedup(spark.createDataFrame([(1, "ä" * 150, "", "")], SCHEMA)).collect()
    assert [tuple(r) for r in row] == [(1, 300, 300, 1, hashlib.sha256(b"").hexdigest())]
    assert S.suffix_dedup(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(ValueError):
        S.repeated_strings(spark.createDataFrame([], SCHEMA), width=8)
