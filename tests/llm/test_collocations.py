import random
import re
from collections import Counter

import pytest

from fjordlake.llm import collocations as C

SCHEMA = "doc_id long, text string, lang string, phrase string, n long"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, most, share, top):
    counts, words = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        found = counts.setdefault(lang, Counter())
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(UPPER)):
            w = re.findall("[^\x20\x09]+", piece)
            words[lang] += len(w)
            found.update(" ".join(w[i : i + k]) for k in range(1, most + 1) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        known = {p: a for p, a in f.items() if a >= least and " " in p}
        inner = Counter()
        for q, b in known.items():
            w = q.split(" ")
            for k in range(2, len(w)):
                for i in range(len(w) - k + 1):
                    inner[" ".join(w[i : i + k])] = max(inner[" ".join(w[i : i + k])], b)
        scored = []
        for p, a in known.items():
            if p in inner and 100 * inner[p] >= share * a:
                continue
            w = p.split(" ")
            cuts = [(f[" ".join(w[:k])], f[" ".join(w[k:])], k) for k in range(1, len(w))]
            score, k, left, right = min((1000 * a * words[lang] // (x * y), k, x, y) for x, y, k in cuts)
            scored.append((-score, -a, p.encode(), (p, a, left, right, words[lang], score, k)))
        out += [(lang, i, *x[3]) for i, x in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def texts(seed, n=150):
    rng = random.Random(seed)
    word = ["Alpha", "beta", "Γ", "ämber", "x", "y-z", "d'e", "É"]
    rows = []
    for _ in range(n):
        part = " ".join(rng.choice(word) + rng.choice(("", "", "", ".", ",\t", "!?", "\n", "\x0b", " ")) for _ in range(rng.randrange(30)))
        rows.append((part + rng.choice(("", " In The END of it", "\t in  the end of IT.")), rng.choice(("en", "de", None, "und"))))
    return rows + [(None, "en"), ("", None), ("  \t ", "fr"), ("one", "fr"), ("same same " * 200, "de")] + [("hot Piece here", "en")] * 120


@pytest.mark.parametrize("least,most,share,top", [(5, 5, 100, 2000), (3, 5, 60, 2000), (20, 2, 100, 3), (10, 3, 100, 7), (4, 4, 90, 11)])
def test_against_brute_force(spark, least, most, share, top):
    rows = texts(least)
    frame = spark.createDataFrame([(i, t, x, "p", 1) for i, (t, x) in enumerate(rows)], SCHEMA).repartition(5)
    found = C.collocations(frame, least=least, most_words=most, share=share, top=top)
    assert sorted(map(tuple, found.collect())) == brute(rows, least, most, share, top)


def test_a_full_bitmap_changes_nothing(spark):  # one word of bits: nearly every run is let through
    rows = texts(8)
    frame = spark.createDataFrame([(i, t, x, "p", 1) for i, (t, x) in enumerate(rows)], SCHEMA).repartition(3)
    assert sorted(map(tuple, C.collocations(frame, least=6, bits=6).collect())) == brute(rows, 6, 5, 100, 2000)


def test_scores_beyond_64_bits(spark):
    cases = [(10**12, 10**12 + 7, 10**13 + 9, 10**15 + 1), (3, 7, 11, 13), (10**15, 10**15, 10**15, 10**16 - 1), (100, 10**9, 10**9, 10**15)]
    found = spark.createDataFrame(cases, "a long, l long, r long, n long").select("a", "l", "r", "n", C.cut_score().alias("score"))
    assert [r.score for r in found.collect()] == [1000 * a * n // (x * y) for a, x, y, n in cases]


def test_empty_and_without_candidates(spark):
    assert C.collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    assert C.collocations(spark.createDataFrame([(1, "a b c", "en", "", 1)], SCHEMA)).count() == 0


def test_a_very_long_text(spark):
    rows = [("the same words again and " * 60_000, "en")]
    frame = spark.createDataFrame([(1, rows[0][0], "en", "", 1)], SCHEMA)
    assert sorted(map(tuple, C.collocations(frame).collect())) == brute(rows, 100, 5, 100, 2000)
