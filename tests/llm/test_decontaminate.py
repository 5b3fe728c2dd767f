import hashlib
import random
import re

from fjordlake.llm.decontaminate import contamination, find_matches, remove_contaminated

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string"
ITEMS = "item_id long, text string"


def words(s):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), s or ""))


def brute(docs, items, window=10):
    out = {}
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for item_id, item in items:
            t = words(item)
            size = min(window, len(t))
            grams = {tuple(t[i : i + size]) for i in range(len(t) - size + 1)} if t else set()
            for p in range(len(w) - size + 1):
                if size and tuple(w[p : p + size]) in grams:
                    hit.update(range(p, p + size))
                    found.add("null" if item_id is None else str(item_id))
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out[doc_id] = (len(w), len(hit), len(found), digest, bool(hit))
    return out


def cases():
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(12)] + ["é", "ßa"]
    items = [(i, " ".join(r.choices(vocabulary, k=r.choice([0, 1, 3, 9, 10, 11, 30])))) for i in range(25)]
    items += [(3, items[-1][1]), (None, "null item of four"), (77, None), (78, "")]
    docs = []
    for i in range(120):
        w = r.choices(vocabulary + ["zz"], k=r.choice([0, 2, 15, 80]))
        for _ in range(r.randrange(3)):
            t = words(r.choice(items)[1])
            a = r.randrange(len(t) + 1)
            at = r.randrange(len(w) + 1)
            w[at:at] = t[a : a + r.choice([9, 10, 12, 30])]
        docs.append((i, r.choice([" ", ", ", "\n-- "]).join(w).upper() if i % 7 == 0 else " ".join(w)))
    return docs + [(500, None), (501, ""), (502, "!!"), (503, "x " * 60000 + items[-5][1])], items


def test_against_brute_force(spark):
    docs, items = cases()
    want = brute(docs, items)
    got = contamination(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, ITEMS))
    rows = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got.collect()}
    assert rows == want and any(v[4] for v in want.values())


def test_blocks_of_the_benchmark_add_up(spark):
    docs, items = cases()
    d, b = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    one = find_matches(d, b, ["doc_id"]).collect()
    many = find_matches(d, b, ["doc_id"], block_bytes=900).collect()
    pick = lambda rs: {r.doc_id: (r.matches.n_hit, r.matches["items"], r.matches.hit_starts, r.matches.longest) for r in rs}
    assert pick(one) == pick(many)


def test_longest_match_and_removal(spark):
    item = " ".join(f"b{i}" for i in range(40))
    docs = [(1, "a b c " + " ".join(f"b{i}" for i in range(5, 33)) + " z", "x"), (2, "clean text", None), (None, None, "y")]
    d = spark.createDataFrame(docs, "doc_id long, text string, matches string")
    b = spark.createDataFrame([(9, item)], ITEMS)
    m = {r.doc_id: r.matches for r in find_matches(d, b, ["doc_id"]).collect()}
    assert (m[1].longest, m[1].longest_item, m[1].longest_start, m[1].n_hit) == (28, "9", 3, 28)
    assert m[2].longest == 0 and m[2].longest_item is None
    kept = remove_contaminated(d, b)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {2, None}


def test_empty_tables(spark):
    d, b = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    assert contamination(d, b).count() == 0
    full = spark.createDataFrame([(1, "a b")], DOCS)
    row = contamination(full, b).first()
    assert (row.n_words, row.n_hit, row.contaminated) == (2, 0, False)
